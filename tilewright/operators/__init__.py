"""Operations on tables, places, rasters and links."""
