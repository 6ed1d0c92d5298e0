"""Names, key=value lines, correspondence lines and scored replies as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strip_bom(c: Column) -> Column:
    return F.regexp_replace(c, "^﻿", "")


def number_or_null(column: str) -> Column:
    """A text column to double: empty, 'nan' in any case, or no number at all is NULL."""
    v = F.expr(f"try_cast(trim(`{column}`) as double)")
    return F.when(~F.isnan(v), v)


def key_values(lines: DataFrame, column: str = "value", keep_empty_keys: bool = False) -> DataFrame:
    """key, value of each line with an equals sign; only the first sign splits."""
    line = strip_bom(F.col(column))
    out = lines.where(F.contains(F.col(column), F.lit("="))).select(F.trim(F.substring_index(line, "=", 1)).alias("key"), F.trim(F.expr(f"substring({column}, instr({column}, '=') + 1)")).alias("value"))
    return out if keep_empty_keys else out.where(F.col("key") != "")


def placed_name(c: Column) -> tuple[Column, Column, Column]:
    """fov, x, y of a name like `a_x12_y7`; NULLs where the name is of another kind."""
    pattern = r"^(.*)_x(\d+)_y(\d+)$"
    hit = F.rlike(c, F.lit(pattern))
    return tuple(F.when(hit, F.regexp_extract(c, pattern, i).cast(kind)) for i, kind in ((1, "string"), (2, "int"), (3, "int")))


def tile_name(c: Column) -> tuple[Column, Column]:
    """y, x of a tile id like `y256_x512`."""
    return tuple(F.regexp_extract(c, r"^y(\d+)_x(\d+)$", i).cast("int") for i in (1, 2))


def well_order(c: Column) -> list[Column]:
    """Sort keys of a well like `12B`: the number, then the letter."""
    return [F.regexp_extract(c, r"^(\d+)", 1).cast("int"), F.right(c, F.lit(1))]


def correspondence(lines: DataFrame, column: str = "value") -> DataFrame:
    """n, status, files: one row per number of a line `1、2：a.tif、b.tif（note）`.

    status: linked (with its files, repeats dropped, order kept), unmatched (numbers but no file). Lines without a number
    before a colon are left to `not_understood`.
    """
    parts = F.split(F.col(column), "[：:]", 2)
    numbers = F.regexp_extract_all(parts[0], F.lit(r"(\d+)"), 1)
    files = F.array_distinct(F.filter(F.transform(F.split(parts[1], "[、,，]"), lambda p: F.regexp_extract(p, r"([^、,，：:（(]*?\.tif)", 1)), lambda p: p != ""))
    files = F.transform(files, F.trim)
    read = lines.where(F.size(parts) == 2).where(F.size(numbers) > 0).select(numbers.alias("numbers"), files.alias("files"))
    return read.select(F.explode(F.transform("numbers", lambda v: v.cast("int"))).alias("n"), F.when(F.size("files") > 0, "linked").otherwise("unmatched").alias("status"), "files")


def not_understood(lines: DataFrame, column: str = "value") -> DataFrame:
    parts = F.split(F.col(column), "[：:]", 2)
    return lines.where((F.size(parts) < 2) | (F.size(F.regexp_extract_all(parts[0], F.lit(r"(\d+)"), 1)) == 0))


def scored_reply(replies: DataFrame, key: str, reply: str, names: list[str]) -> DataFrame:
    """key, one column per name (0 where the reply has none), n_parsed: `1. solid: 3` counts, `mitoses: x` does not."""
    lines = replies.select(key, F.posexplode(F.split(F.col(reply), "\n")).alias("at", "line")).where(F.contains("line", F.lit(":")))
    name = F.lower(F.trim(F.regexp_replace(F.substring_index("line", ":", 1), r"^[\s\d.*#\-)_]+|[*_`\s]+$", "")))
    score = F.expr("try_cast(split(trim(substring(line, instr(line, ':') + 1)), '[\\\\s]+')[0] as double)")
    hits = lines.select(key, "at", name.alias("name"), score.alias("score")).where(F.col("score").isNotNull() & F.col("name").isin(names))
    got = hits.groupBy(key).agg(*[F.max_by(F.when(F.col("name") == n, F.col("score")), F.when(F.col("name") == n, F.col("at"))).alias(n) for n in names], F.count_distinct("name").alias("n_parsed"))
    full = replies.select(key).distinct().join(got, key, "left")
    return full.select(key, *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names], F.coalesce("n_parsed", F.lit(0)).alias("n_parsed"))


def html_escape(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c
