"""Files as relations."""
