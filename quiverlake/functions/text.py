"""The default tokenizer as a Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LONGEST = 128


def uncut_tokens(text: Column | str) -> Column:
    """As tokens(), but of any length: as many, and the same but for long ones."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(r"([a-z0-9\x{80}-\x{10FFFF}]+)"), F.lit(1))


def cut(token: Column) -> Column:
    return F.when(F.octet_length(token) > LONGEST, F.decode(F.substring(F.encode(token, "UTF-8"), 1, LONGEST), "UTF-8")).otherwise(token)


def tokens(text: Column | str, stopwords: list[str] | None = None) -> Column:
    """Runs of ASCII letters and digits and anything beyond ASCII, A-Z lower-cased, cut at LONGEST bytes; null has none."""
    short = F.transform(uncut_tokens(text), cut)
    return F.filter(short, lambda t: ~t.isin(stopwords)) if stopwords else short
