"""Words as the operators of this package see them: runs of anything but ASCII white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[ \t-\r]"


def words(text: Column) -> Column:
    """Array of the words of a text (null text: empty array)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def n_words(text: Column) -> Column:
    """Number of words, without building them: starts of runs."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t-\r]++")).cast("long")
