"""Word columns from built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: the white space that ends a word
SPACE = r"[\x20\x09-\x0D]"
_SPACES = " \t\n\x0b\x0c\r"


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACES))


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none of a null one."""
    bare = stripped(F.coalesce(text, F.lit("")))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE + "+"))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")
