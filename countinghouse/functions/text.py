"""String normalisation used by the cleaning layer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NOT_WORD = r"([^\p{L}\p{N}])"
_BREAK = "\u0001 "


def title_words(text: Column) -> Column:
    """Capitalise the first letter after every non-alphanumeric character.

    Spark's ``initcap`` starts words at spaces only, so a removable break is
    put behind each separator first. Letters after digits stay lower case.
    """
    broken = F.regexp_replace(text, _NOT_WORD, f"$1{_BREAK}")
    return F.regexp_replace(F.initcap(broken), _BREAK, "")


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def tidy_name(text: Column) -> Column:
    return title_words(F.trim(text))


def tidy_optional_name(text: Column) -> Column:
    return title_words(blank_to_null(text))
