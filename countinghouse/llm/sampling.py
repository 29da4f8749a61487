"""Bounded samples that depend on the rows only, not on how they are dealt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countinghouse.session import stored

_PARTS = 1 << 40
#: Rows let through by the hash for each row wanted.
_SPARE = 1.2


def smallest_hashes(rows: DataFrame, limit: int) -> DataFrame:
    """The distinct values of the column ``id`` with the smallest hashes, ``limit`` at most.

    A bound on the hash, from the number of rows, lets few more through than are wanted,
    so that no task or driver sees all of them.
    """
    total = rows.count()
    if total > _SPARE * limit:
        bound = int(_PARTS * _SPARE * limit / total)
        rows = rows.filter(F.pmod(F.xxhash64("id"), F.lit(_PARTS)) < bound)
    order = F.pmod(F.xxhash64("id"), F.lit(_PARTS))
    return stored(rows.select("id").distinct().orderBy(order, "id").limit(limit), "sample")
