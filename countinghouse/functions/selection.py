"""Rows at given places of an order, found by narrowing instead of sorting.

The value at a place is enclosed by the quantiles of a KLL sketch, which merges from task
to task; an exact count of the rows below and inside proves the enclosure, and the next
sketch looks inside it only. Each round is one aggregation for all places that are asked
for. When few rows are left their values are counted one by one. Nothing is sorted or
shuffled, and a value that any number of rows share ends the search for its places.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a sketch, more than its error in rank, and the quantiles taken from it.
SKETCH_SIZE, MARGIN, GRID = 400, 0.02, 256
#: Rows whose values are counted on the driver.
FEW = 20_000


@dataclass
class Sought:
    """The place asked for (from 1) among the rows where ``within`` holds.

    ``outer`` encloses its value for certain, ``low`` and ``high`` are what is measured next,
    always less than that, so each round leaves fewer values.
    """

    value: Column
    within: Column
    place: int
    low: int | None = None
    high: int | None = None
    outer: tuple[int | None, int | None] = (None, None)
    #: Once it is known: the value, and how many rows have smaller ones.
    found: int | None = None
    below: int = 0

    def inside(self) -> Column:
        chosen = self.within
        if self.low is not None:
            chosen &= (self.value >= self.low) & (self.value <= self.high)
        return chosen

    def smaller(self) -> Column:
        return self.within & (self.value < self.low) if self.low is not None else F.lit(False)


def find(rows: DataFrame, sought: Sequence[Sought], total: int | None = None) -> None:
    """Fill in ``found`` and ``below`` of each; values are longs without nulls, and ``rows``,
    read once a round, is stored. ``total`` is the number of rows, where it is known."""
    open_ = list(sought)
    if not open_:
        return
    if total is not None and total <= FEW:  # nothing to narrow
        _count_values(rows, open_)
        if any(x.found is None for x in open_):
            raise ValueError(f"places beyond {total} rows")
        return
    while open_:
        measured = rows.agg(
            *(
                column
                for n, x in enumerate(open_)
                for column in (
                    F.count_if(x.smaller()).alias(f"below_{n}"),
                    F.count_if(x.inside()).alias(f"inside_{n}"),
                    F.min(F.when(x.inside(), x.value)).alias(f"least_{n}"),
                    F.max(F.when(x.inside(), x.value)).alias(f"most_{n}"),
                    _sketch(x).alias(f"sketch_{n}"),
                )
            )
        )
        grid = F.lit([n / GRID for n in range(GRID + 1)])
        seen = measured.select(
            "*",
            *(
                F.when(
                    F.col(f"inside_{n}") > 0,
                    F.kll_sketch_get_quantile_bigint(f"sketch_{n}", grid),
                ).alias(f"values_{n}")
                for n in range(len(open_))
            ),
        ).drop(*(f"sketch_{n}" for n in range(len(open_)))).first()
        few = []
        for n, x in enumerate(open_):
            below, inside = seen[f"below_{n}"], seen[f"inside_{n}"]
            least, most = seen[f"least_{n}"], seen[f"most_{n}"]
            if x.place <= below:
                x.high, x.low = x.low - 1, x.outer[0]
            elif x.place > below + inside:
                if x.low is None:
                    raise ValueError(f"place {x.place} of {inside} rows")
                x.low, x.high = x.high + 1, x.outer[1]
            elif least == most:
                x.found, x.below = least, below
            elif inside <= FEW:
                x.below = below
                few.append(x)
            else:
                values, share = seen[f"values_{n}"], (x.place - below) / inside
                x.outer = least, most
                low, high = floor((share - MARGIN) * GRID), ceil((share + MARGIN) * GRID)
                x.low = max(least, values[min(max(low, 0), GRID)])
                x.high = min(most, values[min(max(high, 0), GRID)])
                if (x.low, x.high) == x.outer:  # few values: cut between two of them
                    x.high = min(values[round(share * GRID)], most - 1)
        if few:
            _count_values(rows, few)
        open_ = [x for x in open_ if x.found is None]


def _sketch(x: Sought) -> Column:
    return F.kll_sketch_agg_bigint(F.when(x.inside(), x.value), SKETCH_SIZE)


def _count_values(rows: DataFrame, few: list[Sought]) -> None:
    """At most ``FEW`` rows each, so at most as many values; places in the same rows share."""
    shared: dict[tuple, list[Sought]] = {}
    for x in few:
        shared.setdefault((str(x.value), str(x.within), x.low, x.high), []).append(x)
    groups = list(shared.values())
    tagged = rows.select(
        F.explode(
            F.array_compact(
                F.array(
                    *(
                        F.when(
                            group[0].inside(),
                            F.struct(F.lit(n).alias("n"), group[0].value.alias("value")),
                        )
                        for n, group in enumerate(groups)
                    )
                )
            )
        ).alias("hit")
    )
    counted: list[list] = [[] for _ in groups]
    for row in tagged.groupBy("hit.n", "hit.value").count().collect():
        counted[row["n"]].append((row["value"], row["count"]))
    for group, values in zip(groups, counted):
        values.sort()
        for x in group:
            for value, count in values:
                if x.below + count >= x.place:
                    x.found = value
                    break
                x.below += count


def cuts(
    rows: DataFrame, keys: dict[str, Column], tie: str, places: list[int], total: int | None = None
) -> dict:
    """For each key the (key, tie) of the rows at the given places of its order."""
    first = {
        (name, place): Sought(key, F.lit(True), place)
        for name, key in keys.items()
        for place in places
    }
    find(rows, list(first.values()), total)
    second = {
        at: Sought(F.col(tie), keys[at[0]] == x.found, at[1] - x.below) for at, x in first.items()
    }
    find(rows, list(second.values()), total)
    return {
        name: [(first[name, place].found, second[name, place].found) for place in places]
        for name in keys
    }


def tile_ends(count: int, tiles: int) -> list[int]:
    """The last place of each NTILE bucket but the last; the first are larger by one."""
    size, extra = divmod(count, tiles)
    return [n * size + min(n, extra) for n in range(1, tiles)] if count else []


def tile_of(key: Column, tie: str, ends: list[tuple[int, int]]) -> Column:
    """The NTILE bucket of a row, from the rows that end the buckets."""
    beyond = [
        ((key > last) | ((key == last) & (F.col(tie) > own))).cast("int") for last, own in ends
    ]
    return sum(beyond, F.lit(1))
