"""Removal of lines that many sites share, with built-in functions only.

A line (trimmed of blanks, in lower case, not empty) is known by its hash. One
HyperLogLog sketch of the sites per hash, merged by aggregation, tells how many
distinct sites have it, and a second one in how many kinds of company it stands. Lines
of which one estimate is near the limit are counted exactly. Lines on more than
``max_sites`` sites and in more than as many kinds of company are removed from every
document that has any other line; one without is itself what the sites share, and would
only be lost.

A line's company in a document is the other line with the least MD5, by each quarter of
the MD5; the quarter with most kinds counts. Company tells the two reasons apart for which
a line is on many sites: boilerplate stands in documents that share little else, while the
lines of a copied document bring their company along, even if some other lines of the copy
were changed. Copies are left to near-duplicate removal.

Defined results: a null text stays null, an empty one empty; a null site is no site, a
line that is alone in its document has no company there; equal rows get equal texts; an empty table stays empty; other columns are kept as
they are, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countinghouse.session import stored

MAX_SITES = 10
#: Logarithm of the number of registers: 1.6 % standard error.
LOG_REGISTERS = 12
#: Estimates this close to the limit are settled by an exact count: six standard errors.
NEAR = 0.1


#: Columns of a line's company, one for each quarter of an MD5.
COMPANY = tuple(f"company_{n}" for n in range(4))


def _normal(line: Column) -> Column:
    return F.lower(F.trim(line))


def line_key(line: Column) -> Column:
    return F.xxhash64(_normal(line))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _has_content(line: Column) -> Column:
    return F.trim(line) != ""


def spread_lines(lines: DataFrame, max_sites: int = MAX_SITES) -> DataFrame:
    """``line`` of each key that more than ``max_sites`` distinct sites have, in more than as
    many kinds of company.

    ``lines`` has the columns ``line``, ``site`` and ``COMPANY``; nulls don't count.
    """
    sketches = lines.groupBy("line").agg(
        *(
            F.hll_sketch_estimate(F.hll_sketch_agg(kind, F.lit(LOG_REGISTERS))).alias(kind)
            for kind in ("site", *COMPANY)
        )
    )
    fewer = F.least("site", F.greatest(*COMPANY))
    least, most = max_sites * (1 - NEAR) - 1, max_sites * (1 + NEAR) + 1
    known = stored(
        sketches.filter(fewer >= least).select("line", (fewer > most).alias("sure")), "spread"
    )
    unsure = lines.join(known.filter("not sure").select("line"), "line", "left_semi")

    def above(kind: str) -> DataFrame:
        return (
            unsure.filter(F.col(kind).isNotNull())
            .groupBy("line", kind)
            .agg(F.count(F.lit(1)).alias("rows"))
            .groupBy("line")
            .agg(F.count(F.lit(1)).alias("kinds"))
            .filter(F.col("kinds") > max_sites)
            .select("line")
        )

    mixed = reduce(DataFrame.unionByName, map(above, COMPANY))
    exact = above("site").join(mixed, "line", "left_semi")
    return known.filter("sure").select("line").unionByName(exact)


def remove_spread_lines(
    docs: DataFrame,
    max_sites: int = MAX_SITES,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    removed_col: str | None = None,
) -> DataFrame:
    """``docs`` without the lines that more than ``max_sites`` sites have.

    ``removed_col`` names a further column for the number of lines removed.
    """
    text = F.col(f"`{text_col}`")
    marked = F.transform(
        F.filter(_lines(text), _has_content),
        lambda line: F.struct(line_key(line).alias("line"), F.md5(_normal(line)).alias("mark")),
    )

    def quarter(mark: Column, n: int) -> Column:
        return F.substring(mark, 1 + 8 * n, 8)

    def two_least(n: int) -> Column:
        marks = F.transform("contents", lambda x: quarter(x["mark"], n))
        return F.slice(F.array_sort(F.array_distinct(marks)), 1, 2)

    def company(n: int) -> Column:
        first, second = (F.get(f"least_{n}", F.lit(k)) for k in range(2))
        other = F.when(quarter(F.col("content.mark"), n) == first, second).otherwise(first)
        return F.conv(other, 16, 10).cast("bigint").alias(COMPANY[n])

    count = range(len(COMPANY))
    lines = stored(
        docs.select(
            F.col(f"`{id_col}`").alias("id"),
            F.xxhash64(text).alias("digest"),
            F.col(f"`{site_col}`").alias("site"),
            marked.alias("contents"),
        )
        .select("*", *(two_least(n).alias(f"least_{n}") for n in count))
        .select(
            "id", "digest", "site", *(f"least_{n}" for n in count),
            F.explode("contents").alias("content"),
        )
        .select("id", "digest", "site", "content.line", *map(company, count)),
        "lines",
    )
    spread = stored(spread_lines(lines, max_sites), "spread-lines")
    # Equal rows have equal lines.
    boilerplate = stored(
        lines.join(spread, "line")
        .groupBy("id", "digest")
        .agg(F.collect_set("line").alias("spread")),
        "boilerplate",
    )
    given = F.col(f"d.`{text_col}`")
    kept = F.filter(
        _lines(given),
        lambda line: ~(_has_content(line) & F.array_contains(F.col("b.spread"), line_key(line))),
    )
    changed = F.col("b.spread").isNotNull() & F.exists(kept, _has_content)
    # The list grows with the documents, so it is never broadcast, at no size.
    joined = docs.alias("d").join(
        boilerplate.alias("b").hint("merge"),
        F.col(f"d.`{id_col}`").eqNullSafe(F.col("b.id"))
        & (F.xxhash64(given) == F.col("b.digest")),
        "left",
    )
    columns = [
        F.when(changed, F.array_join(kept, "\n")).otherwise(given).alias(text_col)
        if name == text_col
        else F.col(f"d.`{name}`")
        for name in docs.columns
    ]
    if removed_col:
        removed = F.size(_lines(given)) - F.size(kept)
        columns.append(F.when(changed, removed).otherwise(0).cast("long").alias(removed_col))
    return joined.select(*columns)
