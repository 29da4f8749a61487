"""Exact top-k search by inner product, in three phases with a uniform threshold.

The components are dealt over ``lists`` score lists: a list holds each vector's
partial score. Queries and candidates come in blocks; a pair of blocks is a tile, and
a tile is a task's work.

1. Each tile works out its lists and gathers the best entries of each, ``KEPT`` of them,
   with the k best totals among them and the highest partial score that each list left
   out. The k-th best total among a query's entries is a safe cutoff: the k best totals
   are at least as high.
2. The cutoff goes back with the query. A total that reaches it has a partial score of
   at least cutoff / lists, the uniform threshold, in some list. A tile whose lists left
   out no such entry, or none that could add up to the cutoff, has given sufficient
   entries and isn't worked out again. Only the other tiles, and of their queries only
   those concerned, collect all entries that reach the threshold.
3. The totals of these are worked out exactly, and the k best of each tile that reach
   the cutoff are merged by query with what the sufficient tiles gathered.

A query moves k rows from a tile, however many near copies reach its threshold.

Defined results: vectors that are null, empty, or hold null or non-finite components,
and rows with a null id take no part; all rows with a query's id are its own; a
repeated query counts once, a repeated candidate each time; of vectors of different
lengths the common components count; further columns are left out. Scores are 64-bit
integers; vectors so long that a score might not fit fail with OverflowError.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from countinghouse.llm.arrow import lists as lists_of
from countinghouse.session import stored

LISTS = 2
QUERY_BLOCK = 4_096
CANDIDATE_BLOCK = 4_096
#: Queries whose scores a task holds at once.
STRIP = 128
#: Entries of a list that a tile looks through for a query before there is a cutoff.
KEPT = 64
FOUND = "query_id bigint, vec_id bigint, score bigint"
#: ``rest`` and ``rests``: the highest partial score that the lists of the tile left out, and
#: the sum of all lists' highest; null where nothing is left out.
GATHERED = f"{FOUND}, query_block int, candidate_block int, rest bigint, rests bigint"


def scaled(vectors: DataFrame, factor: int, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and the integer vector of the rows that take part."""
    vector = F.col(f"`{vector_col}`")
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return vectors.filter(
        F.col(f"`{id_col}`").isNotNull() & vector.isNotNull() & (F.size(vector) > 0) & finite
    ).select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * factor)).alias("vector"),
    )


def in_blocks(vectors: DataFrame, name: str, count: int, size: int) -> tuple[DataFrame, int]:
    """The vectors with the number of their block, and the number of blocks."""
    blocks = max(1, ceil(count / size))
    # By the vector too: rows that share an id needn't share a block.
    block = F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)).cast("int")
    return vectors.withColumn(name, block), blocks


def tiles(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """The rows of each tile: those that ask and those that are given, sent as rows of the two
    blocks, never as pairs of rows."""
    tile = ("query_block", "candidate_block")
    asked = queries.select("id", "vector", "cutoff", F.lit(True).alias("asks"), *tile)
    given = candidates.select(
        "id", "vector", F.lit(None).cast("long").alias("cutoff"), F.lit(False).alias("asks"), *tile
    )
    return asked.unionByName(given)


def _every(name: str, blocks: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias(name)


def _matrix(vectors: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for row, vector in enumerate(vectors):
        out[row, : len(vector)] = vector
    return out


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point where every sum is below 2**53."""
    bound = int(np.abs(left).max(initial=0)) * int(np.abs(right).max(initial=0)) * left.shape[1]
    if bound < 1 << 53:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    longest = np.abs(left).astype(np.float64).sum(axis=1).max(initial=0)
    # Both halves of a sum must fit together.
    if longest * float(np.abs(right).max(initial=0)) >= 1 << 62:
        raise OverflowError("a score may need more than 64 bits")
    return left @ right.T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > least)
        ties = np.flatnonzero(scores == least)
        if len(ties) > k - len(above):
            smallest = np.argpartition(ids[ties], k - len(above) - 1)[: k - len(above)]
            ties = ties[smallest]
        return np.concatenate([above, ties])
    return np.arange(len(scores))


def _gather(
    scores: list[np.ndarray], known: np.ndarray, others: np.ndarray, k: int, kept: int
):
    """Phase 1: the k best totals among the best entries of the lists, and what they left out."""
    left = np.flatnonzero(others)
    out = np.ones((len(scores), len(left)), bool)
    for missed, part in zip(out, scores):
        missed[_best(part[left], known[left], max(k, kept))] = False
    found = left[~out.all(axis=0)]
    totals = sum(part[found] for part in scores)
    chosen = _best(totals, known[found], k)
    rest = rests = None
    if out.all(axis=0).any():
        highest = [int(part[left][missed].max()) for part, missed in zip(scores, out)]
        rest, rests = max(highest), sum(highest)
    return found[chosen], totals[chosen], rest, rests


def _collect(
    scores: list[np.ndarray], known: np.ndarray, others: np.ndarray, k: int, cutoff: int
):
    """Phases 2 and 3: of the entries that reach the uniform threshold in a list, the k best
    totals that reach the cutoff."""
    uniform = -(-cutoff // len(scores))
    reached = scores[0] >= uniform
    for more in scores[1:]:
        reached |= more >= uniform
    found = np.flatnonzero(reached & others)
    totals = sum(part[found] for part in scores)
    found, totals = found[totals >= cutoff], totals[totals >= cutoff]
    chosen = _best(totals, known[found], k)
    return found[chosen], totals[chosen], None, None


def _tile(k: int, parts: int, kept: int, query_block: str, candidate_block: str):
    """Gathers for queries without a cutoff, collects for those with one."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        tile = table[query_block][0].as_py(), table[candidate_block][0].as_py()
        asks = table["asks"].combine_chunks().to_numpy(zero_copy_only=False)
        ids = table["id"].combine_chunks().to_numpy()
        vectors = lists_of(table["vector"].combine_chunks())
        width = max(map(len, vectors))
        asked, given = np.flatnonzero(asks), np.flatnonzero(~asks)
        order = given[np.argsort(ids[given], kind="stable")]
        candidates, known = _matrix([vectors[n] for n in order], width), ids[order]
        cutoffs = table["cutoff"].combine_chunks().to_pylist()
        slices = np.array_split(np.arange(width), parts)
        pieces = [np.ascontiguousarray(candidates[:, part]) for part in slices]
        out: list[list] = [[] for _ in range(5)]
        for start in range(0, len(asked), STRIP):
            strip = asked[start : start + STRIP]
            queries = _matrix([vectors[n] for n in strip], width)
            partial = [_products(queries[:, part], piece) for part, piece in zip(slices, pieces)]
            for row, n in enumerate(strip):
                others = known != ids[n]
                scores = [part[row] for part in partial]
                if cutoffs[n] is None:
                    found, totals, rest, rests = _gather(scores, known, others, k, kept)
                else:
                    found, totals, rest, rests = _collect(scores, known, others, k, cutoffs[n])
                out[0].append(np.full(len(found), ids[n]))
                out[1].append(known[found])
                out[2].append(totals)
                out[3] += [rest] * len(found)
                out[4] += [rests] * len(found)
        rows = len(out[3])
        numbers = [np.concatenate(x) if x else np.empty(0, np.int64) for x in out[:3]]
        columns = [pa.array(x.astype(np.int64), pa.int64()) for x in numbers]
        columns += [pa.array(np.full(rows, block), pa.int32()) for block in tile]
        columns += [pa.array(x, pa.int64()) for x in out[3:]]
        names = "query_id vec_id score query_block candidate_block rest rests".split()
        return pa.table(dict(zip(names, columns)))

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    factor: int = 256,
    parts: int = LISTS,
    kept: int = KEPT,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of the k highest inner
    products of each query with the other rows, where a component x counts as
    floor(factor * x)."""
    # Of equal rows no query needs more than k: a hot row stays small in its block.
    candidates = stored(
        scaled(vectors, factor, id_col, vector_col)
        .groupBy("id", "vector")
        .agg(F.count(F.lit(1)).alias("copies"))
        .select("id", "vector", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)))))
        .drop("col"),
        "candidates",
    )
    queries = stored(
        scaled(vectors.filter(is_query), factor, id_col, vector_col)
        .groupBy("id")
        .agg(F.min("vector").alias("vector")),
        "queries",
    )
    given, given_blocks = in_blocks(
        candidates, "candidate_block", candidates.count(), CANDIDATE_BLOCK
    )
    asked, asked_blocks = in_blocks(queries, "query_block", queries.count(), QUERY_BLOCK)
    tile = ("query_block", "candidate_block")
    work = _tile(k, parts, kept, *tile)
    gathered = stored(
        tiles(
            asked.select("*", F.lit(None).cast("long").alias("cutoff"), _every(tile[1], given_blocks)),
            given.select("*", _every(tile[0], asked_blocks)),
        )
        .groupBy(*tile)
        .applyInArrow(work, GATHERED),
        "gathered",
    )
    # A query with fewer than k entries has so few candidates that all of them are listed;
    # its cutoff is the lowest total.
    cutoffs = _ranked(gathered, k).groupBy("query_id").agg(F.min("score").alias("cutoff"))
    open_ = stored(insufficient(gathered, cutoffs, parts), "open")
    again = tiles(
        open_.join(queries, F.col("query_id") == F.col("id")),
        given.join(open_.select(*tile).distinct(), "candidate_block"),
    )
    found = again.groupBy(*tile).applyInArrow(work, GATHERED).select("query_id", "vec_id", "score")
    sufficient = gathered.join(open_, ["query_id", "candidate_block"], "left_anti").select(
        "query_id", "vec_id", "score"
    )
    return _ranked(sufficient.unionByName(found), k).select(
        "query_id", F.col("rank").cast("int"), "vec_id", "score"
    )


def insufficient(gathered: DataFrame, cutoffs: DataFrame, parts: int) -> DataFrame:
    """The queries with their ``cutoff`` and the tiles that left out what may reach it: an entry
    at the uniform threshold, and highest entries that add up to the cutoff."""
    tile = ("query_id", "query_block", "candidate_block")
    left = gathered.groupBy(*tile).agg(F.max("rest").alias("rest"), F.max("rests").alias("rests"))
    # rest >= ceil(cutoff / parts), without a quotient or an overflow.
    uniform = F.col("rest").cast("decimal(20,0)") * parts >= F.col("cutoff")
    reaches = uniform & (F.col("rests") >= F.col("cutoff"))
    return left.join(cutoffs, "query_id").filter(reaches).select(*tile, "cutoff")
