"""Spelling variants by a dictionary of pairs of trie nodes.

The words of the corpus, each with its number of occurrences, form two tries: one of the
words and one of the words read backwards. Each node has a whole number, so a place in a
word is a pair of numbers: the node of what is before it and the node of what is after
it. Two words that differ by one replaced code point share the pair around that place;
a word that has one code point more than another shares, with that code point skipped,
the pair of a place of the other where it would be inserted. A pair determines everything
but the one code point, so joining on pairs gives the exact neighbours, each once: of a
run of equal code points only the first is skipped against insertions.

Nodes are numbered in one pass over words in order: a word's nodes are those of the word
before it as far as both agree, and new ones from there. The order is a range shuffle;
the nodes that a partition shares with the one before it are linked by one row for each
partition. No prefix is ever written out, so a word may be of any length.

A pair is shared by no more words than there are letters, and one that inserts there; a
neighbour is counted within the pair, without making rows of two words. A word's form is
its near word of largest count, if that is ``ratio`` times its own; forms are followed to
the last by doubling, and as counts grow at each step there is no circle.

Defined results: a null text has no words, a null id counts as an empty one; repeated rows
count each; of near words with equal counts the first in code-point order is the form;
further columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countinghouse.llm.arrow import list_array, sliced
from countinghouse.session import stored

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5

#: Nodes and words of a partition are numbered within this range.
_RANGE = 1 << 40


def runs(
    docs: DataFrame, least: int = LEAST_LENGTH, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id`` and ``run`` of each maximal run of letters of at least that length, with A-Z in
    lower case. Shorter runs match nowhere, as no part of one is longer."""
    upper = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    text = F.translate(F.col(f"`{text_col}`"), upper, upper.lower())
    found = F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{least},}}"), 0)
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.explode(found).alias("run"))


def counted(words: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """``word`` and its number ``n``, of the words with at least that many."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def _agreeing(one: str, other: str) -> int:
    """How many code points two words begin with in common."""
    most = min(len(one), len(other))
    if one[:most] == other[:most]:
        return most
    low, high = 0, most  # they agree for low, but not for high
    while high - low > 1:
        middle = (low + high) // 2
        if one[low:middle] == other[low:middle]:
            low = middle
        else:
            high = middle
    return low


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the trie nodes of ordered words within a partition.

    ``nodes`` holds a word's nodes from the root to its own; the first word's nodes are
    numbered by their depth. ``place`` is the word's number in order, ``fresh`` says which
    code points differ from the one before.
    """
    part = TaskContext.get().partitionId()
    start = part * _RANGE
    place, free, last, path = start, start, "", np.empty(0, np.int64)
    for batch in batches:
        for piece in sliced(batch, 1_000):
            paths, fresh = [], []
            for word in piece["word"].to_pylist():
                kept = _agreeing(last, word) + 1 if len(path) else 0
                new = len(word) + 1 - kept
                path = np.concatenate([path[:kept], np.arange(free, free + new)])
                free, last = free + new, word
                paths.append(path)
                codes = np.frombuffer(word.encode("utf-32-le"), np.uint32)
                fresh.append(np.concatenate([[True], codes[1:] != codes[:-1]]))
            rows = piece.num_rows
            flags = pa.array(np.concatenate(fresh), pa.bool_())
            ends = np.cumsum([0, *map(len, fresh)])
            yield pa.RecordBatch.from_arrays(
                [
                    *(piece[name] for name in piece.schema.names),
                    pa.array(np.full(rows, part), pa.int32()),
                    pa.array(np.arange(place, place + rows)),
                    list_array(paths, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flags),
                ],
                names=[*piece.schema.names, "part", "place", "nodes", "fresh"],
            )
            place += rows


def numbered(words: DataFrame) -> DataFrame:
    """``words`` with ``place``, ``fresh`` and the trie ``nodes`` of the column ``word``.

    The numbers name the nodes of the whole table: a node that several partitions have is
    named by the first. The driver holds two words a partition.
    """
    kinds = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in words.schema)
    known = stored(
        words.repartitionByRange("word")
        .sortWithinPartitions("word")
        .mapInArrow(
            _nodes, f"{kinds}, part int, place bigint, nodes array<bigint>, fresh array<boolean>"
        ),
        "trie",
    )
    ends = known.groupBy("part").agg(
        F.min("word").alias("first"), F.max("word").alias("last"), F.max_by("nodes", "word").alias("nodes")
    )
    shared, before, path = [], "", []
    for row in sorted(ends.collect(), key=lambda row: row["part"]):
        carried = path[: _agreeing(before, row["first"]) + 1]
        shared.append((row["part"], carried))
        start = row["part"] * _RANGE
        path = [carried[x - start] if x - start < len(carried) else x for x in row["nodes"]]
        before = row["last"]
    links = words.sparkSession.createDataFrame(shared, "linked int, carried array<bigint>")
    start = F.col("part").cast("long") * _RANGE
    own = F.transform(
        "nodes",
        lambda x: F.coalesce(
            F.get("carried", F.least(x - start, F.size("carried").cast("long")).cast("int")), x
        ),
    )
    # One row a partition, whatever the size.
    return known.join(F.broadcast(links), F.col("part") == F.col("linked")).select(
        *words.columns, "place", own.alias("nodes"), "fresh"
    )


def _pairs(before: Column, after: Column, fresh: Column) -> Column:
    """The pairs of a word: one for each code point skipped, one for each gap."""
    length = F.size(fresh)

    def pair(at: Column, skipped: int) -> list[Column]:
        return [
            F.get(before, at).alias("before"),
            F.get(after, length - skipped - at).alias("after"),
            F.lit(bool(skipped)).alias("skips"),
        ]

    skipped = F.transform(
        F.sequence(F.lit(0), length - 1),
        lambda at: F.struct(*pair(at, 1), F.get(fresh, at).alias("counts")),
    )
    gaps = F.transform(
        F.sequence(F.lit(0), length), lambda at: F.struct(*pair(at, 0), F.lit(True).alias("counts"))
    )
    return F.concat(skipped, gaps)


def _neighbours(words: DataFrame, backwards: DataFrame) -> DataFrame:
    """``place``, ``n_near`` and the best near word (``top``: minus its count, its place)."""
    both = words.join(
        backwards.select(F.col("place_of").alias("place"), F.col("nodes").alias("after")), "place"
    )
    pair = F.explode(_pairs(F.col("nodes"), F.col("after"), F.col("fresh"))).alias("pair")
    # The dictionary: a pair's words, those of largest count first.
    member = F.struct((-F.col("n")).alias("less"), "place", "pair.skips", "pair.counts")
    shared = (
        both.select("place", "n", pair)
        .groupBy("pair.before", "pair.after")
        .agg(F.sort_array(F.collect_list(member)).alias("words"))
        .filter(F.size("words") > 1)
        .select("words", F.explode("words").alias("own"))
    )

    def near(other: Column) -> Column:
        own = F.col("own")
        differ = other["place"] != own["place"]
        return differ & (
            (own["skips"] & other["skips"])
            | (own["skips"] & own["counts"] & ~other["skips"])
            | (~own["skips"] & other["skips"] & other["counts"])
        )

    found = shared.select("own.place", F.filter("words", near).alias("near")).filter(
        F.size("near") > 0
    )
    best = F.get("near", F.lit(0))
    return found.groupBy("place").agg(
        F.sum(F.size("near")).alias("n_near"),
        F.min(F.struct(best["less"].alias("less"), best["place"].alias("place"))).alias("top"),
    )


def _last_forms(forms: DataFrame) -> DataFrame:
    """``place`` and ``root``, the end of the chain of ``form`` from each place that has one."""
    now = forms.select("place", F.col("form").alias("root"))
    while True:
        further = now.select(F.col("place").alias("via"), F.col("root").alias("next"))
        then = stored(
            now.join(further, F.col("root") == F.col("via"), "left").select(
                "place", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
            ),
            "roots",
        )
        now = then.select("place", "root")
        if then.filter("moved").isEmpty():
            return now


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of each word.

    ``words`` has the distinct ``word``, none empty, and its count ``n``.
    """
    known = stored(numbered(words.select("word", "n")), "words")
    reversed_ = known.select(F.col("place").alias("place_of"), F.reverse("word").alias("word"))
    backwards = numbered(reversed_)
    near = stored(_neighbours(known, backwards), "near-words")
    plain = known.select("place", "word", "n")
    chosen = near.join(plain, "place").select(
        "place",
        "n_near",
        F.when(-F.col("top.less") >= ratio * F.col("n"), F.col("top.place")).alias("form"),
        F.when(-F.col("top.less") >= ratio * F.col("n"), -F.col("top.less")).alias("form_n"),
    )
    chosen = stored(chosen, "forms")
    roots = _last_forms(chosen.filter("form is not null"))

    def named(place: str, word: str) -> DataFrame:
        return plain.select(F.col("place").alias(place), F.col("word").alias(word))

    ends = (
        chosen.filter("form is not null").join(roots, "place")
        .join(named("form", "form_word"), "form")
        .join(named("root", "root_word"), "root")
        .select("place", "form_word", "root_word", "form_n")
    )
    return (
        plain.join(near.select("place", "n_near"), "place", "left")
        .join(ends, "place", "left")
        .select(
            "word",
            F.col("form_word").alias("form"),
            F.coalesce("root_word", "word").alias("root"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            "form_n",
        )
    )
