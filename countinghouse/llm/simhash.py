"""Near-duplicates by SimHash, with candidates from pigeonring filtering.

A fingerprint of 64 bits is seen as a ring of ``distance + 1`` segments. If two
fingerprints differ in at most ``distance`` bits, some segment starts a chain in
which the first l segments together differ in at most l - 1 bits, for every l. So
the first segment of the chain is equal and the second differs in one bit at most:
each distinct fingerprint is filed 64 times, once for each bit, under the segment
before that bit's and the bit's own segment without that bit. Two fingerprints
that share a place are candidates; longer chains are checked next, and the whole
chain is the Hamming distance.

Copies are one fingerprint. In a place, each fingerprint is first compared with its
neighbour in order and with the smallest one only. What that connects need not be
compared again: only places that still hold several components are gone through,
and there no two members of the largest component meet.

Defined results: a null or empty text has fingerprint zero and is linked like any
other; equal rows are in one component; a null id is ignored in the smallest id
unless a component has no other; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from countinghouse.llm.arrow import bytes_of, sliced, unused
from countinghouse.llm.components import components
from countinghouse.session import stored

BITS = 64
#: Spark's and the contract's seed.
SEED = 42
#: Shingles whose bits are counted at once.
COUNTED = 65_536


def fingerprint(text: bytes, words: int) -> int:
    """SimHash over the hashes of all shingles of ``words`` words, as a signed integer."""
    found = text.lower().split()  # bytes: A-Z and the six ASCII white spaces only
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(words, len(found))
    hashed = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    total = len(found) - width + 1
    for at in range(0, total, COUNTED):
        stop = min(total, at + COUNTED)
        spans = zip(starts[at:stop].tolist(), ends[at + width - 1 : stop + width - 1].tolist())
        hashes = np.fromiter((hashed(joined[a:b], SEED) for a, b in spans), ">u8", stop - at)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(counts * 2 > total)
    return int(packed.view(">i8")[0])


def fingerprints(
    docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id`` and ``fingerprint`` (long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, 1_000):
                marks = [fingerprint(text.as_py(), words) for text in part["text"]]
                yield pa.RecordBatch.from_arrays(
                    [part["id"], pa.array(marks, pa.int64())], names=["id", "fingerprint"]
                )

    given = bytes_of(docs, id_col, text_col)
    return given.mapInArrow(
        run, f"id {given.schema['id'].dataType.simpleString()}, fingerprint bigint"
    )


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


class Ring:
    """The segments of a fingerprint for a greatest distance."""

    def __init__(self, distance: int):
        if distance < 1:
            raise ValueError("the distance is at least one bit")
        self.distance, self.segments = distance, distance + 1
        bounds = [BITS * n // self.segments for n in range(self.segments + 1)]
        self.masks = [
            sum(1 << bit for bit in range(a, b)) for a, b in zip(bounds, bounds[1:])
        ]
        #: For each bit, the segment before the bit's own: there its chain starts.
        self.starts = [
            (n - 1) % self.segments
            for n, (a, b) in enumerate(zip(bounds, bounds[1:]))
            for _ in range(a, b)
        ]

    def places(self, mark: Column) -> Column:
        """The 64 places of a fingerprint."""
        return F.array(
            *(
                F.struct(
                    F.lit(bit).alias("slot"),
                    mark.bitwiseAND(
                        F.lit(
                            _signed(
                                (self.masks[start] | self.masks[(start + 1) % self.segments])
                                & ~(1 << bit)
                            )
                        )
                    ).alias("part"),
                )
                for bit, start in enumerate(self.starts)
            )
        )

    def linked(self, one: Column, other: Column, slot: Column) -> Column:
        """Whether every longer chain from the slot's start, and so the whole, is in budget."""
        differ = one.bitwiseXOR(other)
        within = F.lit(True)
        for length in range(3, self.segments + 1):
            chains = [
                _signed(sum(self.masks[(start + n) % self.segments] for n in range(length)))
                for start in self.starts
            ]
            mask = F.element_at(F.lit(chains).cast("array<bigint>"), slot + 1)
            within &= F.bit_count(differ.bitwiseAND(mask)) <= length - 1
        return within & (F.bit_count(differ) <= self.distance)


def links(marks: DataFrame, distance: int) -> DataFrame:
    """``node`` and ``label`` of each distinct ``fingerprint`` that is linked with another."""
    ring = Ring(distance)
    # 64 rows come of each: dealt out first, or a few files would make all of them.
    partitions = int(marks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    filed = marks.repartition(partitions, "fingerprint").select(
        F.col("fingerprint"), F.explode(ring.places(F.col("fingerprint"))).alias("place")
    ).select("place.slot", "place.part", "fingerprint")
    order = Window.partitionBy("slot", "part").orderBy("fingerprint")
    shared = stored(
        filed.select(
            "*",
            F.lag("fingerprint").over(order).alias("previous"),
            F.lead("fingerprint").over(order).alias("next"),
            F.first("fingerprint").over(order).alias("smallest"),
        )
        .filter("previous is not null or next is not null")
        .drop("next"),
        "shared-places",
    )
    near = [
        shared.filter(ring.linked(F.col("fingerprint"), F.col(other), F.col("slot"))).select(
            F.col("fingerprint").alias("u"), F.col(other).alias("v")
        )
        for other in ("previous", "smallest")
    ]
    known = stored(components(near[0].unionByName(near[1])), "labels")
    members = stored(
        shared.join(known, shared["fingerprint"] == known["node"], "left").select(
            "slot", "part", "fingerprint", F.coalesce("label", "fingerprint").alias("label")
        ),
        "members",
    )
    mixed = stored(
        members.groupBy("slot", "part", "label")
        .agg(F.count(F.lit(1)).alias("size"))
        .groupBy("slot", "part")
        .agg(
            F.count(F.lit(1)).alias("kinds"),
            F.max_by("label", F.struct("size", "label")).alias("top"),
        )
        .filter("kinds > 1")
        .drop("kinds"),
        "mixed-places",
    )
    rest = stored(
        members.join(mixed, ["slot", "part"]).withColumn(
            "minor", (F.col("label") != F.col("top")).cast("int")
        ),
        "mixed-members",
    )
    one = rest.filter("minor = 1").select(
        "slot",
        "part",
        F.col("fingerprint").alias("one"),
        F.col("label").alias("u"),
        F.explode(F.array(F.lit(0), F.lit(1))).alias("minor"),
    )
    other = rest.select(
        "slot", "part", F.col("fingerprint").alias("other"), F.col("label").alias("v"), "minor"
    )
    across = (
        one.join(other, ["slot", "part", "minor"])
        .filter(
            (F.col("u") != F.col("v"))
            & ((F.col("minor") == 0) | (F.col("one") < F.col("other")))
            & ring.linked(F.col("one"), F.col("other"), F.col("slot"))
        )
        .select("u", "v")
    )
    joined = stored(components(across), "labels").toDF("known", "joined")
    alone = joined.join(known, F.col("known") == F.col("node"), "left_anti").toDF("node", "label")
    return (
        known.join(joined, F.col("label") == F.col("known"), "left")
        .select("node", F.coalesce("joined", "label").alias("label"))
        .unionByName(alone)
    )


def near_duplicates(
    docs: DataFrame,
    words: int = 4,
    distance: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id_col``, ``fingerprint`` (long), ``component_id`` and ``component`` of each row.

    Rows are linked if their fingerprints differ in at most ``distance`` bits.
    ``component_id`` is the smallest id that can be reached, ``component`` a
    fingerprint that names the component.
    """
    marks = stored(fingerprints(docs, words, id_col, text_col), "fingerprints")
    distinct = stored(
        marks.groupBy("fingerprint").agg(F.min("id").alias("smallest_id")), "distinct"
    )
    known = stored(links(distinct, distance), "labels")
    members = stored(
        distinct.join(known, F.col("fingerprint") == F.col("node"), "left").select(
            "fingerprint", "smallest_id", F.coalesce("label", "fingerprint").alias("component")
        ),
        "members",
    )
    least = stored(
        members.groupBy("component").agg(F.min("smallest_id").alias("component_id")), "least"
    )
    named = stored(
        members.join(least, "component").select("fingerprint", "component", "component_id"),
        "named",
    )
    return marks.join(named, "fingerprint").select(
        F.col("id").alias(id_col), "fingerprint", "component_id", "component"
    )


def hex_digits(mark: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(mark)), 16, "0"))


def one_of_each(
    docs: DataFrame,
    words: int = 4,
    distance: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` with the smallest id of each component.

    Of rows that share that id, one with the smallest text stays.
    """
    found = stored(near_duplicates(docs, words, distance, id_col, text_col), "near")
    chosen = stored(
        found.groupBy(id_col)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.bool_or(F.col(id_col).eqNullSafe(F.col("component_id"))).alias("stays"),
        )
        .filter("stays")
        .select(F.col(id_col).alias("chosen_id"), "rows"),
        "chosen",
    )
    match = F.col(f"given.{id_col}").eqNullSafe(F.col("chosen.chosen_id"))

    def rows(ids: DataFrame) -> DataFrame:
        return docs.alias("given").join(ids.alias("chosen"), match, "left_semi")

    # Ids of their own grow with the documents and are never broadcast, at no size.
    # Repeated ids are stored apart: where there are few, the documents needn't move again.
    own = rows(chosen.filter("rows = 1").hint("merge"))
    repeated = rows(stored(chosen.filter("rows > 1"), "repeated-ids"))
    mark, named, component, least, place = (
        unused(docs.columns, name) for name in ("mark", "named", "component", "least", "place")
    )
    marked = repeated.mapInArrow(
        _with_fingerprint(words, docs.columns.index(text_col), mark),
        T.StructType([*docs.schema.fields, T.StructField(mark, T.LongType())]),
    )
    names = found.groupBy(F.col("fingerprint").alias(named)).agg(
        F.first("component").alias(component), F.min("component_id").alias(least)
    )
    order = Window.partitionBy(component).orderBy(text_col, F.xxhash64(*docs.columns))
    first = (
        marked.join(names, F.col(mark) == F.col(named))
        .filter(F.col(id_col).eqNullSafe(F.col(least)))
        .withColumn(place, F.row_number().over(order))
        .filter(F.col(place) == 1)
        .select(*(f"`{name}`" for name in docs.columns))
    )
    return own.unionByName(first)


def _with_fingerprint(words: int, column: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [
                fingerprint((text.as_py() or "").encode(), words) for text in batch.column(column)
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(marks, pa.int64())], names=[*batch.schema.names, name]
            )

    return run
