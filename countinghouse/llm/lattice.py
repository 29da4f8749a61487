"""Near-duplicate vectors by lattice hashing.

Each vector, scaled to length one, is projected to eight random directions and decoded
to the nearest point of the lattice E8, the densest in eight dimensions; that is its
cell. Several tables do so with other directions. A vector is filed in its own cell and
in the neighbouring cells that its projection is nearest to. Two vectors of one label
meet where at least one of them is at home; those that meet are compared by cosine.

Equal vectors of a label are one class with a count. Cells in which nobody can meet are
left before any vector moves. In a cell the vectors are compared block by block: a cell
of more than ``block`` rows is dealt out to blocks, and each pair of blocks is a piece
of work of its own. A piece returns one row for each vector, with the number of its
links and one vector that it is connected with, never the pairs. A pair that meets
several times counts where it meets first: every piece works out the cells again, from
whole numbers, so that no order of addition can change them.

Recall: two vectors with a cosine of exactly 0.93 meet in one of four tables with a
probability of 0.98, those of 0.96 or more with 0.99 or more; tests measure it against
brute force.

Defined results: a vector that is null, empty or zero or has a null or non-finite
component, or whose label is null, links with nothing; vectors of different lengths
don't link; equal rows link with each other; a null id is ignored in the smallest id
unless a component has no other; further columns are left out; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countinghouse.llm.arrow import lists, sliced
from countinghouse.llm.components import components
from countinghouse.session import stored

TABLES = 4
#: Neighbouring cells that a vector is filed in, beside its own.
PROBES = 2
#: Lattice units for a unit vector's standard deviation in a direction.
SCALE = 0.6
#: Rows of a cell that are compared with each other at once.
BLOCK = 1_024

WIDTH = 8
#: Unit vectors and directions are whole numbers of these steps: below 2^53 sums are exact.
_VECTOR_STEP, _DIRECTION_STEP = 1 << 20, 1 << 12


def _neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled: two entries of 2, or all 1 with an even
    number of signs."""
    found = []
    for one, other in combinations(range(WIDTH), 2):
        for a, b in product((2, -2), repeat=2):
            row = [0] * WIDTH
            row[one], row[other] = a, b
            found.append(row)
    found += [signs for signs in product((1, -1), repeat=WIDTH) if signs.count(-1) % 2 == 0]
    return np.array(found, np.int16)


NEIGHBOURS = _neighbours()


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest whole-number points whose entries have an even sum."""
    near = np.rint(x)
    off = x - near
    rows = np.flatnonzero(near.sum(axis=1) % 2)
    worst = np.abs(off[rows]).argmax(axis=1)
    near[rows, worst] += np.where(off[rows, worst] >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8, doubled so that they are whole numbers."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.rint(2 * np.where(nearer[:, None], whole, half)).astype(np.int16)


class Lattice:
    """The tables for a seed: which cells a vector is filed in."""

    def __init__(
        self, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, seed: int = 13
    ):
        if not 0 <= probes <= len(NEIGHBOURS) or tables < 1 or scale <= 0:
            raise ValueError("tables and scale are positive, probes at most 240")
        self.tables, self.probes, self.scale, self.seed = tables, probes, scale, seed
        self._known: dict[int, np.ndarray] = {}

    def directions(self, length: int) -> np.ndarray:
        """The directions of all tables side by side, in whole steps."""
        if length not in self._known:
            drawn = np.random.default_rng([self.seed, length]).normal(
                size=(length, self.tables * WIDTH)
            )
            self._known[length] = np.rint(drawn * self.scale * _DIRECTION_STEP)
        return self._known[length]

    def cells(self, rows: np.ndarray) -> np.ndarray:
        """For each row (at length one), table and filing (its own cell first) a point."""
        seen = np.rint(rows * _VECTOR_STEP) @ self.directions(rows.shape[1])
        seen /= _VECTOR_STEP * _DIRECTION_STEP
        out = np.empty((len(rows), self.tables, 1 + self.probes, WIDTH), np.int16)
        for table in range(self.tables):
            x = seen[:, table * WIDTH : (table + 1) * WIDTH]
            home = decode(x)
            out[:, table, 0] = home
            if self.probes:
                # Nearest to what is left of x: largest product, as all have one length.
                towards = (x - home / 2) @ NEIGHBOURS.T.astype(float)
                order = np.argsort(-np.rint(towards * (1 << 30)), axis=1, kind="stable")
                out[:, table, 1:] = home[:, None] + NEIGHBOURS[order[:, : self.probes]]
        return out


def units(vectors: np.ndarray) -> np.ndarray:
    """The rows in double precision at length one; none may be zero."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # else squares overflow
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _has_direction(vector: np.ndarray | None) -> bool:
    return vector is not None and bool(np.isfinite(vector).all()) and bool(vector.any())


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """The lists of a column; None for a null and for one with a null in it."""
    if column.null_count or column.values.null_count:
        rows = column.to_pylist()
        return [None if x is None or None in x else np.array(x, np.float64) for x in rows]
    return lists(column)


def _classes(
    vectors: DataFrame, id_col: str, vector_col: str, label_col: str
) -> tuple[DataFrame, DataFrame]:
    """Each row's ``id`` and class ``digest`` (null: links with nothing), and the classes."""
    own = vectors.schema[vector_col].dataType.simpleString()
    # Components travel as they are given and are made double where they are worked with.
    vector_type = own if own == "array<float>" else "array<double>"
    given = vectors.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{label_col}`").alias("label"),
        F.col(f"`{vector_col}`").cast(vector_type).alias("vector"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, 4_096):
                marks, labels = [], part["label"].cast(pa.string()).to_pylist()
                for vector, label in zip(_vectors(part["vector"]), labels):
                    if label is None or not _has_direction(vector):
                        marks.append(None)
                    else:
                        # Adding zero makes the negative zero positive.
                        mark = hashlib.blake2b((vector + 0.0).tobytes(), digest_size=20)
                        mark.update(label.encode())
                        marks.append(mark.digest())
                columns = [part["id"], part["label"], part["vector"], pa.array(marks, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "vector", "digest"])

    kinds = {field.name: field.dataType.simpleString() for field in given.schema}
    marked = given.mapInArrow(
        run, f"id {kinds['id']}, label {kinds['label']}, vector {vector_type}, digest binary"
    )
    known = (
        marked.filter("digest is not null")
        .groupBy("digest")
        .agg(
            F.count(F.lit(1)).alias("size"),
            F.min("id").alias("smallest_id"),
            F.first("label").alias("label"),
            F.first("vector").alias("vector"),
        )
        .withColumn("node", F.monotonically_increasing_id())
    )
    return marked.select("id", "digest"), stored(known, "vector-classes")


def _filed(classes: DataFrame, lattice: Lattice) -> DataFrame:
    """``cell`` (with its table and length), ``node`` and ``home`` of each filing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, 4_096):
                vectors = lists(part["vector"])
                lengths = np.array([len(x) for x in vectors])
                for length in np.unique(lengths):
                    rows = np.flatnonzero(lengths == length)
                    points = lattice.cells(units(np.array([vectors[n] for n in rows], np.float64)))
                    key = np.zeros((*points.shape[:3], WIDTH + 3), np.int16)
                    key[..., 0] = np.arange(lattice.tables)[None, :, None]
                    key[..., 1], key[..., 2] = length & 0x7FFF, length >> 15
                    key[..., 3:] = points
                    each = lattice.tables * (1 + lattice.probes)
                    taken = pa.array(np.repeat(rows, each))
                    home = np.zeros(points.shape[:3], bool)
                    home[..., 0] = True
                    data = pa.py_buffer(key.tobytes())
                    cells = pa.FixedSizeBinaryArray.from_buffers(
                        pa.binary(2 * (WIDTH + 3)), len(taken), [None, data]
                    )
                    yield pa.RecordBatch.from_arrays(
                        [
                            part["label"].take(taken),
                            cells.cast(pa.binary()),
                            part["node"].take(taken),
                            pa.array(home.ravel()),
                        ],
                        names=["label", "cell", "node", "home"],
                    )

    kind = classes.schema["label"].dataType.simpleString()
    return classes.select("label", "vector", "node").mapInArrow(
        run, f"label {kind}, cell binary, node bigint, home boolean"
    )


def _codes(points: np.ndarray) -> np.ndarray:
    """A whole number for each lattice point, equal where the points are equal."""
    flat = np.ascontiguousarray(points.reshape(-1, WIDTH)).view(np.dtype((np.void, 2 * WIDTH)))
    return np.unique(flat, return_inverse=True)[1].reshape(points.shape[:-1])


class Piece:
    """The rows of one cell, or of two of its blocks, compared with each other."""

    def __init__(self, lattice: Lattice, threshold: float):
        self.lattice, self.threshold = lattice, threshold

    def links(
        self,
        table: int,
        nodes: np.ndarray,
        home: np.ndarray,
        rows: np.ndarray,
        side: np.ndarray | None,
    ) -> tuple[np.ndarray, np.ndarray]:
        """Which rows are linked, and which of these links count here. ``side`` says of which
        of two blocks a row is; only rows of different blocks are compared then."""
        linked = rows @ rows.T >= self.threshold
        np.fill_diagonal(linked, False)
        linked &= home[:, None] | home[None, :]
        if side is not None:
            linked &= side[:, None] != side[None, :]
        if not linked.any():
            return linked, linked
        codes = _codes(self.lattice.cells(rows))
        own, all_ = codes[:, :, 0], codes
        counted = linked.copy()
        for earlier in range(table):
            counted &= ~self._meet(own[:, earlier], all_[:, earlier])
        # In the same table two vectors may visit each other: the smaller node's home counts.
        probed = self._visits(own[:, table], all_[:, table])
        mutual = probed & probed.T
        hosts = home[:, None] & ~home[None, :]  # the row is at home, the column visits
        smaller = nodes[:, None] < nodes[None, :]
        counted &= ~(mutual & ((hosts & ~smaller) | (hosts.T & smaller)))
        return linked, counted

    @staticmethod
    def _visits(own: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Whether the row is filed as a visitor in the column's own cell."""
        found = np.zeros((len(own), len(own)), bool)
        for probe in range(1, codes.shape[1]):
            found |= codes[:, probe][:, None] == own[None, :]
        return found

    def _meet(self, own: np.ndarray, codes: np.ndarray) -> np.ndarray:
        visits = self._visits(own, codes)
        return visits | visits.T | (own[:, None] == own[None, :])


def _roots(linked: np.ndarray) -> np.ndarray:
    """For each row the first row that it is connected with."""
    roots = np.full(len(linked), -1)
    for start in range(len(linked)):
        if roots[start] < 0:
            roots[start], edge = start, np.array([start])
            while len(edge):
                edge = np.flatnonzero(linked[edge].any(axis=0) & (roots < 0))
                roots[edge] = start
    return roots


def _compared(lattice: Lattice, threshold: float):
    """Goes through rows sorted by piece; gives ``node``, ``root`` and ``links``."""
    piece = Piece(lattice, threshold)

    def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cell = table["cell"][0].as_py()
        at = int(np.frombuffer(cell[:2], np.int16)[0])
        nodes = table["node"].to_numpy()
        sizes = table["size"].to_numpy()
        home = table["home"].to_numpy()
        side = table["side"].to_numpy() if table["first"][0] != table["second"][0] else None
        vectors = units(np.array(lists(table["vector"].combine_chunks()), np.float64))
        linked, counted = piece.links(at, nodes, home, vectors, side)
        rows = np.flatnonzero(linked.any(axis=1))
        if len(rows):
            roots = _roots(linked[np.ix_(rows, rows)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(nodes[rows]),
                    pa.array(nodes[rows][roots]),
                    pa.array(counted[rows].astype(np.int64) @ sizes),
                ],
                names=["node", "root", "links"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            table = pa.Table.from_batches(waiting)
            starts = _starts(table)
            for a, b in zip(starts[:-1], starts[1:]):
                if b - a > 1:
                    yield from found(table.slice(a, b - a).combine_chunks())
            # The last piece may go on in the next batch.
            waiting = table.slice(starts[-1]).combine_chunks().to_batches()
        if waiting:
            table = pa.Table.from_batches(waiting)
            if table.num_rows > 1:
                yield from found(table.combine_chunks())

    return run


def _starts(table: pa.Table) -> np.ndarray:
    """Where another piece begins."""
    changed = np.zeros(table.num_rows, bool)
    changed[0] = True
    for name in ("label", "cell", "first", "second"):
        codes = table[name].combine_chunks().dictionary_encode().indices.to_numpy()
        changed[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(changed)


def near_vectors(
    vectors: DataFrame,
    threshold: float = 0.93,
    lattice: Lattice | None = None,
    block: int = BLOCK,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """``id_col``, ``n_links``, ``component_id`` and ``kept`` of each row.

    Rows of one label are linked if they meet and their cosine is at least ``threshold``.
    ``n_links`` counts the other rows that a row is linked with, ``component_id`` is the
    smallest id that can be reached, and rows with that id are kept.
    """
    lattice = lattice or Lattice()
    spark = vectors.sparkSession
    marked, classes = _classes(vectors, id_col, vector_col, label_col)
    filed = stored(_filed(classes, lattice), "filed-vectors")
    # Cells in which somebody meets somebody, with the number of their blocks.
    shared = stored(
        filed.groupBy("label", "cell")
        .agg(F.count(F.lit(1)).alias("rows"), F.bool_or("home").alias("hosted"))
        .filter("rows > 1 and hosted")
        .select("label", "cell", F.ceil(F.col("rows") / block).cast("int").alias("blocks")),
        "shared-cells",
    )
    dealt = filed.join(shared, ["label", "cell"]).withColumn(
        "own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    meeting = dealt.withColumn("other", other).select(
        "label",
        "cell",
        F.least("own", "other").alias("first"),
        F.greatest("own", "other").alias("second"),
        (F.col("own") > F.col("other")).alias("side"),
        "node",
        "home",
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = ["label", "cell", "first", "second"]
    found = stored(
        meeting.join(classes.select("node", "size", "vector"), "node")
        .repartition(parts, *place)
        .sortWithinPartitions(*place, "node")
        .mapInArrow(_compared(lattice, threshold), "node bigint, root bigint, links bigint"),
        "links",
    )
    joined = stored(components(found.select(F.col("node").alias("u"), F.col("root").alias("v"))), "labels")
    counts = found.groupBy(F.col("node").alias("counted")).agg(F.sum("links").alias("links"))
    members = stored(
        classes.join(joined.withColumnRenamed("label", "component"), "node", "left")
        .join(counts, F.col("node") == F.col("counted"), "left")
        .select(
            F.col("digest").alias("known"),
            "smallest_id",
            F.coalesce("component", "node").alias("component"),
            (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("links"),
        ),
        "members",
    )
    least = members.groupBy("component").agg(F.min("smallest_id").alias("component_id"))
    named = stored(members.join(least, "component").select("known", "links", "component_id"), "named")
    # A vector that links with nothing is a component of its own; for ``kept`` nulls are equal.
    component = F.when(F.col("known").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return marked.join(named, F.col("digest") == F.col("known"), "left").select(
        F.col("id").alias(id_col),
        F.coalesce("links", F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
