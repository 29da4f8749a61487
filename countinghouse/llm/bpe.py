"""Byte-level BPE by overlapping chunks, and back to bytes.

A text is cut into chunks that overlap. Chunks are dealt over the cluster, split
into pre-tokens and encoded there. A scan of the pattern depends only on the
place it starts from, so two neighbouring chunks agree from the first place where
both have a pre-token boundary: there one chunk takes over from the other. Where
an overlap holds no such place (one pre-token longer than the overlap) the text
is scanned on from the last boundary known until it meets one of the next chunk.

Defined results: a null or empty text has no ids; repeated rows each give a row;
an empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countinghouse.llm.arrow import list_array, lists, sliced, texts_of

CHUNK = 32_768
OVERLAP = 1_024
#: A match that ends so close to the end of a chunk might have gone on.
MARGIN = 3
#: Pre-tokens that a worker remembers at once; then it starts anew.
REMEMBERED = 400_000


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class PieceCoder(dict):
    """Pre-token to its ids as packed 32-bit integers, worked out at first sight."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        ranks = read_ranks(path)
        self.merge = tiktoken.Encoding(
            "ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
        )._encode_single_piece
        self.pattern = regex.compile(pattern)

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        packed = self[piece] = np.asarray(self.merge(piece), "<u4").tobytes()
        return packed

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(
            b"".join(map(self.__getitem__, self.pattern.findall(text))), "<u4"
        )


@lru_cache(maxsize=4)
def coder(path: str, pattern: str) -> PieceCoder:
    return PieceCoder(path, pattern)


@lru_cache(maxsize=4)
def byte_table(path: str) -> np.ndarray:
    """Bytes by id."""
    ranks = read_ranks(path)
    table = np.full(max(ranks.values()) + 1, b"", object)
    for piece, rank in ranks.items():
        table[rank] = piece
    return table


def _cut(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in sliced(batch, 1):
                text = row["text"][0].as_py()
                starts = range(0, max(1, len(text) - overlap), chunk - overlap)
                for part, start in enumerate(starts):
                    yield pa.RecordBatch.from_pydict(
                        {
                            "id": row["id"],
                            "digest": row["digest"],
                            "part": pa.array([part], pa.int64()),
                            "start": pa.array([start], pa.int64()),
                            "last": pa.array([part == len(starts) - 1]),
                            "text": pa.array([text[start : start + chunk]]),
                        }
                    )

    return run


def _scan(path: str, pattern: str):
    """Adds to each chunk the ends of its pre-tokens, their numbers of ids, and the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path, pattern)
        for batch in batches:
            done = [
                scanned(start, text, code)
                for start, text in zip(batch["start"].to_pylist(), batch["text"].to_pylist())
            ]
            ends, counts, ids = ([x[name] for x in done] for name in ("ends", "counts", "ids"))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    list_array(ends, pa.int64()),
                    list_array(counts, pa.int64()),
                    list_array(ids, pa.int32()),
                ],
                names=[*batch.schema.names, "ends", "counts", "ids"],
            )

    return run


def scanned(start: int, text: str, code: PieceCoder) -> dict:
    """A chunk with the ends of its pre-tokens, their numbers of ids, and the ids."""
    pieces = code.pattern.findall(text)
    packed = [code[piece] for piece in pieces]
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    return {
        "start": start,
        "text": text,
        "ends": start + np.cumsum(lengths),
        "counts": np.fromiter(map(len, packed), np.int64, len(pieces)) // 4,
        "ids": np.frombuffer(b"".join(packed), "<u4"),
    }


def stitched(chunks: list[dict], code: PieceCoder) -> np.ndarray:
    """The ids of a text from its scanned chunks in order."""
    out, chunk, n, at, joining = [], chunks[0], 1, 0, 1
    while True:
        stop = chunk["start"] + len(chunk["text"])
        offsets = np.concatenate([[0], np.cumsum(chunk["counts"])])
        ends = chunk["ends"] if n == len(chunks) else chunk["ends"][chunk["ends"] <= stop - MARGIN]
        bounds = np.concatenate([[chunk["start"]], ends])
        first = int(np.searchsorted(bounds, at))
        if n == len(chunks):
            out.append(chunk["ids"][offsets[first] :])
            return np.concatenate(out)
        follower = chunks[n]
        common = np.intersect1d(
            bounds[first:], np.concatenate([[follower["start"]], follower["ends"]])
        )
        if len(common):
            at = int(common[0])
            out.append(chunk["ids"][offsets[first] : offsets[np.searchsorted(bounds, at)]])
            chunk, n, joining = follower, n + 1, 1
            continue
        # They never agree: keep what is known and scan the rest together with the
        # next chunks, with twice as many each time, so that long runs stay linear.
        out.append(chunk["ids"][offsets[first] : offsets[len(bounds) - 1]])
        at = int(bounds[-1])
        text = chunk["text"][at - chunk["start"] :]
        for follower in chunks[n : n + joining]:
            text += follower["text"][at + len(text) - follower["start"] :]
        chunk = scanned(at, text, code)
        n, joining = min(len(chunks), n + joining), joining * 2


def _stitch(path: str, pattern: str):
    def run(table: pa.Table) -> pa.Table:
        code = coder(path, pattern)
        table = table.sort_by("part").combine_chunks()
        columns = {name: table[name].combine_chunks() for name in table.column_names}
        numbers = {name: lists(columns[name]) for name in ("ends", "counts", "ids")}
        chunks = [
            {"start": start, "text": columns["text"][n].as_py()}
            | {name: numbers[name][n] for name in numbers}
            for n, start in enumerate(columns["start"].to_pylist())
        ]
        ids = stitched(chunks, code).astype(np.int32)
        return pa.table(
            {
                "id": columns["id"][:1],
                "ids": list_array([ids], pa.int32()),
                "copies": columns["copies"][:1],
            }
        )

    return run


def _encode_whole(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path, pattern)
        for batch in batches:
            for part in sliced(batch, 500):
                ids = [code.ids(text) for text in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part["id"], list_array(ids, pa.int32())], names=["id", "ids"]
                )

    return run


def encode(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """``id_col`` and ``ids`` (array of int): what merging each match of ``pattern`` alone gives.

    A text of one chunk has nothing to stitch and is encoded where it is read;
    only chunks of longer texts move.
    """
    given = texts_of(docs, id_col, text_col)
    kind = given.schema["id"].dataType.simpleString()
    whole = given.filter(F.length("text") <= chunk).mapInArrow(
        _encode_whole(ranks_path, pattern), f"id {kind}, ids array<int>"
    )
    keys = ["id", "digest", "part", "start", "last", "text"]
    columns = f"id {kind}, digest string, part bigint, start bigint, last boolean, text string"
    long = given.filter(F.length("text") > chunk).withColumn("digest", F.md5("text"))
    parallelism = max(
        int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")),
        docs.sparkSession.sparkContext.defaultParallelism,
    )
    scanned = (
        long.mapInArrow(_cut(chunk, overlap), columns)
        # Rows of equal id and text are one before they move; their number stays with them.
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("copies"))
        .repartition(parallelism, "id", "digest", "part")
        .mapInArrow(
            _scan(ranks_path, pattern),
            f"{columns}, copies bigint, ends array<bigint>, counts array<bigint>, ids array<int>",
        )
    )
    joined = (
        scanned.groupBy("id", "digest")
        .applyInArrow(_stitch(ranks_path, pattern), f"id {kind}, ids array<int>, copies bigint")
        .select("id", "ids", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        .drop("col")
    )
    return whole.unionByName(joined).withColumnRenamed("id", id_col)


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(path)
        for batch in batches:
            for part in sliced(batch, 500):
                texts = [b"".join(table[ids].tolist()) for ids in lists(part["ids"])]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(texts, pa.binary())],
                    names=[*part.schema.names, "decoded"],
                )

    return run


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Adds ``decoded``, the joined bytes of the column ``ids``."""
    columns = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields
    )
    return encoded.mapInArrow(_decode(ranks_path), f"{columns}, decoded binary")
