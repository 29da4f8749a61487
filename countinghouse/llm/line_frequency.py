"""Quality rules with cross-document line frequency.

Lines (words in lower case, digits alike, joined by one blank) are hashed. For each
host the distinct documents that have a line are counted, where copies of one text
are one document. A line above the limit is removed: found in more than ``max_docs``
documents of its host, whatever the size of the host. A caller can ask that it also be in
more than ``max_share`` of the host's documents, a limit that grows with the host. A
document is depleted, and rejected, if under ``min_words`` words or under
``min_left`` of its words are left. Before that, short or repetitive documents fail.

Defined results: a null or empty text has no words and fails; a null host is a host
of its own; equal rows get equal verdicts; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countinghouse.llm.arrow import list_array, sliced, unused
from countinghouse.session import stored

MIN_WORDS = 50
MAX_REPEATED = 50
MAX_DOCS = 20
#: 0: the count alone decides.
MAX_SHARE = 0.0
MIN_LEFT = 0.3
WINDOW = 3

_DIGITS = bytes.maketrans(b"123456789", b"000000000")
_SYMBOLS = b"#*$%&|<>"
#: All but the bytes that continue a code point in UTF-8.
_FIRST_BYTES = bytes([*range(0x80), *range(0xC0, 0x100)])
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes]) -> int:
    """Words inside a window of three words that occurs twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    hit = np.fromiter((counts[window] > 1 for window in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for shift in range(WINDOW):
        covered[shift : shift + len(hit)] |= hit
    return int(covered.sum())


def line_key(line: bytes) -> int:
    """Hash of a line's normal form; 0 words: 0."""
    words = line.lower().translate(_DIGITS).split()
    return xxhash.xxh64_intdigest(b" ".join(words)) if words else 0


def measure(text: bytes) -> tuple[tuple[int, ...], list[int], list[int]]:
    """The measures of a text, and the keys and numbers of words of its lines."""
    words = text.split()
    chars = sum(map(len, words)) - len(text.translate(None, _FIRST_BYTES))
    seen, repeated, keys, sizes = set(), 0, [], []
    for line in text.split(b"\n"):
        count = len(line.split())
        if not count:
            continue
        repeated += line in seen
        seen.add(line)
        keys.append(line_key(line))
        sizes.append(count)
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    return (len(words), chars, symbols, repeated, repeated_words(words)), keys, sizes


def measured(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source"
) -> DataFrame:
    """For each row its measures, keys of lines and their sizes, and a digest of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, 1_000):
                done = [measure(text.as_py()) for text in part["text"]]
                yield pa.RecordBatch.from_arrays(
                    [
                        part["id"],
                        part["host"],
                        part["digest"],
                        *(
                            pa.array([x[0][n] for x in done], pa.int64())
                            for n in range(len(MEASURES))
                        ),
                        list_array(
                            [np.array(x[1], np.uint64).view(np.int64) for x in done], pa.int64()
                        ),
                        list_array([np.array(x[2], np.int64) for x in done], pa.int64()),
                    ],
                    names=["id", "host", "digest", *MEASURES, "lines", "sizes"],
                )

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    given = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{host_col}`").alias("host"),
        F.xxhash64(text).alias("digest"),
        text.cast("binary").alias("text"),
    )
    kinds = {name: given.schema[name].dataType.simpleString() for name in ("id", "host")}
    columns = ", ".join(f"{name} bigint" for name in MEASURES)
    return given.mapInArrow(
        run,
        f"id {kinds['id']}, host {kinds['host']}, digest bigint, {columns},"
        " lines array<bigint>, sizes array<bigint>",
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED
    )


def frequent_lines(
    rows: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE
) -> DataFrame:
    """``host`` and ``line`` of the lines above the limits of their host."""
    counts = (
        rows.select("host", "digest", F.explode("lines").alias("line"))
        .groupBy("host", "line", "digest")
        .agg(F.count(F.lit(1)).alias("times"))
        .groupBy("host", "line")
        .agg(F.count(F.lit(1)).alias("docs"))
        .filter(F.col("docs") > max_docs)
    )
    if not max_share:
        return counts.select("host", "line")
    hosts = stored(
        rows.groupBy("host", "digest")
        .agg(F.count(F.lit(1)).alias("copies"))
        .groupBy("host")
        .agg(F.count(F.lit(1)).alias("host_docs")),
        "hosts",
    )
    return (
        counts.alias("c")
        .join(hosts.alias("h"), F.col("c.host").eqNullSafe(F.col("h.host")))
        .filter(F.col("docs") > F.col("host_docs") * max_share)
        .select("c.host", "line")
    )


def verdicts(
    docs: DataFrame,
    max_docs: int = MAX_DOCS,
    max_share: float = MAX_SHARE,
    min_words: int = MIN_WORDS,
    min_left: float = MIN_LEFT,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
) -> DataFrame:
    """For each row: ``id``, ``host``, ``digest`` of its text, the measures, ``base_failed``,
    ``removed`` (keys of the lines above the limits, null if none), ``words_left`` and ``kept``."""
    given = measured(docs, id_col, text_col, host_col)
    rows = stored(given.withColumn("row", F.monotonically_increasing_id()), "measured")
    frequent = stored(frequent_lines(rows, max_docs, max_share), "frequent-lines")
    lines = rows.select(
        "row", "host", F.explode(F.arrays_zip("lines", "sizes")).alias("at")
    ).select("row", "host", F.col("at.lines").alias("line"), F.col("at.sizes").alias("size"))
    removed = stored(
        lines.alias("l")
        .join(
            frequent.alias("f"),
            F.col("l.host").eqNullSafe(F.col("f.host")) & (F.col("l.line") == F.col("f.line")),
        )
        .groupBy(F.col("row").alias("hit"))
        .agg(F.sum("size").alias("gone"), F.collect_set("l.line").alias("removed")),
        "removed",
    )
    left = F.col("n_words") - F.coalesce("gone", F.lit(0))
    depleted = F.col("gone").isNotNull() & (
        (left < min_words) | (left < F.col("n_words") * min_left)
    )
    return (
        rows.drop("lines", "sizes")
        .join(removed, F.col("row") == F.col("hit"), "left")
        .withColumn("words_left", left)
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & ~depleted)
        .drop("hit", "gone", "row")
    )


def _without(line_keys: int, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, keys in zip(batch.column(column), batch.column(line_keys)):
                keys, text = keys.as_py(), text.as_py()
                if keys:
                    gone = {key & (1 << 64) - 1 for key in keys}
                    lines = text.encode().split(b"\n")
                    text = b"\n".join(x for x in lines if line_key(x) not in gone).decode()
                texts.append(text)
            arrays = list(batch.columns[:line_keys])
            arrays[column] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names[:line_keys])

    return run


def apply(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    **limits: float,
) -> DataFrame:
    """The rows of ``docs`` that are kept, without the lines above the limits."""
    found = verdicts(docs, id_col=id_col, text_col=text_col, host_col=host_col, **limits)
    # Equal rows have one verdict, so the documents are looked up by what decides it.
    passed = stored(
        found.filter("kept")
        .groupBy("id", "host", "digest")
        .agg(F.first("removed").alias("removed")),
        "passed",
    )
    digest = F.xxhash64(F.coalesce(F.col(f"d.`{text_col}`"), F.lit("")))
    joined = docs.alias("d").join(
        passed.alias("p"),
        F.col(f"d.`{id_col}`").eqNullSafe(F.col("p.id"))
        & F.col(f"d.`{host_col}`").eqNullSafe(F.col("p.host"))
        & (digest == F.col("p.digest")),
    )
    return joined.select(
        *(F.col(f"d.`{name}`") for name in docs.columns),
        F.col("p.removed").alias(unused(docs.columns, "removed")),
    ).mapInArrow(
        _without(len(docs.columns), docs.columns.index(text_col)), docs.schema
    )
