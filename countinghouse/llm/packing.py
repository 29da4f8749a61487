"""Packing token sequences to a mixture, by deficit round-robin over source queues.

Every source is a queue of tokens, its documents one after the other. In each round
a queue is granted its share of a window and hands over that many tokens, cutting
documents where the grant ends; what the grant lacks of a whole token is carried to
the next round as a deficit; a queue whose grants are below a grain saves them up, so
that documents aren't cut into single tokens. The rounds, one after the other, are cut
into windows, so each window has the target proportions but for a grain of each source
as long as its queues last, and an empty queue leaves its room to the others.

Sources that the mixture names and the largest others have queues of their own; all the
rest share one, the tail, inside which a second level takes turns: the grains of the tail's
sources are dealt to rounds in proportion to their tokens, a round's grains follow each
other, and prefix sums over the rounds give every grain its place in the tail. So a source
has its proportion however many there are; only the tail's tokens move for it.

The state after any round follows from the round's number (``Rounds.handed``). So no
task waits for another: a document knows its place in its queue from per-partition sums,
and from that its rounds, windows and offsets, in whatever partition it lies.

Defined results: a null or empty text is one end token; a null source shares the queue
of the empty name; repeated rows are packed each; an empty table gives no pieces;
further columns are left out. Only the last sequence can be shorter than a window.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from countinghouse.functions.ordering import with_running_total
from countinghouse.llm.arrow import sliced
from countinghouse.session import stored

WINDOW = 2_048
END = 1
#: Tokens that a queue hands over at a time: what a window can lack or exceed of a source.
GRAIN = 128
#: Weights are in this part of a token.
PARTS = 512
#: The largest sources that have a queue of their own beside those named in the mixture.
MAX_QUEUES = 256


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1
    characters stand for themselves, the other bytes in order for those from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [byte for byte in range(256) if byte not in printable]
    return {chr(byte): byte for byte in printable} | {
        chr(256 + n): byte for n, byte in enumerate(others)
    }


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> tiktoken.Encoding:
    """The tokenizer of a ``tokenizers`` file, without special tokens: their names in a text
    are ordinary text. The ids of such a vocabulary are in the order of its merges."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    special = {token["content"] for token in content["added_tokens"]}
    letters = byte_letters()
    ranks = {
        bytes(map(letters.__getitem__, piece)): number
        for piece, number in content["model"]["vocab"].items()
        if piece not in special
    }
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def tokenized(
    docs: DataFrame,
    tokenizer_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """For each row ``id``, ``source``, ``tokens``, its packed ``ids``, and, of its own
    partition and source, the tokens before it (``before``); stored.

    The pattern is the tokenizer's own: it merges within the matches only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(tokenizer_path, pattern)
        kind = "<u2" if encoding.max_token_value < 1 << 16 else "<u4"
        handed: dict[str, int] = {}
        for batch in batches:
            for part in sliced(batch, 500):
                ids, tokens, before = [], [], []
                for text in part["text"].to_pylist():
                    found = encoding.encode_to_numpy(text, disallowed_special=())
                    tokens.append(len(found) + 1)
                    ids.append(np.append(found, END).astype(kind).tobytes())
                for source, count in zip(part["source"].to_pylist(), tokens):
                    before.append(handed.get(source, 0))
                    handed[source] = before[-1] + count
                yield pa.RecordBatch.from_arrays(
                    [
                        part["id"],
                        part["source"],
                        pa.array(tokens, pa.int64()),
                        pa.array(before, pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    names=["id", "source", "tokens", "before", "ids"],
                )

    given = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )
    kind = given.schema["id"].dataType.simpleString()
    return stored(
        given.mapInArrow(
            run, f"id {kind}, source string, tokens bigint, before bigint, ids binary"
        ).withColumn("partition", F.spark_partition_id()),
        "tokenized",
    )


class Rounds:
    """What the queues have handed over after any number of rounds.

    A round grants a queue ``weight / PARTS`` tokens. The queue hands over whole grains
    as soon as its grants add up to one; the rest is its deficit. Queues begin at
    different phases, so that small ones don't all hand over in the same round.
    """

    def __init__(self, tokens: list[int], wanted: list[float], window: int, grain: int):
        if window % grain:
            raise ValueError("a window holds whole grains")
        total = sum(wanted)
        self.window, self.grain = window, grain
        self.tokens = np.array(tokens, np.int64)
        self.weights = np.array(
            [max(1, round(window * PARTS * share / total)) for share in wanted], np.int64
        )
        self.phases = np.arange(len(tokens), dtype=np.int64) * grain // max(1, len(tokens))
        #: The round in which a queue is empty; later ones count as this one.
        self.ends = self.tokens * PARTS // self.weights + grain * PARTS + 2

    def handed(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens by round and queue."""
        rounds = np.minimum(rounds[:, None], self.ends[None, :])
        grains = (rounds * self.weights + self.phases * PARTS) // (self.grain * PARTS)
        return np.minimum(grains * self.grain, self.tokens)

    def pieces(
        self, starts: np.ndarray, tokens: np.ndarray, queues: np.ndarray
    ) -> tuple[np.ndarray, ...]:
        """The pieces of documents that are at ``starts`` of their queues, in order: the
        document's number, start in it, length and place."""
        stops, first = starts + tokens, starts // self.grain
        counts = (stops - 1) // self.grain - first + 1
        doc = np.repeat(np.arange(len(starts)), counts)
        grains = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - first, counts)
        queue = queues[doc]
        needed = ((grains + 1) * self.grain - self.phases[queue]) * PARTS
        rounds = (needed + self.weights[queue] - 1) // self.weights[queue] - 1
        new = np.ones(len(doc), bool)
        new[1:] = (rounds[1:] != rounds[:-1]) | (doc[1:] != doc[:-1])
        doc, queue, rounds, grains = doc[new], queue[new], rounds[new], grains[new]
        begins = np.maximum(grains * self.grain, starts[doc])
        ends = np.empty_like(begins)
        ends[:-1] = begins[1:]
        last = np.ones(len(doc), bool)
        last[:-1] = doc[1:] != doc[:-1]
        ends[last] = stops[doc[last]]
        now = self.handed(rounds)
        gained = np.cumsum(self.handed(rounds + 1) - now, axis=1)
        row = np.arange(len(doc))
        earlier = np.where(queue > 0, gained[row, np.maximum(queue - 1, 0)], 0)
        place = now.sum(axis=1) + earlier + begins - now[row, queue]
        # No piece is longer than a window, so it crosses one border at most.
        border = (place // self.window + 1) * self.window
        cut = np.minimum(ends, begins + border - place)
        over = cut < ends
        parts = [(doc, begins, cut, place), (doc[over], cut[over], ends[over], border[over])]
        doc, begins, ends, place = map(np.concatenate, zip(*parts))
        order = np.lexsort((begins, doc))
        doc, begins, ends, place = doc[order], begins[order], ends[order], place[order]
        return doc, begins - starts[doc], ends - begins, place


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    pattern: str,
    mixture: dict[str, float] | None = None,
    window: int = WINDOW,
    grain: int = GRAIN,
    max_queues: int = MAX_QUEUES,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The pieces of all documents: ``id_col``, ``start``, ``length``, ``ids`` (packed
    little-endian, 32 bits), ``doc_tokens``, ``sequence_id`` and ``offset``.

    ``mixture`` gives target proportions of tokens by source; without it, and for sources
    it does not name, the target is the source's part of all tokens, so that all queues
    last equally long. A target that is not positive, or of a source without documents,
    can't be kept and raises ValueError.
    """
    rows = tokenized(docs, tokenizer_path, pattern, id_col, text_col, source_col)
    sums = stored(
        rows.groupBy("source", "partition").agg(F.sum("tokens").alias("tokens")), "sums"
    )
    totals = stored(sums.groupBy("source").agg(F.sum("tokens").alias("tokens")), "totals")
    named = _named(totals, mixture or {})
    # At most max_queues more rows come to the driver, however many sources there are.
    others = totals.filter(~F.col("source").isin(*named)) if named else totals
    largest = others.orderBy(F.desc("tokens"), "source").limit(max_queues - 1).collect()
    everything = totals.agg(F.sum("tokens")).first()[0] or 0
    tokens = [*named.values(), *(row["tokens"] for row in largest)]
    wanted = [*(mixture or {}).values(), *(row["tokens"] / everything for row in largest)]
    queues = {x: n for n, x in enumerate([*named, *(row["source"] for row in largest)])}
    left = everything - sum(tokens)
    state = Rounds([*tokens, left], [*wanted, max(left / max(1, everything), 1e-9)], window, grain)
    # A window spans the partitions of one source.
    order = Window.partitionBy("source").orderBy("partition")
    places = stored(
        sums.select(
            "source",
            "partition",
            _queue(queues).alias("queue"),
            (F.sum("tokens").over(order) - F.col("tokens")).alias("base"),
        ),
        "places",
    )
    placed = rows.join(places, ["source", "partition"]).select(
        "id",
        "source",
        "queue",
        (F.col("base") + F.col("before")).alias("at"),
        F.lit(0).cast("bigint").alias("begin"),
        "tokens",
        F.col("tokens").alias("doc_tokens"),
        "ids",
    )
    if left:
        in_tail = F.col("queue") == len(queues)
        tail = totals.filter(~F.col("source").isin(*queues)) if queues else totals
        turns = _turns(tail, left, window, grain)
        placed = placed.filter(~in_tail).unionByName(_in_turns(placed.filter(in_tail), turns, grain))
    kind = rows.schema["id"].dataType.simpleString()
    return placed.drop("source").mapInArrow(
        _cut(state),
        f"`{id_col}` {kind}, start bigint, length bigint, ids binary, doc_tokens bigint,"
        " sequence_id bigint, offset bigint",
    )


def _named(totals: DataFrame, mixture: dict[str, float]) -> dict[str, int]:
    """The tokens of each source of the mixture, in its order."""
    wrong = [x for x, share in mixture.items() if not 0 < share < float("inf")]
    if not mixture:
        return {}
    found = totals.filter(F.col("source").isin(*mixture)).collect()
    known = {row["source"]: row["tokens"] for row in found}
    if wrong or len(known) < len(mixture):
        raise ValueError(f"targets that can't be kept: {wrong or sorted(set(mixture) - set(known))}")
    return {x: known[x] for x in mixture}


def _queue(queues: dict[str, int]) -> Column:
    if not queues:
        return F.lit(0)
    known = F.create_map(*(F.lit(x) for pair in queues.items() for x in pair))
    return F.coalesce(known[F.col("source")], F.lit(len(queues)))


def _turns(totals: DataFrame, everything: int, window: int, grain: int) -> DataFrame:
    """``source``, ``grain`` and ``place`` of each grain of the tail.

    A round is about a window of the tail. Grain n of a source's N is due when n / N of
    all rounds are over, later by the source's phase, which keeps small sources from
    coming in the same round. A round holds few grains: they follow each other by source.
    """
    rounds = max(1, everything // window)
    count = F.call_function("div", F.col("tokens") + grain - 1, F.lit(grain))
    number = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("grains") - 1)).alias("grain")
    wide = "decimal(38,0)"
    due = (F.col("grain") * PARTS + F.col("phase")).cast(wide) * rounds
    grains = (
        totals.withColumn("grains", count)
        .withColumn("phase", F.pmod(F.xxhash64("source"), F.lit(PARTS)))
        .select("source", "tokens", "grains", "phase", number)
        .select(
            "source",
            "grain",
            F.call_function("div", due, (F.col("grains") * PARTS).cast(wide)).alias("round"),
            F.least(F.lit(grain), F.col("tokens") - F.col("grain") * grain).alias("size"),
        )
    )
    per_round = grains.groupBy("round").agg(F.sum("size").alias("held"))
    begins = with_running_total(per_round, [F.col("round")], "held", "upto").select(
        "round", (F.col("upto") - F.col("held")).alias("begins")
    )
    order = Window.partitionBy("round").orderBy("source", "grain")
    return stored(
        grains.withColumn("inside", F.sum("size").over(order) - F.col("size"))
        .join(begins, "round")
        .select("source", "grain", (F.col("begins") + F.col("inside")).cast("bigint").alias("place")),
        "turns",
    )


def _in_turns(placed: DataFrame, turns: DataFrame, grain: int) -> DataFrame:
    """The tail's documents cut into the grains of their sources, at their places in the tail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, 200):
                rows, grains, begins, sizes, ids = [], [], [], [], []
                columns = (part[name].to_pylist() for name in ("at", "tokens", "ids"))
                for row, (at, tokens, packed) in enumerate(zip(*columns)):
                    width = len(packed) // tokens
                    for n in range(at // grain, (at + tokens - 1) // grain + 1):
                        begin, end = max(n * grain - at, 0), min((n + 1) * grain - at, tokens)
                        rows.append(row)
                        grains.append(n)
                        begins.append(begin)
                        sizes.append(end - begin)
                        ids.append(packed[begin * width : end * width])
                taken = part.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [
                        taken["id"], taken["source"], taken["queue"], taken["at"],
                        pa.array(begins, pa.int64()), pa.array(sizes, pa.int64()),
                        taken["doc_tokens"], pa.array(ids, pa.binary()), pa.array(grains, pa.int64()),
                    ],
                    names=[
                        "id", "source", "queue", "at", "begin", "tokens", "doc_tokens", "ids", "grain",
                    ],
                )

    kinds = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in placed.schema)
    inside = F.col("at") + F.col("begin") - F.col("grain") * grain
    return (
        placed.mapInArrow(run, f"{kinds}, grain bigint")
        .join(turns, ["source", "grain"])
        .withColumn("at", F.col("place") + inside)
        .select(*placed.columns)
    )


def _cut(state: Rounds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, 200):
                at, tokens, queue, begin = (
                    part[name].to_numpy().astype(np.int64)
                    for name in ("at", "tokens", "queue", "begin")
                )
                doc, start, length, place = state.pieces(at, tokens, queue)
                # The pieces in order are the ids in order, so they share one buffer.
                packed = b"".join(part["ids"].to_pylist())
                ids = np.frombuffer(packed, f"<u{len(packed) // tokens.sum()}").astype("<u4")
                ends = np.concatenate([[0], np.cumsum(length) * 4])
                yield pa.RecordBatch.from_arrays(
                    [
                        part["id"].take(pa.array(doc)),
                        pa.array(begin[doc] + start),
                        pa.array(length),
                        pa.LargeBinaryArray.from_buffers(
                            pa.large_binary(),
                            len(doc),
                            [None, pa.py_buffer(ends), pa.py_buffer(ids)],
                        ).cast(pa.binary()),
                        part["doc_tokens"].take(pa.array(doc)),
                        pa.array(place // state.window),
                        pa.array(place % state.window),
                    ],
                    names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

    return run
