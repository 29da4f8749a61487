"""Repair of conversation structure by a grammar-compressed dynamic programme.

A conversation becomes a string of symbols, one a turn: the initial of its role and its
fault. The cheapest edits that give a legal order of roles follow from one min-plus
transfer matrix a symbol, over the states of an automaton: cost and audit for each pair
of states. Re-Pair finds the pairs of symbols that occur most often over all
conversations and names each by a rule, round by round; a rule's matrix is the product
of its two parts' matrices, worked out once, bottom-up, and shared by all conversations.
An audit is a rope: a rule's audits only point to those of its parts. Equal strings of
different conversations are worked out once.

Edits and costs: Keep 0, Rerole to user or assistant 3, Delete 4 (required for blank and
duplicate turns), Insert of an empty user or assistant turn 3; a truncated turn that
stays adds 3. Initials of the repaired roles read ``(s?(ua)+)?``. Of equally cheap edits
the audit that is least in ASCII counts. Inserts belong to the turn after them, so the
audits of the same turns differ before either ends, and the order of two audits follows
from the order of their parts: no step compares texts of audits.

No conversation is gathered. Duplicates come from an aggregate over (conversation, role,
digest); equal turns are one row with a count; the order of turns is a range shuffle of
short rows, in which a long conversation spreads over many tasks and gives segments of
at most ``SEGMENT`` symbols. Texts move once, for the hash of the repaired conversation,
which is a stream: sorted rows pass through, nothing but the audit is held.

Defined results: a null id, role or text counts as one space, a null id is a conversation
too; null turns come first and are left out of gaps; turns of equal number are ordered by
role and then by the MD5 of the text; further columns are left out; an empty table gives
an empty result. ``gaps`` that no long can hold are null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countinghouse.llm.arrow import sliced
from countinghouse.session import stored

#: White space of the contract: blank turns hold nothing else.
SPACES = " \t\n\v\f\r"
ENDS = ".!?"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3

#: Symbols of a segment.
SEGMENT = 65_536
#: Rounds of Re-Pair and rules of a round. They bound the grammar, not what it is applied to.
ROUNDS, RULES = 8, 8
_FIRST_RULE = 0xE000  # Unicode's private use

INITIALS = "suao"  # o: any other
FAULTS = ("none", "truncated", "blank", "duplicate")
#: One letter for each initial and fault.
LETTERS = {
    (initial, fault): chr(ord("A") + n)
    for n, (initial, fault) in enumerate(product(INITIALS, FAULTS))
}

#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
NEXT = {
    (START, "s"): SYSTEM,
    (START, "u"): USER,
    (SYSTEM, "u"): USER,
    (USER, "a"): ASSISTANT,
    (ASSISTANT, "u"): USER,
}
ROLE = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}


def _wanted(state: int) -> str:
    """The initial that is inserted, or given to a turn, in a state."""
    return "a" if state == USER else "u"


def _inserts(state: int) -> dict[int, int]:
    """How many inserts lead to each state."""
    found, count = {state: 0}, 0
    while (after := NEXT[state, _wanted(state)]) not in found:
        state, count = after, count + 1
        found[state] = count
    return found


class Matrix:
    """What symbols do: for a state before them the states after them, best audit first.

    ``rows[before]`` maps each state after to (cost, rope), in the order of the audits. A
    rope is a text or a pair of ropes.
    """

    def __init__(self, rows: list[dict], counts: tuple, first: str, last: str):
        self.rows, self.counts, self.first, self.last = rows, counts, first, last

    def __mul__(self, other: Matrix) -> Matrix:
        rows = [step(row, other) for row in self.rows]
        illegal = int(self.last + other.first not in LEGAL)
        counts = tuple(a + b for a, b in zip(self.counts, other.counts))
        return Matrix(rows, (*counts[:3], counts[3] + illegal), self.first, other.last)


def step(row: dict, matrix: Matrix) -> dict:
    """A row of states, each with (cost, rope), carried on by a matrix."""
    best: dict = {}
    for place, (state, (cost, rope)) in enumerate(row.items()):
        for rank, (after, (more, added)) in enumerate(matrix.rows[state].items()):
            known = best.get(after)
            # Of equal costs the earlier place is less, and the first to come here.
            if known is None or cost + more < known[0]:
                best[after] = (cost + more, place, rank, (rope, added))
    ordered = sorted(best.items(), key=lambda item: item[1][1:3])
    return {after: (cost, rope) for after, (cost, _, _, rope) in ordered}


def terminal(initial: str, fault: str) -> Matrix:
    """The matrix of one turn: inserts, then one edit."""
    must_go = fault in ("blank", "duplicate")
    kept = TRUNCATED if fault == "truncated" else 0
    rows = []
    for before in STATES:
        best: dict[int, tuple[int, str]] = {}
        for state, count in _inserts(before).items():
            edits = [(state, DELETE, "D")]
            if not must_go:
                edits.append((NEXT[state, _wanted(state)], REROLE + kept, "R"))
                if (state, initial) in NEXT:
                    edits.append((NEXT[state, initial], KEEP + kept, "K"))
            for after, cost, letter in edits:
                found = (INSERT * count + cost, "I" * count + letter)
                best[after] = min(best.get(after, found), found)
        rows.append(dict(sorted(best.items(), key=lambda item: item[1][1])))
    counts = tuple(int(fault == name) for name in ("blank", "duplicate", "truncated"))
    return Matrix(rows, (*counts, 0), initial, initial)


def finished(row: dict) -> tuple[int, object]:
    """The cheapest legal end of a row of states: cost and rope."""
    ends = []
    for place, (state, (cost, rope)) in enumerate(row.items()):
        # A conversation ends where nothing came or after an assistant turn.
        more = 0 if state == START else _inserts(state)[ASSISTANT]
        ends.append((cost + INSERT * more, place, (rope, "I" * more)))
    cost, _, rope = min(ends, key=lambda end: end[:2])
    return cost, rope


def text_of(rope: object) -> str:
    """A rope as a text, without recursion."""
    out, waiting = [], [rope]
    while waiting:
        now = waiting.pop()
        if isinstance(now, str):
            out.append(now)
        else:
            waiting += now[::-1]
    return "".join(out)


class Grammar:
    """Rules of two symbols each, and the matrices of all symbols."""

    def __init__(self) -> None:
        self.rules: list[str] = []
        self.matrices = {
            letter: terminal(initial, fault) for (initial, fault), letter in LETTERS.items()
        }

    def add(self, pair: str) -> None:
        name = chr(_FIRST_RULE + len(self.rules))
        self.rules.append(pair)
        self.matrices[name] = self.matrices[pair[0]] * self.matrices[pair[1]]

    def written(self, symbols: Column) -> Column:
        """The symbols with all rules applied, in order."""
        for n, pair in enumerate(self.rules):
            symbols = F.replace(symbols, F.lit(pair), F.lit(chr(_FIRST_RULE + n)))
        return symbols


def re_pair(sequences: DataFrame, rounds: int = ROUNDS, rules: int = RULES) -> Grammar:
    """A grammar for the column ``symbols``: in each round the most frequent pairs that share
    no symbol become rules. The driver sees counts of pairs, at most 16 + 64 symbols squared."""
    grammar = Grammar()
    for _ in range(rounds):
        pair = F.explode(
            F.regexp_extract_all(grammar.written(F.col("symbols")), F.lit("(?=(..))"), 1)
        )
        counted = (
            sequences.select(pair.alias("pair"))
            .groupBy("pair")
            .count()
            .filter("count > 1")
            .orderBy(F.desc("count"), "pair")
            .limit(rules * rules)
            .collect()
        )
        taken: set[str] = set()
        for row in counted:
            if len(taken) < 2 * rules and not taken & set(row["pair"]):
                taken |= set(row["pair"])
                grammar.add(row["pair"])
        if not taken:
            break
    return grammar


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first.isin(*INITIALS[:3]), first).otherwise("o")


def _turns(
    given: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str
) -> DataFrame:
    space = F.lit(" ")
    return given.select(
        F.col(f"`{id_col}`").alias("conv"),
        F.col(f"`{turn_col}`").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`"), space).alias("role"),
        F.coalesce(F.col(f"`{text_col}`"), space).alias("text"),
    ).withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))


ORDER = ["conv", "turn", "role", "digest"]


def _marked(turns: DataFrame) -> DataFrame:
    """A row for each different turn: its ``symbol``, ``copies``, and the ``repeated`` symbol
    of its further copies."""
    end = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    own = (
        F.when(end == "", "blank").when(end.isin(*ENDS), "none").otherwise("truncated")
    )
    collapsed = stored(
        turns.groupBy(*ORDER, own.alias("fault")).agg(F.count(F.lit(1)).alias("copies")),
        "turns",
    )
    seen = (
        collapsed.groupBy(
            F.col("conv").alias("seen_conv"),
            F.col("role").alias("seen_role"),
            F.col("digest").alias("seen_digest"),
        )
        .agg(
            F.count(F.lit(1)).alias("times"),
            F.min("turn").alias("first_turn"),
            F.bool_or(F.col("turn").isNull()).alias("first_is_null"),
        )
        .filter("times > 1")
    )
    later = F.when(F.col("first_is_null"), F.col("turn").isNotNull()).otherwise(
        F.col("turn") > F.col("first_turn")
    )
    joined = collapsed.join(
        seen,
        F.col("conv").eqNullSafe(F.col("seen_conv"))
        & (F.col("role") == F.col("seen_role"))
        & (F.col("digest") == F.col("seen_digest")),
        "left",
    ).withColumn("initial", _initial(F.col("role")))
    fault = F.when(F.col("fault") == "blank", "blank").when(
        F.coalesce(later, F.lit(False)), "duplicate"
    )
    names = F.create_map(
        *(F.lit(x) for (i, f), letter in LETTERS.items() for x in (i + f, letter))
    )
    again = F.when(F.col("fault") == "blank", "blank").otherwise("duplicate")
    return joined.select(
        *ORDER,
        "copies",
        names[F.concat("initial", F.coalesce(fault, F.col("fault")))].alias("symbol"),
        names[F.concat("initial", again)].alias("repeated"),
    )


def _segmented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of symbols of one conversation in ordered rows, in parts of ``SEGMENT``."""
    part = TaskContext.get().partitionId()
    conv, n, symbols, kind = None, 0, [], None

    def segment() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([conv], kind),
                pa.array([part], pa.int32()),
                pa.array([n]),
                pa.array(["".join(symbols)]),
            ],
            names=["conv", "part", "n", "symbols"],
        )

    for batch in batches:
        kind = batch["conv"].type
        rows = zip(
            *(batch[x].to_pylist() for x in ("conv", "copies", "symbol", "repeated"))
        )
        for one, copies, symbol, repeated in rows:
            if symbols and one != conv:
                yield segment()
                n, symbols = n + 1, []
            conv = one
            symbols.append(symbol)
            left = copies - 1
            while left or len(symbols) >= SEGMENT:
                if len(symbols) >= SEGMENT:
                    yield segment()
                    n, symbols = n + 1, []
                added = min(left, SEGMENT - len(symbols))
                symbols += repeated * added
                left -= added
    if symbols:
        yield segment()


def segments(marked: DataFrame) -> DataFrame:
    """``conv``, the order ``part`` and ``n``, and ``symbols`` of each segment."""
    kind = marked.schema["conv"].dataType.simpleString()
    return (
        marked.repartitionByRange(*ORDER)
        .sortWithinPartitions(*ORDER)
        .mapInArrow(_segmented, f"conv {kind}, part int, n bigint, symbols string")
    )


COUNTS = ("blank", "duplicate", "truncated", "illegal")
_SOLVED = ", ".join(f"{name} bigint" for name in (*COUNTS, "cost")) + ", audit string"


def _solved(matrices: dict[str, Matrix], pieces: Iterator[str]) -> tuple:
    """Counts, cost and audit of a conversation whose written symbols come in pieces."""
    row, counts, last = {START: (0, "")}, [0] * 4, ""
    for piece in pieces:
        for symbol in piece:
            matrix = matrices[symbol]
            row = step(row, matrix)
            for n, more in enumerate(matrix.counts):
                counts[n] += more
            counts[3] += bool(last) and last + matrix.first not in LEGAL
            last = matrix.last
    cost, rope = finished(row)
    return (*counts, cost, text_of(rope))


def _audits(cut: DataFrame) -> DataFrame:
    """``conv``, counts, ``cost`` and ``audit`` of each conversation."""
    parts = cut.groupBy("conv").agg(F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    long = stored(parts.select(F.col("conv").alias("long_conv")), "long-conversations")
    is_long = F.col("conv").eqNullSafe(F.col("long_conv"))
    whole = cut.join(long, is_long, "left_anti")
    split = cut.join(long, is_long, "left_semi")
    sequences = stored(cut.select("symbols").distinct(), "sequences")
    grammar = re_pair(sequences)
    matrices = grammar.matrices
    kind = cut.schema["conv"].dataType.simpleString()
    names = [*COUNTS, "cost", "audit"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, 1_000):
                rows = [_solved(matrices, [x.as_py()]) for x in part["written"]]
                yield pa.RecordBatch.from_arrays(
                    [part["symbols"], *(pa.array(x) for x in zip(*rows))], ["shared", *names]
                )

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, rows in _grouped(batches, ("written",)):
            found = _solved(matrices, (row[0] for row in rows))
            yield pa.RecordBatch.from_arrays(
                [conv, *(pa.array([x]) for x in found)], ["conv", *names]
            )

    written = grammar.written(F.col("symbols")).alias("written")
    # The distinct sequences that a whole conversation has; longer ones are streamed below.
    shared = stored(
        whole.select("symbols").distinct().select("symbols", written).mapInArrow(
            each, f"shared string, {_SOLVED}"
        ),
        "solved",
    )
    short = whole.join(shared, F.col("symbols") == F.col("shared")).select("conv", *names)
    others = (
        split.select("conv", "part", "n", written)
        .repartition("conv")
        .sortWithinPartitions("conv", "part", "n")
        .mapInArrow(streamed, f"conv {kind}, {_SOLVED}")
    )
    return stored(short.unionByName(others), "audits")


def _grouped(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]):
    """(an array of the conversation's id, its rows) one after the other from sorted rows; rows
    are a stream that must be read to its end."""
    kind = None

    def flat():
        nonlocal kind
        for batch in batches:
            kind = batch["conv"].type
            for part in sliced(batch, 1_000):
                yield from zip(part["conv"].to_pylist(), *(part[x].to_pylist() for x in columns))

    rows = flat()
    waiting = next(rows, None)
    while waiting is not None:
        conv = waiting[0]

        def own():
            nonlocal waiting
            while waiting is not None and waiting[0] == conv:
                now, waiting = waiting, next(rows, None)
                yield now[1:]

        yield pa.array([conv], kind), own()


def repaired(audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The turns (role, text) after the edits that the audit names."""
    state = START
    for letter in audit:
        role, text = next(turns) if letter != "I" else ("", "")
        if letter == "D":
            continue
        initial = role[:1] if letter == "K" else _wanted(state)
        state = NEXT[state, initial]
        yield (role if letter == "K" else ROLE[initial]), text


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [*COUNTS, "cost"]
    for conv, rows in _grouped(batches, ("role", "text", *names)):
        _, audit, *counts = next(rows)  # the audit comes first
        own, between = hashlib.sha256(), b""
        for role, text in repaired(audit, ((row[0], row[1]) for row in rows)):
            own.update(between + f"{role}:{text}".encode())
            between = b"\n"
        for _ in rows:  # none is left, unless the audit were wrong
            raise ValueError("more turns than edits")
        yield pa.RecordBatch.from_arrays(
            [conv, *(pa.array([x]) for x in (*counts, audit, own.hexdigest()))],
            ["conv", *names, "audit", "repaired_sha256"],
        )


def repair(
    given: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row for each conversation: ``id_col``, ``gaps``, ``blank``, ``duplicate``,
    ``truncated``, ``illegal``, ``cost``, ``audit`` and ``repaired_sha256``."""
    turns = _turns(given, id_col, turn_col, role_col, text_col)
    marked = _marked(turns)
    cut = stored(segments(marked), "segments")
    audits = _audits(cut)
    return _digests(turns, audits, id_col)


def _digests(turns: DataFrame, audits: DataFrame, id_col: str) -> DataFrame:
    decimal = "decimal(38,0)"
    wide = (
        F.max("turn").cast(decimal) - F.min("turn").cast(decimal) + 1 - F.count_distinct("turn")
    )
    gaps = turns.groupBy(F.col("conv").alias("gap_conv")).agg(
        F.when(F.count("turn") == 0, 0).otherwise(wide.try_cast("bigint")).alias("gaps")
    )
    nothing = {name: F.lit(None).cast("bigint") for name in (*COUNTS, "cost")}
    heads = audits.select(
        "conv",
        F.lit(0).alias("kind"),
        F.lit(None).cast(turns.schema["turn"].dataType).alias("turn"),
        F.lit("").alias("role"),
        F.lit(None).cast("binary").alias("digest"),
        F.col("audit").alias("text"),
        *(F.col(name) for name in nothing),
    )
    rows = turns.select(
        "conv",
        F.lit(1).alias("kind"),
        "turn",
        "role",
        "digest",
        "text",
        *(value.alias(name) for name, value in nothing.items()),
    )
    kind = turns.schema["conv"].dataType.simpleString()
    hashed = (
        heads.unionByName(rows)
        .repartition("conv")
        .sortWithinPartitions("conv", "kind", "turn", "role", "digest")
        .select("conv", "role", "text", *COUNTS, "cost")
        .mapInArrow(
            _hashed,
            f"conv {kind}, {', '.join(f'{x} bigint' for x in (*COUNTS, 'cost'))},"
            " audit string, repaired_sha256 string",
        )
    )
    return hashed.join(gaps, F.col("conv").eqNullSafe(F.col("gap_conv"))).select(
        F.col("conv").alias(id_col), "gaps", *COUNTS, "cost", "audit", "repaired_sha256"
    )
