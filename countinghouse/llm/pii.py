"""Personal data: proposals by generators, chosen by boosted trees.

The base spans of each kind come from its pattern and its check. Beside them,
generators of high recall propose overlapping spans: any run of number groups with as
many digits as a card or a telephone number has, any address-like text around ``@`` or
a spelled-out "at". Boosted trees score each proposal by its format and what stands
around it; where the score reaches its kind's threshold the span is added, better
ones first, unless it overlaps a span already there. So a card next to a telephone
number is found though the pattern takes both as one number.

Training needs no labelled table: base spans are right, other proposals around them
wrong; snippets where two spans touch or a span is written differently, made from the
same base spans, show what the patterns miss. It uses the base spans of at most
``MAX_TRAIN`` documents. A kind's threshold is the lowest score that had at least
``PRECISION`` on snippets kept apart, lowered half-way to the next; a kind without such a score gets no more spans.

Defined results: a null or empty text has no spans; repeated rows get equal results;
an empty table gives an empty result; further columns are left out, or kept as they are
by ``redact``.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from ipaddress import IPv6Address, ip_address

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countinghouse.llm.arrow import sliced, texts_of
from countinghouse.llm.boosting import Boosted, boost
from countinghouse.llm.sampling import smallest_hashes

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
MAX_TRAIN = 40_000
PRECISION = 0.98
#: Characters of context on each side.
CONTEXT = 32
#: Spans and snippets for training that come to the driver at most.
MAX_SPANS = 8_000
#: Snippets are made of as many spans at least, of each several times if there are fewer.
VARIED = 1_000

Span = tuple[int, int, int]

# The base patterns. Each start is only tried where a run begins, and an
# address is sought from its "@", which finds the same leftmost matches in linear time.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Found in every text that any pattern or generator here finds something in.
_MAY_HOLD = re.compile(
    r"[0-9@]|[\[(] ?(?:at|dot) ?[\])]| dot | at (?=[\w-]{1,63}\.[a-z]{2})|[a-fA-F]:[a-fA-F]{1,4}:"
)
_AREA = re.compile(r"[0-9](?:[\x20()./-]{0,3}[0-9])*")
_RUN = re.compile(r"[0-9]+")
_AT = re.compile(
    r"@|\x20?[\[(]\x20?at\x20?[\])]\x20?"
    r"|\x20at\x20(?=[\w-]{1,63}(?:\.|\x20?[\[(]\x20?dot\x20?[\])]\x20?|\x20dot\x20)[a-z]{2})"
)
_BEFORE_AT = re.compile(r"[\w.%+-]{1,64}\Z")
_AFTER_AT = re.compile(
    r"[\w-]{1,63}(?:(?:\.|\x20?[\[(]\x20?dot\x20?[\])]\x20?|\x20dot\x20)[\w-]{1,63}){1,8}"
)
_IPV6 = re.compile(r"(?<![\w:])[0-9a-fA-F:]{2,39}(?![\w:])")
#: Words before a span that hint at a kind, and ones that hint at another number.
_HINTS = (
    re.compile(r"mail|contact|write|address", re.I),
    re.compile(r"\bip\b|host|server|addr", re.I),
    re.compile(r"card|visa|master|amex|credit|payment", re.I),
    re.compile(r"tel|phone|call|mobile|cell|fax", re.I),
    re.compile(
        r"version|\bv\b|isbn|order|invoice|\bid\b|\bno\b|token|password|key|=\s*\"?\Z", re.I
    ),
)


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) << (place & 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_RUN.findall(text))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        else:
            done = max(done, at + 1)
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """The base spans by start, then kind."""
    found = [(a, b, EMAIL) for a, b in _emails(text)] if "@" in text else []
    for match in _IP.finditer(text):
        parts = [part.lstrip("0") or "0" for part in match[0].split(".")]
        if all(len(part) <= 3 and int(part) <= 255 for part in parts):
            found.append((*match.span(), IP))
    for match in _CARD.finditer(text):
        digits = _digits(match[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((*match.span(), CARD))
    if "+" in text:
        for match in _PHONE.finditer(text):
            if 10 <= len(_digits(match[0])) <= 15:
                found.append((*match.span(), PHONE))
    return sorted(found, key=lambda x: (x[0], x[2]))


def proposals(text: str) -> list[Span]:
    """Spans that may be personal data; they overlap."""
    found: set[Span] = set()
    for area in _AREA.finditer(text):
        runs = [m.span() for m in _RUN.finditer(text, *area.span())]
        for first, (start, _) in enumerate(runs):
            count = 0
            for last in range(first, len(runs)):
                count += runs[last][1] - runs[last][0]
                if count > 19:
                    break
                end = runs[last][1]
                if 12 <= count:
                    found.add((start, end, CARD))
                if 7 <= count <= 15:
                    begin = start
                    while begin and text[begin - 1] in "(+" and start - begin < 2:
                        begin -= 1
                    found.add((begin, end, PHONE))
                if last - first == 3 and text[start:end].count(".") == 3 and count <= 12:
                    found.add((start, end, IP))
    # Anything like an IPv6 address, clock times and hardware addresses too.
    for match in _IPV6.finditer(text) if ":" in text else ():
        if match[0].count(":") > 1 and _RUN.search(match[0]):
            found.add((*match.span(), IP))
    for sign in _AT.finditer(text):
        before = _BEFORE_AT.search(text, max(0, sign.start() - 64), sign.start())
        after = _AFTER_AT.match(text, sign.end())
        if before and after:
            found.add((before.start(), after.end(), EMAIL))
    return sorted(found)


def _is_ipv6(body: str) -> bool:
    try:
        return isinstance(ip_address(body), IPv6Address)
    except ValueError:
        return False


def _kind_of(char: str) -> int:
    if not char:
        return 0
    return 1 if char.isspace() else 2 if char.isdigit() else 3 if char.isalpha() else 4


def features(text: str, span: Span) -> list[float]:
    """Format and context of a proposal."""
    start, end, kind = span
    body = text[start:end]
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    runs = _RUN.findall(body)
    digits = "".join(runs)
    lengths = [len(x) for x in runs] or [0]
    tail = re.split(r"[^\w]+", body)[-1]
    return [
        *(float(kind == n) for n in range(4)),
        len(body),
        len(digits),
        len(runs),
        max(lengths),
        min(lengths),
        lengths[0],
        lengths[-1],
        *(body.count(sign) for sign in " .-/(:@"),
        body.startswith("+"),
        body.startswith("("),
        body.count(")") - body.count("("),
        sum(map(str.isalpha, body)),
        len(tail) if tail.isalpha() else 0,
        float(digits[:1] or -1),
        luhn(digits) if kind == CARD else 0,
        all(int(x) <= 255 for x in runs) if kind == IP and max(lengths) <= 3 else 0,
        _is_ipv6(body) if kind == IP else 0,
        _kind_of(before[-1:]),
        _kind_of(before.rstrip(" (+.-/")[-1:]),
        before[-1:] in ("+", ".", "-", "/", "(", ":"),
        _kind_of(after[:1]),
        _kind_of(after.lstrip(" ).-/")[:1]),
        after[:1] in (".", "-", "/", ":", ")") and after[1:2].isdigit(),
        *(bool(hint.search(before[-20:])) for hint in _HINTS),
    ]


WIDTH = len(features("1", (0, 1, 0)))
#: Proposals that are scored at once.
SCORED = 20_000


class Held:
    """The places of a text that spans hold, as disjoint stretches in order."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.stops: list[int] = []
        for start, stop, _ in sorted(spans):
            if self.stops and start < self.stops[-1]:
                self.stops[-1] = max(self.stops[-1], stop)
            else:
                self.starts.append(start)
                self.stops.append(stop)

    def free(self, span: Span) -> bool:
        at = bisect_left(self.starts, span[1])
        return not at or self.stops[at - 1] <= span[0]

    def take(self, span: Span) -> None:
        """Hold a free span too."""
        insort(self.starts, span[0])
        insort(self.stops, span[1])


@dataclass
class Detector:
    """Trees and a threshold by kind."""

    trees: Boosted | None
    thresholds: tuple[float, ...]

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """Base spans, and all spans, by start, then kind."""
        if not _MAY_HOLD.search(text):
            return [], []
        base = base_spans(text)
        held = Held(base)
        offered = [x for x in proposals(text) if held.free(x)] if self.trees else []
        if not offered:
            return base, base
        scores = np.concatenate(
            [
                self.trees.chance(
                    np.array([features(text, x) for x in offered[n : n + SCORED]], float)
                )
                for n in range(0, len(offered), SCORED)
            ]
        )
        likely = [n for n, x in enumerate(offered) if scores[n] >= self.thresholds[x[2]]]
        spans = [offered[n] for n in likely]
        chosen = [spans[n] for n in best_first(scores[likely].tolist(), spans)]
        return base, sorted(base + chosen, key=lambda x: (x[0], x[2]))


def _snippets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each base span with its surroundings."""
    for batch in batches:
        out = []
        for text in batch["text"]:
            text = text.as_py()
            if not _MAY_HOLD.search(text):
                continue
            for start, end, kind in base_spans(text):
                before = text[max(0, start - CONTEXT) : start]
                out.append((kind, before, text[start:end], text[end : end + CONTEXT]))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([x[0] for x in out], pa.int32()),
                *(pa.array([x[n] for x in out], pa.string()) for n in (1, 2, 3)),
            ],
            names=["kind", "before", "body", "after"],
        )


def _ipv6(random: np.random.Generator) -> str:
    """An address, written out or shortened."""
    groups = [f"{x:x}" for x in random.integers(0, 1 << 16, 8)]
    form = random.integers(4)
    if form == 0:
        return ":".join(x.zfill(4) for x in groups)
    if form == 1:
        return ":".join(groups)
    # A run of zeros is left out, at least two groups.
    first, last = random.integers(1, 4), random.integers(1, 4)
    return ("2001:db8" if random.integers(2) else ":".join(groups[:first])) + "::" + ":".join(
        groups[8 - last :] if form == 2 else ["1"]
    )


def rewritten(kind: int, body: str, random: np.random.Generator) -> str:
    """The same data as the patterns don't expect it."""
    digits = _digits(body)
    if kind == EMAIL:
        sign = (" (at) ", "[at]", " at ", " [at] ", "(at)")[random.integers(5)]
        dot = (".", " dot ", " [dot] ", "[dot]", " (dot) ")[random.integers(5)]
        name, _, domain = body.partition("@")
        if random.integers(2):  # names without figures are as good
            name = re.sub(r"[0-9]", "", name).strip("._-+%") or name
        return f"{name}{sign}{domain.replace('.', dot)}"
    if kind == IP:
        return _ipv6(random)
    if kind == CARD:
        sign = (" ", "-", ".", "")[random.integers(4)]
        return sign.join(digits[n : n + 4] for n in range(0, len(digits), 4))
    local = digits[-10:]
    form = ("({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}")[random.integers(4)]
    return form.format(local[:3], local[3:6], local[6:])


def spoiled(kind: int, body: str, random: np.random.Generator) -> str:
    """Something of the same look that is no such data."""
    digits = _digits(body)
    if kind == EMAIL:
        name, _, domain = body.partition("@")
        form = random.integers(3)
        return body.replace("@", " ") if form else f"{name} at {domain.partition('.')[0]}"
    if kind == IP:
        form = random.integers(4)
        if form == 0:  # a hardware address
            return ":".join(f"{x:02x}" for x in random.integers(0, 256, 6))
        if form == 1:  # clock times and the like
            return ":".join(f"{x:02d}" for x in random.integers(0, 60, random.integers(3, 8)))
        parts = body.split(".")
        parts[random.integers(len(parts))] = str(random.integers(256, 1000))
        return ".".join(parts)
    if kind == CARD:
        return digits[:-1] + str((int(digits[-1]) + random.integers(1, 10)) % 10)
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}"


@dataclass
class Examples:
    """Proposals of snippets: features, whether right, spans, and the snippet of each."""

    inputs: np.ndarray
    right: np.ndarray
    spans: list[Span]
    snippets: np.ndarray


def examples(rows: list[dict]) -> Examples:
    """The proposals in and behind the given base spans, as found, touching another span,
    written differently, and spoiled."""
    random = np.random.default_rng(0)
    inputs, right, spans, snippets = [], [], [], []
    # Few spans are varied more often.
    for row in rows * max(1, VARIED // max(1, len(rows))):
        kind, body, before, after = row["kind"], row["body"], row["before"], row["after"]
        other = rows[random.integers(len(rows))]
        between = (" ", " ", ", ", " / ")[random.integers(4)]
        for parts in (
            [(body, kind), (after, None)],
            [(body, kind), (between, None), (other["body"], other["kind"]), (other["after"], None)],
            [(rewritten(kind, body, random), kind), (after, None)],
            [(spoiled(kind, body, random), None), (after, None)],
        ):
            known, text = set(), before
            for part, marked in parts:
                at = len(text)
                if marked is not None:
                    known.add((at, at + len(part), marked))
                else:  # what stands around may be personal data too
                    known |= {(at + a, at + b, k) for a, b, k in base_spans(part)}
                text += part
            number = snippets[-1] + 1 if snippets else 0
            for span in proposals(text):
                if len(before) < span[1] < len(text) or span[1] == len(text) and not after:
                    inputs.append(features(text, span))
                    right.append(span in known)
                    spans.append(span)
                    snippets.append(number)
    return Examples(
        np.array(inputs, float).reshape(-1, WIDTH),
        np.array(right, float),
        spans,
        np.array(snippets),
    )


def best_first(scores: list[float], spans: list[Span]) -> list[int]:
    """Places of the spans that overlap no better one."""
    chosen, held = [], Held([])
    for n in sorted(range(len(spans)), key=lambda n: (-scores[n], spans[n])):
        if held.free(spans[n]):
            held.take(spans[n])
            chosen.append(n)
    return chosen


def fit(rows: list[dict]) -> Detector:
    if len(rows) < 20:
        return Detector(None, (2.0,) * 4)
    apart = len(rows) // 4
    seen, kept = examples(rows[apart:]), examples(rows[:apart])
    trees = boost(seen.inputs, seen.right)
    scores = trees.chance(kept.inputs)
    borders = np.flatnonzero(np.diff(kept.snippets)) + 1
    chosen = [
        int(group[n])
        for group in np.split(np.arange(len(scores)), borders)
        for n in best_first(scores[group].tolist(), [kept.spans[x] for x in group])
    ]
    thresholds = []
    for kind in range(len(KINDS)):
        own = np.array([n for n in chosen if kept.spans[n][2] == kind], int)
        own = own[np.argsort(-scores[own], kind="stable")]
        known, right = scores[own], kept.right[own]
        precise = np.cumsum(right) >= PRECISION * np.arange(1, len(right) + 1)
        precise[:-1] &= known[:-1] != known[1:]  # equal scores stand or fall together
        at = np.flatnonzero(precise)
        # Half-way to the next lower score, the first that would be one mistake too many.
        lower = known[at[-1] + 1 : at[-1] + 2] if len(at) else []
        least = (known[at[-1]] + lower[0]) / 2 if len(lower) else 0.5
        thresholds.append(max(0.5, float(least)) if len(at) else 2.0)
    return Detector(trees, tuple(thresholds))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Detector:
    """A detector from the base spans of the ``MAX_TRAIN`` documents with the smallest
    hashes of their ids; at most ``MAX_SPANS`` spans with context come to the driver."""
    given = texts_of(docs, id_col, text_col)
    ids = smallest_hashes(given.select("id"), MAX_TRAIN)
    rows = (
        given.join(ids, "id", "left_semi")
        .select("text")
        .mapInArrow(_snippets, "kind int, before string, body string, after string")
        .orderBy(F.xxhash64("before", "body", "after"), "before", "body", "after")
        .limit(MAX_SPANS)
        .collect()
    )
    return fit([row.asDict() for row in rows])


def detect(
    docs: DataFrame, detector: Detector, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col``, ``base`` and ``spans`` of each row: arrays of kind, start and end in
    code points, ordered by start, then kind."""
    spread = docs.sparkSession.sparkContext.broadcast(detector)  # of fixed size
    kind = pa.list_(
        pa.struct({"kind": pa.string(), "start": pa.int64(), "stop": pa.int64()})
    )

    def rows(spans: list[Span]) -> list[dict]:
        return [{"kind": KINDS[k], "start": a, "stop": b} for a, b, k in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, 1_000):
                found = [spread.value.spans(text) for text in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part["id"],
                        pa.array([rows(x) for x, _ in found], kind),
                        pa.array([rows(x) for _, x in found], kind),
                    ],
                    names=["id", "base", "spans"],
                )

    given = texts_of(docs, id_col, text_col)
    spans = "array<struct<kind: string, start: bigint, stop: bigint>>"
    return given.mapInArrow(
        run, f"id {given.schema['id'].dataType.simpleString()}, base {spans}, spans {spans}"
    ).withColumnRenamed("id", id_col)


def without(text: str, spans: list[Span]) -> str:
    """The text with each run of overlapping spans replaced by the kind of its first."""
    out, at, end = [], 0, -1
    for start, stop, kind in spans:
        if start >= end:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        end = at = max(end, stop)
    return "".join([*out, text[at:]])


def redact(
    docs: DataFrame,
    detector: Detector | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with every span replaced by its kind in square brackets."""
    spread = docs.sparkSession.sparkContext.broadcast(
        detector or train(docs, id_col, text_col)
    )
    column = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                text and without(text, spread.value.spans(text)[1])
                for text in batch.column(column).to_pylist()
            ]
            arrays = list(batch.columns)
            arrays[column] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
