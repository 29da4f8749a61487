"""License scan: sentences to identifiers, identifier sequences to ordered rules.

A text is cut into sentences, each normalised to lower-case words with single blanks.
A sentence that belongs to a license is recognised by its whole normal form and known
by an identifier; where a wrapped line, a semicolon or an abbreviation cut it, its pieces
are taken together. Comment marks are no words. A notice with a subject, the name of a
license in one of its usual forms and a reference is known by the license it names, a line
of source code by its SPDX expression. The identifiers of a document, in order and with at
most ``max_gap`` unknown pieces between them, are matched against the rules from left to
right: at each place the first rule of the list whose sequence follows is taken, so rules
are ordered from the most to the least specific, and matching goes on behind it.

Defined results: a null or empty text has no match; repeated rows each give their
matches; an empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countinghouse.llm.arrow import sliced

_GRANT = "you can redistribute it and or modify it under the terms of the gnu"
_LATER = "of the license or at your option any later version"

# Sentences of public licenses in their normal form, by identifier.
SENTENCES = {
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "the mit license": "mit-title",
    "mit license": "mit-title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software"
    " and associated documentation files the software to deal in the software without"
    " restriction including without limitation the rights to use copy modify merge publish"
    " distribute sublicense and or sell copies of the software and to permit persons to whom the"
    " software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or"
    " substantial portions of the software": "mit-condition",
    "the software is provided as is without warranty of any kind express or implied including but"
    " not limited to the warranties of merchantability fitness for a particular purpose and"
    " noninfringement": "mit-disclaimer",
    "licensed under the apache license version 2 0": "apache-2-notice",
    "licensed under the apache license version 2 0 the license": "apache-2-notice",
    "apache license version 2 0": "apache-2-title",
    "you may not use this file except in compliance with the license": "apache-2-compliance",
    "you may obtain a copy of the license at": "apache-2-copy",
    "unless required by applicable law or agreed to in writing software distributed under the"
    " license is distributed on an as is basis without warranties or conditions of any kind"
    " either express or implied": "apache-2-disclaimer",
    "this work is licensed under the gnu general public license version 3": "gpl-3-notice",
    "licensed under the gnu general public license version 3": "gpl-3-notice",
    "gnu general public license version 3": "gpl-3-title",
    "this program is free software you can redistribute it and or modify it under the terms of"
    " the gnu general public license as published by the free software foundation either"
    " version 3 of the license or at your option any later version": "gpl-3-later-grant",
    "this program is free software you can redistribute it and or modify it under the terms of"
    " the gnu general public license as published by the free software foundation either"
    " version 2 of the license or at your option any later version": "gpl-2-later-grant",
    "this program is free software you can redistribute it and or modify it under the terms of"
    " the gnu general public license version 2 as published by the free software"
    " foundation": "gpl-2-grant",
    "gnu general public license version 2": "gpl-2-title",
    **{
        f"this {thing} is free software {_GRANT} {kind} general public license as published by the"
        f" free software foundation either version {version} {_LATER}": f"{name}-later-grant"
        for thing in ("program", "library", "software")
        for kind, version, name in (
            ("lesser", "2 1", "lgpl-2.1"),
            ("lesser", "3", "lgpl-3"),
            ("affero", "3", "agpl-3"),
        )
    },
    "this library is distributed in the hope that it will be useful but without any warranty"
    " without even the implied warranty of merchantability or fitness for a particular"
    " purpose": "gnu-disclaimer",
    "this source code form is subject to the terms of the mozilla public license v 2"
    " 0": "mpl-2-notice",
    "mozilla public license version 2 0": "mpl-2-title",
    "distributed under the boost software license version 1 0": "boost-notice",
    "boost software license version 1 0": "boost-title",
    "permission to use copy modify and or distribute this software for any purpose with or without"
    " fee is hereby granted provided that the above copyright notice and this permission notice"
    " appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without"
    " fee is hereby granted provided that the above copyright notice and this permission notice"
    " appear in all copies": "isc-grant",
    "permission is granted to anyone to use this software for any purpose including commercial"
    " applications and to alter it and redistribute it freely subject to the following"
    " restrictions": "zlib-grant",
    "neither the name of the copyright holder nor the names of its contributors may be used to"
    " endorse or promote products derived from this software without specific prior written"
    " permission": "bsd-names",
    "licensed under cc0 1 0": "cc0-notice",
    "licensed under cc by nd 4 0": "cc-by-nd-4-notice",
    "licensed under cc by nc sa 4 0": "cc-by-nc-sa-4-notice",
    "licensed under cc by nc nd 4 0": "cc-by-nc-nd-4-notice",
    "this program is distributed in the hope that it will be useful but without any warranty"
    " without even the implied warranty of merchantability or fitness for a particular"
    " purpose": "gnu-disclaimer",
    "redistribution and use in source and binary forms with or without modification are permitted"
    " provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of"
    " conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of"
    " conditions and the following disclaimer in the documentation and or other materials"
    " provided with the distribution": "bsd-binary",
    "licensed under cc by nc 4 0": "cc-by-nc-4-notice",
    "licensed under cc by 4 0": "cc-by-4-notice",
    "licensed under cc by sa 4 0": "cc-by-sa-4-notice",
    "this work is licensed under a creative commons attribution 4 0 international"
    " license": "cc-by-4-notice",
    "this work is licensed under a creative commons attribution sharealike 4 0 international"
    " license": "cc-by-sa-4-notice",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international"
    " license": "cc-by-nc-4-notice",
    "this is free and unencumbered software released into the public domain": "unlicense-grant",
    "all rights reserved": "all-rights-reserved",
}

#: Sentences with a name in them: begin, end, identifier.
SLOTS = [
    (
        "neither the name of",
        "may be used to endorse or promote products derived from this software without specific"
        " prior written permission",
        "bsd-names",
    ),
    (
        "the name of",
        "may not be used to endorse or promote products derived from this software without specific"
        " prior written permission",
        "bsd-names",
    ),
]
#: Words that such a name, with what belongs to it, has at most.
SLOT_WORDS = 25

#: Identifiers that a line of source code may give.
SPDX = (
    "MIT Apache-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only"
    " LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later"
    " BSD-2-Clause BSD-3-Clause MPL-2.0 ISC Zlib BSL-1.0 Unlicense CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0"
).split()
SPDX_WORDS = "spdx license identifier"
SENTENCES |= {
    f"{SPDX_WORDS} {re.sub('[^a-z0-9]+', ' ', name.lower())}": f"spdx-{name}" for name in SPDX
}

#: Others that occur in expressions, and what may follow ``WITH``.
SPDX_OTHER = (
    "GPL-2.0 GPL-3.0 LGPL-2.1 LGPL-3.0 AGPL-3.0 EPL-2.0 0BSD CC-BY-NC-4.0 CC-BY-NC-SA-4.0"
).split()
SPDX_EXCEPTIONS = (
    "Classpath-exception-2.0 GCC-exception-3.1 LLVM-exception Linux-syscall-note"
).split()
EXPRESSION = "spdx-expression"

# Names of licenses in notices, in normal form.
NAMES = {
    "mit": "MIT",
    "bsd 3 clause": "BSD-3-Clause",
    "3 clause bsd": "BSD-3-Clause",
    "new bsd": "BSD-3-Clause",
    "modified bsd": "BSD-3-Clause",
    "bsd 2 clause": "BSD-2-Clause",
    "2 clause bsd": "BSD-2-Clause",
    "simplified bsd": "BSD-2-Clause",
    "isc": "ISC",
    "zlib": "Zlib",
    "unlicense": "Unlicense",
}
#: Names that need a version: the name's forms, the version, the license.
VERSIONED = [
    (("apache", "apache software"), "2 0", "Apache-2.0"),
    (("mozilla public", "mpl"), "2 0", "MPL-2.0"),
    (("eclipse public", "epl"), "2 0", "EPL-2.0"),
    (("boost software", "bsl"), "1 0", "BSL-1.0"),
    (("gnu general public", "gnu gpl", "gpl"), "2", "GPL-2.0"),
    (("gnu general public", "gnu gpl", "gpl"), "3", "GPL-3.0"),
    (("gnu lesser general public", "gnu lgpl", "lgpl"), "2 1", "LGPL-2.1"),
    (("gnu lesser general public", "gnu lgpl", "lgpl"), "3", "LGPL-3.0"),
    (("gnu affero general public", "gnu agpl", "agpl"), "3", "AGPL-3.0"),
]
LATER = (" or later", " or any later version", " or at your option any later version")


def _versions(version: str) -> list[str]:
    whole = version.removesuffix(" 0")
    numbers = {version, whole, f"{whole} 0"} if " " not in whole else {version}
    return [f"{mark}{number}" for mark in ("", "version ", "v", "v ") for number in numbers]


def notice_names() -> dict[str, str]:
    """The licenses that a notice may name, by the whole normal form of the name."""
    known = {}
    for name, license_ in NAMES.items():
        known |= {f"{name}{word}": license_ for word in ("", " license", " licence")}
    for forms, version, license_ in VERSIONED:
        gnu = "GPL" in license_
        for name in forms:
            for number in _versions(version):
                for word in (" license ", " licence ", " "):
                    known[f"{name}{word}{number}"] = f"{license_}-only" if gnu else license_
                    for later in LATER if gnu else ():
                        known[f"{name}{word}{number}{later}"] = f"{license_}-or-later"
                known |= {
                    f"{name} {number}{word}": license_ for word in (" license", " licence") if not gnu
                }
            if gnu and " " not in name:
                known[f"{name}v{version}"] = f"{license_}-only"
    return known


NOTICE_NAMES = notice_names()
_NOTICE = re.compile(
    r"\b(?:licensed|released|distributed|available|published|provided) under (?:either )?"
    r"(?:the )?(?:terms (?:and conditions )?of )?(?:the )?"
    f"({'|'.join(sorted(NOTICE_NAMES, key=len, reverse=True))})"
    r"(?= |$)(?: licen[sc]e)?((?: (?:see|which|the license|a copy|as found|in)\b.*)?)$"
)
#: Words that the subject of a notice, and the reference behind the name, have at most.
NOTICE_WORDS = 25
#: Unknown pieces between two sentences of a rule, at most.
MAX_GAP = 20

# Titles of license texts with the date below them.
SENTENCES |= {
    "gnu general public license version 3 29 june 2007": "gpl-3-title",
    "gnu general public license version 2 june 1991": "gpl-2-title",
    "gnu lesser general public license version 3 29 june 2007": "lgpl-3-title",
    "gnu lesser general public license version 2 1 february 1999": "lgpl-2.1-title",
    "gnu affero general public license version 3 19 november 2007": "agpl-3-title",
    "eclipse public license v 2 0": "epl-2-title",
}

# Ordered rules: sequence of sentence identifiers, then the license it shows.
RULES = [
    (("mit-title", "mit-grant", "mit-condition", "mit-disclaimer"), "MIT"),
    (("mit-title", "mit-grant", "mit-condition"), "MIT"),
    (("mit-grant", "mit-condition", "mit-disclaimer"), "MIT"),
    (("mit-grant", "mit-condition"), "MIT"),
    (
        ("apache-2-notice", "apache-2-compliance", "apache-2-copy", "apache-2-disclaimer"),
        "Apache-2.0",
    ),
    (("apache-2-notice", "apache-2-compliance"), "Apache-2.0"),
    (("gpl-3-later-grant", "gnu-disclaimer"), "GPL-3.0-or-later"),
    (("gpl-2-later-grant", "gnu-disclaimer"), "GPL-2.0-or-later"),
    (
        ("all-rights-reserved", "bsd-grant", "bsd-source", "bsd-binary", "bsd-names"),
        "BSD-3-Clause",
    ),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-names"), "BSD-3-Clause"),
    (("all-rights-reserved", "bsd-grant", "bsd-source", "bsd-binary"), "BSD-2-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary"), "BSD-2-Clause"),
    (("lgpl-2.1-later-grant", "gnu-disclaimer"), "LGPL-2.1-or-later"),
    (("lgpl-3-later-grant", "gnu-disclaimer"), "LGPL-3.0-or-later"),
    (("agpl-3-later-grant", "gnu-disclaimer"), "AGPL-3.0-or-later"),
    (("gpl-2-grant", "gnu-disclaimer"), "GPL-2.0-only"),
    (("mit-notice",), "MIT"),
    (("mit-grant",), "MIT"),
    (("mit-title",), "MIT"),
    (("apache-2-notice",), "Apache-2.0"),
    (("apache-2-title",), "Apache-2.0"),
    (("gpl-3-notice",), "GPL-3.0-only"),
    (("gpl-3-title",), "GPL-3.0-only"),
    (("gpl-3-later-grant",), "GPL-3.0-or-later"),
    (("gpl-2-later-grant",), "GPL-2.0-or-later"),
    (("cc-by-nc-4-notice",), "CC-BY-NC-4.0"),
    (("cc-by-sa-4-notice",), "CC-BY-SA-4.0"),
    (("cc-by-4-notice",), "CC-BY-4.0"),
    (("gpl-2-grant",), "GPL-2.0-only"),
    (("gpl-2-title",), "GPL-2.0-only"),
    (("lgpl-2.1-later-grant",), "LGPL-2.1-or-later"),
    (("lgpl-3-later-grant",), "LGPL-3.0-or-later"),
    (("agpl-3-later-grant",), "AGPL-3.0-or-later"),
    (("mpl-2-notice",), "MPL-2.0"),
    (("mpl-2-title",), "MPL-2.0"),
    (("boost-notice",), "BSL-1.0"),
    (("boost-title",), "BSL-1.0"),
    (("isc-grant",), "ISC"),
    (("zlib-grant",), "Zlib"),
    (("cc0-notice",), "CC0-1.0"),
    (("cc-by-nd-4-notice",), "CC-BY-ND-4.0"),
    (("cc-by-nc-sa-4-notice",), "CC-BY-NC-SA-4.0"),
    (("cc-by-nc-nd-4-notice",), "CC-BY-NC-ND-4.0"),
    *(((f"spdx-{name}",), name) for name in SPDX),
    (("unlicense-grant",), "Unlicense"),
    (("all-rights-reserved",), "LicenseRef-All-Rights-Reserved"),
    (("lgpl-3-title",), "LGPL-3.0-only"),
    (("lgpl-2.1-title",), "LGPL-2.1-only"),
    (("agpl-3-title",), "AGPL-3.0-only"),
    (("epl-2-title",), "EPL-2.0"),
    *(((f"notice-{name}",), name) for name in sorted(set(NOTICE_NAMES.values()))),
    ((EXPRESSION,), ""),  # the license that the line itself gives
]

#: Every known sentence holds one of these; sentences without are unknown at once.
CUES = ("licen", "software", "copyright", "rights", "warrant", "redistribut")
#: Where a piece of a sentence ends: a stop, semicolon or colon before white space, or a
#: line's end unless the next line goes on in lower case, as wrapped sentences do, with or
#: without a comment mark.
BORDER = (
    r"[.!?;:]+(?:\s+|$)"
    r"|\n(?![ \t]*(?:(?:#+|//+!?|/?\*+|;+|--+|%+|>+|dnl|REM)[ \t]*)?[a-z(])(?:[ \t]*;+(?=\s))?"
)
_BORDER = re.compile(BORDER)
_NO_WORD = re.compile("[^a-z0-9]+")


def normal_form(sentence: str) -> str:
    return _NO_WORD.sub(" ", sentence.lower()).strip()


def openings(table: dict[str, str]) -> set[str]:
    """What the sentences of a table can begin with, by whole words."""
    known = set()
    for sentence in table:
        words = sentence.split()
        known |= {" ".join(words[:n]) for n in range(1, len(words))}
    return known


def _in_slot(run: str, slots: list[tuple[str, str, str]]) -> tuple[str | None, bool]:
    """The identifier of a sentence with a name, and whether it may become one."""
    may = False
    for begin, end, name in slots:
        if run.startswith(f"{begin} "):
            if run.endswith(f" {end}") and run.count(" ") < len(f"{begin} {end}".split()) + SLOT_WORDS:
                return name, False
            may |= run.count(" ") < len(f"{begin} {end}".split()) + SLOT_WORDS
        may |= f"{begin} ".startswith(f"{run} ")
    return None, may


def notice(sentence: str) -> str | None:
    """The identifier of a notice that names one license."""
    found = _NOTICE.search(sentence) if " under " in sentence else None
    if not found or "licen" not in sentence:
        return None
    subject, reference = sentence[: found.start()].split(), found[2].split()
    if max(len(subject), len(reference)) > NOTICE_WORDS or {"not", "or", "neither"} & set(subject):
        return None
    return f"notice-{NOTICE_NAMES[found[1]]}"


_SPDX_KNOWN = {name.lower(): name for name in [*SPDX, *SPDX_OTHER]}
_SPDX_WITH = {name.lower(): name for name in SPDX_EXCEPTIONS}


def spdx_expression(line: str) -> str | None:
    """The expression of licenses that a line holds, with names and operators spelt as usual."""
    tokens = re.findall(r"[\w.+-]+|[()]|\S", re.split(r"\*/|-->", line)[0])
    spelt, shape = [], ""
    for token in tokens:
        name = token.lower()
        if name in ("and", "or", "with") or token in "()":
            spelt.append(token.upper())
            shape += {"and": "&", "or": "|", "with": "w"}.get(name, token)
        elif name in _SPDX_WITH:
            spelt.append(_SPDX_WITH[name])
            shape += "x"
        elif name.removesuffix("+") in _SPDX_KNOWN:
            spelt.append(_SPDX_KNOWN[name.removesuffix("+")] + "+" * name.endswith("+"))
            shape += "l"
        else:
            return None
    shown = " ".join(spelt).replace("( ", "(").replace(" )", ")")
    return shown if _whole(shape.replace("lwx", "l")) else None


def _whole(shape: str) -> bool:
    """Whether operands (l), operators (& and |) and parentheses make one expression."""
    depth, wants = 0, True
    for mark in shape:
        if mark not in ("(l" if wants else ")&|"):
            return False
        depth += {"(": 1, ")": -1}.get(mark, 0)
        if depth < 0:
            return False
        wants = mark in "(&|"
    return not wants and not depth


def recognised(
    text: str,
    table: dict[str, str],
    begins: set[str],
    slots: list[tuple[str, str, str]],
    notices: bool = True,
) -> list[tuple[int, int, str]]:
    """First piece, last piece and identifier of the known sentences, the longest at each
    place; behind the identifier of an expression, after a blank, the expression. An empty
    piece ends a sentence, as between paragraphs."""
    pieces = _BORDER.split(text)
    normal = [normal_form(piece) for piece in pieces]
    out, at = [], 0
    while at < len(pieces):
        run, best = "", None
        for end in range(at, len(pieces)):
            if not normal[end]:
                break
            more, said = normal[end], None
            if run == SPDX_WORDS:  # a line holds all of it, whatever follows
                line = pieces[end].split("\n")[0]
                more, said = normal_form(line), spdx_expression(line) if notices else None
            run = f"{run} {more}".strip()
            name, may = _in_slot(run, slots)
            if notices and not name:
                name = f"{EXPRESSION} {said}" if said else notice(run) if end == at else None
            name = table.get(run, name)
            if name:
                best = (at, end, name)
            if run not in begins and not may:
                break
        if best:
            out.append(best)
        at = best[1] + 1 if best else at + 1
    return out


def matched(
    sequence: list[tuple[int, int, str]],
    rules: list[tuple[tuple[str, ...], str]],
    max_gap: int = MAX_GAP,
) -> list[tuple[int, str, int, int]]:
    """Rule, license, and places of the first and last piece of each match."""
    out, at = [], 0
    names = [name.split(" ")[0] for *_, name in sequence]
    near = [b[0] - a[1] <= max_gap + 1 for a, b in zip(sequence, sequence[1:])]
    while at < len(names):
        for number, (wanted, license_) in enumerate(rules):
            end = at + len(wanted) - 1
            if tuple(names[at : end + 1]) == wanted and all(near[at:end]):
                shown = license_ or sequence[at][2].partition(" ")[2]
                out.append((number, shown, sequence[at][0], sequence[end][1]))
                at = end
                break
        at += 1
    return out


def scan(
    docs: DataFrame,
    table: dict[str, str] | None = None,
    rules: list[tuple[tuple[str, ...], str]] | None = None,
    max_gap: int = MAX_GAP,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id_col``, ``rule``, ``license``, ``first`` and ``last`` (places of pieces) of
    each match. With a table of the caller's own, only its sentences are known."""
    rules = RULES if rules is None else rules
    slots = SLOTS if table is None else []
    known, notices = (SENTENCES, True) if table is None else (table, False)
    certain = all(any(cue in sentence for cue in CUES) for sentence in known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins = openings(known)
        for batch in batches:
            for part in sliced(batch, 1_000):
                found = [
                    (row, *match)
                    for row, text in enumerate(part["text"].to_pylist())
                    for match in matched(
                        recognised(text, known, begins, slots, notices), rules, max_gap
                    )
                ]
                rows, numbers, licenses, firsts, lasts = zip(*found) if found else [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [
                        part["id"].take(pa.array(rows, pa.int64())),
                        pa.array(numbers, pa.int32()),
                        pa.array(licenses, pa.string()),
                        pa.array(firsts, pa.int32()),
                        pa.array(lasts, pa.int32()),
                    ],
                    names=["id", "rule", "license", "first", "last"],
                )

    text = F.col(f"`{text_col}`")
    may_hold = reduce(
        Column.__or__, (F.contains(F.lower(text), F.lit(cue)) for cue in CUES)
    ) | F.lit(not certain)
    given = docs.filter(text.isNotNull() & may_hold).select(
        F.col(f"`{id_col}`").alias("id"), text.alias("text")
    )
    kind = given.schema["id"].dataType.simpleString()
    return given.mapInArrow(
        run, f"id {kind}, rule int, license string, first int, last int"
    ).withColumnRenamed("id", id_col)
