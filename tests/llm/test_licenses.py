from __future__ import annotations

import random
import re
from collections import Counter

from countinghouse.llm import licenses, queries
from tests.llm.conftest import ROWS

FOLDER = "/root/testdata/sf0.01"

MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""


def plain(text):
    found = []
    for place, sentence in enumerate(re.split(licenses.BORDER, text or "")):
        normal = re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()
        if normal in licenses.SENTENCES:
            found.append((place, licenses.SENTENCES[normal]))
    out, at = [], 0
    while at < len(found):
        fits = [
            (n, name, len(wanted))
            for n, (wanted, name) in enumerate(licenses.RULES)
            if tuple(x for _, x in found[at : at + len(wanted)]) == wanted
        ]
        if fits:
            n, name, length = fits[0]
            out.append((n, name, found[at][0], found[at + length - 1][0]))
            at += length - 1
        at += 1
    return out


def test_query(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    wanted = Counter((row.doc_id, *match) for row in docs for match in plain(row.text))
    found = queries.op8_license_rules(spark, FOLDER).collect()
    assert wanted and Counter(tuple(row) for row in found) == wanted


def test_sequences_and_order_of_rules(spark, awkward, no_docs):
    docs = spark.createDataFrame([(1, MIT), (1, MIT), (2, f"{MIT}\nAll rights reserved")], "doc_id bigint, text string")
    found = Counter((row.doc_id, row.license) for row in licenses.scan(docs).collect())
    assert found == {(1, "MIT"): 2, (2, "MIT"): 1, (2, "LicenseRef-All-Rights-Reserved"): 1}
    table, rules = {"one two": "a", "three": "b"}, [(("a", "b"), "AB"), (("b",), "B")]
    docs = spark.createDataFrame([(1, "One, two! x. Three. three. one two.")], "doc_id bigint, text string")
    assert [tuple(r) for r in licenses.scan(docs, table, rules).collect()] == [
        (1, 0, "AB", 0, 2), (1, 1, "B", 3, 3),
    ]
    assert licenses.scan(awkward).count() == sum(len(plain(row[1])) for row in ROWS)
    assert licenses.scan(no_docs).count() == 0


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
BSD = """Copyright (c) 2020, Someone Inc. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
NAMES = """3. Neither the name of Someone Inc. nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""


def test_standard_headers_plain_and_in_comments(spark):
    headers = [
        (MIT, "MIT"),
        (APACHE, "Apache-2.0"),
        (BSD, "BSD-2-Clause"),
        (BSD + NAMES, "BSD-3-Clause"),
        (GPL, "GPL-3.0-or-later"),
        (GPL.replace("GNU General", "GNU Affero General"), "AGPL-3.0-or-later"),
        (GPL.replace("GNU General", "GNU Lesser General"), "LGPL-3.0-or-later"),
        (MPL, "MPL-2.0"),
        ("SPDX-License-Identifier: BSD-3-Clause\nimport os", "BSD-3-Clause"),
    ]
    rows, wanted = [], []
    for mark in ("", "# ", " * ", "// ", "-- ", ";; "):
        for header, name in headers:
            rows.append((len(rows), "\n".join(mark + line for line in header.split("\n"))))
            wanted.append((len(wanted), name))
    rows.append((1_000, "This file is not what the license says; the software is free."))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = sorted((row.doc_id, row.license) for row in licenses.scan(docs).collect())
    assert found == wanted
    apache = licenses.scan(docs.filter("doc_id = 1")).collect()
    assert [licenses.RULES[row.rule][0][-1] for row in apache] == ["apache-2-disclaimer"]


def test_rules_name_known_sentences():
    known = set(licenses.SENTENCES.values()) | {licenses.EXPRESSION}
    known |= {f"notice-{name}" for name in licenses.NOTICE_NAMES.values()}
    assert all(set(wanted) <= known for wanted, _ in licenses.RULES)
    assert all(any(cue in text for cue in licenses.CUES) for text in licenses.SENTENCES)


def test_notices_titles_and_expressions(spark):
    notices = [
        ("This project is licensed under the MIT License - see the LICENSE file for details.", "MIT"),
        ("Licensed under MIT.", "MIT"),
        ("This project is licensed under the Apache License, Version 2.0.", "Apache-2.0"),
        ("Released under the BSD 3-Clause License.", "BSD-3-Clause"),
        ("The code is distributed under the GNU General Public License v3.0.", "GPL-3.0-only"),
        ("Our tool is licensed under the GNU GPL, version 2 or later.", "GPL-2.0-or-later"),
        ("Everything here is available under the LGPL v2.1 licence: see below", "LGPL-2.1-only"),
        ("Parts are licensed under the LGPL v2.1; others are not.", "LGPL-2.1-only"),
        ("                GNU GENERAL PUBLIC LICENSE\n                  Version 3, 29 June 2007\n", "GPL-3.0-only"),
        ("GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999", "LGPL-2.1-only"),
        ("// SPDX-License-Identifier: MIT OR Apache-2.0\nint main() {}", "MIT OR Apache-2.0"),
        ("/* SPDX-License-Identifier: (gpl-2.0+ with linux-syscall-note or MIT) and ISC */",
         "(GPL-2.0+ WITH Linux-syscall-note OR MIT) AND ISC"),
        ("SPDX-License-Identifier: EPL-2.0", "EPL-2.0"),
        ("SPDX-License-Identifier: MIT OR", None),
        ("SPDX-License-Identifier: MIT Apache-2.0", None),
        ("SPDX-License-Identifier: (MIT OR ISC", None),
        ("This program and the accompanying materials are made available under the terms of the"
         " Eclipse Public License 2.0 which accompanies this distribution.", "EPL-2.0"),
        ("This text is not licensed under the MIT license.", None),
        ("It was released under pressure and the license of the bar was lost.", None),
        ("Licensed under the Apache License.", None),
    ]
    docs = spark.createDataFrame([(n, text) for n, (text, _) in enumerate(notices)], "doc_id bigint, text string")
    found = [(row.doc_id, row.license) for row in licenses.scan(docs).collect()]
    assert sorted(found) == [(n, name) for n, (_, name) in enumerate(notices) if name]


def test_sentences_far_apart_are_no_sequence(spark):
    title, _, grant = MIT.partition("\n")
    for far in (5, 5_000):
        text = f"{title}\n" + "Something else.\n" * far + grant
        rules = [row.rule for row in licenses.scan(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()]
        names = [licenses.RULES[rule][0] for rule in rules]
        if far < licenses.MAX_GAP:
            assert names == [("mit-title", "mit-grant", "mit-condition")]
        else:
            assert names == [("mit-title",), ("mit-grant", "mit-condition")]


def test_like_a_plain_matcher_with_its_own_table(spark):
    table = {"alpha beta": "a", "gamma": "b", "delta epsilon zeta": "c"}
    rules = [(("a", "b", "c"), "ABC"), (("a", "b"), "AB"), (("b", "c"), "BC"), (("c",), "C")]
    said = {"a": "Alpha, beta.", "b": "GAMMA!", "c": "delta epsilon\nzeta.", "-": "Unknown words."}
    pick = random.Random(8)
    rows = [(n, "".join(pick.choices("abc-", (3, 3, 3, 2), k=pick.randint(0, 30)))) for n in range(200)]
    wanted = []
    for n, letters in rows:
        at = 0
        while at < len(letters):
            found = next(
                (
                    (rule, hit)
                    for rule, (names, _) in enumerate(rules)
                    if (hit := re.compile("-{0,2}".join(names)).match(letters, at))
                ),
                None,
            )
            if found:
                wanted.append((n, found[0], rules[found[0]][1], at, found[1].end() - 1))
            at = found[1].end() if found else at + 1
    docs = spark.createDataFrame(
        [(n, " ".join(said[x] for x in letters)) for n, letters in rows], "doc_id bigint, text string"
    )
    found = licenses.scan(docs, table, rules, max_gap=2).collect()
    assert sorted(tuple(row) for row in found) == sorted(wanted) and len(wanted) > 200
