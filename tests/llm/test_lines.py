from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import functions as F

from countinghouse.llm import line_frequency, line_spread, queries
from tests.llm.conftest import FOLDER, ROWS

WORDS = r"[^\x20\x09-\x0D]+"


def plain_measures(text):
    text = text or ""
    words = re.findall(WORDS, text)
    windows = [tuple(words[n : n + 3]) for n in range(len(words) - 2)]
    counts, covered, seen, repeated = Counter(windows), set(), set(), 0
    for n, window in enumerate(windows):
        if counts[window] > 1:
            covered |= {n, n + 1, n + 2}
    for line in text.split("\n"):
        if re.search(WORDS, line):
            repeated += line in seen
            seen.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, repeated, len(covered)


def test_measures(spark, documents, awkward):
    texts = [row.text for row in documents.collect()] + [row[1] for row in ROWS]
    for text in texts:
        assert line_frequency.measure((text or "").encode())[0] == plain_measures(text)
    rows = queries.op3_line_frequency(spark, FOLDER).collect()
    known = {row.doc_id: plain_measures(row.text) for row in documents.collect()}
    for row in rows:
        words, *_, covered = known[row.doc_id]
        assert tuple(row[name] for name in line_frequency.MEASURES) == known[row.doc_id]
        assert row.base_failed == (words < 50 or 100 * covered > 50 * words)
        assert not (row.base_failed and row.kept)


def plain_verdicts(rows, max_docs, max_share, min_words, min_left):
    """By (id, text, host): whether it is kept, and the lines that go."""

    def norm(line):
        line = "".join(c.lower() if "A" <= c <= "Z" else c for c in line)
        return " ".join(re.findall(WORDS, re.sub("[1-9]", "0", line)))

    found, hosts = {}, {}
    for _, text, host in rows:
        hosts.setdefault(host, set()).add(text or "")
        for line in (text or "").split("\n"):
            if norm(line):
                found.setdefault((host, norm(line)), set()).add(text)
    out = []
    for number, text, host in rows:
        words, *_, covered = plain_measures(text)
        gone = [
            line
            for line in (text or "").split("\n")
            if len(found.get((host, norm(line)), ())) > max_docs
            and len(found[host, norm(line)]) > max_share * len(hosts[host])
        ]
        left = words - sum(len(re.findall(WORDS, line)) for line in gone)
        failed = words < 50 or 100 * covered > 50 * words
        depleted = bool(gone) and (left < min_words or left < min_left * words)
        out.append((number, not failed and not depleted, left))
    return sorted(out, key=str)


def test_frequent_lines_go_and_depleted_documents_too(spark):
    def own(n, count):
        names = "abcdefghijklmnopqrstuvwxyz"
        return " ".join(names[n % 26] * (1 + n // 26) + names[k % 26] * (1 + k) for k in range(count))

    rows = [(n, f"Visit  us 24 times\n{own(n, 70)}", "h") for n in range(8)]
    rows += [(20 + n, f"{own(n, 3)}\nvisit us 13 times\n{own(9, 60)}", "h") for n in range(8)]
    rows += [(40 + n, f"Visit us 24 times\n{own(n, 60)}", "other") for n in range(3)]
    rows += [(60, rows[0][1], "h"), (60, rows[0][1], "h"), (61, None, None), (62, own(62, 70), None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    limits = {"max_docs": 4, "max_share": 0.1, "min_words": 50, "min_left": 0.5}
    found = line_frequency.verdicts(docs, **limits).collect()
    assert sorted(((r.id, r.kept, r.words_left) for r in found), key=str) == plain_verdicts(
        rows, **limits
    )
    kept = {row.doc_id: row.text for row in line_frequency.apply(docs, **limits).collect()}
    assert set(kept) == {row.id for row in found if row.kept}
    assert kept[0] == own(0, 70) and kept[40] == f"Visit us 24 times\n{own(0, 60)}"
    assert line_frequency.apply(docs, **limits).filter("doc_id = 60").count() == 2


def test_a_line_above_the_count_goes_in_a_host_of_any_size(spark):
    def words(n):
        return " ".join(f"w{chr(97 + n // 26 % 26)}{chr(97 + n % 26)}x{chr(97 + n // 676)}{'a' * k}" for k in range(60))

    rows = [(n, f"visit us\n{words(n)}" if n < 30 else words(n), "big") for n in range(2_000)]
    rows += [(5_000 + n, f"visit us\n{words(n)}", "small") for n in range(21)]
    rows += [(6_000 + n, f"visit us\n{words(n)}", "smaller") for n in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = {row.id: row.words_left for row in line_frequency.verdicts(docs).collect()}
    assert {n for n, _, _ in rows if n < 30 or 5_000 <= n < 6_000} == {
        row.id for row in line_frequency.verdicts(docs).filter("removed is not null").collect()
    }
    assert found[3] == found[5_003] == 60 and found[6_003] == 62


def test_awkward_rows(awkward, no_docs):
    assert line_frequency.verdicts(awkward).count() == len(ROWS)
    assert line_frequency.apply(awkward).schema == awkward.schema
    assert line_frequency.apply(no_docs).count() == 0
    assert line_spread.remove_spread_lines(no_docs).count() == 0
    found = line_spread.remove_spread_lines(awkward, removed_col="removed")
    assert found.columns == [*awkward.columns, "removed"]
    assert sorted(((r.doc_id, r.text) for r in found.collect()), key=str) == sorted(
        (row[:2] for row in ROWS), key=str
    )


def test_lines_of_many_sites_go(spark):
    rows = [(n, f"  All Rights reserved \nmy own long line number {n}\n", f"s{n}") for n in range(30)]
    rows += [(100 + n, f"few sites have this\nmy own long line number {n}x", f"s{n % 10}") for n in range(40)]
    rows += [(200 + n, "a whole text\nof many sites", f"s{n}") for n in range(20)]
    rows += [(300, "all rights reserved\n\nall rights reserved\nmy own much longer line than those two are", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = {r.doc_id: r.text for r in line_spread.remove_spread_lines(docs).collect()}
    assert found[3] == "my own long line number 3\n"
    assert found[100] == rows[30][1]
    assert found[201] == "a whole text\nof many sites"
    assert found[300] == "\nmy own much longer line than those two are"


def test_boilerplate_goes_where_it_is_most_of_the_text(spark):
    """Of a text of which half a dozen lines are shared, only its own stay; copies stay."""
    footer = [f"shared footer number {n} with quite many words in it" for n in range(6)]
    rows = [(n, "\n".join([f"own {n}", *footer]), f"s{n}") for n in range(60)]
    copy = [f"copied line number {n}" for n in range(20)]
    rows += [(100 + n, "\n".join(copy), f"s{n}") for n in range(30)]
    changed = [[*copy[:n], f"changed {n}", *copy[n + 1 :]] for n in range(18)]
    rows += [(200 + n, "\n".join(x), f"s{n}") for n, x in enumerate(changed)]
    rows += [(300 + n, footer[0], f"s{n}") for n in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = {r.doc_id: r.text for r in line_spread.remove_spread_lines(docs).collect()}
    assert {n: found[n] for n in range(60)} == {n: f"own {n}" for n in range(60)}
    assert all(found[n] == text for n, text, _ in rows if 100 <= n < 300)
    assert {found[300 + n] for n in range(20)} == {footer[0]}  # has nothing else
    alone = [(n, "all texts are this", f"s{n}") for n in range(40)]
    docs = spark.createDataFrame(alone, "doc_id bigint, text string, source string")
    assert {r.text for r in line_spread.remove_spread_lines(docs).collect()} == {"all texts are this"}


def test_sketches_and_exact_counts_agree(spark):
    rows = [(f"line{sites}", f"site{n}") for sites in range(1, 40) for n in range(sites)] * 2
    lines = spark.createDataFrame(rows, "name string, site string").selectExpr(
        "xxhash64(name) as line", "site", "name", "0L as company_0", "null as company_1",
        "xxhash64(site) as company_2", "1L as company_3",
    )
    for limit in (1, 10, 25):
        found = line_spread.spread_lines(lines, limit)
        names = lines.join(found, "line").select("name").distinct().collect()
        assert {row.name for row in names} == {f"line{n}" for n in range(limit + 1, 40)}
    few = lines.withColumn("company_2", F.pmod("company_2", F.lit(9)))
    assert line_spread.spread_lines(few, 10).count() == 0


def test_no_python_on_the_main_path(spark):
    plan = queries.op6_line_spread(spark, FOLDER)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|InArrow", plan)
