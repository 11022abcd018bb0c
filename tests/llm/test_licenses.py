import re
from collections import Counter

import duckdb

from ledgerlake.llm import licenses

from .helpers import SF, no_docs, odd_docs, odd_rows


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    key = lambda r: (r[0], r[1] or "", round(r[2], 9), r[3], r[4])
    got = sorted(map(key, licenses.op4_licenses(spark, SF).select("doc_id", "license", "score", "n_matches", "licenses").collect()))
    want = sorted(map(key, con.execute(f"SELECT doc_id, license, score, n_matches, licenses FROM ({licenses.SQL})").fetchall()))
    assert got == want
    assert any(r[1] for r in got)


def dice(unit, template):
    a, b = (Counter(zip(w, w[1:], strict=False)) for w in (re.sub(r"[\W_]+", " ", x.lower()).split() for x in (unit, template)))
    return 2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values()))


def test_near_and_far_texts(spark):
    mit = licenses.TEMPLATES["MIT/text"]
    cut, half = " ".join(mit.split()[:80]), " ".join(mit.split()[:40])
    rows = [(1, mit), (2, "x\n" + mit.upper().replace(" ", "  ") + "\ny"), (3, half), (4, cut), (5, "Prose. " * 50 + "\nAll rights reserved.\n" + "more prose. " * 50), (6, "rights"), (7, mit + "\n" + licenses.TEMPLATES["CC0-1.0/notice"])]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].license == got[2].license == "MIT/text"
    assert got[3].license is None
    assert (got[4].license is not None) == (dice(cut, mit) >= 0.8)
    assert got[5].license == "All-rights-reserved/notice"
    assert (got[6].license, got[6].score, got[6].n_matches, got[6].licenses) == (None, 0.0, 0, "")
    assert got[7].licenses == "CC0-1.0/notice,MIT/text"


def test_wrapped_notices_variants_and_whole_licences(spark):
    t = licenses.TEMPLATES
    wrap = lambda text, n: "\n".join(" ".join(text.split()[i : i + n]) for i in range(0, len(text.split()), n))
    rows = [
        (1, "Some prose before it. This work is licensed under the GNU General\nPublic License, version 3. And more of it,\non other lines."),
        (2, "no sentence ends here\nThis work is licensed under the GNU\nGeneral Public License version 2\nand on it goes"),
        (3, wrap(t["BSD-3-Clause/whole"], 12)),
        (4, "Copyright (c) 2020 Someone\n\n" + wrap(t["MIT/whole"], 9)),
        (5, t["CC-BY-SA-4.0/work"]),
        (6, "A first sentence. " + t["MPL-2.0/header"] + " a place. A last one."),
        (7, t["AGPL-3.0/notice"] + "\n" + t["AGPL-3.0/notice"]),
        (8, "word " * 400_000 + "All rights reserved"),
    ]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    names = {k: r.license for k, r in got.items()}
    assert names == {1: "GPL-3.0/notice", 2: "GPL-2.0/notice", 3: "BSD-3-Clause/whole", 4: "MIT/text", 5: "CC-BY-SA-4.0/work", 6: "MPL-2.0/header", 7: "AGPL-3.0/notice", 8: None}
    assert "MIT/whole" in got[4].licenses
    assert [got[k].licenses for k in (1, 2, 5, 7)] == [names[k] for k in (1, 2, 5, 7)]
    assert licenses.scan(docs).where("doc_id = 1").collect() == [got[1]] * 2


def test_ties_go_to_the_first_name(spark):
    a, b = licenses.TEMPLATES["MIT/licensed"], licenses.TEMPLATES["MIT/notice"]
    unit = "the MIT License"
    assert dice(unit, a) == dice(unit, b)
    r = licenses.scan(spark.createDataFrame([(1, "under " + unit)], "doc_id long, text string")).first()
    assert r.license == "MIT/licensed"


def test_units_at_the_bounds_of_size_equal_sql(spark):
    rows = []
    for name, b, _ in licenses.BAGS:  # as many bigrams more or fewer as the threshold allows, and one beyond
        words = re.sub(r"[\W_]+", " ", licenses.TEMPLATES[name].lower()).split()
        rows += [" ".join([*words, *(f"w{i}" for i in range(n))]) for n in (b // 2 - 1, b // 2, b // 2 + 1)]
        rows += [" ".join(words[:n]) for n in (2 * b // 3, 2 * b // 3 + 1, 2 * b // 3 + 2)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    key = lambda r: (r[0], r[1] or "", round(r[2], 9), r[3], r[4])
    want = sorted(map(key, con.execute(f"SELECT doc_id, license, score, n_matches, licenses FROM ({licenses.SQL})").fetchall()))
    assert sorted(map(key, licenses.scan(docs).collect())) == want
    assert any(score == 0.8 for _, _, score, _, _ in want)


def test_odd_cases(spark):
    got = licenses.scan(odd_docs(spark)).collect()
    assert len(got) == len(odd_rows())
    assert all(r.license is None and r.n_matches == 0 for r in got)
    assert licenses.scan(no_docs(spark)).collect() == []


def test_main_path_is_native(spark):
    plan = licenses.op4_licenses(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def test_every_match_holds_an_anchor():
    words = set(licenses.anchors())
    for _, b, entries in licenses.BAGS:
        free = sum(n for gram, n in entries if not words & set(gram.split(" ")))
        assert free < licenses.THRESHOLD / (2 - licenses.THRESHOLD) * b
