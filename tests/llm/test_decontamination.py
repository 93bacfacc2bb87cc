import random
import re
from collections import Counter

import duckdb
import numpy as np

from newsloom.llm import decontamination as dc


def words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window):
    doc, hit, found = words(text), set(), set()
    for name, item in items:
        w = words(item)
        m = min(window, len(w))
        for p in range(len(w) - m + 1 if m else 0):
            for q in range(len(doc) - m + 1):
                if doc[q : q + m] == w[p : p + m]:
                    hit |= set(range(q, q + m))
                    found.add(name)
    return len(doc), len(hit), sorted(str(f) for f in found if f is not None)


def test_matches_equal_brute_force_with_one_and_many_blocks(spark):
    rng = random.Random(6)
    word = lambda: rng.choice(["Red", "blue", "été", "x1", "of"])
    make = lambda n: rng.choice([" ", ", ", "\n"]).join(word() for _ in range(n))
    items = [(k, make(rng.randrange(0, 9))) for k in range(12)] + [(None, make(5)), (99, None), (3, make(4))]
    rows = [(k, make(rng.randrange(0, 60)) + (" zebra " if k % 2 else " ") + make(9)) for k in range(40)] + [(50, None), (51, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_words", "'x' AS matches").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block_words in (10_000, 8):
        got = dc.measure(dc.find_matches(docs, bench, window=4, block_words=block_words)).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.n_words, r.n_hit, r["items"]) == brute(dict(rows)[r.doc_id], items, 4)
            for m in r.matches:
                doc = words(dict(rows)[r.doc_id])[m.doc_start : m.doc_start + m.n_words]
                assert any(str(n) == str(m.item_id) and words(t)[m.item_start : m.item_start + m.n_words] == doc for n, t in items)


def test_longest_matches_of_suffixes():
    rng = random.Random(2)
    items = [("a", [rng.choice([b"p", b"q", b"r"]) for _ in range(30)])]
    block = dc.Block(items, 5)
    text = [rng.choice([b"p", b"q", b"r", b"z"]) for _ in range(200)]
    ids = np.zeros(200 + 2 * block.longest + 64, np.int32)
    ids[:200] = [block.vocabulary.get(w, 0) for w in text]
    longest, *_ = dc.search(ids, dc.suffix_array(ids, block.longest, len(block.vocabulary)), block)
    for k in range(30):
        best = 0
        for at in range(200):
            n = 0
            while k + n < 30 and at + n < 200 and items[0][1][k + n] == text[at + n]:
                n += 1
            best = max(best, n)
        assert longest[k] == best


def test_removal_keeps_columns_and_clean_rows(spark):
    long = "one two three four five six seven eight nine ten eleven"
    rows = [(1, f"Start {long} end", "a"), (2, long.replace("six", "6"), "b"), (3, None, "c"), (None, "", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    bench = spark.createDataFrame([(1, long)], "item_id long, text string")
    got = dc.decontaminate(docs, bench)
    assert got.columns == docs.columns and sorted(r.row for r in got.collect()) == ["b", "c", "d"]
    assert dc.decontaminate(docs, bench.limit(0)).count() == 4 and dc.decontaminate(docs.limit(0), bench).count() == 0
    assert dc.report(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_report_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = Counter(con.execute(dc.REPORT_SQL).fetchall())
    got = dc.report(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")))
    assert Counter(map(tuple, got.collect())) == want
