import hashlib
import random
import zlib
from collections import Counter

import duckdb
import pytest

from newsloom.llm import manifest

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    doc_id, text, lang, source, n_chars = row
    n_chars = n_chars if n_chars is None else n_chars + more
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree(hashes):
    """The root, and each node's way: (left siblings, right siblings) level by level."""
    ways, level, of = [[] for _ in hashes], list(hashes), [[i] for i in range(len(hashes))]
    while len(level) > 1:
        for k in range(len(level)):
            other = k ^ 1
            for i in of[k]:
                ways[i].append(("", "") if other >= len(level) else (level[other], "") if other < k else ("", level[other]))
        level = [H(*level[k : k + 2]) for k in range(0, len(level), 2)]
        of = [sum(of[k : k + 2], []) for k in range(0, len(of), 2)]
    return level[0], ways


def brute(rows):
    first = lambda v: (v is not None, v)
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    order = sorted(langs, key=lambda v: (v is not None, (v or "").encode()))
    for v in langs.values():
        v.sort(key=lambda r: (first(r[0]), leaf(r)))
    trees = {k: tree([leaf(r) for r in langs[k]]) for k in order}
    root, outer = tree([trees[k][0] for k in order]) if order else ("", [])
    out = []
    for k, up in zip(order, outer):
        for r, way in zip(langs[k], trees[k][1]):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            folded = leaf(r, int(bad))
            for left, right in way + up:
                folded = H(left, folded, right)
            out.append((r[0], leaf(r), trees[k][0], root, H(*[s for pair in way + up for s in pair]), folded, folded == root))
    return Counter(out)


def rows_of(rng, n):
    langs = [None, "en", "de", "fr", "é", "zh", ""]
    text = lambda: rng.choice([None, "", "a", "née", "日本", "x" * 5000, "1:2"])
    return [(rng.choice([None, *range(n)]), text(), rng.choice(langs[: 2 + n % 6]), rng.choice([None, "s", "t:u"]), rng.choice([None, 0, 7])) for _ in range(n)]


@pytest.mark.parametrize("n", [1, 2, 3, 8, 47, 400])
def test_trees_equal_plain_code(spark, n, monkeypatch):
    # blocks of four leaves, so that there are several rounds
    monkeypatch.setattr(manifest, "LEVELS", 2)
    monkeypatch.setattr(manifest, "BLOCK", 4)
    rows = rows_of(random.Random(n), n)
    rows += rows[: n // 3]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS leaf", "'x' AS tree", "2 AS pos", "3 AS n", "'y' AS root").repartition(3)
    got = Counter(tuple(r[c] for c in COLUMNS) for r in manifest.report(docs).collect())
    assert got == brute(rows)
    con = duckdb.connect()
    con.register("documents", spark.createDataFrame(rows, SCHEMA).toArrow())
    assert Counter(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({manifest.SQL})").fetchall()) == got


def test_one_doc_id_for_a_third_of_all_rows(spark):
    rows = [(5, "same", "en", "s", 4)] * 300 + [(k, f"t{k}", "en", "s", 2) for k in range(600)]
    got = manifest.report(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert Counter(tuple(r[c] for c in COLUMNS) for r in got) == brute(rows)


def test_empty_table_and_one_row_languages(spark):
    assert manifest.report(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(k, "t", f"l{k}", "s", k) for k in range(9)]
    got = manifest.report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.leaf == r.subroot for r in got) and Counter(tuple(r[c] for c in COLUMNS) for r in got) == brute(rows)


def test_very_long_text_and_schema(spark):
    rows = [(1, "é" * 2_000_000, "en", "s", 2_000_000), (2, "b", "en", "s", 1)]
    got = manifest.report(spark.createDataFrame(rows, SCHEMA))
    assert got.dtypes == [("doc_id", "bigint")] + [(c, "string") for c in COLUMNS[1:-1]] + [("verified", "boolean")]
    assert Counter(tuple(r[c] for c in COLUMNS) for r in got.collect()) == brute(rows)
