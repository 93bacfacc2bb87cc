import random

import pytest

from newsloom.llm import jaccard


def shingle_set(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(zip(*(words[k:] for k in range(5))))


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * len(sets[i] | sets[j]):
                label[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return {doc: (len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(rows)}


def corpus(seed):
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    passage = fresh(60)
    texts = []
    for size in (3, 12, 60, 150):
        base = fresh(size)
        for copies in range(40):
            words = list(base)
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(9999)}"
            texts.append(" ".join(words))
    for _ in range(60):
        texts.append(" ".join(fresh(rng.randrange(5, 40)) + passage + fresh(rng.randrange(5, 40))))
    for _ in range(40):
        texts.append(" ".join(passage + fresh(rng.randrange(0, 9))))
    texts += [None, "", "  \n", "One two", "one  TWO", "one two", " ".join(["a"] * 50), " ".join(["a"] * 60)]
    rng.shuffle(texts)
    return [(10 * i + 3, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("long,frequent", [(32, 32), (4, 8), (4, 10**9)])
def test_components_equal_brute_force(spark, monkeypatch, long, frequent):
    monkeypatch.setattr(jaccard, "LONG", long)
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    rows = corpus(long)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(docs).collect()}
    assert got == brute(rows)


def test_families_that_do_not_link(spark, monkeypatch):
    """Long columns whose rows stay apart: combinations of common passages, and a few earlier columns only."""
    monkeypatch.setattr(jaccard, "BEFORE", 2)
    rng = random.Random(9)
    passages = [[f"p{k}_{i}" for i in range(24)] for k in range(9)]
    rows = [(k, " ".join(w for p in rng.sample(passages, 5) for w in p)) for k in range(150)]
    rows += [(200 + k, t + " more") for k, (_, t) in enumerate(rows[:30])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(docs).collect()} == brute(rows)


def test_very_long_text(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(["x", *words])), (3, " ".join(words[:47_000])), (4, " ".join(words[:56_000])), (5, " ".join(words[:40]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(docs).collect()} == brute(rows)


def test_null_ids_bridge(spark):
    base = [f"b{k}" for k in range(60)]
    texts = [base, base[3:], base[7:]]  # the first and the last do not link
    rows = [(5, " ".join(texts[0])), (None, " ".join(texts[1])), (2, " ".join(texts[2]))]
    got = {r.doc_id: r.component_id for r in jaccard.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {5: 2, None: 2, 2: 2}


def test_empty_table_and_odd_rows(spark):
    assert jaccard.link(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS n", "'x' AS rep")
    got = sorted(jaccard.link(docs).collect(), key=str)
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in got) == [(0, 2, 7), (7, 2, 7), (7, 2, 7), (9, 0, 9)]
