import random

import public_tokenizers
import pytest

from newsloom.llm import token_counts as tc

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder():
    with open(RANKS, "rb") as f:
        return tc.encoding(f.read(), public_tokenizers.PATTERN)


def random_text(rng, n):
    pieces = ["word", " ", "  ", "\n", "\n\n ", "It's", "don't", "é", "ß", " 12", "3", "!?", " ...", "\t", "日本", "_", "a b c d e f g"]
    return "".join(rng.choice(pieces) for _ in range(n))


def test_edits_equal_full_recount(encoder):
    rng = random.Random(8)
    count = lambda s: len(encoder.encode_ordinary(s))
    for size in (0, 1, 5, 60, 900):
        text = random_text(rng, size)
        tree = tc.Tree(text, count)
        assert tree.n_tokens == count(text)
        for _ in range(60):
            a = rng.randrange(len(text) + 1)
            b = min(len(text), a + rng.choice([0, 1, 2, 9, 400]))
            new = random_text(rng, rng.choice([0, 1, 3, 200]))
            tree.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert tree.text == text and tree.n_tokens == count(text)
            assert sum(tree.chars[tree.width :]) == len(text)


def test_small_edits_encode_little(encoder):
    text = "some words of a long text " * 4000
    tree = tc.Tree(text, lambda s: len(encoder.encode_ordinary(s)))
    tree.encoded = 0
    tree.edit(50_000, 50_003, "new")
    assert tree.encoded < 4 * tc.LEAF


def test_rows_and_edits_table(spark, encoder):
    docs = spark.createDataFrame([(1, "ab cd"), (1, "xy"), (2, None), (3, ""), (None, "free")], "doc_id long, text string")
    docs = docs.selectExpr("*", "5 AS n_tokens")
    rows = [(1, 2, 0, 1, "Z"), (1, 1, 0, 0, "new "), (2, 1, 0, 9, "born"), (9, 1, 0, 0, "x"), (None, 1, 0, 0, "y"), (3, 1, None, None, None)]
    edits = spark.createDataFrame(rows, "doc_id long, seq int, start int, end int, text string")
    got = {(r.doc_id, r.text): r for r in tc.count(docs, edits, RANKS, public_tokenizers.PATTERN).collect()}
    n = lambda s: len(encoder.encode_ordinary(s))
    assert got[1, "ab cd"].text_after == "Zew ab cd" and got[1, "xy"].text_after == "Zew xy"
    assert got[2, None].text_after == "born" and got[2, None].n_tokens == 0 and got[2, None].n_tokens_after == n("born")
    assert got[3, ""].text_after == "" and got[None, "free"].n_tokens_after == n("free") == got[None, "free"].n_tokens
    assert tc.count(docs.limit(0), edits, RANKS, public_tokenizers.PATTERN).count() == 0


def test_query_rows_equal_full_recount(spark, sf_dir, encoder):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in tc.report(docs, RANKS, public_tokenizers.PATTERN).collect()}
    for r in docs.select("doc_id", "text", tc.sample_edits(F.col("text"), F.col("doc_id")).alias("e")).collect():
        text = r.text
        assert got[r.doc_id].n_tokens == len(encoder.encode_ordinary(text))
        for e in r.e:
            a, b = min(e.start, len(text)), min(e.end, len(text))
            text = text[:a] + e.text + text[b:]
        assert got[r.doc_id].n_tokens_after == len(encoder.encode_ordinary(text))


def test_stored_trees_take_the_next_edits(spark, encoder, tmp_path):
    n = lambda s: len(encoder.encode_ordinary(s))
    docs = spark.createDataFrame([(1, "some words of a long text " * 400), (2, None), (3, "short")], "doc_id long, text string")
    schema = "doc_id long, seq int, start int, end int, text string"
    one = spark.createDataFrame([(1, 1, 5000, 5003, "new"), (2, 1, 0, 0, "born here")], schema)
    two = spark.createDataFrame([(1, 1, 0, 4, "Other"), (2, 1, 4, 9, ""), (3, 1, 0, 0, "very ")], schema)
    tc.count(docs, one, RANKS, public_tokenizers.PATTERN, tree="tree").write.parquet(f"{tmp_path}/first")
    first = spark.read.parquet(f"{tmp_path}/first")
    got = {r.doc_id: r for r in tc.count(first, two, RANKS, public_tokenizers.PATTERN, text="text_after", tree="tree").collect()}
    before = {r.doc_id: r for r in first.collect()}
    assert got[2].text_after == "born" and got[3].text_after == "very short"
    for k, r in got.items():
        assert r.n_tokens == before[k].n_tokens_after and r.n_tokens_after == n(r.text_after)
        assert sum(x.chars for x in r.tree) == len(r.text_after) and sum(x.tokens for x in r.tree) == r.n_tokens_after
    assert got[1].n_encoded < 3 * tc.LEAF
    # leaves that do not fit their text are not believed; those that fit are, and nothing is encoded for them
    stale = first.selectExpr("doc_id", "text_after AS text", "array(named_struct('chars', 1L, 'tokens', 77L, 'digest', 5L)) AS tree")
    assert {r.n_tokens for r in tc.count(stale, None, RANKS, public_tokenizers.PATTERN, tree="tree").collect()} == {r.n_tokens_after for r in before.values()}
    calls = []
    tree = tc.Tree("ab cd", lambda s: calls.append(s) or n(s), [{"chars": 5, "tokens": n("ab cd"), "digest": tc.digest("ab cd")}])
    assert tree.n_tokens == n("ab cd") and not calls


def test_leaves_of_another_text_of_the_same_length_are_not_believed(spark, encoder):
    n = lambda s: len(encoder.encode_ordinary(s))
    texts = ["plain words here", "qzxv kjwpq vvvvv"]
    assert len(texts[0]) == len(texts[1]) and n(texts[0]) != n(texts[1])
    docs = spark.createDataFrame([(1, texts[0]), (2, None), (3, "")], "doc_id long, text string")
    kept = tc.count(docs, None, RANKS, public_tokenizers.PATTERN, tree="tree").drop("text_after")
    moved = kept.selectExpr("doc_id", "CASE WHEN doc_id = 1 THEN 'qzxv kjwpq vvvvv' ELSE text END AS text", "tree")
    got = {r.doc_id: r for r in tc.count(moved, None, RANKS, public_tokenizers.PATTERN, tree="tree").collect()}
    assert got[1].n_tokens == n(texts[1]) and got[2].n_tokens == got[3].n_tokens == 0
    part = [{"chars": 5, "tokens": 1, "digest": tc.digest("plain")}]
    assert tc.Tree(texts[0], n, part).n_tokens == n(texts[0])


def test_very_long_text_over_spark(spark, encoder):
    text = "some words, and 12 more of a very long text\n" * 40_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    edits = spark.createDataFrame([(1, 1, 900_000, 900_004, "new")], "doc_id long, seq int, start int, end int, text string")
    r = tc.count(docs, edits, RANKS, public_tokenizers.PATTERN).first()
    after = text[:900_000] + "new" + text[900_004:]
    assert r.text_after == after and r.n_tokens_after == len(encoder.encode_ordinary(after)) and r.n_encoded < 4 * tc.LEAF
