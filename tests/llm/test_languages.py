import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsloom.llm import languages

EN = "the quick brown fox jumps over the lazy dog and runs with that other animal through this green forest every day "
DE = "der schnelle braune fuchs springt über den faulen hund und läuft mit dem anderen tier jeden tag durch diesen wald "


@pytest.fixture(scope="module")
def model(spark):
    rows = [("en", EN * 3), ("de", DE * 3), ("fr", "le renard brun saute par dessus le chien paresseux et court dans la forêt verte " * 3), (None, EN), ("en", None)]
    return languages.learn(spark.createDataFrame(rows, "lang string, text string"))


def test_counts_equal_plain_code(spark):
    text = "Ab é. ab"
    data = [b - 64 if 65 <= b <= 90 else b - 96 if 97 <= b <= 122 else b - 101 if b >= 128 else 0 for b in b" " + text.encode() + b" "]
    want = {}
    for a, b, c in zip(data, data[1:], data[2:]):
        if b:
            h = (((a * 160 + b) * 160 + c) * 2654435761 & 0xFFFFFFFF) >> 16
            want[h] = want.get(h, 0) + 2
    df = spark.createDataFrame([("x", text), ("x", text)], "lang string, text string")
    assert {r.bucket: r.n for r in languages.count_trigrams(df).collect()} == want


def test_mixtures_follow_plain_em():
    rng = np.random.default_rng(0)
    like = rng.random((3, 40)).astype(np.float32)
    share = np.full(3, 1 / 3)
    for _ in range(languages.ROUNDS):
        joint = like[:, :25] * share[:, None]
        share = (joint / joint.sum(0)).mean(1)
    got, fit = languages.mixtures(like, np.array([0, 25]), np.ones((3, 2)))
    assert np.allclose(got[:, 0], share, atol=1e-5) and abs(fit[0] - np.log((like[:, :25] * share[:, None]).sum(0)).sum()) < 1e-3


def test_predictions_and_sets(spark, model):
    rows = [(1, EN), (2, DE), (3, EN * 2 + DE), (4, None), (5, "12 345 — …"), (6, ""), (7, "д"), (None, DE)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'zz' AS lang_pred")
    got = {r.doc_id: r for r in languages.predict(docs, model).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3, 4, 5, 6, None)] == ["en", "de", "en", "und", "und", "und", "de"]
    assert {x.lang for x in got[3].languages} == {"en", "de"} and [x.lang for x in got[1].languages] == ["en"]
    assert got[7].lang_pred != "und" and all(0 <= r.score <= 1 for r in got.values()) and got[4].score == 0
    assert languages.predict(docs.limit(0), model).count() == 0


def test_logarithms_equal_plain_counts(spark, model):
    counts = {}
    rows = [("en", EN * 3), ("de", DE * 3)]
    for r in languages.count_trigrams(spark.createDataFrame(rows, "lang string, text string")).collect():
        counts.setdefault(r.lang, {})[r.bucket] = r.n
    used = np.array(sorted(set(counts["en"]) | set(counts["de"]) | {0, languages.BUCKETS - 1}))
    got = languages._columns(model[1], used)
    for name in ("en", "de"):
        whole = sum(counts[name].values()) + languages.ALPHA * languages.BUCKETS
        want = np.log([(counts[name].get(b, 0) + languages.ALPHA) / whole for b in used.tolist()])
        assert np.allclose(got[model[0].index(name)], want, atol=1e-4)


def test_sets_equal_plain_search(model):
    """The chosen set is the prefix of languages, by their share in the full mixture, with the largest penalised likelihood."""
    texts = [EN, DE, EN + DE, EN * 2 + DE * 2, EN[:20] + DE[:30], "the der", "x"]
    names, logs = model
    _, _, chosen = languages.infer(pa.array(texts), logs)
    table = np.exp(languages._columns(logs, np.arange(languages.BUCKETS)).astype(np.float64))
    for t, text in enumerate(texts):
        codes, first, _ = languages.word_trigrams(pa.array([text]))
        words = np.multiply.reduceat(table[:, codes], first, axis=1)
        words /= words.max(0)
        share = np.full(len(names), 1 / len(names))

        def em(allowed, words=words):
            share = allowed / allowed.sum()
            for _ in range(languages.ROUNDS):
                joint = words * share[:, None]
                share = (joint / joint.sum(0)).mean(1)
            return share, np.log((words * share[:, None]).sum(0)).sum()

        share, _ = em(np.ones(len(names)))
        order = np.argsort(-share, kind="stable")
        one = np.log(words).sum(1)
        best, value = {int(one.argmax())}, one.max()
        step = languages.STEP + np.log(words.shape[1]) / 2
        for k in range(2, len(names) + 1):
            allowed = np.zeros(len(names))
            allowed[order[:k]] = 1
            reached = em(allowed)[1] - (k - 1) * step
            if reached > value + 1e-3:
                best, value = set(order[:k].tolist()), reached
        assert set(np.flatnonzero(chosen[:, t] > 1e-6)) <= best and {int(chosen[:, t].argmax())} <= best


def test_two_thousand_languages(spark):
    rows = [(k, "en" if k % 2 else "de", EN if k % 2 else DE) for k in range(200)] + [(1000 + k, f"junk{k}", f"word{k} abc") for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = languages.report(docs.filter("doc_id < 30 OR doc_id >= 1000")).filter("doc_id < 30").collect()
    assert len(got) == 30 and all(r.lang_pred == ("en" if r.doc_id % 2 else "de") for r in got)


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert languages.report(docs).select("lang_pred", "score").first() == ("und", 0.0)


def test_long_and_short_texts_side_by_side(model):
    best, score, chosen = languages.infer(pa.array([EN, None, EN * 5000, "", DE]), model[1])
    assert [model[0][k] if k >= 0 else None for k in best] == ["en", None, "en", None, "de"]


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/documents.parquet")
    got = languages.report(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.98
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in languages.report(docs).collect())
