"""The pipeline against brute force, stage by stage and as a whole, on a small corpus."""

import random
import re

import public_tokenizers
import pyarrow as pa
import sentencepiece
from test_decontamination import brute as contaminated
from test_jaccard import brute as components
from test_substrings import brute as shortened

import corpus_pipeline

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(3)
    vocabulary = {
        "en": "the of and house river green walking under bright morning people their common window".split(),
        "de": "der die und haus fluss grün gehen unter hell morgen leute ihre fenster straße".split(),
    }
    fresh = lambda lang, n: [rng.choice(vocabulary[lang]) + str(rng.randrange(90)) for _ in range(n)]

    def prose(lang, n):
        w = fresh(lang, n)
        return " ".join(x + ("." if k % 9 == 8 else "") for k, x in enumerate(w))

    bench = [(k, " ".join(fresh("en", 14))) for k in range(3)] + [(7, "short item here"), (8, None)]
    passage = prose("en", 80)
    rows = []
    for k in range(60):
        lang = "de" if k % 3 == 0 else "en"
        text = prose(lang, rng.randrange(30, 120))
        if k % 7 == 1:
            text += ". " + passage + " " + prose(lang, 40)
        if k % 11 == 2:
            text += " " + bench[k % 3][1] + " end."
        rows.append([text, lang])
    base = rows[0][0]
    rows += [[base, "de"], [base + " fin", "de"], [base.replace("1", "1"), "de"], [None, "en"], ["", None], ["123 — 456", "en"], ["und so " + rows[3][0], None]]
    rows.append([rows[5][0] + " short item here", "en"])
    return [(3 * k + 1, t, g, f"src{k % 3}", len(t or "")) for k, (t, g) in enumerate(rows)], bench


def write(spark, folder):
    rows, bench = corpus()
    spark.createDataFrame(rows, FIELDS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, bench


def test_run_equals_brute_force(spark, tmp_path):
    rows, bench = write(spark, str(tmp_path))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # language: only texts without a letter are in no language here
    kept = [(d, t) for d, t, *_ in rows if t and re.search(r"[^\W\d_]", t)]
    groups = components(kept)
    kept = [(d, t) for d, t in kept if groups[d][1] == d]
    texts = {d: t for d, t in shortened(kept, 51).items() if t.strip() or not dict(kept)[d].strip()}
    texts = {d: t for d, t in texts.items() if not contaminated(t, bench, 10)[1]}
    assert got.keys() == texts.keys()
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    lang = {d: g for d, _, g, *_ in rows}
    for d, r in got.items():
        assert r.text == texts[d] and r.n_chars == len(texts[d]) and r.ids == library.encode(texts[d]) and r.agrees
        assert r.lang == (lang[d] or "de") and r.n_tokens == len(r.ids)


def test_stages_keep_the_columns_and_drop_what_they_must(spark, tmp_path):
    rows, _ = write(spark, str(tmp_path))
    docs = spark.createDataFrame(rows, FIELDS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.names == docs.schema.names, name
        assert 0 < out.count() <= docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "ngram_jaccard_join", "substring_dedup", "benchmark_decontamination", "sentencepiece_encoding",
    ]


def test_clashing_names_and_repeated_ids(spark, tmp_path):
    write(spark, str(tmp_path))
    rows = [(1, "the house and the river", "x", 5), (1, "the people and the window", "y", 6), (2, "the house and the river", "z", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __lang string, score int").selectExpr("*", "'en' AS lang")
    kept = corpus_pipeline.language_id(spark, docs, str(tmp_path))
    assert sorted(map(tuple, kept.collect())) == sorted((*r, "en") for r in rows)
    alone = [sorted(map(tuple, corpus_pipeline.near_duplicates(spark, docs.repartition(n), str(tmp_path)).collect())) for n in (1, 3)]
    assert alone[0] == alone[1] == [(1, "the house and the river", "x", 5, "en")]


def test_empty_and_odd_documents(spark, tmp_path):
    write(spark, str(tmp_path))
    empty = spark.createDataFrame([], FIELDS)
    odd = spark.createDataFrame([(None, "the house and the river", None, None, None), (1, None, None, None, None)], FIELDS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
        assert stage(spark, odd, str(tmp_path)).filter("text IS NOT NULL").count() == 1


def test_stages_hand_whole_texts_on_in_small_batches(spark, tmp_path):
    """Executors ran out of memory: batches were bounded by rows alone, and decoded texts came back to be dropped."""
    write(spark, str(tmp_path))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    docs = spark.range(0, 400, 1, 1).selectExpr(
        "id AS doc_id", "repeat('the house and the river ', 400) AS text", "'en' AS lang", "'s' AS source", "9600L AS n_chars"
    )

    def sizes(source):
        for batch in source:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.set(key, before)
            out = stage(spark, docs, str(tmp_path))
            assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) < 600_000
        assert "decoded" not in out._jdf.queryExecution().analyzed().toString()
        spark.conf.set(key, "64k")  # a smaller one of the session's own stays
        corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path))
        assert spark.conf.get(key) in ("64k", "65536b")
    finally:
        spark.conf.set(key, before)
