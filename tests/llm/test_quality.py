import math
import random
import re
import time
from collections import Counter

from newsloom.llm import quality


def words(text):
    """Words by a pattern, with digits alike."""
    found = re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+|[!-/:-@\[-`{-~]+", text or "")
    return [re.sub("[0-9]", "0", re.sub("[A-Z]", lambda m: m[0].lower(), w)) for w in found]


def pairs(text):
    return list(zip(["<"] + words(text), words(text)))


class Plain:
    """Interpolated modified Kneser-Ney of two words, written from its definition."""

    def __init__(self, counts, discounts):
        self.pairs, (self.two, self.one) = counts, discounts
        self.behind = Counter(w for _, w in counts)

    @staticmethod
    def discounts(counts):
        m = Counter(counts)
        if not m[1] or not m[2]:  # too little to tell
            return [0, 0.5, 0.5, 0.5]
        y = m[1] / (m[1] + 2 * m[2])
        return [0] + [min(i, max(0.01, i - (i + 1) * y * m[i + 1] / m[i])) if m[i] else 0.5 for i in (1, 2, 3)]

    def share(self, own, row, d, lower):
        left = sum(d[min(3, n)] for n in row)
        return (max(0.0, own - d[min(3, own)]) + left * lower) / sum(row)

    def p(self, g):
        one = self.share(self.behind[g[1]], self.behind.values(), self.one, 1 / (len(self.behind) + 1))
        row = [n for other, n in self.pairs.items() if other[0] == g[0]]
        return self.share(self.pairs[g], row, self.two, one) if row else one

    def perplexity(self, text):
        logs = [math.log(self.p(g)) for g in pairs(text)]
        return math.exp(-sum(logs) / len(logs))


def sentence(rng):
    return " ".join(rng.choice(["the", "of", "reading", "étude", "House", "12", "and,"]) for _ in range(rng.randrange(1, 9))) + "."


def test_perplexity_equals_plain_model(spark):
    rng = random.Random(2)
    rows = [(k, sentence(rng), rng.choice(["en", "fr", None])) for k in range(60)]
    rows += [(100, "XQ #$% zz~ 99", "en"), (101, None, "en"), (102, "", "fr"), (103, " \n\t", "fr"), (None, "the of", "en"), (5, rows[5][1], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS block", "2 AS g").repartition(3)
    trusted = spark.createDataFrame([(k,) for k in range(0, 60, 2)] + [(None,), (0,), (999,)], "doc_id long")
    got = quality.judge(docs, trusted).collect()
    assert len(got) == len(rows)
    half = dict(docs.select("doc_id", quality.fold("doc_id").alias("f")).collect())
    counts = [Counter(g for k, t, _ in rows[:60] if k % 2 == 0 and half[k] == f for g in pairs(t)) for f in (0, 1)]
    # both halves' counts give the discounts
    two = Plain.discounts([n for c in counts for n in c.values()])
    one = Plain.discounts([n for c in counts for n in Counter(w for _, w in c).values()])
    plain = [Plain(c, (two, one)) for c in counts]
    texts = {k: t for k, t, _ in rows}
    for r in got:
        text = texts[r.doc_id]
        assert r.n_words == len(words(text))
        if not words(text):
            assert r.perplexity is None and not r.keep
        else:
            assert abs(r.perplexity / plain[1 - half[r.doc_id]].perplexity(text) - 1) < 1e-6
            assert r.keep == (r.perplexity <= r.cutoff)
    assert not next(r.keep for r in got if r.doc_id == 100)


def test_shards_and_blocks_add_up(spark, monkeypatch):
    rng = random.Random(3)
    docs = spark.createDataFrame([(k, sentence(rng) + " " + sentence(rng), "en") for k in range(80)], "doc_id long, text string, lang string")
    docs = docs.union(docs.filter("doc_id = 7")).union(spark.createDataFrame([(90, "the of " * 40_000, "en")], docs.schema)).repartition(2)
    trusted = docs.select("doc_id").filter("doc_id % 3 != 0")
    whole = sorted((r.doc_id, r.n_words, round(r.perplexity, 9)) for r in quality.judge(docs, trusted).collect())
    monkeypatch.setattr(quality, "SHARD", 500)
    monkeypatch.setattr(quality, "PIECE", 300)
    assert sorted((r.doc_id, r.n_words, round(r.perplexity, 9)) for r in quality.judge(docs, trusted).collect()) == whole
    assert len(whole) == 82 and whole[-1][1] == 80_000


def test_nothing_trusted_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b", "en"), (2, None, None)], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long")
    assert sorted((r.doc_id, r.perplexity, r.keep) for r in quality.judge(docs, none).collect()) == [(1, None, True), (2, None, False)]
    assert quality.judge(docs.limit(0), docs.select("doc_id")).count() == 0


def test_cutoff_is_the_quantile_of_the_trusted_texts(spark):
    rng = random.Random(6)
    docs = spark.createDataFrame([(k, sentence(rng), "en" if k % 3 else "fr") for k in range(90)], "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(k,) for k in range(0, 90, 2)], "doc_id long")
    got = quality.judge(docs, trusted).collect()
    for lang in ("en", "fr"):
        own = sorted(r.perplexity for r in got if r.lang == lang and r.doc_id % 2 == 0)
        assert {r.cutoff for r in got if r.lang == lang} == {own[math.ceil(quality.QUANTILE * len(own)) - 1]}


def test_disk_holds_one_part_of_the_documents(spark, monkeypatch):
    """What a step shuffled is gone with it, and no step sends the keys of all documents; all parts are all documents."""
    rng = random.Random(7)
    docs = spark.createDataFrame([(k if k % 5 else None, sentence(rng), "en") for k in range(400)], "doc_id long, text string, lang string")
    env, left, asked = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get(), [], []
    files = lambda: [name for f in env.blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if (name := f.rsplit("/")[-1]).startswith("shuffle_")]
    keep, ask = quality.Workspace.keep, quality.asked

    def kept(self, df, *more):
        before = set(files())
        out = keep(self, df, *more)
        end = time.monotonic() + 5
        while (new := set(files()) - before) and time.monotonic() < end:
            time.sleep(0.1)
        left.append(len(new))
        return out

    monkeypatch.setattr(quality.Workspace, "keep", kept)
    monkeypatch.setattr(quality, "asked", lambda used, *more: asked.append(used.count()) or ask(used, *more))
    monkeypatch.setattr(quality, "SHARD", 500)
    setting = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false")
    got = quality.judge(docs, docs.select("doc_id").filter("doc_id % 2 = 0"))
    assert got.count() == 400 and sum(asked) == 400 and max(asked) < 130
    assert left and not any(left)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == setting


def test_a_block_sends_a_word_once_for_each_document(spark, monkeypatch):
    """A hot word costs a shard as many places as documents hold it, not as it occurs; blocks end between documents."""
    monkeypatch.setattr(quality, "PIECE", 15_000)
    monkeypatch.setattr(quality, "BLOCK", 5_000)
    docs = spark.createDataFrame([(k, "the of " * 1_000, "en") for k in range(6)], "doc_id long, text string, lang string").repartition(1)
    rows = quality.asked(docs.withColumn("fold", quality.fold("doc_id")), 2).collect()
    assert len({r.block for r in rows}) == 3 and sum(r.rows is not None for r in rows) == 3
    # the, of, < the, the of, of the
    assert sum(r.n_places for r in rows) == 6 * 5
