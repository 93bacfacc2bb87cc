"""Work that grows with the input, not with its square, and the same results as plain code."""

import random
import time

from pyspark.sql import functions as F

from newsloom.functions import fixed_values as V
from newsloom.functions import text as X
from newsloom import schema as S
from newsloom.operators import bulletin, search, search_index
from newsloom.plans import queries as plans
from newsloom.sources import feed_files, feeds
from newsloom.sources.commits import Tables


def seconds(act):
    began = time.time()
    out = act()
    return out, time.time() - began


def plain_opening(text):
    seen = {}
    for k, p in enumerate(text.split("\n\n")):
        words = p.split()
        bare = [w.strip(" ,;:.!?").lower() for w in words[:3]]
        bare = [w for w in bare if w]
        if len(words) >= 8 and len(bare) >= 2:
            seen.setdefault(" ".join(bare), []).append(k)
    often = [(ks[0], o) for o, ks in seen.items() if len(ks) >= 4]
    return min(often)[1] if often else None


def test_repeated_opening_of_very_many_paragraphs(spark):
    dice = random.Random(7)
    words = ["A", "b,", "!", "Cé", "d e", "f\t g", "..", "h"]
    small = ["\n\n".join(" ".join(dice.choices(words[: dice.randint(2, 8)], k=dice.randint(5, 10))) for _ in range(dice.randint(0, 30))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in small], "t string").select("t", bulletin.repeated_opening("t").alias("o")).collect()
    assert [r.o for r in rows] == [plain_opening(r.t) for r in rows] and any(r.o for r in rows)
    long = "\n\n".join(f"word{k} and more of what stands in this paragraph" for k in range(5000))
    one = spark.range(1).select(F.lit(long + "\n\nlast one here of eight words or more" * 4).alias("t"))
    found, took = seconds(lambda: one.select(bulletin.repeated_opening("t").alias("o")).first().o)
    assert found == "last one here" and took < 30


def test_sentence_budget_reads_texts_once(spark, sf_dir):
    plan = plans.queries()["sentence_budget"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_bylines_by_groups_equal_bylines_in_order(spark):
    assert tuple(p for _, _, group in V.BYLINE_GROUPS for p in group) == V.BYLINES
    made = ["Par Jean Dupont © 2024 AFP Texte.", "Par Anne et Paul Texte ici.", "Genève Berne avec agences Suite.", "Lu TV5 JWPlayer Field fin", "© 2024 AFP Suite", "a\n CONTINUE reading. ", "x • Don’T get y", "x DON'T GET y", "x SIGN UP here y", ". . rien .", ""]
    rows = spark.createDataFrame([(f"{a} {b}",) for a in made for b in made], "t string").withColumn("s", F.lit("Le Temps"))

    def slow(c):
        out = X.without_source(c, "s")
        for p in V.BYLINES:
            out = F.regexp_replace(out, p, "")
        return F.regexp_replace(X.squeeze(out), r"^[ .]+|[ .]+$", "")

    got = rows.select("t", X.article_text("t", "s").alias("a"), slow("t").alias("b")).collect()
    assert all(r.a == r.b for r in got) and any(r.a != r.t for r in got)


def test_pages_of_an_address_in_one_pass(spark, sf_dir):
    plan = plans.queries()["preset_pages"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    # one of the documents, one of the labels
    assert plan.count("FileScan parquet") == 2


def test_a_gram_of_all_items_is_written_by_several_tasks(spark, tmp_path):
    items = spark.range(40).select("id", *[F.lit("abc").alias(c) if c == "title" else F.lit("").alias(c) for c in search.SEARCHED])
    tables = Tables(spark, str(tmp_path / "t"), {"items": items.schema, "postings": search_index.POSTINGS}).init()
    search_index.add(tables, items)
    held = tables.read("postings").filter("gram = 'abc'").withColumn("file", F.input_file_name())
    assert held.count() == 40 and held.select("file").distinct().count() > 1
    assert search_index.find(tables, '"abc"').count() == 40


def test_a_poll_parses_files_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for f in range(3):
        made = "".join(f"<item><title>t{f}{k}</title><link>http://x/{f}/{k}</link></item>" for k in range(5))
        (tmp_path / "in" / f"{f}.xml").write_text(f"<rss>{made}</rss>")
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    def prepare(entries):
        found = feeds.items(entries).withColumn("scraped_at", F.lit(None).cast("timestamp"))
        return found.mapInArrow(run, found.schema)

    tables = Tables(spark, str(tmp_path / "t"), {"log": S.ARTICLE_LOG, "feed_files": feed_files.FEED_FILES}).init()
    assert feed_files.poll(spark, str(tmp_path / "in"), tables, "log", prepare) == {"listed": 3, "read": 3, "added": 15}
    assert seen.value == 15
    assert [r.arrival for r in tables.read("log").orderBy("url").select("arrival").collect()] == list(range(1, 16))
