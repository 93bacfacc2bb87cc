"""Places in whole tables, stable partitions, and slots that take articles from each other."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators import buffer, order, select, store

from test_operators import articles, words


def nodes(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbering_a_whole_table(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 2, 3]), k, rng.random()) for k in range(5000)]
    df = spark.createDataFrame(rows, "a int, id long, x double").repartition(7)
    got = order.numbered(df, F.desc("a"), F.asc("id"))
    assert "SinglePartition" not in nodes(got) and "Window" not in nodes(got) and got.columns == ["a", "id", "x", "ord"]
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [(r.a, r.id, r.x) for r in sorted(got.collect(), key=lambda r: r.ord)] == want
    assert sorted(r.ord for r in got.collect()) == list(range(1, 5001))
    # a column of that name gives way, ties each have a place, an empty table stays empty
    again = order.numbered(got, F.desc("ord"))
    assert {r.id: r.ord for r in again.collect()} == {r.id: 5001 - r.ord for r in got.collect()}
    tied = order.numbered(spark.range(900).select(F.lit(1).alias("k")), F.asc("k"))
    assert sorted(r.ord for r in tied.collect()) == list(range(1, 901))
    assert order.numbered(df.limit(0), F.asc("id")).count() == 0


def test_stable_partition_drops_nothing(spark):
    titles = ["alpha beta gamma delta", "other words stand here", "alpha beta gamma delta", "third subject line now", "other words stand here"]
    rows = [{"title": t, "content": "", "summary": ""} for t in titles * 40]
    every = order.numbered(articles(spark, rows), F.asc("id"))
    whole, pool = select.diversified(every), select.diversified(every, bounded=True)
    assert "SinglePartition" not in nodes(whole) and "Window" not in nodes(whole)
    ids = lambda df: [r.id for r in sorted(df.collect(), key=lambda r: r.ord)]
    assert ids(whole) == ids(pool) == [0, 1, 3] + [k for k in range(200) if k not in (0, 1, 3)]
    assert ids(select.rank(every, "valais")) == ids(select.rank(every, "valais", bounded=True))


def test_first_of_a_key_that_most_rows_share(spark):
    rows = [{"title": "one frequent title of all" if k % 10 else words(k)} for k in range(300)]
    every = order.numbered(articles(spark, rows).orderBy(F.desc("id")), F.desc("id"))
    got = select.unique_stories(every)
    assert "Window" not in nodes(got) and {r.id for r in got.collect()} == {299} | {k for k in range(300) if k % 10 == 0}
    assert got.columns == every.columns


SETS = {
    "sports": {"strong": (r"\bfootball\b",), "team": (r"\bsion\b",), "context": (r"\bfestival\b", r"\bsoleil\b")},
    "low_value": (r"^soleil\b",), "child": (r"\battaque\b",), "anxiety": (r"\bguerre\b", r"\bcrise\b", r"\battaque\b"), "calm": (r"\bmusique\b", r"\bpaix\b"),
}
TOPICS = {
    "valais": (r"\bsion\b", r"\bmartigny\b"), "suisse_romande": (r"\bmartigny\b",), "international_english": (r"\bonu\b",), "un_relevant": (r"\bpeacekeeping\b", r"\bonu\b"),
    "security_world": (r"\bguerre\b", r"\battaque\b"),
}
SUBJECTS = (("war", r"\bguerre\b"),)
STYLES = [
    select.Style("valais"), select.Style("international_english", "en"), select.Style("enfant"), select.Style("anxiogene"), select.Style("suisse_romande"),
    select.Style("un_relevant", "en"), select.Style("non_anxiogene"), select.Style("security_world"),
]


def pool(spark, n=260):
    rng = random.Random(24)
    start = datetime.datetime(2024, 1, 1)
    bits = ["guerre", "crise", "festival", "musique", "Sion", "Martigny", "football", "Conseil federal", "ONU", "paix", "attaque", "", "soleil", "peacekeeping"]
    rows = []
    for k in range(n):
        region = rng.choice(["valais", "suisse", "suisse-romande", "international", "english", "general"])
        title = f"{rng.choice(bits)} {words(rng.randrange(n))}"
        rows.append(
            {
                "title": title, "summary": f"{rng.choice(bits)} {words(k)[:30]}", "region": region, "language": "en" if region == "english" else rng.choice(["fr", "fr", "unknown", "de"]),
                "source_name": rng.choice(["Radio A", "UN News", "Canal9"]), "priority": rng.choice([40, 50, 60]), "status": rng.choice(["new", "new", "used"]),
                "used_count": rng.randrange(3), "published_at": rng.choice([None, start + datetime.timedelta(hours=rng.randrange(40))]),
            }
        )
    return articles(spark, rows).cache()


def one_after_the_other(df, slots, most, stop_after=None):
    """The selection for one slot after the other, with what each took marked as used."""
    out, uses, served = [], {}, 0
    for slot, style in slots:
        if stop_after is not None and served >= stop_after:
            break
        used = df.sparkSession.createDataFrame(list(uses.items()) or [(-1, 0)], "id long, n long")
        now = df.join(F.broadcast(used), "id", "left").withColumns(
            {"status": F.when(F.col("n") > 0, "used").otherwise(F.col("status")), "used_count": F.col("used_count") + F.coalesce("n", F.lit(0))}
        )
        taken = [r.id for r in select.selection(now.drop("n"), style, most, SETS, TOPICS, SUBJECTS).collect()]
        for k, i in enumerate(taken):
            uses[i] = uses.get(i, 0) + 1
            out.append((slot, k + 1, i))
        served += bool(taken)
    return out


def test_a_buffer_of_24_slots_equals_one_selection_after_the_other(spark):
    df = pool(spark)
    slots = [(f"2024-01-01T{h:02d}", STYLES[h % len(STYLES)]) for h in range(24)]
    got = buffer.fill(df, slots, 7, SETS, TOPICS, SUBJECTS)
    rows = sorted((r.slot, r.ord, r.id) for r in got.collect())
    assert rows == one_after_the_other(df, slots, 7)
    assert len({i for _, _, i in rows}) > 50 and {r.filled_up for r in got.collect()} == {False, True}


def test_a_buffer_stops_after_so_many_slots(spark):
    df = pool(spark, 60)
    slots = [(f"s{k}", s) for k, s in enumerate([select.Style("nothing"), *STYLES[:4]])]
    got = sorted((r.slot, r.ord, r.id) for r in buffer.fill(df, slots, 3, SETS, TOPICS, SUBJECTS, stop_after=2).collect())
    assert got == one_after_the_other(df, slots, 3, 2) and len({s for s, _, _ in got}) == 2
    assert buffer.fill(df, [], 3).count() == 0 and buffer.fill(df.limit(0), slots, 3).count() == 0


def test_what_the_slots_can_reach_does_not_grow_with_the_table(spark):
    df = pool(spark)
    slots = [("a", select.Style("contexte")), ("b", select.Style("contexte"))]
    assert buffer.reach([s for _, s in slots], 7) == 35 + 7
    assert buffer.pools(df, [s for _, s in slots]).count() <= 2 * 42


def test_a_stored_source_answers_to_one_configured_row(spark):
    names = "id long, name string, url string, region string, priority int, interval_minutes int, max_entries int, enabled boolean, etag string"
    base = ("general", 50, 5, 20, True)
    stored = spark.createDataFrame([(1, "N", "u1", *base, "e1"), (2, "M", "u9", *base, "e2")], names)
    given = spark.createDataFrame([(None, "X", "u1", *base, None), (None, "N", "u2", *base, None), (None, "M", "u3", *base, None)], names).drop("id", "etag")
    got = {r.name: (r.id, r.url, r.etag) for r in store.merge_sources(stored, given).collect()}
    assert got["X"] == (1, "u1", "e1") and got["M"] == (2, "u3", "e2") and got["N"][1:] == ("u2", None) and got["N"][0] not in (1, 2)
    assert len({v[0] for v in got.values()}) == 3


@pytest.mark.parametrize("key", ["valais", "anxiogene", "non_anxiogene", "other"])
def test_ranks_of_pools_in_plain_code(spark, key):
    """The buffer's ranking is the selection's."""
    from newsloom.functions import fixed_values as V

    df = pool(spark)
    style = select.Style(key)
    rows = [r.asDict(True) for r in buffer.pools(df, [style]).collect()]
    recents = sorted((r for r in rows if r["as_recent"]), key=lambda r: r["as_recent"])
    ids = {r["id"] for r in recents}
    ranked = select.rank(select.numbered(df.filter(F.col("id").isin(list(ids))), *select.recent_order()), key, bounded=True)
    assert [r["id"] for r in buffer._ranked(recents, key, V.TOPICS)] == [r.id for r in ranked.orderBy("ord").collect()]
