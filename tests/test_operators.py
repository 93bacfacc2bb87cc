"""Operators on small tables of our own."""

import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators import bulletin, publish, schedule, search, select, store

ARTICLE = (
    "id long, source_name string, title string, url string, published_at timestamp, created_at timestamp, summary string, content string, "
    "priority int, region string, language string, status string, is_sports boolean, used_count long"
)


def articles(spark, rows):
    base = {
        "source_name": "Radio A", "title": "Nouvelle du village heureux", "url": "u", "published_at": None, "created_at": None, "summary": "",
        "content": "Le texte est dans la langue du pays avec les habitants", "priority": 50, "region": "general", "language": "fr",
        "status": "new", "is_sports": False, "used_count": 0,
    }
    names = [f.split()[0] for f in ARTICLE.split(", ")]
    full = [{**base, "id": k, **r} for k, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], ARTICLE)


def words(k):
    rng = random.Random(k)
    return " ".join("".join(rng.choice("bcdfgklm") + rng.choice("aeiou") for _ in range(3)) for _ in range(6))


def ids(df):
    return [r.id for r in df.orderBy("ord").collect()]


def test_selection_caps_at_seven_and_follows_relevance(spark):
    rows = [{"title": words(k), "region": "valais" if k in (3, 9) else "general", "priority": 50 + k} for k in range(12)]
    got = ids(select.selection(articles(spark, rows), select.Style("valais"), 12))
    assert got[:2] == [9, 3] and len(got) == 2 or len(got) <= 7


def test_selection_fills_up_from_used_articles(spark):
    rows = [{"title": words(k), "status": "used" if k > 1 else "new", "priority": k} for k in range(10)]
    got = ids(select.selection(articles(spark, rows), select.Style("contexte"), 5))
    assert got[:2] == [1, 0] and len(got) == 5
    none = select.selection(articles(spark, rows), select.Style("international"), 5)
    assert none.count() == 0  # nothing is relevant, and nothing fills up


def test_selection_looks_deep_enough(spark):
    rows = [{"title": words(k), "source_name": "A", "priority": 150} for k in range(140)]
    rows += [{"title": "UN News item about peacekeeping", "source_name": "UN News", "priority": 100, "language": "en", "region": "english"}]
    got = select.selection(articles(spark, rows), select.Style("un_relevant", "en"), 3).collect()
    assert [r.id for r in got] == [140]


def test_languages_do_not_mix(spark):
    rows = [
        {"language": "de"}, {"language": "unknown", "content": "Der Rat der Stadt ist mit den Leuten nicht im Saal und von der Stadt"},
        {"language": "fr", "region": "english"}, {"language": "en", "region": "english"}, {"language": "unknown", "content": "x y"}, {},
    ]
    rows[1]["title"] = "Die Stadt und der Rat"
    got = lambda code: sorted(r.id for r in select.in_language(articles(spark, rows), code).collect())
    assert got("fr") == [4, 5] and got("en") == [3]


def test_topic_filter_keeps_all_where_few_are_relevant(spark):
    rows = [{"title": words(k), "content": "", "region": "valais" if k < 3 else "general"} for k in range(8)]
    a = articles(spark, rows)
    assert select.for_topic(a, "valais", 3).count() == 3 and select.for_topic(a, "valais", 4).count() == 8
    assert select.for_topic(a, "international", 4).count() == 0 and select.for_topic(a, "nothing", 4).count() == 8
    assert select.for_topic(a, "international_english").count() == 8 and select.for_topic(a, "un_relevant").count() == 0


def test_moods(spark):
    rows = [{"title": words(k), "content": c} for k, c in enumerate(["guerre crise", "", "festival film", "guerre", "musique", "", "", ""])]
    ranked = lambda df, key: ids(select.rank(select.numbered(df, F.asc("id")), key))
    a = articles(spark, rows)
    assert ranked(a, "anxiogene")[:2] == [0, 3]
    assert ranked(a, "non_anxiogene") == [2, 4, 1, 5, 6, 7]  # six calm ones: the alarming ones go
    assert ranked(a.filter("id < 5"), "non_anxiogene") == [2, 4, 1, 0, 3]
    assert ranked(a, "other") == list(range(8))


def test_repeats(spark):
    rows = [{"title": t, "content": ""} for t in ("Cannes un", "Cannes deux longtemps", "Ukraine", "Cannes deux longtemps!", "Ukraine bis")]
    a = select.numbered(articles(spark, rows), F.asc("id"))
    assert ids(select.diversified(a)) == [0, 2, 1, 3, 4] and ids(select.unique_subjects(a)) == [0, 2]
    assert ids(select.unique_stories(a)) == [0, 1, 2, 4]
    shuffled = select.numbered(articles(spark, rows).repartition(7), F.asc("id"))
    assert ids(select.diversified(shuffled)) == [0, 2, 1, 3, 4]


def test_children_and_low_value(spark):
    rows = [{"title": "Un meurtre"}, {"title": "Un parc"}, {"title": "Live: le lac"}, {"title": "Match de football"}]
    a = articles(spark, rows)
    assert {r.id for r in select.for_children(a).collect()} == {1, 2, 3}
    assert {r.id for r in select.without_low_value(a).collect()} == {0, 1, 3} and {r.id for r in select.without_sports(a).collect()} == {0, 1, 2}


def log(spark, rows):
    names = "arrival long, source_id long, title string, url string, published_at timestamp, published_at_raw string, scraped_at timestamp, summary string, content string, language string"
    ts = lambda s: None if s is None else __import__("datetime").datetime.fromisoformat(s)
    return spark.createDataFrame([(a, s, t, u, ts(p), p, ts(c), "", "", lang) for a, s, t, u, p, c, lang in rows], names)


def test_compaction_keeps_identity_and_last_payload(spark):
    rows = [
        (1, 1, "Alt", "http://a#x", "2024-01-01", "2024-01-01", "fra"),
        (2, 2, "Neu", "http://a", None, "2024-01-02", "xx"),
        (3, 1, "Match de hockey", "http://b", "2024-01-03", "2024-01-03", "en"),
        (4, 9, "unknown source", "http://c", None, "2024-01-03", "en"),
    ]
    sources = spark.createDataFrame([(1, "S1", "valais", 10), (2, "S2", "english", 20)], "id long, name string, region string, priority int")
    got = {r.url: r for r in store.articles(log(spark, rows), sources).collect()}
    assert set(got) == {"http://a", "http://b"}
    a = got["http://a"]
    assert (a.source_id, a.title, str(a.published_at)[:10], str(a.created_at)[:10], a.language, a.arrivals) == (1, "Neu", "2024-01-01", "2024-01-01", "unknown", 2)
    assert got["http://b"].is_sports and not a.is_sports
    twice = store.articles(log(spark, rows + [(k + 10, *r[1:]) for k, r in enumerate(rows)]), sources)
    again = {r.url: (r.id, r.title, r.language) for r in twice.collect()}
    assert again == {u: (r.id, r.title, r.language) for u, r in got.items()}
    used = spark.createDataFrame([("b1", a.id), ("b1", a.id), ("b2", a.id)], "bulletin_id string, article_id long")
    state = {r.url: (r.status, r.used_count) for r in store.articles(log(spark, rows), sources, used).collect()}
    assert state == {"http://a": ("used", 2), "http://b": ("new", 0)}


def test_merge_sources(spark):
    from newsloom import schema

    def sources(rows):
        return schema.conform(spark.createDataFrame(rows, "id long, name string, url string, priority int, last_etag string"), schema.SOURCES)

    stored = sources([(1, "A", "ua", 1, "e1"), (2, "B", "ub", 2, "e2"), (3, "C", "uc", 3, None)])
    given = sources([(None, "A2", "ua", 9, None), (None, "B", "new-url", 8, None), (None, "D", "ud", 7, None)])
    got = {r.url: r for r in store.merge_sources(stored, given).collect()}
    assert {u: r.name for u, r in got.items()} == {"ua": "A2", "new-url": "B", "uc": "C", "ud": "D"}
    assert got["ua"].id == 1 and got["ua"].last_etag == "e1" and got["ua"].priority == 9 and got["new-url"].id == 2


def test_state_sets_and_marks(spark):
    frame = lambda *v: spark.createDataFrame([(x,) for x in v], "id long")
    flat = lambda df: sorted(r.id for r in df.collect())
    assert flat(store.missing(frame(1, 2, 3), frame(2), "id")) == [1, 3] and flat(store.stale(frame(1, 2), frame(2, 9), "id")) == [1]
    assert flat(store.toggled(frame(1, 2), frame(2, 3))) == [1, 3]
    marks, new = store.mark_all(frame(1), frame(1, 4, 4))
    assert flat(marks) == [1, 4] and flat(new) == [4]
    runs = spark.createDataFrame([(1, 1, "running", None), (1, 2, "ok", "done"), (2, 1, "running", None)], "id long, at long, status string, message string")
    assert {r.id: (r.status, r.message) for r in store.latest_status(runs).collect()} == {1: ("ok", "done"), 2: ("running", None)}
    counts = store.archive_counts(spark.createDataFrame([], "is_sports boolean")).first()
    assert (counts.total, counts.sports, counts.editorial) == (0, 0, 0)
    played = spark.createDataFrame([("a", 1, 50.0), ("a", 2, 95.0), ("b", 1, 3.0), ("c", 1, 40.0)], "id string, at long, position double")
    assert {r.id: r.position for r in store.resume_position(played, F.lit(100.0)).collect()} == {"a": 0.0, "b": 0.0, "c": 35.0}
    fetches = spark.createDataFrame([("s", 1, 10, "e1", "m1"), ("s", 2, 20, None, None)], "source string, fetch long, checked_at long, etag string, last_modified string")
    assert store.keep_validators(fetches).select("checked_at", "etag").first() == (20, "e1")


ITEM = "id long, title string, summary string, source string, region string, language string, search_terms string, published_at timestamp, scraped_at timestamp, is_sports boolean, child_friendly boolean, tension int, calm int, priority int"


def items(spark, rows):
    base = {"title": "t", "summary": "", "source": "s", "region": "valais", "language": "fr", "search_terms": "", "published_at": "2024-01-02 10:00:00",
            "scraped_at": "2024-01-02 11:00:00", "is_sports": False, "child_friendly": True, "tension": 0, "calm": 0, "priority": 5}
    names = [f.split()[0] for f in ITEM.split(", ")]
    full = [{**base, "id": k, **r} for k, r in enumerate(rows)]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in full], ITEM.replace("timestamp", "string"))
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ("published_at", "scraped_at")})


def test_search(spark):
    df = items(spark, [{"title": "L'ONU à Genève"}, {"title": "Monument"}, {"title": "Été fou", "summary": "onu"}])
    hits = lambda q: sorted(r.id for r in df.filter(search.matches(q)).collect())
    assert hits('"onu"') == [0, 2] and hits("onu") == [0, 1, 2] and hits("GENEVE") == [0] and hits('"onu" ete') == [2]
    assert hits('"monu"') == [1] and hits("") == [0, 1, 2] and hits("onu geneve") == []
    assert search.preset({"region": "english", "de": "1"}) == {"english": True, "region": "english", "german": True}


def test_facets_and_filters(spark):
    rows = [{}, {"language": "en"}, {"language": "", "region": "english"}, {"is_sports": True}, {"published_at": "2024-01-01 01:00:00"}, {"tension": 9}, {"language": "de"}]
    df = items(spark, rows)
    now = F.lit("2024-01-02 12:00:00").cast("timestamp")
    got = lambda **k: sorted(r.id for r in search.faceted(df, now, **k).collect())
    assert got() == [0, 5] and got(english=True) == [0, 1, 2, 5] and got(most_tension=3) == [0] and got(period="all", german=True) == [0, 4, 5, 6]
    read = spark.createDataFrame([(0,)], "id long")
    assert got(read=read) == [5] and search.counters(df, read).first() == (7, 1)
    assert [r.id for r in df.orderBy(*search.order("alert")).limit(2).collect()] == [5, 0]
    faces = search.facets(df, languages="language").first()
    assert faces.languages == ["de", "en", "fr"]
    assert sorted(r.id for r in search.archive_filter(df, now, region="english").collect()) == [2]
    radio = spark.createDataFrame(
        [(1, "Live", "", None, True), (2, "Valais", "soir", "u2", False), (3, "Suisse", "soir", "u3", False)],
        "ord long, title string, subtitle string, audio_url string, is_live boolean",
    )
    first = lambda q: search.first_match(radio, q).first().ord
    assert first("suisse") == 3 and first("zzz") == 2 and first("") == 2 and search.first_match(radio.filter("ord = 1"), "x").first().ord == 1


BULLETIN = "id string, slot_start string, style_key string, style_label string, status string, audio_path string, duration_seconds double"


def history(spark, rows):
    df = spark.createDataFrame(rows, BULLETIN)
    return df.withColumn("slot_start", F.to_timestamp("slot_start"))


def test_publishing(spark):
    h = history(
        spark,
        [
            ("a", "2024-01-01T10:00:00+01:00", "valais", "V", "ready", "a.mp3", 1.0),
            ("b", "2024-01-01T12:00:00+01:00", "valais", "V", "ready", "", 1.0),
            ("c", "2024-01-01T11:00:00+01:00", "", "Libre", "ready", "c.mp3", 1.0),
            ("d", "2024-01-01T13:00:00+01:00", "suisse", "S", "draft", "d.mp3", 1.0),
            ("e", "2024-01-01T09:00:00+01:00", "valais", "V", "ready", "e.mp3", 1.0),
        ],
    )
    latest = publish.latest_by_topic(h)
    assert [(r.topic, r.id) for r in latest.collect()] == [("Libre", "c"), ("valais", "a")]
    assert [r.id for r in publish.latest_by_topic(h, 1).collect()] == ["c"] and publish.latest_by_topic(h, allowed=["valais"]).count() == 1
    now = F.to_timestamp(F.lit("2024-01-01T10:30:00+00:00"))
    assert publish.current(h, now).first().id == "c" and publish.current(h, F.to_timestamp(F.lit("2020-01-01"))).count() == 0
    assert publish.retained(h, now, 1).count() == 3
    raw = publish.manifest(publish.current(h, now), latest, "https://x/").first().value
    import json

    doc = json.loads(raw)
    assert doc["current"]["audio_url"] == "https://x/current/live.mp3" and doc["bulletins_by_topic"] == doc["bulletins_by_style"]
    assert [b["audio_url"] for b in doc["bulletins_by_topic"]] == ["https://x/bulletins/c.mp3", "https://x/bulletins/a.mp3"]
    back = spark.createDataFrame([(raw,)], "v string").select(publish.read_manifest(F.col("v")).alias("m")).first().m
    assert [i.id for i in back] == ["c", "a"]
    styles = {r.style for r in publish.latest_by_style(h.withColumn("id", F.concat(F.lit("x-non_anxiogene-"), "id"))).collect()}
    assert styles == {"non_anxiogene"}


def test_export(spark):
    rows = [
        {"title": "Une même nouvelle importante", "priority": 1, "summary": "mot " * 200}, {"title": "Une même nouvelle importante!", "priority": 9},
        {"region": "english", "language": "en", "source_name": "UN News - World"}, {"language": "de", "title": "Allemand texte long"}, {"is_sports": True},
    ]
    a = articles(spark, rows)
    got = publish.export_rows(a).collect()
    assert [r.id for r in got] == [1]
    wide = {r.id: r for r in publish.export_rows(a, variants={"english": True, "german": True}).collect()}
    assert set(wide) == {1, 2, 3} and wide[2].search_terms.startswith("english UN") and "deutsch" in wide[3].search_terms
    import json

    doc = json.loads(publish.export_document(publish.export_rows(a, variants={"german": True}), "now").first().value)
    assert doc["articles"][0]["url"] == "u" and doc["count"] == 2 and doc["languages"] == ["de", "fr"] and len(doc["articles"]) == 2


def test_schedule(spark):
    styles = schedule.rotation(spark, [{"key": k} for k in "abc"])
    slots = spark.createDataFrame([("2024-01-01 00:10:00",), ("2024-01-01 05:00:00",)], "s string").withColumn("slot", F.to_timestamp("s"))
    assert {r.s[11:13]: r.key for r in schedule.with_style(slots, styles, "slot", 60, 3).collect()} == {"00": "a", "05": "c"}
    nxt = slots.select(schedule.slots_from(F.col("slot"), 60, 3).alias("n")).first().n
    assert [str(x)[11:16] for x in nxt] == ["00:00", "01:00", "02:00"]
    every = schedule.all_slots(slots, "slot", 60)
    taken = every.limit(2)
    assert every.count() == 6 and schedule.open_slots(every, taken).count() == 4 and schedule.all_slots(slots.limit(0), "slot", 60).count() == 0
    plan = spark.createDataFrame([("a",), ("z",)], "style string")
    latest = spark.createDataFrame([("a", "b1")], "style string, id string")
    with pytest.raises(Exception, match="no bulletin for z"):
        schedule.hour_plan(plan, latest).collect()


def gate(spark, transcript, warnings=(), least=5):
    df = spark.createDataFrame([(transcript, list(warnings))], "t string, w array<string>")
    return df.select(bulletin.quality_issue(F.col("t"), F.col("w"), least).alias("i")).first().i


def test_quality_gate_order(spark):
    text = "Une phrase qui parle de la ville et de ses habitants"
    assert gate(spark, text) is None
    assert gate(spark, "pays neutre", ["Texte TROP COURT"]).startswith("self-reported")
    assert gate(spark, "Sources used for this edition: a. sources used for this edition: b. pays neutre").startswith("duplicate")
    assert gate(spark, "un pays neutre") == "generic filler: pays neutre" and gate(spark, "trois mots seulement") == "short transcript (3 words)"
    same = "\n\n".join(f"Selon la police, tout va {w} dans la ville aujourd'hui." for w in "abcd")
    assert gate(spark, same) == "repetitive paragraph openings: selon la police" and gate(spark, "\n\n".join(same.split("\n\n")[:3])) is None


def test_template_and_credit(spark):
    rows = [{"title": "EN DIRECT: Un parc ouvre", "summary": "Le parc de la ville ouvre ses portes demain.", "source_name": "A"}, {"title": "Deux", "source_name": "B"}, {"title": "Trois", "source_name": "A"}]
    a = select.numbered(articles(spark, rows), F.asc("id")).withColumn("g", F.lit(1))
    text = bulletin.template_bulletin(a, "g", "", "fr", "Radio X").first().transcript.split("\n\n")
    assert text[0].startswith("Bonjour") and text[1] == "D'abord, Un parc ouvre. Le parc de la ville ouvre ses portes demain."
    assert text[2].startswith("Ensuite, Deux.") and text[-1] == "Sources utilisées pour cette édition: A, B."
    df = spark.createDataFrame([("Selon A, la sante va. Sources utilisées pour cette édition: A.", ["A", "B", "A"])], "t string, s array<string>")
    got = df.select(bulletin.credited("t", F.col("s"), "fr").alias("t")).first().t
    assert got == "la santé va.\n\nSources utilisées pour cette édition: A, B."
    assert bulletin.fallback("en", "Radio X").startswith("You are listening to Radio X")
    kinds = spark.createDataFrame([("Un match", "virus"), ("Rien", "le gouvernement"), ("Rien", "x")], "t string, b string")
    assert [r.k for r in kinds.select(bulletin.child_kind("t", "b").alias("k")).collect()] == ["sport", "politics", "general"]
    block = a.filter("ord = 1").select(bulletin.prompt_text(F.lit(1)).alias("p")).first().p
    assert block.startswith("Article A01\n- Source: A\n") and "- Date: unknown" in block


def test_revision_loop(spark):
    df = spark.createDataFrame([(1, "court", []), (2, "un texte de cinq mots ici", [])], "id long, transcript string, warnings array<string>")
    df = df.withColumn("transcript", F.concat("transcript", F.when(F.col("id") == 2, F.repeat(F.lit(" mot"), 300)).otherwise(F.lit(""))))
    got = bulletin.revise(df, lambda bad: bad.withColumn("transcript", F.repeat(F.lit("mot "), 290)))
    assert {r.id: r.issue for r in got.collect()} == {1: None, 2: None}
