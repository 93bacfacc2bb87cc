"""Readers, writers and streams over files in a temporary folder."""

import datetime
import json

from pyspark.sql import functions as F

from newsloom.operators import store
from newsloom.sources import feeds, sinks
from newsloom.streaming import upserts

RSS = """<?xml version="1.0" encoding="UTF-8"?><rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>Flux</title>
<item><title>Le &lt;b&gt;pont&lt;/b&gt; rouvre</title><link>http://h/a#x</link><pubDate>Tue, 02 Jan 2024 10:00:00 +0100</pubDate>
<description><![CDATA[<p>Le pont &amp; la route</p>]]></description></item>
<item><title>Sans lien</title><description>x</description></item>
<item><title>Deux</title><link>http://h/b</link><pubDate>demain</pubDate><description>court</description><content:encoded>Un texte long</content:encoded></item>
</channel></rss>"""

YAML = """# feeds
defaults:
  region: suisse
  priority: 70
sources:
  - name: "Radio: A"
    url: http://a/rss   # main
    enabled: false
  - name: B
    url: http://b/rss
    max_entries: 1
    priority: 9
"""


def test_yaml_sources_and_schedule(spark):
    rows = {r.name: r for r in feeds.load_sources(spark, YAML).collect()}
    assert rows["Radio: A"].region == "suisse" and rows["Radio: A"].priority == 70 and not rows["Radio: A"].enabled
    assert rows["B"].max_entries == 1 and rows["B"].interval_minutes == 5 and rows["B"].enabled
    minutes, styles = feeds.load_schedule("slot_minutes: 30\nrotation:\n  - key: a\n    label: A\n  - key: b\n")
    assert minutes == 30 and [s["key"] for s in styles] == ["a", "b"]
    minutes, styles = feeds.load_schedule("styles:\n  30:\n    key: late\n  0:\n    key: early\n")
    assert minutes == 60 and [s["key"] for s in styles] == ["early", "late"]


def test_feed_items(spark, tmp_path):
    (tmp_path / "f.xml").write_text(RSS, encoding="utf-8")
    got = sorted(feeds.items(feeds.read_feeds(spark, str(tmp_path))).collect(), key=lambda r: r.url)
    assert [(r.title, r.url, r.summary) for r in got] == [("Le pont rouvre", "http://h/a", "Le pont & la route"), ("Deux", "http://h/b", "court")]
    assert str(got[0].published_at) == "2024-01-02 09:00:00" and got[1].published_at is None and got[1].published_at_raw == "demain"
    assert got[1].content == "Un texte long" and got[0].content == got[0].summary


def test_entries_are_capped_by_source(spark):
    sources = feeds.load_sources(spark, YAML.replace("enabled: false", "max_entries: 0"))
    entries = spark.createDataFrame([("B", 2), ("B", 1), ("Radio: A", 1), ("Radio: A", 2), ("C", 1)], "source string, place int")
    kept = {(r.source, r.place) for r in feeds.first_entries(entries, sources).collect()}
    assert kept == {("B", 1), ("Radio: A", 1), ("Radio: A", 2)}


def test_enrichment_takes_longer_pages_only(spark):
    rows = [("http://a", "t", "", "kurz", "suisse"), ("http://b", "t", "", "lang " * 100, "suisse"), ("http://c", "t", "", "short", "english"), ("http://d", "t", "", "same", "x")]
    a = spark.createDataFrame(rows, "url string, title string, summary string, content string, region string")
    pages = spark.createDataFrame([(u, f"<article>{'mot ' * 2000}</article>") for u in ("http://a#x", "http://b", "http://c")] + [("http://d", "<p>s</p>")], "url string, html string")
    got = {r.url: r for r in feeds.enriched(a, pages).collect()}
    assert len(got["http://a"].content) == 4000 and got["http://b"].content.startswith("lang") and got["http://c"].content == "short"
    assert got["http://d"].content == "same" and got["http://c"].language == "en"
    assert feeds.unchanged(spark.createDataFrame([(304,), (200,), (None,)], "status int")).count() == 2


def test_sinks(spark, tmp_path):
    plan = spark.createDataFrame([("30", "b", "f2", "x2", "T, 2"), ("0", "a", "f1", "x1", "T1")], "minute string, style string, file string, source_bulletin string, title string")
    sinks.write_schedule(plan, str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("part-*")).read_text()
    assert text.splitlines() == ["minute,style,file,source_bulletin,title", "0,a,f1,x1,T1", '30,b,f2,x2,"T, 2"']
    drafts = spark.createDataFrame([("id/1", "valais", "un deux trois")], "id string, style_key string, transcript string")
    sinks.write_drafts(drafts, str(tmp_path / "d"))
    record = json.loads(next((tmp_path / "d/json/style_key=valais").glob("part-*")).read_text())
    assert record["word_count"] == 3 and record["file"] == "id-1"
    assert next((tmp_path / "d/txt/style_key=valais").glob("part-*")).read_text() == "un deux trois\n"
    paths = spark.createDataFrame([("gs://b/x/a.mp3",), ("gs://b/x/a.txt",), ("b.mp3",)], "path string")
    assert sorted(r.id for r in sinks.stored_ids(paths).collect()) == ["a", "b"]
    h = spark.createDataFrame([("2", "b's.mp3"), ("1", "a.wav"), ("3", "c.txt")], "id string, audio_path string").withColumn("slot_start", F.col("id"))
    assert sinks.playlist(h).first().value == "file 'a.wav'\nfile 'b'\\''s.mp3'"
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "id string")
    state = sinks.publish_state(F.lit("b"), ids("a", "b", "c"), ids("b", "c"), "now").first()
    assert state.uploaded_bulletins == ["b", "c"] and state.current_live_id == "b"
    assert sinks.clamp(0) == 1 and sinks.clamp(9999) == 500 and sinks.api(ids("b", "a"), 1, F.asc("id")).first().id == "a"
    sinks.write_document(spark.createDataFrame([("{}",)], "value string"), str(tmp_path / "doc"))
    from newsloom import schema

    missing = feeds.first_available(spark, [str(tmp_path / "none"), str(tmp_path / "doc")], schema.EVENTS)
    assert missing.columns == schema.EVENTS.names


def test_stream_equals_batch(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(k, start + datetime.timedelta(minutes=7 * k), k % 5, f"t{k % 3}", float(k), None) for k in range(60)]
    names = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    events = spark.createDataFrame(rows, names)
    events.repartition(6).write.parquet(str(tmp_path / "in"))
    state = lambda df: store.compact(df, "user_id", "event_id", ["ts"], ["event_type", "value"], ["props"])
    upserts.replay(spark, str(tmp_path / "in"), events.schema, lambda s: s, str(tmp_path / "out"), str(tmp_path / "cp"), 2)
    got = state(spark.read.parquet(str(tmp_path / "out")).drop("batch"))
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(got) == key(state(events))
    # a second run finds no new files
    upserts.replay(spark, str(tmp_path / "in"), events.schema, lambda s: s, str(tmp_path / "out"), str(tmp_path / "cp"), 2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60
    firsts = lambda s: upserts.first_seen(s, "user_id").select("user_id")
    upserts.replay(spark, str(tmp_path / "in"), events.schema, firsts, str(tmp_path / "o2"), str(tmp_path / "c2"), 3)
    assert sorted(r.user_id for r in spark.read.parquet(str(tmp_path / "o2")).collect()) == [0, 1, 2, 3, 4]


def test_tick_isolates_failures():
    done = []
    tasks = {"a": lambda: done.append(1), "b": lambda: 1 / 0, "c": lambda: done.append(2)}
    out = upserts.work(tasks)
    assert out["a"] == out["c"] == "ok" and out["b"].startswith("error") and done == [1, 2]
    try:
        upserts.work(tasks, strict=True)
        raise AssertionError
    except ZeroDivisionError:
        pass
