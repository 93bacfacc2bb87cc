"""Feed files: formats, broken ones, encodings, and polls that read only what changed."""

import os
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from newsloom import schema as S
from newsloom.operators import order, store
from newsloom.sources import feed_files, feeds
from newsloom.sources.commits import Tables

RSS = """<?xml version="1.0"?><rss xmlns:content="c" xmlns:dc="d"><channel><title>Feed</title><link>http://feed</link>
<item><title>One &amp; <![CDATA[<b>two</b>]]></title><link>http://h/1</link><guid isPermaLink="false">g1</guid><pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate>
<description>&lt;p&gt;Short&lt;/p&gt;</description><content:encoded><![CDATA[<p>Long <title>t</title> text</p>]]></content:encoded><author><name>n</name></author></item>
<item><title/><dc:date>2024-01-03</dc:date><link>http://h/2</link></item></channel></rss>"""
ATOM = """<feed xmlns="a"><title>Feed</title><id>f</id><entry><source><title>Other</title><updated>2000-01-01</updated></source><id>i1</id><title type="html">A &lt;i&gt;b&lt;/i&gt;</title>
<link rel="self" href="http://s"/><link rel='alternate' href='http://h/a?x=1&amp;y=2'/><updated>2024-01-04T00:00:00Z</updated>
<content type="xhtml"><div xmlns="x"><p>Body <a href="u">link</a></p></div></content><content>second</content></entry><entry><title>B</title><link href="http://h/b"/></entry></feed>"""


def test_formats():
    one, two = feed_files.entries(RSS)
    assert one["title"] == "One & <b>two</b>" and one["link"] == "http://h/1" and one["guid"] == "g1" and one["description"] == "<p>Short</p>"
    assert one["content:encoded"] == "<p>Long <title>t</title> text</p>" and one["pubDate"].startswith("Tue, 02 Jan")
    assert two == {"content": [], "published": "2024-01-03", "link": "http://h/2"}
    a, b = feed_files.entries(ATOM)
    assert a["title"] == "A <i>b</i>" and a["link"] == "http://h/a?x=1&y=2" and a["updated"] == "2024-01-04T00:00:00Z" and a["guid"] == "i1"
    assert a["content"] == ['<div xmlns="x"><p>Body <a href="u">link</a></p></div>', "second"] and b["link"] == "http://h/b"


def test_well_formed_files_as_another_parser_reads_them():
    for text, tag in ((RSS, "item"), (ATOM, "entry")):
        found = [e for e in ET.fromstring(text).iter() if e.tag.rpartition("}")[2] == tag]
        assert len(found) == len(list(feed_files.entries(text)))
        for e, got in zip(found, feed_files.entries(text)):
            title = next(c for c in e if c.tag.rpartition("}")[2] == "title")
            assert (got.get("title") or "") == "".join(title.itertext())


@pytest.mark.parametrize(
    "text, want",
    [
        ("<item><title>A<link>u<item><title>B</title><link>v</link>", [("A", "u"), ("B", "v")]),
        ("<item><title>A & B < C</b></title></x><link>u</link></item></item></rss>", [("A & B < C</b>", "u")]),
        ("<item><title><![CDATA[never ends", [("never ends", None)]),
        ("<item><title>cut off in a ta<link hr", [("cut off in a ta<link hr", None)]),
        ('<entry><title>q</title><link href="u" rel=alternate broken="</entry><entry><link href=v></entry>', [("q", None), (None, "v")]),
        ("no feed at all <b>", []),
        ("", []),
        ("<!-- <item><title>x</title></item> --><item><title>y</title></item>", [("y", None)]),
    ],
)
def test_broken_files(text, want):
    assert [(e.get("title"), e.get("link")) for e in feed_files.entries(text)] == want


def test_long_broken_files_take_time_in_proportion():
    import time

    took = []
    for n in (20_000, 80_000):
        began = time.process_time()
        list(feed_files.entries("<item><title>" + "<a b=\"" * n))
        list(feed_files.entries("<item>" + "<x y='z" * n + "<" * n))
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 1


def test_encodings():
    head = '<?xml version="1.0" encoding="{}"?><item><title>Zürich é</title></item>'
    for name in ("utf-8", "iso-8859-1", "windows-1252", "utf-16"):
        data = head.format(name).encode(name)
        assert next(feed_files.entries(feed_files.decoded(data)))["title"] == "Zürich é"
    assert feed_files.decoded("é".encode("cp1252")) == "é" and feed_files.decoded(b'<?xml encoding="none-such"?>a').endswith("a") and feed_files.decoded(b"") == ""


def tables_of(spark, tmp_path):
    return Tables(spark, f"file://{tmp_path}/tables", {"log": S.ARTICLE_LOG, "feed_files": feed_files.FEED_FILES}).init()


def test_a_poll_reads_what_is_new_or_changed(spark, tmp_path):
    tables, folder = tables_of(spark, tmp_path), tmp_path / "in" / "deep"
    folder.mkdir(parents=True)
    poll = lambda: feed_files.poll(spark, f"file://{tmp_path}/in", tables, "log", feeds.items)
    (folder / "a.xml").write_text(RSS)
    (folder / "b.xml").write_text(ATOM)
    (folder / "none.xml").write_text(" ")
    # the entry without a title is left out
    assert poll() == {"listed": 3, "read": 3, "added": 3}
    version = tables.versions()[-1]
    assert poll() == {"listed": 3, "read": 0, "added": 0} and tables.versions()[-1] == version
    (folder / "a.xml").write_text(RSS.replace("One &amp; ", "Renamed "))
    os.utime(folder / "a.xml", (1_500_000_000, 1_500_000_000))  # changed, though its time is older than the others'
    assert poll() == {"listed": 3, "read": 1, "added": 1}
    log = tables.read("log").orderBy("arrival").collect()
    assert [r.arrival for r in log] == [1, 2, 3, 4] and log[3].title == "Renamed two" and str(log[0].published_at) == "2024-01-02 10:00:00"
    last = store.compact(tables.read("log"), "url", "arrival", [], ["title"], [])
    assert {r.url: r.title for r in last.collect()} == {"http://h/1": "Renamed two", "http://h/a?x=1&y=2": "A b", "http://h/b": "B"}


def test_a_poll_that_fails_is_as_if_it_had_not_been(spark, tmp_path):
    tables = tables_of(spark, tmp_path)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_text(RSS)
    broken = lambda e: feeds.items(e).withColumn("summary", F.raise_error(F.lit("midway")))
    with pytest.raises(Exception, match="midway"):
        feed_files.poll(spark, f"file://{tmp_path}/in", tables, "log", broken)
    assert tables.versions() == [0]
    assert feed_files.poll(spark, f"file://{tmp_path}/in", tables, "log", feeds.items)["added"] == 1


def test_first_rows_of_groups_of_any_size(spark):
    rows = [("hot", k, 7) for k in range(2000)] + [("all", k, 0) for k in range(30)] + [("none", k, None) for k in range(5)] + [(None, k, 2) for k in range(9)]
    df = spark.createDataFrame(rows, "g string, k long, most int").repartition(5)
    got = order.first_of_each(df, "g", F.col("most"), F.desc("k"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
    want = {("hot", k) for k in range(1993, 2000)} | {("all", k) for k in range(30)} | {("none", k) for k in range(5)} | {(None, 8), (None, 7)}
    assert {(r.g, r.k) for r in got.collect()} == want and got.columns == ["g", "k", "most"]
    placed = {(r.g, r.k): r.ord for r in order.numbered_within(df, "g", F.asc("k")).collect()}
    assert all(placed[g, k] == k + 1 for g, k, _ in rows)
    assert order.numbered_within(df.limit(0), "g", F.asc("k")).count() == 0
