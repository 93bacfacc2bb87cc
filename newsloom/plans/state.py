"""Queries over what is kept between runs: stored tables, states of streams, slots and places; each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as X
from ..operators import bulletin, buffer, order, publish, search, search_index, select, store
from ..sources import feed_files, feeds
from ..sources.commits import Conflict, Tables
from ..streaming import keyed, upserts
from . import views
from .queries import _FOLDED, _HAY, _ITEMS_SQL, _LOW, _SEEN, _STORY, NOW, SETS, SUBJECTS, TOPICS, _articles, _count, _detect, _items, _relevance, _stamp, _subject, _tiered, _work_folder, now, query, stamp

# ---- states of streams -----------------------------------------------------------------------

_RULES = keyed.Rules(["user_id"], "event_id", ["first_event"], ["event_type", "value"], ["published_at"])


@query(
    f"""SELECT user_id, min(event_id) AS first_event, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value,
    {_stamp("arg_max(published_at, event_id) FILTER (published_at IS NOT NULL)")} AS published_at, count(*) AS arrivals, 1 AS n_created
    FROM (SELECT *, CASE WHEN event_id % 3 <> 0 THEN ts END AS published_at FROM events) GROUP BY user_id"""
)
def stream_keyed_state(spark, d):
    """State that a stream keeps for each user: the later half of the events is polled first, then the earlier half from the checkpoint."""
    folder = _work_folder(spark)
    events = views.table(spark, d, "events")
    log = lambda df: views.upsert_log(df).withColumn("first_event", F.col("event_id"))
    tables = Tables(spark, f"{folder}/tables", {"users": _RULES.output(log(events).schema)}).init()
    for late in (False, True):
        events.filter((F.xxhash64("event_id") % 2 == 0) == late).write.mode("append").parquet(f"{folder}/in")
        keyed.poll(spark, f"{folder}/in", events.schema, _RULES, tables, "users", f"{folder}/state", log)
    changes = tables.read("users")
    created = changes.groupBy("user_id").agg(F.count_if("created").alias("n_created"))
    found = keyed.latest(changes, ["user_id"]).join(created, "user_id")
    return found.select("user_id", "first_event", "event_type", "value", stamp("published_at").alias("published_at"), "arrivals", "n_created")


# ---- several tables, one commit --------------------------------------------------------------

_STORE = {"bulletins": S.BULLETINS, "bulletin_articles": S.BULLETIN_ARTICLES, "article_uses": S.ARTICLE_USES}


def _orders(spark, d):
    """Orders as bulletins, the parts of their lines as what they picked."""
    bulletins = views.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("status"))
    picked = views.table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("bulletin_id"), F.col("l_partkey").alias("article_id"))
    return bulletins, picked


@query(
    """SELECT 'bulletins' AS what, o_orderstatus AS key, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 2
    UNION ALL SELECT 'pairs', NULL, count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P')
    UNION ALL SELECT 'used', CAST(n AS VARCHAR), count(*) FROM (SELECT l_partkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      WHERE o_orderstatus <> 'P' GROUP BY 1) GROUP BY 2
    UNION ALL SELECT 'refused', 'P', 2"""
)
def atomic_bulletins(spark, d):
    """Bulletins, their articles and the marks of use in one commit for each status; one transaction breaks off and one comes too late, and leave nothing."""
    tables = Tables(spark, f"{_work_folder(spark)}/tables", _STORE).init()
    bulletins, picked = _orders(spark, d)
    of = lambda status: (bulletins.filter(F.col("status") == status), picked.join(bulletins.filter(F.col("status") == status).select(F.col("id").alias("bulletin_id")), "bulletin_id"))
    store.create_bulletins(tables, *of("F"))
    late, refused = tables.transaction(), 0
    late.read("bulletins")
    late.append("bulletins", of("P")[0])
    store.create_bulletins(tables, *of("O"))
    try:
        late.commit()
    except Conflict:
        late.abort()
        refused += 1
    try:
        with tables.transaction() as broken:
            broken.append("bulletin_articles", of("P")[1])
            raise InterruptedError
    except InterruptedError:
        refused += 1
    row = lambda df, what, key: df.select(F.lit(what).alias("what"), key.alias("key"), "n")
    count = F.count("*").alias("n")
    none = F.lit(None).cast("string")
    uses = store.use_counts(tables.read("article_uses")).groupBy("used_count").agg(count)
    out = row(tables.read("bulletins").groupBy("status").agg(count), "bulletins", F.col("status"))
    out = out.union(row(tables.read("bulletin_articles").agg(count), "pairs", none)).union(row(uses, "used", F.col("used_count").cast("string")))
    return out.union(row(spark.range(1).select(F.lit(refused).cast("long").alias("n")), "refused", F.lit("P")))


@query(
    """SELECT CAST(o_orderkey AS VARCHAR) AS bulletin_id, string_agg(p_partkey || ':' || s_name, ',' ORDER BY s_suppkey % 7 DESC, o_orderdate DESC, p_partkey) AS articles
    FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey
    JOIN supplier ON s_suppkey = p_size GROUP BY o_orderkey"""
)
def stored_lineage(spark, d):
    """Bulletins with their articles and sources, through the stored bridge: orders, parts, and the supplier whose key is the part's size."""
    dates = views.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("bulletin_id"), F.col("o_orderdate").cast("timestamp").alias("published_at"))
    pairs = _orders(spark, d)[1].distinct().join(dates, "bulletin_id").withColumnRenamed("published_at", "slot")
    articles = views.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_size").cast("long").alias("source_id"))
    articles = articles.withColumn("published_at", F.lit("2024-01-01").cast("timestamp"))
    sources = views.table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), F.col("s_name").alias("source_name"), (F.col("s_suppkey") % 7).alias("priority"))
    found = publish.lineage(pairs.select("bulletin_id", "article_id"), articles, sources)
    named = F.transform("articles", lambda a: F.concat(a["article_id"].cast("string"), F.lit(":"), a["source_name"]))
    return found.select("bulletin_id", F.array_join(named, ",").alias("articles"))


@query(
    """SELECT id, name, url FROM (
      SELECT s_suppkey AS id, 'X' || s_suppkey AS name, 'https://s/' || s_suppkey AS url FROM supplier
      UNION ALL SELECT NULL, s_name, 'https://other/' || s_suppkey FROM supplier)"""
)
def contested_sources(spark, d):
    """For each stored source, one configured row has its address and another its name: the first one is it, the second one is new (null)."""
    s = views.table(spark, d, "supplier")
    key = F.col("s_suppkey").cast("string")
    rest = {"region": F.lit("general"), "priority": F.lit(50), "interval_minutes": F.lit(5), "max_entries": F.lit(20), "enabled": F.lit(True)}
    stored = s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("https://s/"), key).alias("url")).withColumns(rest)
    one = s.select(F.concat(F.lit("X"), key).alias("name"), F.concat(F.lit("https://s/"), key).alias("url"))
    two = s.select(F.col("s_name").alias("name"), F.concat(F.lit("https://other/"), key).alias("url"))
    out = store.merge_sources(stored, one.union(two).withColumns(rest))
    return out.select(F.when(F.startswith("url", F.lit("https://other/")), F.lit(None)).otherwise(F.col("id")).alias("id"), "name", "url")


# ---- feeds that are polled --------------------------------------------------------------------

_WORDS = "trim(regexp_replace(substr(text, 1, 200), '[^A-Za-z0-9]+', ' ', 'g'))"


@query(
    f"""SELECT 'http://feed/' || doc_id AS url, 'No ' || doc_id || ' & <' || source AS title, {_WORDS} AS summary,
    CASE WHEN doc_id % 3 = 1 THEN NULL ELSE {_stamp("TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id AS BIGINT))")} END AS published_at, doc_id % 2 + 1 AS poll, 0 AS read_again FROM documents"""
)
def polled_feeds(spark, d):
    """Documents as entries of RSS, Atom and broken RSS files; even ones are there at the first poll, odd ones at the second, and a third poll reads nothing."""
    folder = _work_folder(spark)
    docs = views.table(spark, d, "documents")
    key = F.col("doc_id").cast("string")
    link, title = F.concat(F.lit("http://feed/"), key), F.concat(F.lit("No "), key, F.lit(" &amp;amp; &amp;lt;"), F.col("source"))
    words = F.trim(F.regexp_replace(F.substring("text", 1, 200), "[^A-Za-z0-9]+", " "))
    at = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("doc_id").cast("int"))
    rss = F.concat(F.lit("<item><title>"), title, F.lit("</title><link>"), link, F.lit("#x</link><pubDate>"), F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate><description><![CDATA[<p>"), words, F.lit("</p>]]></description></item>"))
    atom = F.concat(F.lit('<entry><source><title>no</title></source><title type="html">'), title, F.lit('</title><link rel="self" href="no"/><link href="'), link, F.lit('"/><summary type="xhtml"><div>'), words, F.lit("</div></summary></entry>"))
    broken = F.concat(F.lit("<item><title>No "), key, F.lit(" & &amp;lt;"), F.col("source"), F.lit("<link>"), link, F.lit("<guid>none<pubDate>"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z<description>"), words)
    made = docs.select((F.col("doc_id") % 2).alias("part"), F.when(F.col("doc_id") % 3 == 0, rss).when(F.col("doc_id") % 3 == 1, atom).otherwise(broken).alias("value"))
    schemas = {"log": S.ARTICLE_LOG, "feed_files": feed_files.FEED_FILES}
    tables = Tables(spark, f"{folder}/tables", schemas).init()
    prepare = lambda e: feeds.items(e).withColumn("scraped_at", F.lit(None).cast("timestamp"))
    polls = []
    for part in (0, 1, None):
        if part is not None:
            made.filter(F.col("part") == part).select("value").write.mode("append").text(f"{folder}/feeds")
        polls.append((len(polls) + 1, tables.versions()[-1] + 1, feed_files.poll(spark, f"{folder}/feeds", tables, "log", prepare, pattern="part-*")))
    bounds = [(k, sum(p["added"] for _, _, p in polls[: k - 1]), sum(p["added"] for _, _, p in polls[:k])) for k, _, _ in polls]
    poll = F.when(F.col("arrival") <= bounds[0][2], 1).otherwise(2)
    again = F.lit(polls[2][2]["read"] + polls[2][2]["added"])
    return tables.read("log").select("url", "title", "summary", stamp("published_at").alias("published_at"), poll.alias("poll"), again.alias("read_again"))


@query(
    f"""WITH {views.ARTICLES_SQL}, p AS (SELECT id, source_name, idx % 4 * 5 AS most, row_number() OVER (PARTITION BY source_name ORDER BY {_SEEN} DESC, id) AS r FROM v_articles)
    SELECT id, source_name FROM p WHERE most = 0 OR r <= most"""
)
def first_of_sources(spark, d):
    """The newest articles of each source, as many as the source says (0: all of them)."""
    rows = _articles(spark, d, False).select("id", "source_name", (F.col("idx") % 4 * 5).alias("most"), select.when_seen().alias("seen"))
    return order.first_of_each(rows, "source_name", F.col("most"), F.desc("seen"), F.asc("id")).select("id", "source_name")


@query(
    f"""WITH {views.ARTICLES_SQL} SELECT source_name, count(*) AS n_new FROM v_articles WHERE id % 3 <> 0 GROUP BY 1"""
)
def ingest_counts(spark, d):
    """New articles of each source, where a third were there before."""
    after = _articles(spark, d, False).select("id", "source_name")
    return feeds.ingest_summary(after.filter("id % 3 = 0"), after)


@query(
    f"""WITH {views.ARTICLES_SQL}, {_detect()} SELECT a.id, CASE WHEN a.language = 'unknown' OR a.region = 'english' THEN detected ELSE a.language END AS language
    FROM v_articles a JOIN v_detected USING (id)"""
)
def reclassified_language(spark, d):
    """The stored language as the present rules see it; sports flags by the production patterns are tested on fixtures."""
    return store.reclassified(_articles(spark, d, False)).select("id", "language")


@query(f"SELECT {_stamp('time_bucket(INTERVAL 15 MINUTE, ts)')} AS slot, count(*) AS n FROM events GROUP BY 1")
def stream_slot_counts(spark, d):
    """Counts of slots as a stream of files gives them: each slot's last count, as batches bring more."""
    folder = _work_folder(spark)
    views.table(spark, d, "events").repartition(4).write.parquet(f"{folder}/in")
    schema = views.table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = upserts.slot_counts(stream, "ts", 15, "1000 days")

    def write(batch, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/{number}")

    counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{folder}/out/*")
    return out.groupBy(stamp("slot").alias("slot")).agg(F.max_by("n", "batch").alias("n"))


# ---- places in whole tables ------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_extendedprice DESC, l_shipdate, l_orderkey, l_linenumber) AS ord FROM lineitem")
def numbered_rows(spark, d):
    """Every row's place in the order of the whole table."""
    rows = views.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate")
    by = [F.desc("l_extendedprice"), F.asc("l_shipdate"), F.asc("l_orderkey"), F.asc("l_linenumber")]
    return order.numbered(rows, *by).select("l_orderkey", "l_linenumber", "ord")


_ARCHIVE = f"row_number() OVER (ORDER BY {_SEEN} DESC, id)"


def _archive(spark, d):
    """All articles, newest first; what orders them stands in ``ord``."""
    return _articles(spark, d, False).withColumn("ord", F.struct((-F.unix_micros(select.when_seen())).alias("newest"), F.col("id").alias("id")))


@query(
    f"""WITH {views.ARTICLES_SQL}, k AS (SELECT id, {_ARCHIVE} AS o, {_subject()} AS s FROM v_articles),
    a AS (SELECT id, o, row_number() OVER (PARTITION BY s ORDER BY o) > 1 AS again FROM k)
    SELECT id, row_number() OVER (ORDER BY again, o) AS ord FROM a"""
)
def diversified_archive(spark, d):
    """All articles, the newest of each subject first."""
    return select.diversified(_archive(spark, d), SUBJECTS).select("id", "ord")


@query(
    f"""WITH {views.ARTICLES_SQL}, k AS (SELECT id, {_ARCHIVE} AS o, {_STORY} AS story, {_subject()} AS s FROM v_articles)
    SELECT id, o AS ord, 'story' AS kind FROM (SELECT *, row_number() OVER (PARTITION BY story ORDER BY o) AS r FROM k) WHERE r = 1
    UNION ALL SELECT id, o, 'subject' FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY o) AS r FROM k) WHERE r = 1"""
)
def unique_articles(spark, d):
    """The newest article of each story, and of each subject."""
    keys = _articles(spark, d, False).select("id", "published_at", "created_at", X.story_key("title", "summary", "content").alias("story"), select.subject(SUBJECTS).alias("subject"))
    archive = order.numbered(keys, *select.archive_order())
    kinds = {"story": select.unique_stories(archive, F.col("story")), "subject": select.unique_subjects(archive, SUBJECTS, F.col("subject"))}
    one, two = (df.select("id", "ord", F.lit(k).alias("kind")) for k, df in kinds.items())
    return one.union(two)


@query(
    f"""WITH {views.ARTICLES_SQL}, m AS (SELECT id, {_relevance("suisse")} AS rel, priority, {_ARCHIVE} AS o FROM v_articles)
    SELECT id, row_number() OVER (ORDER BY rel DESC, priority DESC, o) AS ord FROM m"""
)
def ranked_archive(spark, d):
    """All articles, ranked for a topic."""
    return select.rank(_archive(spark, d), "suisse", TOPICS).select("id", "ord")


@query(
    f"""WITH {_ITEMS_SQL} SELECT id, 'fresh' AS page FROM v_items WHERE language <> 'de' AND language <> 'en' AND region <> 'english' AND NOT is_sports
      AND coalesce(published_at, scraped_at) >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY
    UNION ALL SELECT id, 'open' FROM v_items WHERE language <> 'de' AND child_friendly AND tension <= 4 AND priority >= 40 AND id % 10 <> 3"""
)
def device_pages(spark, d):
    """What the app shows with its first settings, and with English, all times and items for children."""
    items = _items(spark, d)
    read = items.filter("id % 10 = 3").select("id")
    fresh = search.on_device(items, now(), period="7d")
    every = search.on_device(items, now(), read, english=True, period="all", hide_sports=False, child_only=True, most_tension=4, least_priority=40)
    return fresh.select("id", F.lit("fresh").alias("page")).union(every.select("id", F.lit("open").alias("page")))


_FOUND = f"SELECT id FROM v_items WHERE regexp_matches({_HAY}, '(^|[^a-z0-9])the([^a-z0-9]|$)') AND contains({_HAY}, 'ation') AND contains({_HAY}, 'of th')"


@query(f"WITH {_ITEMS_SQL} {_FOUND}")
def search_by_postings(spark, d):
    """The quoted search over posting lists, to which two thirds of the items came first and the rest later."""
    items = _items(spark, d).select("id", *search.SEARCHED)
    schemas = {"items": items.schema, "postings": search_index.POSTINGS}
    tables = Tables(spark, f"{_work_folder(spark)}/tables", schemas).init()
    for late in (False, True):
        search_index.add(tables, items.filter((F.col("id") % 3 == 0) == late))
    return search_index.find(tables, '"The" "ATION" of th').select("id")


_DRAFT = "transcript || CASE conv_id % 4 WHEN 1 THEN chr(10) || 'sources utilisées pour cette édition: a' || chr(10) || 'Sources utilisées pour cette édition: b' ELSE '' END"


@query(
    f"""WITH {views.TRANSCRIPTS_SQL}, t AS (SELECT conv_id, lower({_DRAFT}) AS low FROM v_transcripts)
    SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN 'self-reported short transcript' WHEN conv_id % 4 = 1 THEN 'duplicate source credits'
      WHEN contains(low, 'the') THEN 'generic filler: the' END AS issue FROM t"""
)
def draft_self_reports(spark, d):
    """Drafts that say of themselves that they are too short, and such as credit their sources twice."""
    t = views.transcripts(spark, d)
    credit = F.lit("\nsources utilisées pour cette édition: a\nSources utilisées pour cette édition: b")
    draft = F.concat("transcript", F.when(F.col("conv_id") % 4 == 1, credit).otherwise(""))
    warnings = F.when(F.col("conv_id") % 4 == 0, F.array(F.lit("ok"), F.lit("Le texte est Trop Court"))).otherwise(F.array(F.lit("a warning")))
    return t.select("conv_id", bulletin.quality_issue(draft, warnings, 0, ("the",)).alias("issue")).withColumn(
        "issue", F.when(F.startswith("issue", F.lit("repetitive")), F.lit(None)).otherwise(F.col("issue"))
    )


# ---- slots that take articles from each other ------------------------------------------------

_SLOTS = [(f"2024-02-01 {h:02d}:00:00", select.Style(("valais", "suisse", "anxiogene", "non_anxiogene", "enfant", "contexte")[h % 6])) for h in range(6)]


def _buffer_sql() -> str:
    """The selection once for each slot, on what the slots before have left."""
    flagged = f"""v_flagged AS MATERIALIZED (SELECT id, title, priority, status, is_sports, region, used_count, {_SEEN} AS seen, {_STORY} AS story, {_subject()} AS subject,
      NOT {_tiered("folded_source")} AND NOT {_LOW} AND region <> 'english' AND (language = 'fr' OR (language NOT IN ('en', 'de') AND detected IN ('fr', 'unknown'))) AS usable,
      NOT regexp_matches(folded, '{"|".join(f"(?:{p})" for p in SETS["child"])}') AS child_ok,
      2 * {_count("folded", SETS["anxiety"])} AS alarm, {_count("folded", SETS["calm"])} AS calm,
      {", ".join(f"{_relevance(t)} AS rel_{t}" for t in ("valais", "suisse"))}
      FROM (SELECT *, {_FOLDED} FROM v_articles) JOIN v_detected USING (id))"""
    parts = [flagged, "taken0 AS (SELECT 0::BIGINT AS id, 0 AS n WHERE false)"]
    for k, (_, style) in enumerate(_SLOTS):
        size = select.pool_size(style, 7)
        child = style.key == "enfant"
        ok = "usable AND child_ok" if child else "usable"
        rel = f"rel_{style.key}" if style.key in ("valais", "suisse") else None
        topic = lambda source: f"SELECT * FROM (SELECT *, count(*) FILTER ({rel} > 0) OVER () AS n_rel FROM {source} WHERE {ok}) WHERE {rel} > 0 OR n_rel < 3" if rel else f"SELECT *, 0 AS n_rel FROM {source} WHERE {ok}"  # noqa: E731, B023
        by = f"{rel} DESC, priority DESC, o2" if rel else "alarm DESC, o2" if style.key == "anxiogene" else "CASE WHEN alarm <= 1 THEN -calm ELSE 1 END, o2" if child or style.key == "non_anxiogene" else "o2"
        keep = "alarm <= 1 OR n_calm < 6" if child or style.key == "non_anxiogene" else "true"
        parts.append(
            f"""c{k} AS (SELECT *, row_number() OVER (ORDER BY priority DESC, seen DESC, id) AS o FROM v_flagged
              WHERE status = 'new' AND NOT is_sports AND region <> 'english' AND id NOT IN (SELECT id FROM taken{k}) ORDER BY o LIMIT {size}),
            r{k} AS (SELECT f.*, row_number() OVER (ORDER BY f.seen DESC, f.used_count + coalesce(t.n, 0), f.id) AS o FROM v_flagged f LEFT JOIN taken{k} t USING (id)
              WHERE NOT is_sports AND region <> 'english' ORDER BY o LIMIT {size}),
            cf{k} AS ({topic(f"c{k}")}), rf{k} AS ({topic(f"r{k}")}),
            u{k} AS (SELECT *, row_number() OVER (ORDER BY part, o) AS o2, count(*) FILTER (alarm <= 1) OVER () AS n_calm FROM (SELECT *, 0 AS part FROM cf{k} UNION ALL
              SELECT *, 1 FROM rf{k} WHERE id NOT IN (SELECT id FROM cf{k}) AND (SELECT count(*) FROM cf{k}) < 7)),
            p{k} AS (SELECT *, row_number() OVER (ORDER BY {by}) AS place FROM u{k} WHERE {keep}),
            s{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY story ORDER BY place) AS sr FROM p{k}) WHERE sr = 1),
            d{k} AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY place) > 1 AS again FROM s{k}),
            g{k} AS MATERIALIZED (SELECT '{_SLOTS[k][0]}' AS slot, row_number() OVER (ORDER BY again, place) AS ord, id, part = 1 AS filled_up FROM d{k} {"WHERE NOT again" if child else ""} ORDER BY ord LIMIT 7),
            taken{k + 1} AS MATERIALIZED (SELECT id, sum(n)::BIGINT AS n FROM (SELECT id, n FROM taken{k} UNION ALL SELECT id, 1 FROM g{k}) GROUP BY id)"""
        )
    return f"WITH {views.ARTICLES_SQL}, {_detect()}, {', '.join(parts)} " + " UNION ALL ".join(f"SELECT * FROM g{k}" for k in range(len(_SLOTS)))


@query(_buffer_sql())
def slot_buffer(spark, d):
    """Six slots in one plan, each with what the ones before have left."""
    return buffer.fill(_articles(spark, d), _SLOTS, 7, SETS, TOPICS, SUBJECTS)
