"""Queries over stored records, dates, texts and replies, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, language, payload
from ..functions import fixed_values as V
from ..functions import text as X
from ..operators import bulletin, publish, schedule, search, select, store
from . import views
from .queries import _ITEMS_SQL, _SEEN, _articles, _detect, _fold, _items, _squeeze, _stamp, NOW, TOPICS, now, query, stamp

# ---- dates and slots -------------------------------------------------------------------------


@query(
    f"""SELECT event_id, {_stamp("s")} AS slot FROM (SELECT event_id, unnest(generate_series(time_bucket(INTERVAL 30 MINUTE, l),
    time_bucket(INTERVAL 30 MINUTE, l) + INTERVAL 90 MINUTE, INTERVAL 30 MINUTE)) AS s
    FROM (SELECT event_id, ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Zurich' AS l FROM events))"""
)
def upcoming_slots(spark, d):
    """The running slot and the next three of each event's wall clock."""
    slots = schedule.slots_from(F.col("ts"), 30, 4, dates.LOCAL_ZONE)
    return views.table(spark, d, "events").select("event_id", F.explode(slots).alias("slot")).select("event_id", stamp("slot").alias("slot"))


@query("SELECT event_id, strftime(ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Zurich', '%d.%m.%Y %H:%M') AS shown FROM events")
def displayed_times(spark, d):
    return views.table(spark, d, "events").select("event_id", dates.display(F.col("ts")).alias("shown"))


def _written_dates(events):
    """The events' times as feeds write them: RFC 822 with an offset or a zone's name, ISO with Z or an offset, and no date at all."""
    full, iso = F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    n = F.col("event_id") % 5
    raw = F.when(n == 0, F.concat(full, F.lit(" +0100"))).when(n == 1, F.concat(full, F.lit(" GMT"))).when(n == 2, F.concat(iso, F.lit("Z")))
    raw = raw.when(n == 3, F.concat(iso, F.lit("-05:00"))).otherwise("yesterday")
    return events.withColumns({"raw": raw, "updated": F.when(F.col("event_id") % 2 == 0, F.concat(iso, F.lit("+02:00")))})


@query(
    f"""SELECT event_id, {_stamp("CASE event_id % 5 WHEN 0 THEN s - INTERVAL 1 HOUR WHEN 1 THEN s WHEN 2 THEN s WHEN 3 THEN s + INTERVAL 5 HOUR END")} AS parsed,
    {_stamp("CASE event_id % 5 WHEN 0 THEN s - INTERVAL 1 HOUR WHEN 1 THEN s WHEN 2 THEN s WHEN 3 THEN s + INTERVAL 5 HOUR ELSE CASE WHEN event_id % 2 = 0 THEN s - INTERVAL 2 HOUR END END")}
    AS first FROM (SELECT event_id, date_trunc('second', ts) AS s FROM events)"""
)
def parsed_dates(spark, d):
    """Instants of written dates, and of the first that can be read."""
    e = _written_dates(views.table(spark, d, "events"))
    return e.select("event_id", stamp(dates.parse_date("raw")).alias("parsed"), stamp(dates.first_date("raw", "updated")).alias("first"))


# ---- logs that compact to state --------------------------------------------------------------


@query(
    """SELECT event_type AS source, max(event_id) FILTER (event_id % 4 = 0) AS etag_of, arg_max(value, event_id) AS checked
    FROM events GROUP BY 1"""
)
def kept_validators(spark, d):
    """Validators that a fetch without any does not take away."""
    e = views.table(spark, d, "events")
    log = e.select(
        F.col("event_type").alias("source"), F.col("event_id").alias("fetch"), F.col("value").alias("checked_at"),
        F.when(F.col("event_id") % 4 == 0, F.col("event_id")).alias("etag"), F.lit(None).cast("string").alias("last_modified"),
    )
    return store.keep_validators(log).select("source", F.col("etag").alias("etag_of"), F.col("checked_at").alias("checked"))


@query(
    """SELECT user_id AS id, arg_max(event_type, event_id) AS status, max(event_id) FILTER (event_id % 3 = 0) AS message
    FROM events GROUP BY 1"""
)
def run_states(spark, d):
    """The last state of each run, and its last message."""
    e = views.table(spark, d, "events")
    log = e.select(F.col("user_id").alias("id"), F.col("event_id").alias("at"), F.col("event_type").alias("status"), F.when(F.col("event_id") % 3 == 0, F.col("event_id")).alias("message"))
    return store.latest_status(log)


@query(
    """WITH uses AS (SELECT l_partkey AS id, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1)
    SELECT p_partkey AS id, coalesce(n, 0) AS used_count, CASE WHEN n > 0 THEN 'used' ELSE 'new' END AS status FROM part LEFT JOIN uses ON p_partkey = id"""
)
def use_counts(spark, d):
    """A bridge table that holds each pair once, and what it says of the rows that are used."""
    bridge = views.table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), "l_orderkey").distinct()
    uses = bridge.groupBy("id").agg(F.count("*").alias("used_count"))
    return store.with_use(views.table(spark, d, "part").select(F.col("p_partkey").alias("id")), uses).select("id", "used_count", "status")


def _stored_sources(spark, d):
    s = views.table(spark, d, "supplier")
    return s.select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("https://s/"), F.col("s_suppkey").cast("string")).alias("url"),
        F.lit("general").alias("region"), F.lit(50).alias("priority"), F.lit(5).alias("interval_minutes"), F.lit(20).alias("max_entries"),
        F.lit(True).alias("enabled"), F.concat(F.lit("e"), F.col("s_suppkey").cast("string")).alias("etag"),
    )


@query(
    """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'renamed ' || s_suppkey ELSE s_name END AS name,
      CASE WHEN s_suppkey % 3 = 1 THEN 'https://moved/' || s_suppkey ELSE 'https://s/' || s_suppkey END AS url,
      CASE WHEN s_suppkey % 3 < 2 THEN 90 ELSE 50 END AS priority, 'e' || s_suppkey AS etag FROM supplier
    UNION ALL SELECT NULL, 'added ' || s_suppkey, 'https://new/' || s_suppkey, 90, NULL FROM supplier WHERE s_suppkey % 3 = 2"""
)
def merged_sources(spark, d):
    """Stored sources after a configuration that renames some, moves others and adds some; new ids are hashes, shown as null."""
    stored = _stored_sources(spark, d)
    n, key = F.col("id") % 3, F.col("id").cast("string")
    given = stored.withColumn("priority", F.lit(90)).withColumns(
        {
            "name": F.when(n == 0, F.concat(F.lit("renamed "), key)).when(n == 2, F.concat(F.lit("added "), key)).otherwise(F.col("name")),
            "url": F.when(n == 1, F.concat(F.lit("https://moved/"), key)).when(n == 2, F.concat(F.lit("https://new/"), key)).otherwise(F.col("url")),
        }
    )
    out = store.merge_sources(stored, given.drop("id", "etag"))
    return out.select(F.when(F.startswith("url", F.lit("https://new/")), F.lit(None)).otherwise(F.col("id")).alias("id"), "name", "url", "priority", "etag")


@query(
    """WITH r AS (SELECT event_id AS id FROM events WHERE event_id % 4 = 0), t AS (SELECT event_id AS id FROM events WHERE event_id % 6 = 0)
    SELECT id, 'toggled' AS mark FROM (SELECT id FROM r WHERE id NOT IN (SELECT id FROM t) UNION ALL SELECT id FROM t WHERE id NOT IN (SELECT id FROM r))
    UNION ALL SELECT id, 'all' FROM (SELECT id FROM r UNION SELECT id FROM t) UNION ALL SELECT id, 'new' FROM t WHERE id NOT IN (SELECT id FROM r)"""
)
def read_marks(spark, d):
    """Read marks after toggling some items, and after marking all visible ones."""
    e = views.table(spark, d, "events").select(F.col("event_id").alias("id"))
    read, shown = e.filter("id % 4 = 0"), e.filter("id % 6 = 0")
    every, new = store.mark_all(read, shown)
    parts = ((store.toggled(read, shown), "toggled"), (every, "all"), (new, "new"))
    a, b, c = (df.select("id", F.lit(name).alias("mark")) for df, name in parts)
    return a.unionByName(b).unionByName(c)


@query("SELECT count(*) AS n_items, count(*) FILTER (event_id % 4 = 0) AS n_read FROM events WHERE event_id % 6 < 5")
def read_counters(spark, d):
    e = views.table(spark, d, "events").select(F.col("event_id").alias("id"))
    return search.counters(e.filter("id % 6 < 5"), e.filter("id % 4 = 0"))


@query(
    """SELECT user_id AS id, CASE WHEN p >= m - 8 THEN 0.0 ELSE greatest(0.0, p - 5) END AS position
    FROM (SELECT user_id, arg_max(value, event_id) AS p, max(value) + 5 AS m FROM events GROUP BY 1)"""
)
def resume_positions(spark, d):
    log = views.table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("at"), F.col("value").alias("position"))
    return store.resume_position(log, F.col("position") + 5)


@query(
    """WITH remote AS (SELECT event_id AS id FROM events WHERE event_id % 3 = 0),
    keep AS (SELECT event_id AS id FROM events WHERE event_id % 6 = 0 UNION SELECT max(event_id) FROM events WHERE event_id % 3 = 0)
    SELECT id FROM remote WHERE id NOT IN (SELECT id FROM keep)"""
)
def removed_objects(spark, d):
    """What goes: neither retained nor the current one."""
    e = views.table(spark, d, "events").select(F.col("event_id").alias("id"))
    remote = e.filter("id % 3 = 0")
    return store.stale(remote, e.filter("id % 6 = 0").union(remote.agg(F.max("id"))), "id")


@query(
    """SELECT p.page_id FROM pages p WHERE sha256(regexp_replace(trim(url), '#.*$', '')) IN
    (SELECT sha256('https://example.org/' || page_id) FROM pages UNION ALL SELECT sha256(regexp_replace(trim(url), '#.*$', '')) FROM pages WHERE page_id % 2 = 0)"""
)
def known_addresses(spark, d):
    """The lookup of given addresses among the stored ones, by hash."""
    p = views.table(spark, d, "pages").select("page_id", X.url_hash(X.canonical_url("url")).alias("url_hash"))
    given = p.filter("page_id % 2 = 0").select("url_hash").union(p.select(X.url_hash(F.concat(F.lit("https://example.org/"), F.col("page_id").cast("string")))))
    return store.still_kept(p, given, "url_hash").select("page_id")


@query(
    """SELECT 'https://a/' || doc_id % 700 AS url, min(doc_id) AS first_doc, arg_max(source, doc_id) AS last_source, count(*) AS arrivals,
    count(DISTINCT doc_id) FILTER (doc_id % 3 = 0) > 0 AS used FROM documents GROUP BY 1"""
)
def stored_articles(spark, d):
    """Articles of an arrival log, one for each address; the first arrival gives what is fixed, the last one what is news."""
    docs = views.table(spark, d, "documents")
    address = F.concat(F.lit(" https://a/"), (F.col("doc_id") % 700).cast("string"), F.lit("#"), F.col("doc_id").cast("string"))
    log = docs.select(
        address.alias("url"), F.col("doc_id").alias("arrival"), F.lit(1).alias("source_id"), F.col("doc_id").alias("scraped_at"), F.col("source").alias("title"),
        F.lit("").alias("summary"), F.lit("").alias("content"), F.lit("fr").alias("language"), F.lit(None).cast("timestamp").alias("published_at"),
        F.lit(None).cast("string").alias("published_at_raw"),
    )
    sources = spark.createDataFrame([(1, "A", "valais", 5)], "id int, name string, region string, priority int")
    seen = log.withColumn("url", X.canonical_url("url")).filter("arrival % 3 = 0")
    used = seen.select(F.col("arrival").alias("bulletin_id"), F.xxhash64(X.url_hash("url")).alias("article_id"))
    out = store.articles(log, sources, used)
    return out.select("url", F.col("created_at").alias("first_doc"), F.col("title").alias("last_source"), "arrivals", (F.col("status") == "used").alias("used"))


# ---- texts -----------------------------------------------------------------------------------


@query("SELECT page_id, regexp_replace(url, '[^\\p{L}\\p{N}_-]', '-', 'g') AS stem FROM pages")
def safe_stems(spark, d):
    return views.table(spark, d, "pages").select("page_id", X.safe_stem("url").alias("stem"))


@query(
    """SELECT page_id, regexp_replace(regexp_replace(u, '([?&])artist=[^&#]*&?', '\\1', 'g'), '[?&]$', '', 'g')
    || CASE WHEN contains(regexp_replace(regexp_replace(u, '([?&])artist=[^&#]*&?', '\\1', 'g'), '[?&]$', '', 'g'), '?') THEN '&' ELSE '?' END || 'artist=A+%26+B' AS url
    FROM (SELECT page_id, regexp_replace(url, '#.*$', '') || CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN '?artist=x&n=1' ELSE '?n=1&artist=old' END AS u FROM pages)"""
)
def url_parameters(spark, d):
    """Addresses with one parameter replaced."""
    tail = F.when(F.col("page_id") % 3 == 0, "").when(F.col("page_id") % 3 == 1, "?artist=x&n=1").otherwise("?n=1&artist=old")
    p = views.table(spark, d, "pages").withColumn("u", F.concat(F.regexp_replace("url", "#.*$", ""), tail))
    return p.select("page_id", X.set_query_value("u", "artist", F.lit("A & B")).alias("url"))


@query(
    """SELECT doc_id, len(p) AS n, sha256(array_to_string(p, '|')) AS body
    FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n+'), lambda x: trim(x)), lambda x: x <> '') AS p FROM documents)"""
)
def text_paragraphs(spark, d):
    p = views.table(spark, d, "documents").select("doc_id", X.paragraphs("text").alias("p"))
    return p.select("doc_id", F.size("p").alias("n"), F.sha2(F.array_join("p", "|"), 256).alias("body"))


_SENTENCES = "regexp_split_to_array(regexp_replace({0}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"


@query(
    f"""SELECT doc_id, len(s) AS n, sha256(array_to_string(s, '|')) AS body
    FROM (SELECT doc_id, list_filter(list_transform({_SENTENCES.format("text")}, lambda x: trim(x)), lambda x: x <> '') AS s FROM documents)"""
)
def text_sentences(spark, d):
    s = views.table(spark, d, "documents").select("doc_id", X.sentences("text").alias("s"))
    return s.select("doc_id", F.size("s").alias("n"), F.sha2(F.array_join("s", "|"), 256).alias("body"))


@query(
    f"""WITH s AS (SELECT doc_id, t, {_SENTENCES.format("trim(t)")} AS s, list_filter(list_transform(regexp_split_to_array(t, '\\n{{2,}}'), lambda x: trim(x)), lambda x: x <> '') AS p
      FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN replace(text, chr(10), chr(10) || chr(10)) ELSE replace(text, chr(10), ' ') END AS t FROM documents))
    SELECT doc_id, sha256(CASE WHEN len(p) > 1 THEN array_to_string(p, chr(10) || chr(10)) WHEN len(s) <= 3 THEN trim(t)
      ELSE array_to_string(list_filter(list_transform(range(1, len(s) + 1, 2), lambda i: trim(array_to_string(list_slice(s, i, i + 1), ' '))), lambda x: x <> ''), chr(10) || chr(10)) END) AS body FROM s"""
)
def paired_sentences(spark, d):
    """One long paragraph becomes several of two sentences each."""
    t = F.when(F.col("doc_id") % 4 == 0, F.replace("text", F.lit("\n"), F.lit("\n\n"))).otherwise(F.replace("text", F.lit("\n"), F.lit(" ")))
    docs = views.table(spark, d, "documents").select("doc_id", t.alias("t"))
    return docs.select("doc_id", F.sha2(X.pair_sentences("t"), 256).alias("body"))


@query(
    f"""WITH {views.ARTICLES_SQL}, {_detect()} SELECT id, CASE WHEN language <> 'unknown' THEN language ELSE detected END AS resolved,
    CASE WHEN language <> '' THEN language WHEN region = 'english' THEN 'en' ELSE 'unknown' END AS item_language FROM v_articles JOIN v_detected USING (id)"""
)
def stored_language(spark, d):
    """The stored language where it is known, else the detected one; and the one that readers filter by."""
    return _articles(spark, d).select(
        "id", language.resolved("language", "title", "summary", "content", F.col("region")).alias("resolved"), search.item_language().alias("item_language")
    )


@query(
    """SELECT conv_id, turn, CASE conv_id % 4 WHEN 3 THEN NULL WHEN 2 THEN 'Bulletin' ELSE 'Turn ' || turn END AS title,
    CASE WHEN conv_id % 4 <> 3 THEN trim(coalesce(text, '')) END AS transcript, CASE WHEN conv_id % 4 <> 3 THEN CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 0 END END AS n_warnings
    FROM conversations"""
)
def reply_drafts(spark, d):
    """Drafts in replies: bare JSON, JSON in a code fence, JSON among other words and with an empty title, and none."""
    n = F.col("conv_id") % 4
    title = F.when(n == 2, F.lit(" ")).otherwise(F.concat(F.lit("Turn "), F.col("turn").cast("string")))
    warnings = F.when(n % 2 == 0, F.array(F.lit("short"), F.lit(""))).otherwise(F.array(F.lit("")))
    body = F.to_json(F.struct(title.alias("title"), F.coalesce("text", F.lit("")).alias("transcript"), warnings.alias("warnings"), F.lit(1).alias("more")))
    raw = F.when(n == 0, body).when(n == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(n == 2, F.concat(F.lit("Here it is: "), body, F.lit(" Done.")))
    c = views.table(spark, d, "conversations").select("conv_id", "turn", payload.json_object(raw.otherwise("I cannot do that.")).alias("j"))
    draft = F.when(F.col("j").isNotNull(), payload.draft(F.col("j")))
    return c.select("conv_id", "turn", draft["title"].alias("title"), draft["transcript"].alias("transcript"), F.size(draft["warnings"]).alias("n_warnings")).withColumn(
        "n_warnings", F.when(F.col("title").isNotNull(), F.col("n_warnings"))
    )


@query(
    f"""WITH {views.ARTICLES_SQL} SELECT id, 'Article A' || CASE WHEN id < 10 THEN '0' ELSE '' END || id || chr(10) || '- Source: ' || source_name || chr(10) || '- Region: ' || region || chr(10)
    || '- Detected language: ' || language || chr(10) || '- Title: ' || title || chr(10) || '- URL: https://a/' || id || chr(10) || '- Date: ' || coalesce({_stamp("published_at")}, 'unknown') || chr(10)
    || '- Content: ' || CASE WHEN length(c) <= 900 THEN c ELSE regexp_replace(substr(c, 1, 900), ' [^ ]*$', '') || '...' END AS block
    FROM (SELECT *, {_squeeze("CASE WHEN content <> '' THEN content ELSE summary END")} AS c FROM v_articles)"""
)
def prompt_blocks(spark, d):
    a = _articles(spark, d).withColumn("url", F.concat(F.lit("https://a/"), F.col("id").cast("string"))).withColumn("published_at", stamp("published_at"))
    return a.select("id", bulletin.prompt_text(F.col("id")).alias("block"))


# ---- bulletins and clients -------------------------------------------------------------------

_STYLES = ("non_anxiogene", "anxiogene", "enfant", "contexte", "pote")


@query(
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'enfant' WHEN 1 THEN 'non_anxiogene' ELSE 'flash_info_' || event_type END AS style FROM events"""
)
def bulletin_styles(spark, d):
    """The style that a bulletin's id names, else what its label says."""
    n = F.col("event_id") % 4
    named = F.concat(F.col("event_id").cast("string"), F.when(n == 0, "-enfant-x").when(n == 1, "_non_anxiogene").otherwise(""))
    e = views.table(spark, d, "events").select("event_id", named.alias("id"), F.concat(F.lit("Flash -- Info "), F.col("event_type")).alias("style_label"))
    return e.select("event_id", publish.style_of(keys=_STYLES).alias("style"))


@query(
    f"""WITH {views.BULLETINS_SQL}, h AS (SELECT * FROM v_bulletins WHERE status = 'ready' ORDER BY slot_start DESC, id LIMIT 200)
    SELECT style_key AS style, arg_max(id, (slot_start, -id)) AS id FROM h WHERE audio_path IS NOT NULL GROUP BY 1"""
)
def latest_per_style(spark, d):
    """The newest one with sound of each style, among the newest 200 as the schedule looks back."""
    return publish.latest_by_style(views.bulletins(spark, d)).select("style", "id")


@query(
    f"""WITH {views.BULLETINS_SQL} SELECT id, style_key AS topic, 'https://cdn/x/bulletins/' || id || '.mp3' AS audio_url, {_stamp("slot_start")} AS slot_start
    FROM v_bulletins WHERE status = 'ready'"""
)
def manifest_items(spark, d):
    b = views.bulletins(spark, d).filter("status = 'ready'").withColumn("topic", publish.topic_of()).withColumn("id", F.col("id").cast("string"))
    m = b.select(publish.manifest_item("https://cdn/x/").alias("m")).select("m.*")
    return m.select(F.col("id").cast("long").alias("id"), "topic", "audio_url", stamp("slot_start").alias("slot_start"))


@query(
    """SELECT event_id, 'Radio X - ' || CASE WHEN event_id % 3 = 0 THEN 'Radio X' ELSE 'News ' || event_id END || ' (' ||
    CASE WHEN event_id % 2 = 0 THEN event_type WHEN event_id % 3 = 0 THEN 'Radio X' ELSE 'News ' || event_id END || ')' AS line FROM events"""
)
def stream_metadata(spark, d):
    """The line that a stream shows: placeholders filled in, the brand's own prefix taken off the title."""
    title = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, F.concat(F.lit("Radio X - News "), F.col("event_id").cast("string")))
    title = title.otherwise(F.concat(F.lit("News "), F.col("event_id").cast("string")))
    label = F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise("")
    line = payload.metadata_text("{artist} - {title} ({style})", "Radio X", title, label, F.col("event_id").cast("string"))
    return views.table(spark, d, "events").select("event_id", line.alias("line"))


@query(
    """WITH latest AS (SELECT event_type AS style, max(event_id) AS id FROM events GROUP BY 1)
    SELECT o_orderkey % 60 AS minute, (o_orderkey % 60) // 12 AS place, style, id FROM (SELECT DISTINCT o_orderkey % 60 AS o_orderkey FROM orders)
    JOIN (SELECT *, row_number() OVER (ORDER BY style) - 1 AS k FROM latest) ON k = (o_orderkey % 60) // 12"""
)
def hour_plan(spark, d):
    """Each minute's style with the style's latest bulletin."""
    latest = views.table(spark, d, "events").groupBy(F.col("event_type").alias("style")).agg(F.max("event_id").alias("id"))
    styles = latest.agg(F.array_sort(F.collect_set("style"))).scalar()
    minute = (F.col("o_orderkey") % 60).alias("minute")
    plan = views.table(spark, d, "orders").select(minute).distinct().withColumn("place", F.floor(F.col("minute") / 12))
    plan = plan.withColumn("style", F.try_element_at(styles, (F.col("place") + 1).cast("int"))).filter("style IS NOT NULL")
    return schedule.hour_plan(plan, latest).select("minute", "place", "style", "id")


@query(
    f"""WITH {_ITEMS_SQL} SELECT id FROM v_items WHERE region = 'valais' AND coalesce(published_at, scraped_at) >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY
    AND contains({_fold("concat_ws(' ', title, summary, source, region, language, '')")}, 'on the')"""
)
def archive_search(spark, d):
    return search.archive_filter(_items(spark, d), now(), region="valais", period="7d", query=" On  The").select("id")


@query(
    f"""WITH {_ITEMS_SQL} SELECT id, 'english' AS page FROM v_items WHERE region = 'english' AND NOT is_sports AND language <> 'de'
    UNION ALL SELECT id, 'german' FROM v_items WHERE language NOT IN ('en') AND NOT is_sports
    UNION ALL SELECT id, 'plain' FROM v_items WHERE language NOT IN ('en', 'de') AND NOT is_sports"""
)
def preset_pages(spark, d):
    """What a page shows whose address opens English by its region, German, or nothing."""
    pages = {"english": {"region": "english"}, "german": {"de": "1"}, "plain": {}}
    return search.pages_of(_items(spark, d), now(), {name: {"period": "all"} | search.preset(p) for name, p in pages.items()})


@query(
    """WITH i AS (SELECT event_id, event_type, event_id % 7 <> 0 AS sound, event_id % 11 = 0 AS live FROM events WHERE event_type <> (SELECT min(event_type) FROM events))
    SELECT 'hit' AS kind, min(event_id) AS id FROM i WHERE sound AND event_type = (SELECT max(event_type) FROM events)
    UNION ALL SELECT 'other', min(event_id) FROM i WHERE sound
    UNION ALL SELECT 'shown', count(*) FROM i"""
)
def spoken_search(spark, d):
    """The first item that a spoken query finds, the first one for a query that finds nothing, and how many the catalogue shows."""
    e = views.table(spark, d, "events")
    ends = e.agg(F.min("event_type").alias("a"), F.max("event_type").alias("b")).first()
    items = e.select(
        F.col("event_id").alias("id"), F.col("event_id").alias("ord"), F.when(F.col("event_id") % 7 != 0, "x.mp3").alias("audio_url"), F.lit("Bulletin").alias("title"),
        F.col("event_type").alias("subtitle"), (F.col("event_id") % 11 == 0).alias("is_live"), F.col("event_type").alias("style_key"),
    )
    shown = search.catalogue(items, False, (ends["a"],))
    found = [search.first_match(shown, q).select(F.lit(k).alias("kind"), "id") for k, q in (("hit", f" {ends['b'].upper()} "), ("other", "no such thing"))]
    return found[0].unionByName(found[1]).unionByName(shown.agg(F.lit("shown").alias("kind"), F.count("*").alias("id")))


@query(
    f"""WITH {views.ARTICLES_SQL}, {views.BULLETINS_SQL}
    SELECT 'article' AS kind, id FROM (SELECT id FROM v_articles ORDER BY {_SEEN} DESC, id LIMIT 12)
    UNION ALL SELECT 'bulletin', id FROM (SELECT id FROM v_bulletins ORDER BY slot_start DESC, id LIMIT 12)"""
)
def diagnostics(spark, d):
    """The newest twelve articles and bulletins."""
    a = select.top(_articles(spark, d), 12, *select.archive_order()).select(F.lit("article").alias("kind"), "id")
    b = select.top(views.bulletins(spark, d), 12, F.desc("slot_start"), F.asc("id")).select(F.lit("bulletin").alias("kind"), "id")
    return a.unionByName(b)


@query(f"WITH {views.ARTICLES_SQL} SELECT id, row_number() OVER (ORDER BY {_SEEN} DESC, id) AS ord FROM v_articles ORDER BY ord LIMIT 50")
def unranked(spark, d):
    """A style without a ranking keeps the order it is given."""
    head = select.numbered(select.top(_articles(spark, d), 50, *select.archive_order()), *select.archive_order())
    return select.rank(head, "contexte", TOPICS).select("id", "ord")


@query(
    f"""WITH {views.ARTICLES_SQL} SELECT source_name, '{V.CREDIT["fr"]}' || string_agg(s, ', ' ORDER BY o) || '.' AS credit
    FROM (SELECT source_name, s, min(o) AS o FROM (SELECT source_name, 'S' || (id % 4) AS s, row_number() OVER (PARTITION BY source_name ORDER BY id) AS o FROM v_articles) GROUP BY 1, 2) GROUP BY 1"""
)
def source_credits(spark, d):
    """The distinct sources of a bulletin in the order of their first mention."""
    a = _articles(spark, d).groupBy("source_name").agg(F.array_sort(F.collect_list(F.struct("id", F.concat(F.lit("S"), (F.col("id") % 4).cast("string")).alias("s")))).alias("x"))
    return a.select("source_name", bulletin.source_credit(F.transform("x", lambda x: x["s"]), "fr").alias("credit"))
