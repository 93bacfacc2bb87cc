"""The queries of the engine over the driver tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, language, rules
from ..functions import html as H
from ..functions import speech
from ..functions import text as X
from ..operators import bulletin, publish, schedule, search, select, store
from ..sources import sinks
from ..sources.folders import shared_folder
from . import views

# ---- rule sets of words that the driver tables hold ------------------------------------------

SETS = {
    "sports": {
        "strong": (r"\blicense\b", r"\btoken\b"),
        "team": (r"\bthis\b", r"\bavec\b", r"\bsich\b"),
        "context": (r"\bthat\b", r"\bfrom\b", r"\bpour\b", r"\bmit\b", r"\bdans\b", r"\bnicht\b"),
    },
    "low_value": (r"^the\b", r"^le\b", r"\bis the\b"),
    "child": (r"\btrash\b", r"\bscum\b", r"\bidiot"),
    "anxiety": (r"\bwas\b", r"\bnot\b", r"\bnicht\b", r"\bpas\b", r"\bare\b"),
    "calm": (r"\bwith\b", r"\bund\b", r"\bque\b", r"\bfor\b"),
}
TOPICS = {
    "valais": (r"\bpour\b", r"\bdans\b", r"\bthis\b"),
    "suisse": (r"\bavec\b", r"\bsur\b"),
    "international": (r"\bfrom\b", r"\bune\b"),
    "international_english": (r"\bthe\b",),
}
SUBJECTS = (("ukraine-war", r"\btrash\b"), ("cannes", r"\bavec\b|\bsich\b"))
NOW = "2024-01-20 12:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _stamp(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


# ---- SQL mirrors of the expressions ----------------------------------------------------------


def _fold(c: str) -> str:
    return f"strip_accents(lower({c}))"


def _for_rules(c: str) -> str:
    """Letters without accents are word characters to Spark's \\b, but not to DuckDB's."""
    return f"replace(replace(replace({_fold(c)}, 'ß', 's'), 'œ', 'o'), 'æ', 'a')"


def _any(c: str, patterns) -> str:
    return f"regexp_matches({c}, '{'|'.join(f'(?:{p})' for p in patterns)}')"


def _count(c: str, patterns) -> str:
    return "(" + " + ".join(f"CAST(regexp_matches({c}, '{p}') AS INT)" for p in patterns) + ")"


def _squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def _key(c: str) -> str:
    bare = f"regexp_replace({_fold(c)}, 'https?://\\S+', ' ', 'g')"
    return _squeeze(f"regexp_replace({bare}, '[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s]', ' ', 'g')")


_STORY = f"""CASE WHEN length({_key("title")}) >= 12 THEN 'title:' || {_key("title")}
  ELSE 'body:' || {_key("title")} || ':' || substr({_key("summary")}, 1, 140) END"""
_ALL = "title || ' ' || summary || ' ' || content"
_FOLDED = f"{_for_rules(_ALL)} AS folded, {_for_rules('source_name || chr(32) || ' + _ALL)} AS folded_source"


def _subject(stop=tuple(X.V.SUBJECT_STOP_WORDS)) -> str:
    stops = ", ".join(f"'{w}'" for w in stop)
    words = f"list_filter(regexp_extract_all({_fold(_ALL)}, '[a-z0-9]{{4,}}'), lambda w: w NOT IN ({stops}))"
    cases = " ".join(f"WHEN regexp_matches({_for_rules(_ALL)}, '{p}') THEN '{k}'" for k, p in SUBJECTS)
    named = f"array_to_string(list_slice({words}, 1, 4), '-')"
    return f"CASE {cases} WHEN {named} <> '' THEN {named} ELSE substr({_fold(_ALL)}, 1, 40) END"


def _tiered(c: str) -> str:
    s = SETS["sports"]
    return f"({_any(c, s['strong'])} OR ({_any(c, s['team'])} AND {_count(c, s['context'])} >= 1) OR {_count(c, s['context'])} >= 3)"


_LOW = _any(f"trim({_for_rules('title || chr(32) || summary')})", SETS["low_value"])


def _relevance(topic: str) -> str:
    secure = f"source_name || ' ' || region || ' ' || {_ALL}"
    bonus = " ".join(
        f"WHEN region IN ({', '.join(repr(r) for r in regions)}) THEN {more}" for regions, more in X.V.TOPIC_REGION_BONUS[topic]
    )
    return f"(4 * {_count(_for_rules(secure), TOPICS[topic])} + CASE {bonus} ELSE 0 END)"


def _detect() -> str:
    body = "trim(concat_ws(' ', nullif(title, ''), nullif(summary, ''), nullif(substr(content, 1, 1800), '')))"
    tokens = f"regexp_extract_all({_fold(f'''regexp_replace({body}, '[^a-zA-ZÀ-ÖØ-öø-ÿ0-9'']+', ' ', 'g')''')}, '[^ ]+')"
    parts = []
    for name, marks in X.V.LANGUAGE_WORDS.items():
        found = f"len(list_filter(tok, lambda t: t IN ({', '.join(repr(m) for m in marks)})))"
        letters = " + ".join(f"CASE WHEN contains(low, '{ch}') THEN 2 ELSE 0 END" for ch in X.V.LANGUAGE_LETTERS.get(name, ""))
        parts.append(f"{found} + {letters or 0} AS s_{name}")
    return f"""v_detected AS (
  SELECT id, CASE WHEN region = 'english' THEN 'en' WHEN len(tok) < 4 OR greatest(s_fr, s_en, s_de) < 4 THEN 'unknown'
    WHEN s_fr >= s_en AND s_fr >= s_de THEN 'fr' WHEN s_en >= s_de AND s_en >= greatest(s_fr, s_de) + 2 THEN 'en'
    WHEN s_de > s_en AND s_de >= greatest(s_fr, s_en) + 2 THEN 'de' ELSE 'unknown' END AS detected
  FROM (SELECT id, region, tok, {', '.join(parts)} FROM (SELECT id, region, {tokens} AS tok, lower({body}) AS low FROM v_articles)))"""


_SEEN = "coalesce(published_at, created_at)"


def _articles(spark, d, flags=True):
    return views.articles(spark, d, flags)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query; whole numbers come out as long, as in the SQL."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])

        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


# ---- catalogue and stored tables -------------------------------------------------------------


@query(f"WITH {views.SOURCES_SQL} SELECT source_name, idx, priority, region, enabled FROM v_sources")
def source_catalog(spark, d):
    return views.sources(spark, d)


@query(f"WITH {views.SOURCES_SQL} SELECT count(*) AS n FROM v_sources WHERE enabled")
def enabled_sources(spark, d):
    return views.sources(spark, d).filter("enabled").agg(F.count("*").alias("n"))


@query(
    f"""WITH {views.ARTICLES_SQL} SELECT id, source_name, priority, {_stamp(_SEEN)} AS seen FROM v_articles
    WHERE status = 'new' AND NOT is_sports AND region <> 'english' ORDER BY priority DESC, {_SEEN} DESC, id LIMIT 50"""
)
def articles_join_sources_topk(spark, d):
    bare = _articles(spark, d).drop("idx", "priority", "region")
    joined = bare.join(views.sources(spark, d).select("source_name", "priority", "region"), "source_name")
    kept = select.top(select.candidates(joined, english=False), 50, *select.candidate_order())
    return kept.select("id", "source_name", "priority", stamp(select.when_seen()).alias("seen"))


@query(
    f"""WITH {views.ARTICLES_SQL} SELECT id, source_name, used_count, {_stamp(_SEEN)} AS seen FROM v_articles
    WHERE NOT is_sports ORDER BY {_SEEN} DESC, used_count, id LIMIT 50"""
)
def recent_articles_topk(spark, d):
    kept = select.top(select.recent(_articles(spark, d)), 50, *select.recent_order())
    return kept.select("id", "source_name", "used_count", stamp(select.when_seen()).alias("seen"))


@query(
    f"""WITH {views.ARTICLES_SQL} SELECT id, title, region, language, {_stamp(_SEEN)} AS seen FROM v_articles
    ORDER BY {_SEEN} DESC, id LIMIT 100"""
)
def article_archive(spark, d):
    kept = select.top(_articles(spark, d), 100, *select.archive_order())
    return kept.select("id", "title", "region", "language", stamp(select.when_seen()).alias("seen"))


@query(f"WITH {views.ARTICLES_SQL} SELECT status, count(*) AS n FROM v_articles GROUP BY status")
def status_counts(spark, d):
    return store.status_counts(_articles(spark, d))


@query(
    f"""WITH {views.ARTICLES_SQL} SELECT count(*) AS total, count(*) FILTER (is_sports) AS sports,
    count(*) FILTER (NOT is_sports) AS editorial FROM v_articles"""
)
def archive_counts(spark, d):
    return store.archive_counts(_articles(spark, d))


@query("SELECT max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(user_id, event_id) AS user_id FROM events")
def last_event(spark, d):
    return store.last_by(views.table(spark, d, "events"), ["event_id", "event_type", "user_id"], "event_id")


@query("SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS url, sha256(regexp_replace(trim(url), '#.*$', '')) AS url_hash FROM pages")
def url_canonical_hash(spark, d):
    url = X.canonical_url("url")
    return views.table(spark, d, "pages").select("page_id", url.alias("url"), X.url_hash(url).alias("url_hash"))


_UPSERT = """SELECT user_id, arg_min(event_id, event_id) AS first_event, arg_max(event_type, event_id) AS event_type,
    arg_max(value, event_id) AS value, strftime(arg_max(published_at, event_id) FILTER (published_at IS NOT NULL), '%Y-%m-%d %H:%M:%S') AS published_at,
    count(*) AS arrivals
    FROM (SELECT *, CASE WHEN event_id % 3 <> 0 THEN ts END AS published_at FROM events) GROUP BY user_id"""


def _compacted(log):
    log = log.withColumn("first_event", F.col("event_id"))
    out = store.compact(log, "user_id", "event_id", ["first_event"], ["event_type", "value"], ["published_at"])
    return out.withColumn("published_at", stamp("published_at"))


@query(_UPSERT)
def upsert_compaction(spark, d):
    return _compacted(views.upsert_log(views.table(spark, d, "events")))


@query(_UPSERT)
def stream_upsert_equals_batch(spark, d):
    """The events arrive as a stream of files; what it writes compacts to the same state."""
    from ..streaming import upserts

    folder = _work_folder(spark)
    events = views.table(spark, d, "events")
    events.write.mode("overwrite").parquet(f"{folder}/in")
    upserts.replay(spark, f"{folder}/in", events.schema, views.upsert_log, f"{folder}/out", f"{folder}/state", 2)
    return _compacted(spark.read.parquet(f"{folder}/out").drop("batch"))


def _work_folder(spark) -> str:
    import uuid

    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


# ---- keys, stories, subjects -----------------------------------------------------------------


@query(f"WITH {views.ARTICLES_SQL} SELECT id, {_key('title')} AS title_key, sha256({_STORY}) AS story FROM v_articles")
def normalized_text_key(spark, d):
    a = _articles(spark, d)
    return a.select("id", X.key("title").alias("title_key"), F.sha2(X.story_key("title", "summary", "content"), 256).alias("story"))


@query(
    f"""WITH {views.ARTICLES_SQL}, k AS (SELECT id, {_STORY} AS story, {_SEEN} AS seen, priority FROM v_articles)
    SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY story ORDER BY seen DESC, priority DESC, id) AS r FROM k) WHERE r = 1"""
)
def story_dedup(spark, d):
    keyed = _articles(spark, d).select(
        "id", "priority", select.when_seen().alias("seen"), F.sha2(X.story_key("title", "summary", "content"), 256).alias("story")
    )
    w = Window.partitionBy("story").orderBy(F.desc("seen"), F.desc("priority"), "id")
    return keyed.withColumn("r", F.row_number().over(w)).filter("r = 1").select("id")


def _subject_key():
    return X.subject_key(rules.joined("title", "summary", "content"), SUBJECTS)


@query(
    f"""WITH {views.ARTICLES_SQL}, k AS (SELECT id, {_subject()} AS s FROM v_articles)
    SELECT id, s AS subject, row_number() OVER (PARTITION BY s ORDER BY id) > 1 AS again FROM k"""
)
def topic_key_diversify(spark, d):
    """Every article with its subject; those that are not their subject's first one come after all others.

    The first one is a minimum and a join, so that a subject of very many articles is no window of one task.
    """
    keyed = _articles(spark, d).select("id", _subject_key().alias("subject"))
    first = keyed.groupBy("subject").agg(F.min("id").alias("first"))
    return keyed.join(first, "subject").select("id", "subject", (F.col("id") > F.col("first")).alias("again"))


@query(f"WITH {views.ARTICLES_SQL} SELECT min(id) AS id, {_subject()} AS subject FROM v_articles GROUP BY 2")
def topic_unique(spark, d):
    return _articles(spark, d).groupBy(_subject_key().alias("subject")).agg(F.min("id").alias("id"))


# ---- rules -----------------------------------------------------------------------------------


@query(
    f"""WITH {views.ARTICLES_SQL} SELECT id, {_tiered("folded")} AS sports_text, {_tiered("folded_source")} AS sports_article, {_LOW} AS low_value,
    {_any("folded", SETS["child"])} AS child_unsuitable FROM (SELECT *, {_FOLDED} FROM v_articles)"""
)
def rule_flags(spark, d):
    a = _articles(spark, d, False).withColumn("folded", rules.joined("title", "summary", "content"))
    a = a.withColumn("folded_source", rules.with_source(F.col("folded"), "source_name"))
    return a.select(
        "id",
        rules.tiered(F.col("folded"), **SETS["sports"], bound=True).alias("sports_text"),
        rules.tiered(F.col("folded_source"), **SETS["sports"], bound=True).alias("sports_article"),
        rules.is_low_value("title", "summary", SETS["low_value"]).alias("low_value"),
        rules.any_match(F.col("folded"), SETS["child"]).alias("child_unsuitable"),
    )


@query(
    f"""WITH {views.ARTICLES_SQL} SELECT id, CAST(2 * {_count("folded", SETS["anxiety"])} AS BIGINT) AS anxiety,
    CAST({_count("folded", SETS["calm"])} AS BIGINT) AS calm FROM (SELECT *, {_FOLDED} FROM v_articles)"""
)
def anxiety_calm_scores(spark, d):
    a = _articles(spark, d, False).select("id", rules.joined("title", "summary", "content").alias("folded"))
    return a.select("id", rules.anxiety(F.col("folded"), SETS["anxiety"], True).alias("anxiety"), rules.calm(F.col("folded"), SETS["calm"], True).alias("calm"))


@query(
    f"""WITH {views.ARTICLES_SQL} SELECT id, {", ".join(f"CAST({_relevance(t)} AS BIGINT) AS {t}" for t in ("valais", "suisse", "international"))} FROM v_articles"""
)
def topic_relevance(spark, d):
    folded = rules.joined("source_name", "region", "title", "summary", "content")
    score = lambda t: rules.relevance(t, "source_name", "region", "title", "summary", "content", TOPICS, F.col("folded")).alias(t)
    return _articles(spark, d, False).withColumn("folded", folded).select("id", *[score(t) for t in ("valais", "suisse", "international")])


@query(
    f"""WITH {views.ARTICLES_SQL} SELECT id, CAST({_relevance("suisse")} AS BIGINT) AS score FROM v_articles
    ORDER BY {_relevance("suisse")} DESC, priority DESC, {_SEEN} DESC, id LIMIT 40"""
)
def rank_topic(spark, d):
    scored, order = select.rank_order(_articles(spark, d), "suisse", TOPICS)
    return select.top(scored, 40, *order, *select.archive_order()).select("id", F.col("_s").alias("score"))


@query(
    f"""WITH {views.ARTICLES_SQL}, s AS (SELECT id, 2 * {_count("folded", SETS["anxiety"])} <= 1 AS low, {_count("folded", SETS["calm"])} AS calm
      FROM (SELECT *, {_FOLDED} FROM v_articles)),
    n AS (SELECT *, count(*) FILTER (low) OVER () AS n FROM s)
    SELECT id, low, CAST(calm AS BIGINT) AS calm FROM n WHERE low OR n < 6"""
)
def rank_calm(spark, d):
    """What the calm ranking keeps, with what it orders by."""
    scored, _ = select.rank_order(_articles(spark, d), "non_anxiogene", TOPICS, SETS["anxiety"], SETS["calm"])
    return scored.select("id", F.col("_a").alias("low"), F.col("_c").alias("calm"))


@query(
    f"""WITH {views.ARTICLES_SQL} SELECT id, CAST(2 * {_count("folded", SETS["anxiety"])} AS BIGINT) AS score FROM (SELECT *, {_FOLDED} FROM v_articles)
    ORDER BY 2 * {_count("folded", SETS["anxiety"])} DESC, {_SEEN} DESC, id LIMIT 40"""
)
def rank_alarming(spark, d):
    scored, order = select.rank_order(_articles(spark, d), "anxiogene", TOPICS, SETS["anxiety"], SETS["calm"])
    return select.top(scored, 40, *order, *select.archive_order()).select("id", F.col("_s").alias("score"))


# ---- selection -------------------------------------------------------------------------------


def _fit(source: str, topic: str, minimum: int) -> str:
    return f"""SELECT * FROM (SELECT *, count(*) FILTER (rel > 0) OVER () AS n_rel FROM (
      SELECT a.*, {_relevance(topic)} AS rel FROM (SELECT *, {_FOLDED} FROM {source}) a JOIN v_detected USING (id)
      WHERE NOT {_tiered("folded_source")} AND NOT {_LOW} AND region <> 'english'
        AND (language = 'fr' OR (language NOT IN ('en', 'de') AND detected IN ('fr', 'unknown'))))) WHERE rel > 0 OR n_rel < {minimum}"""


@query(
    f"""WITH {views.ARTICLES_SQL}, {_detect()},
    c0 AS (SELECT * FROM v_articles WHERE status = 'new' AND NOT is_sports AND region <> 'english' ORDER BY priority DESC, {_SEEN} DESC, id LIMIT 120),
    r0 AS (SELECT * FROM v_articles WHERE NOT is_sports AND region <> 'english' ORDER BY {_SEEN} DESC, used_count, id LIMIT 120),
    c AS (SELECT *, 0 AS part, row_number() OVER (ORDER BY priority DESC, {_SEEN} DESC, id) AS o FROM ({_fit("c0", "valais", 3)})),
    r AS (SELECT *, 1 AS part, row_number() OVER (ORDER BY {_SEEN} DESC, used_count, id) AS o FROM ({_fit("r0", "valais", 3)})
          WHERE id NOT IN (SELECT id FROM c) AND (SELECT count(*) FROM c) < 7),
    u AS (SELECT *, row_number() OVER (ORDER BY part, o) AS ord FROM (SELECT * FROM c UNION ALL SELECT * FROM r)),
    k AS (SELECT *, row_number() OVER (ORDER BY rel DESC, priority DESC, ord) AS place, {_STORY} AS story FROM u),
    s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY story ORDER BY place) AS sr FROM k) WHERE sr = 1),
    t AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY place) > 1 AS again
          FROM (SELECT *, {_subject()} AS subject FROM s))
    SELECT row_number() OVER (ORDER BY again, place) AS ord, id, source_name, CAST(rel AS BIGINT) AS score FROM t ORDER BY again, place LIMIT 7"""
)
def select_articles(spark, d):
    """The flagship: the articles of one bulletin."""
    keyed = select.selection(_articles(spark, d), select.Style("valais"), 7, SETS, TOPICS, SUBJECTS)
    score = rules.relevance("valais", "source_name", "region", "title", "summary", "content", TOPICS)
    return keyed.select("ord", "id", "source_name", score.alias("score"))


@query(
    f"""WITH {views.ARTICLES_SQL}, m AS (SELECT id, {_relevance("suisse")} AS rel FROM v_articles),
    n AS (SELECT id, rel, count(*) FILTER (rel > 0) OVER () AS n FROM m)
    SELECT id, 'few' AS kind FROM n WHERE rel > 0 OR n < 4 UNION ALL SELECT id, 'many' FROM n WHERE rel > 0 OR n < 1000000000"""
)
def topic_filter_minimum(spark, d):
    every = _articles(spark, d)
    few, many = (select.for_topic(every, "suisse", n, TOPICS).select("id", F.lit(k).alias("kind")) for n, k in ((4, "few"), (10**9, "many")))
    return few.unionByName(many)


# ---- language --------------------------------------------------------------------------------

_CODES = ("fr", "fra", "FR-CH", " eng ", "en-US", "de-ch", "ger", "it", "", "unknown")


@query(
    """SELECT doc_id, CASE WHEN c IN ('fr', 'fra', 'fre', 'fr-fr', 'fr_ch', 'fr-ch') THEN 'fr' WHEN c IN ('en', 'eng', 'en-us', 'en-gb') THEN 'en'
    WHEN c IN ('de', 'deu', 'ger', 'de-ch', 'de-de') THEN 'de' ELSE 'unknown' END AS code FROM (SELECT doc_id, lower(trim("""
    + "["
    + ", ".join(f"'{c}'" for c in _CODES)
    + "][doc_id % 10 + 1])) AS c FROM documents)"
)
def language_alias(spark, d):
    given = F.element_at(F.array(*map(F.lit, _CODES)), (F.col("doc_id") % 10 + 1).cast("int"))
    return views.table(spark, d, "documents").select("doc_id", language.canonical(given).alias("code"))


@query(f"WITH {views.ARTICLES_SQL}, {_detect()} SELECT id, detected FROM v_detected")
def language_detect(spark, d):
    return _articles(spark, d).select("id", language.detect("title", "summary", "content", F.col("region")).alias("detected"))


# ---- search and facets -----------------------------------------------------------------------

_ITEM_COLUMNS = f"""id, title, source_name AS source, region, language, published_at, created_at AS scraped_at, priority, is_sports,
    substr(content, 1, 320) AS summary, least(10, 2 * {_count("folded", SETS["anxiety"])}) AS tension, least(10, {_count("folded", SETS["calm"])}) AS calm,
    NOT {_any("folded", SETS["child"])} AND NOT is_sports AS child_friendly"""
_ITEMS_SQL = f"{views.ARTICLES_SQL}, v_items AS (SELECT {_ITEM_COLUMNS} FROM (SELECT *, {_FOLDED} FROM v_articles))"


def _items(spark, d):
    """Items meet the labels when they are narrow: no text is shuffled."""
    a = _articles(spark, d, False).withColumn("folded", rules.joined("title", "summary", "content"))
    narrow = a.select(
        "id", "title", F.col("source_name").alias("source"), "region", "language", "published_at", F.col("created_at").alias("scraped_at"),
        "priority", F.substring("content", 1, 320).alias("summary"), F.lit("").alias("search_terms"),
        F.least(F.lit(10), rules.anxiety(F.col("folded"), SETS["anxiety"], True)).alias("tension"),
        F.least(F.lit(10), rules.calm(F.col("folded"), SETS["calm"], True)).alias("calm"),
        rules.any_match(F.col("folded"), SETS["child"]).alias("unsuitable"),
    )
    flagged = views.flagged(narrow, spark, d, "id")
    return flagged.withColumn("child_friendly", ~F.col("unsuitable") & ~F.col("is_sports")).drop("unsuitable")


_HAY = _fold("concat_ws(' ', title, summary, source, region, language, '')")


@query(
    f"""WITH {_ITEMS_SQL} SELECT id FROM v_items WHERE regexp_matches({_HAY}, '(^|[^a-z0-9])the([^a-z0-9]|$)')
    AND contains({_HAY}, 'ation') AND contains({_HAY}, 'of th')"""
)
def search_quoted(spark, d):
    return _items(spark, d).filter(search.matches('"The" "ATION" of th')).select("id")


@query(
    f"""WITH {_ITEMS_SQL} SELECT id FROM v_items WHERE language <> 'de' AND language <> 'en' AND region = 'suisse' AND NOT is_sports AND child_friendly
    AND tension <= 6 AND priority >= 40 AND coalesce(published_at, scraped_at) >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND id % 10 <> 3"""
)
def faceted_filter(spark, d):
    items = _items(spark, d)
    read = items.filter("id % 10 = 3").select("id")
    return search.faceted(items, now(), read, region="suisse", period="7d", child_only=True, most_tension=6, least_priority=40).select("id")


@query(
    f"""WITH {_ITEMS_SQL}, t AS (SELECT id, coalesce(published_at, scraped_at) AS seen FROM v_items)
    SELECT id, 'today' AS period FROM t WHERE CAST(seen AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Zurich' AS DATE)
      = CAST(TIMESTAMP '{NOW}' AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Zurich' AS DATE)
    UNION ALL SELECT id, '24h' FROM t WHERE seen >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR
    UNION ALL SELECT id, '7d' FROM t WHERE seen >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY"""
)
def date_range(spark, d):
    items = _items(spark, d).select("id", F.coalesce("published_at", "scraped_at").alias("at"))
    periods = [F.when(dates.in_period(F.col("at"), p, now()), F.lit(p)) for p in ("today", "24h", "7d")]
    return items.select("id", F.explode(F.array_compact(F.array(*periods))).alias("period"))


@query(
    f"""WITH {_ITEMS_SQL}, s AS (SELECT id, 'calm' AS o, row_number() OVER (ORDER BY tension, calm DESC, coalesce(published_at, scraped_at) DESC, id) AS place FROM v_items
    UNION ALL SELECT id, 'alert', row_number() OVER (ORDER BY tension DESC, coalesce(published_at, scraped_at) DESC, id) FROM v_items
    UNION ALL SELECT id, 'romand', row_number() OVER (ORDER BY priority DESC, coalesce(published_at, scraped_at) DESC, id) FROM v_items
    UNION ALL SELECT id, 'newest', row_number() OVER (ORDER BY coalesce(published_at, scraped_at) DESC, id) FROM v_items)
    SELECT * FROM s WHERE place <= 80"""
)
def client_sorts(spark, d):
    items = _items(spark, d)
    out = None
    for name in ("calm", "alert", "romand", "newest"):
        head = select.numbered(select.top(items, 80, *search.order(name)), *search.order(name), name="place").select("id", F.lit(name).alias("o"), "place")
        out = head if out is None else out.unionByName(head)
    return out


@query(
    f"""WITH {_ITEMS_SQL} SELECT array_to_string(list_sort(list(DISTINCT region)), ',') AS regions, array_to_string(list_sort(list(DISTINCT language)), ',') AS languages,
    array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM v_items"""
)
def export_facets(spark, d):
    found = search.facets(_articles(spark, d), regions="region", languages="language", sources="source_name")
    return found.select(*[F.array_join(c, ",").alias(c) for c in found.columns])


def _excerpt(c: str, most: int) -> str:
    clean = _squeeze(c)
    return f"CASE WHEN length({clean}) <= {most} THEN {clean} ELSE regexp_replace(substr({clean}, 1, {most}), ' [^ ]*$', '') || '...' END"


@query(
    f"""WITH {views.ARTICLES_SQL}, p AS (SELECT *, {_FOLDED} FROM v_articles WHERE NOT is_sports AND region <> 'english' AND language <> 'en' AND language <> 'de'
      ORDER BY {_SEEN} DESC, priority DESC, id LIMIT 300),
    k AS (SELECT *, row_number() OVER (PARTITION BY {_STORY} ORDER BY {_SEEN} DESC, priority DESC, id) AS r FROM p)
    SELECT id, source_name AS source, region, language, {_excerpt("summary", 320)} AS summary, CAST(least(10, 2 * {_count("folded", SETS["anxiety"])}) AS BIGINT) AS tension,
    CAST(least(10, {_count("folded", SETS["calm"])}) AS BIGINT) AS calm, NOT {_any("folded", SETS["child"])} AND NOT is_sports AS child_friendly, '' AS search_terms
    FROM k WHERE r = 1 ORDER BY {_SEEN} DESC, priority DESC, id LIMIT 100"""
)
def export_site_rows(spark, d):
    rows = publish.export_rows(_articles(spark, d), 100, sets=SETS)
    return rows.select("id", "source", "region", "language", "summary", "tension", "calm", "child_friendly", "search_terms")


@query(
    f"""WITH {views.ARTICLES_SQL} SELECT id, CASE WHEN language = 'de' THEN '{X.V.GERMAN_TERMS}' WHEN region <> 'english' THEN ''
    WHEN source_name LIKE 'UN News%' THEN '{X.V.UN_TERMS}' ELSE 'english' END AS search_terms FROM v_articles"""
)
def export_search_terms(spark, d):
    return _articles(spark, d).select("id", publish.search_terms().alias("search_terms"))


# ---- bulletins and publishing ----------------------------------------------------------------


@query(
    f"""WITH {views.BULLETINS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY style_key ORDER BY slot_start DESC, id) AS r FROM v_bulletins
    WHERE status = 'ready' AND coalesce(audio_path, '') <> '')
    SELECT style_key AS topic, id, {_stamp("slot_start")} AS slot_start FROM r WHERE r = 1 ORDER BY slot_start DESC, id LIMIT 3"""
)
def latest_per_topic(spark, d):
    return publish.latest_by_topic(views.bulletins(spark, d), 3).select("topic", "id", stamp("slot_start").alias("slot_start"))


@query(f"WITH {views.BULLETINS_SQL} SELECT style_key, count(*) AS n FROM v_bulletins WHERE slot_start >= TIMESTAMP '{NOW}' - INTERVAL 48 HOUR GROUP BY 1")
def retention_window(spark, d):
    return publish.retained(views.bulletins(spark, d), now(), 48).groupBy("style_key").agg(F.count("*").alias("n"))


@query(
    f"""WITH {views.BULLETINS_SQL}, h AS (SELECT * FROM v_bulletins WHERE status = 'ready' ORDER BY slot_start DESC, id LIMIT 20000)
    SELECT id, style_key, {_stamp("slot_start")} AS slot_start FROM h WHERE slot_start <= TIMESTAMP '{NOW}' ORDER BY h.slot_start DESC, id LIMIT 1"""
)
def current_item(spark, d):
    found = publish.current(views.bulletins(spark, d), now(), horizon=20_000)
    return found.select("id", "style_key", stamp("slot_start").alias("slot_start"))


@query(
    f"""WITH {views.BULLETINS_SQL} SELECT id, {_stamp("slot_start")} AS slot_start FROM v_bulletins WHERE status = 'ready' ORDER BY v_bulletins.slot_start DESC, id LIMIT 240"""
)
def bulletin_history(spark, d):
    kept = select.top(views.bulletins(spark, d).filter("status = 'ready'"), 240, F.desc("slot_start"), F.asc("id"))
    return kept.select("id", stamp("slot_start").alias("slot_start"))


@query(
    f"""WITH {views.BULLETINS_SQL}, h AS (SELECT * FROM v_bulletins WHERE status = 'ready' AND audio_path IS NOT NULL ORDER BY slot_start DESC, id LIMIT 12)
    SELECT string_agg('file ''' || audio_path || '''', chr(10) ORDER BY slot_start, id) AS value FROM h"""
)
def playlist(spark, d):
    history = views.bulletins(spark, d).filter("status = 'ready' AND audio_path IS NOT NULL")
    return sinks.playlist(select.top(history, 12, F.desc("slot_start"), F.asc("id")))


@query(
    """WITH desired AS (SELECT event_id AS id FROM events WHERE value >= 5), uploaded AS (SELECT event_id AS id FROM events WHERE event_id % 5 = 0),
    remote AS (SELECT event_id AS id FROM events WHERE event_id % 3 = 0)
    SELECT id, 'upload' AS action FROM desired WHERE id NOT IN (SELECT id FROM uploaded INTERSECT SELECT id FROM remote)
    UNION ALL SELECT id, 'delete' FROM remote WHERE id NOT IN (SELECT id FROM desired)
    UNION ALL SELECT id, 'state' FROM uploaded WHERE id IN (SELECT id FROM desired)"""
)
def publish_diff(spark, d):
    e = views.table(spark, d, "events").select(F.col("event_id").alias("id"), "value")
    desired, uploaded, remote = e.filter("value >= 5"), e.filter("id % 5 = 0"), e.filter("id % 3 = 0")
    there = store.still_kept(uploaded, remote, "id")
    parts = (
        store.missing(desired, there, "id").select("id", F.lit("upload").alias("action")),
        store.stale(remote, desired, "id").select("id", F.lit("delete").alias("action")),
        store.still_kept(uploaded, desired, "id").select("id", F.lit("state").alias("action")),
    )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    """SELECT o_orderkey AS bulletin_id, count(*) AS n, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_size DESC, l_shipdate DESC, l_linenumber, p_partkey) AS parts
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1"""
)
def bulletin_lineage(spark, d):
    """A bridge table between two others, one list for each key."""
    o = views.table(spark, d, "orders").select("o_orderkey")
    bridge = views.table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    joined = bridge.join(views.table(spark, d, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    one = F.struct((-F.col("p_size")).alias("a"), (-F.unix_micros(F.col("l_shipdate").cast("timestamp"))).alias("b"), "l_linenumber", "p_partkey")
    listed = joined.groupBy(F.col("o_orderkey").alias("bulletin_id")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(one)).alias("s"))
    return listed.select("bulletin_id", "n", F.array_join(F.transform("s", lambda x: x["p_partkey"].cast("string")), ",").alias("parts"))


# ---- schedule --------------------------------------------------------------------------------


@query("SELECT strftime(time_bucket(INTERVAL 30 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS slot, count(*) AS n FROM events GROUP BY 1")
def slot_floor(spark, d):
    return views.table(spark, d, "events").groupBy(stamp(dates.floor_slot(F.col("ts"), 30)).alias("slot")).agg(F.count("*").alias("n"))


@query(
    """SELECT event_id, ['a', 'b', 'c', 'd', 'e', 'f', 'g'][((hour(l) * 60 + minute(l)) // 60) % 7 + 1] AS style
    FROM (SELECT event_id, ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Zurich' AS l FROM events)"""
)
def slot_rotation(spark, d):
    styles = schedule.rotation(spark, [{"key": k} for k in "abcdefg"]).select("place", F.col("key").alias("style"))
    local = views.table(spark, d, "events").select("event_id", dates.local_time("ts").alias("local"))
    return schedule.with_style(local, styles, "local", 60, 7).select("event_id", "style")


@query(
    """WITH s AS (SELECT DISTINCT date_trunc('hour', ts) AS slot FROM events WHERE event_type = (SELECT min(event_type) FROM events) AND value >= 60)
    SELECT strftime(g, '%Y-%m-%d %H:%M:%S') AS slot FROM (SELECT unnest(generate_series((SELECT date_trunc('hour', min(ts)) FROM events),
    (SELECT date_trunc('hour', max(ts)) FROM events), INTERVAL 1 HOUR)) AS g) WHERE g NOT IN (SELECT slot FROM s)"""
)
def slot_gap_fill(spark, d):
    e = views.table(spark, d, "events")
    kind = e.agg(F.min("event_type").alias("k"))
    taken = e.filter("value >= 60").join(F.broadcast(kind), F.col("event_type") == F.col("k"))  # one row
    taken = taken.select(dates.floor_slot(F.col("ts"), 60).alias("slot"))
    return schedule.open_slots(schedule.all_slots(e, "ts", 60), taken).select(stamp("slot").alias("slot"))


# ---- bulletin text ---------------------------------------------------------------------------

_BANNED = ("thanks for", "i cannot", "password")
_LONG_WORDS = "len(list_filter(string_split(trim(regexp_replace({0}, '\\s+', ' ', 'g')), ' '), lambda w: w <> ''))"


def _opening(source: str, key: str, body: str) -> str:
    """SQL table ``opening`` (key, opening): the first opening that four paragraphs of ``body`` share."""
    return f"""op0 AS (SELECT {key}, generate_subscripts(string_split({body}, chr(10) || chr(10)), 1) AS i, unnest(string_split({body}, chr(10) || chr(10))) AS p FROM {source}),
    op1 AS (SELECT {key}, i, list_filter(string_split(trim(regexp_replace(p, '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM op0),
    op2 AS (SELECT {key}, i, list_filter(list_transform(list_slice(w, 1, 3), lambda x: lower(trim(x, ' ,;:.!?'))), lambda x: x <> '') AS o FROM op1 WHERE len(w) >= 8),
    op3 AS (SELECT {key}, array_to_string(o, ' ') AS o, min(i) AS i FROM op2 WHERE len(o) >= 2 GROUP BY 1, 2 HAVING count(*) >= 4),
    opening AS (SELECT {key}, arg_min(o, i) AS opening FROM op3 GROUP BY 1)"""


@query(
    f"""WITH {views.TRANSCRIPTS_SQL}, {_opening("v_transcripts", "conv_id", "transcript")},
    w AS (SELECT conv_id, lower(transcript) AS low, {_LONG_WORDS.format("transcript")} AS n FROM v_transcripts)
    SELECT conv_id, CAST(n AS BIGINT) AS n_words, CASE {" ".join(f"WHEN contains(low, '{p}') THEN 'generic filler: {p}'" for p in _BANNED)}
    WHEN n < 40 THEN 'short transcript (' || n || ' words)' WHEN opening IS NOT NULL THEN 'repetitive paragraph openings: ' || opening END AS issue
    FROM w LEFT JOIN opening USING (conv_id)"""
)
def draft_quality_gate(spark, d):
    t = views.transcripts(spark, d)
    none = F.array().cast("array<string>")
    issue = bulletin.quality_issue(F.col("transcript"), none, 40, _BANNED)
    return t.select("conv_id", X.word_count("transcript").alias("n_words"), issue.alias("issue"))


@query(
    f"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p FROM documents),
    w AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(p, '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM p),
    o AS (SELECT doc_id, array_to_string(list_filter(list_transform(list_slice(w, 1, 3), lambda x: lower(trim(x, ' ,;:.!?'))), lambda x: x <> ''), ' ') AS o,
          len(list_filter(list_transform(list_slice(w, 1, 3), lambda x: trim(x, ' ,;:.!?')), lambda x: x <> '')) AS k FROM w WHERE len(w) >= 8),
    c AS (SELECT doc_id, o, count(*) AS n FROM o WHERE k >= 2 GROUP BY 1, 2)
    SELECT doc_id, count(*) AS openings, max(n) AS most FROM c GROUP BY 1"""
)
def repeated_openings(spark, d):
    docs = views.table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("p"))
    docs = docs.filter(X.word_count("p") >= 8)
    strip = lambda w: F.lower(F.regexp_replace(w, "^[ ,;:.!?]+|[ ,;:.!?]+$", ""))
    first = F.filter(F.transform(F.slice(X.words("p"), 1, 3), strip), lambda w: w != "")
    counted = docs.select("doc_id", first.alias("o")).filter(F.size("o") >= 2).groupBy("doc_id", F.array_join("o", " ").alias("o")).agg(F.count("*").alias("n"))
    return counted.groupBy("doc_id").agg(F.count("*").alias("openings"), F.max("n").alias("most"))


@query(
    f"""WITH lined AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS t FROM documents), {_opening("lined", "doc_id", "t")}
    SELECT doc_id, opening FROM documents LEFT JOIN opening USING (doc_id)"""
)
def repeated_paragraph_opening(spark, d):
    """The gate's own rule on each document's lines as paragraphs."""
    docs = views.table(spark, d, "documents")
    return docs.select("doc_id", bulletin.repeated_opening(F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("opening"))


@query()
def sentence_budget(spark, d):
    """Whole sentences up to 60 words (tests hold it against plain code)."""
    a = _articles(spark, d, False)
    return a.select("id", X.bounded_excerpt("title", "content", "source_name", 60).alias("excerpt"))


def _unescape(c: str) -> str:
    """The references that the pages hold; the ampersand's own comes last."""
    for name, char in (("nbsp", "\u00a0"), ("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        c = f"replace({c}, '&{name};', '{char}')"
    return c


_BARE_PAGE = "html"
for _tag in ("script", "style", "noscript", "svg"):
    _BARE_PAGE = f"regexp_replace({_BARE_PAGE}, '(?is)<{_tag}\\b.*?</{_tag}\\s*>', ' ', 'g')"
_TAGLESS = "regexp_replace(regexp_replace({0}, '(?s)<!--.*?-->', ' ', 'g'), '(?s)</?[A-Za-z!?][^>]*>', ' ', 'g')"


@query(
    f"""WITH b AS (SELECT page_id, {_BARE_PAGE} AS b FROM pages),
    a AS (SELECT page_id, b, regexp_extract_all(b, '(?is)<article\\b.*?</article\\s*>') AS a FROM b)
    SELECT page_id, trim(regexp_replace(replace({_unescape(_TAGLESS.format("CASE WHEN len(a) > 0 THEN array_to_string(a, ' ') ELSE b END"))}, chr(160), ' '), '\\s+', ' ', 'g')) AS text FROM a"""
)
def html_main_text(spark, d):
    p = views.table(spark, d, "pages")
    return p.select("page_id", H.main_text("html").alias("text"))


@query(
    f"""WITH {views.ARTICLES_SQL}, h AS (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY {_SEEN} DESC, id) AS o FROM v_articles)
    SELECT source_name AS grp, array_to_string(list_prepend('Edition', list_append(list(['First', 'Next', 'In parallel', 'Also worth noting',
      'Another important point', 'Elsewhere', 'Further in this briefing', 'Another item to watch', 'One final point', 'To close'][least(o, 10)] || ', ' || id || '.' ORDER BY o), 'End')), chr(10) || chr(10)) AS transcript
    FROM h WHERE o <= 12 GROUP BY 1"""
)
def template_bulletin(spark, d):
    """The frame, the transitions and the order of a bulletin, on ids instead of prose."""
    w = Window.partitionBy("source_name").orderBy(select.when_seen().desc(), "id")
    head = _articles(spark, d).select("id", "source_name", F.row_number().over(w).alias("o")).filter("o <= 12")
    part = F.concat(bulletin.transition(F.col("o"), "en"), F.lit(", "), F.col("id").cast("string"), F.lit("."))
    listed = head.groupBy(F.col("source_name").alias("grp")).agg(F.array_sort(F.collect_list(F.struct("o", part.alias("p")))).alias("s"))
    pieces = F.concat(F.array(F.lit("Edition")), F.transform("s", lambda x: x["p"]), F.array(F.lit("End")))
    return listed.select("grp", F.array_join(pieces, "\n\n").alias("transcript"))


@query()
def bulletin_prose(spark, d):
    """Whole bulletins, one for each source, from its newest articles (tests hold the parts against plain code)."""
    w = Window.partitionBy("source_name").orderBy(select.when_seen().desc(), "id")
    head = _articles(spark, d).withColumn("ord", F.row_number().over(w)).filter("ord <= 12").withColumn("grp", F.col("source_name"))
    return bulletin.template_bulletin(head, "grp", "", "fr", "Radio Locale")


@query(f"WITH {views.ARTICLES_SQL} SELECT source_name, CAST(sum({_LONG_WORDS.format('content')}) AS BIGINT) AS n_words, max(length({_excerpt('content', 900)})) AS longest FROM v_articles GROUP BY 1")
def word_counts(spark, d):
    a = _articles(spark, d).select("source_name", X.word_count("content").alias("n"), F.length(X.excerpt("content", 900)).alias("l"))
    return a.groupBy("source_name").agg(F.sum("n").alias("n_words"), F.max("l").alias("longest"))


def _normalized(c: str) -> str:
    for sign in sorted(X.V.SPOKEN_SIGNS, key=len, reverse=True):
        c = f"replace({c}, '{sign.replace(chr(39), chr(39) * 2)}', '{X.V.SPOKEN_SIGNS[sign].replace(chr(39), chr(39) * 2)}')"
    for pattern, said in X.V.SPOKEN_WORDS:
        c = f"regexp_replace({c}, '{pattern}', '{said}', 'g')"
    c = f"regexp_replace(regexp_replace({c}, '([A-Za-zÀ-ÿ])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-zÀ-ÿ])', '\\1 \\2', 'g')"
    table = "string_split('" + "|".join(speech.french_numbers()) + "', '|')"
    digits, most = "ltrim(replace(x, 'ᵉ', ''), '0')", speech.MOST_DIGITS
    group = lambda k: f"CAST(substr(lpad({digits}, {most}, '0'), {most - 3 * k - 2}, 3) AS INT)"
    low, high = f"{table}[{group(0)} + 1]", group(1)
    bare = f"CASE WHEN {high} % 100 IN (0, 80) THEN regexp_replace({table}[{high} + 1], 's$', '') ELSE {table}[{high} + 1] END"
    many = lambda n, name: f"CASE WHEN {n} > 0 THEN {table}[{n} + 1] || ' {name}' || CASE WHEN {n} > 1 THEN 's' ELSE '' END END"
    scales = ", ".join(many(group(k + 2), speech.SCALES[k]) for k in reversed(range(len(speech.SCALES))))
    said = f"""CASE WHEN length({digits}) > {most} THEN array_to_string(list_transform(string_split({digits}, ''), lambda y: {table}[CAST(y AS INT) + 1]), ' ')
      ELSE concat_ws(' ', {scales}, CASE WHEN {high} = 1 THEN 'mille' WHEN {high} > 1 THEN {bare} || ' mille' END,
        CASE WHEN {group(0)} > 0 OR {digits} = '' THEN {low} END) END"""
    words = f"regexp_extract_all({c}, '(?s)[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+')"
    c = f"array_to_string(list_transform({words}, lambda x: CASE WHEN regexp_full_match(x, '[0-9]+ᵉ?') THEN {said} ELSE x END), '')"
    c = f"regexp_replace({c}, '\\s+([,.;:!?])', '\\1', 'g')"
    return f"trim(regexp_replace(regexp_replace({c}, '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'))"


def _plainer(c: str) -> str:
    c = f"strip_accents(replace(replace({c}, 'œ', 'oe'), 'Œ', 'Oe'))"
    for pattern, said in X.V.PLAIN_SPEECH:
        c = f"regexp_replace({c}, '(?i){pattern}', '{said}', 'g')"
    return c


def _line_table(source: str, most: int) -> str:
    """SQL tables over ``source`` (doc_id, t) up to ``lines`` (doc_id, lines)."""
    last = "length(regexp_extract(a, '[^\\x02]*$'))"
    fill = lambda pieces, long: f"""list_reduce({pieces}, lambda a, x: CASE {long} WHEN {last} = 0 OR {last} + 1 + length(x) <= {most}
      THEN a || CASE WHEN {last} = 0 THEN '' ELSE ' ' END || x ELSE a || chr(2) || x END, '')"""  # noqa: E731
    split = lambda c, signs: f"regexp_split_to_array(regexp_replace({c}, '([{signs}])\\s+', '\\1' || chr(1), 'g'), chr(1))"
    return f"""sp AS (SELECT doc_id, i, unnest({split("p", ".!?")}) AS s, generate_subscripts({split("p", ".!?")}, 1) AS j
      FROM (SELECT doc_id, unnest(regexp_split_to_array(t, '\\n{{2,}}')) AS p, generate_subscripts(regexp_split_to_array(t, '\\n{{2,}}'), 1) AS i FROM {source})),
    sc AS (SELECT doc_id, i, j, trim(s) AS s, unnest({split("trim(s)", ",;:")}) AS c, generate_subscripts({split("trim(s)", ",;:")}, 1) AS k FROM sp WHERE trim(s) <> ''),
    sw AS (SELECT *, CASE WHEN length(c) <= {most} THEN c ELSE chr(2) || {fill("list_filter(regexp_split_to_array(c, chr(92) || 's+'), lambda w: w <> '')", "")} || chr(2) END AS w FROM sc),
    sl AS (SELECT doc_id, i, j, any_value(s) AS s, list(w ORDER BY k) AS w FROM sw GROUP BY 1, 2, 3),
    lines AS (SELECT doc_id, string_agg(l, chr(10) ORDER BY i, j) AS lines FROM (SELECT doc_id, i, j, CASE WHEN length(s) <= {most} THEN s
      ELSE array_to_string(list_filter(list_transform(string_split({fill("w", "WHEN starts_with(x, chr(2)) THEN a || x")}, chr(2)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) END AS l FROM sl) GROUP BY 1)"""


@query(
    f"""WITH t AS (SELECT doc_id, {_plainer(_normalized("text"))} AS t FROM documents), {_line_table("t", speech.SHORT_LINE)}
    SELECT doc_id, coalesce(lines, '') AS lines FROM documents LEFT JOIN lines USING (doc_id)"""
)
def speech_text(spark, d):
    docs = views.table(spark, d, "documents")
    return docs.select("doc_id", speech.ascii_lines("text").alias("lines"))


@query(
    f"""WITH t AS (SELECT event_id AS doc_id, {_normalized("event_id * 7919 || ' ' || event_type || event_id || ', le ' || event_id % 101 || 'ᵉ jour + 3% ; ' || event_id * 1000003 % 987654321012 || '|fin'")} AS t FROM events)
    SELECT doc_id AS event_id, t AS said FROM t"""
)
def spoken_numbers(spark, d):
    e = views.table(spark, d, "events")
    n = F.col("event_id")
    parts = ((n * 7919).cast("string"), F.lit(" "), F.col("event_type"), n.cast("string"), F.lit(", le "), (n % 101).cast("string"), F.lit("ᵉ jour + 3% ; "))
    return e.select("event_id", speech.normalize(F.concat(*parts, (n * 1000003 % 987654321012).cast("string"), F.lit("|fin"))).alias("said"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import records, state  # noqa: F401  register their queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLE)
