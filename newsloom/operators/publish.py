"""What is published: exported articles with facets, the latest bulletin of each topic, and the manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import rules
from ..functions.text import excerpt, story_key, text
from .search import facets
from .select import export_order, first_by, numbered, top


def exportable(articles: DataFrame, sports: bool = False, english: bool = False, german: bool = False) -> DataFrame:
    held = F.lit(True)
    if not sports:
        held = held & ~F.col("is_sports")
    if not english:
        held = held & (F.col("region") != "english") & (F.col("language") != "en")
    if not german:
        held = held & (F.col("language") != "de")
    return articles.filter(held)


def search_terms(source="source_name") -> Column:
    un = F.startswith(text(source), F.lit("UN News"))
    return (
        F.when(F.col("language") == "de", V.GERMAN_TERMS)
        .when(F.col("region") != "english", "")
        .when(un, V.UN_TERMS)
        .otherwise("english")
    )


def export_rows(articles: DataFrame, limit: int = 400, variants: dict | None = None, sets: dict | None = None) -> DataFrame:
    """At most ``limit`` items, newest first, of the first 3 x limit rows, one for each story, with their scores."""
    sets = sets or {}
    pool = numbered(top(exportable(articles, **(variants or {})), 3 * limit, *export_order()), *export_order())
    kept = first_by(pool, story_key("title", "summary", "content")).orderBy("ord").limit(limit)
    folded = rules.joined("title", "summary", "content")
    unsuitable = rules.any_match(folded, sets.get("child", V.CHILD_UNSUITABLE))
    return kept.select(
        "id",
        "title",
        *[c for c in ("url",) if c in articles.columns],
        F.col("source_name").alias("source"),
        F.coalesce(F.nullif(text("region"), F.lit("")), F.lit("general")).alias("region"),
        F.coalesce(F.nullif(text("language"), F.lit("")), F.lit("unknown")).alias("language"),
        "published_at",
        F.col("created_at").alias("scraped_at"),
        excerpt(F.when(text("summary") != "", F.col("summary")).otherwise(F.col("content"))).alias("summary"),
        "priority",
        "is_sports",
        F.least(F.lit(10), rules.anxiety(folded, sets.get("anxiety", V.ANXIETY))).alias("tension"),
        F.least(F.lit(10), rules.calm(folded, sets.get("calm", V.CALM))).alias("calm"),
        (~unsuitable & ~F.col("is_sports")).alias("child_friendly"),
        search_terms().alias("search_terms"),
        "ord",
    )


def export_document(rows: DataFrame, generated_at: str) -> DataFrame:
    """The export as one JSON document: count, facets and articles in order."""
    names = [c for c in rows.columns if c != "ord"]
    listed = F.array_sort(F.collect_list(F.struct("ord", F.struct(*names).alias("a"))))
    body = rows.agg(F.count("*").alias("count"), F.transform(listed, lambda x: x["a"]).alias("articles"))
    faces = facets(rows, regions="region", languages="language", sources="source")
    whole = F.struct(F.lit(generated_at).alias("generated_at"), "count", "regions", "languages", "sources", "articles")
    return body.join(F.broadcast(faces)).select(F.to_json(whole).alias("value"))  # both of one row


def topic_of(style="style_key", label="style_label") -> Column:
    return F.coalesce(F.nullif(text(style), F.lit("")), F.col(label))


def latest_by_topic(bulletins: DataFrame, limit: int = 6, allowed: list[str] | None = None, horizon: int | None = None) -> DataFrame:
    """The newest bulletin with sound of each topic, the newest topics first."""
    history = bulletins.filter("status = 'ready'")
    if horizon is not None:
        history = top(history, horizon, F.desc("slot_start"), F.asc("id"))
    kept = history.filter(F.coalesce("audio_path", F.lit("")) != "").withColumn("topic", topic_of())
    if allowed is not None:
        kept = kept.filter(F.col("topic").isin(allowed))
    w = Window.partitionBy("topic").orderBy(F.desc("slot_start"), F.asc("id"))
    newest = kept.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    return newest.orderBy(F.desc("slot_start"), "id").limit(limit)


def current(bulletins: DataFrame, now: Column, horizon: int = 200) -> DataFrame:
    """The newest ready bulletin whose slot has begun, of the last ``horizon`` ones; no row if there is none."""
    ready = top(bulletins.filter("status = 'ready'"), horizon, F.desc("slot_start"), F.asc("id"))
    return top(ready.filter(F.col("slot_start") <= now), 1, F.desc("slot_start"), F.asc("id"))


def retained(bulletins: DataFrame, now: Column, hours: int) -> DataFrame:
    return bulletins.filter(F.col("slot_start") >= now - F.make_dt_interval(hours=F.lit(hours)))


def style_of(bulletin_id="id", label="style_label", keys=("non_anxiogene", "anxiogene", "enfant", "contexte", "pote")) -> Column:
    """The style that an id names, else what its label says (first fit)."""
    out = F.lower(F.regexp_replace(text(label), r"(?U)\W+", "_"))
    for key in reversed(keys):
        out = F.when(F.contains(text(bulletin_id), F.lit(key)), F.lit(key)).otherwise(out)
    return out


def latest_by_style(bulletins: DataFrame, horizon: int = 200) -> DataFrame:
    history = top(bulletins.filter("status = 'ready'"), horizon, F.desc("slot_start"), F.asc("id"))
    kept = history.filter(F.coalesce("audio_path", F.lit("")) != "").withColumn("style", style_of())
    w = Window.partitionBy("style").orderBy(F.desc("slot_start"), F.asc("id"))
    return kept.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def manifest_item(base_url: str, folder: str = "bulletins") -> Column:
    return F.struct(
        "id",
        "slot_start",
        F.col("topic"),
        F.concat(F.lit(base_url.rstrip("/") + f"/{folder}/"), F.col("id"), F.lit(".mp3")).alias("audio_url"),
        "duration_seconds",
    )


def manifest(current_row: DataFrame, by_topic: DataFrame, base_url: str) -> DataFrame:
    """The manifest as one JSON document: the current bulletin and the topics' latest, under both names they go by."""
    listed = F.array_sort(
        F.collect_list(F.struct((-F.unix_micros("slot_start")).alias("o"), F.col("id"), manifest_item(base_url).alias("b")))
    )
    items = by_topic.agg(F.transform(listed, lambda x: x["b"]).alias("items"))
    live = F.struct("id", "slot_start", F.lit(base_url.rstrip("/") + "/current/live.mp3").alias("audio_url"))
    now = current_row.agg(F.first(live).alias("current"))
    whole = F.struct("current", F.col("items").alias("bulletins_by_topic"), F.col("items").alias("bulletins_by_style"))
    return now.join(F.broadcast(items)).select(F.to_json(whole).alias("value"))  # both of one row


def read_manifest(raw: Column) -> Column:
    """Items of a manifest: by topic, else by style; without those that have no address."""
    item = "id string, topic string, audio_url string, url string"
    parsed = F.from_json(raw, f"bulletins_by_topic array<struct<{_colons(item)}>>, bulletins_by_style array<struct<{_colons(item)}>>")
    items = F.coalesce(parsed["bulletins_by_topic"], parsed["bulletins_by_style"])
    named = F.transform(items, lambda i: F.struct(i["id"].alias("id"), i["topic"].alias("topic"), F.coalesce(i["audio_url"], i["url"]).alias("audio_url")))
    return F.filter(named, lambda i: F.coalesce(i["audio_url"], F.lit("")) != "")


def _colons(fields: str) -> str:
    return ", ".join(f.strip().replace(" ", ": ", 1) for f in fields.split(","))


def lineage(bridge: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Each bulletin's articles with their sources, by priority and date."""
    named = sources.select(F.col("id").alias("source_id"), "source_name", "priority")
    joined = bridge.join(articles.withColumnRenamed("id", "article_id"), "article_id").join(named, "source_id")
    one = F.struct((-F.col("priority")).alias("p"), (-F.unix_micros("published_at")).alias("d"), "article_id", "title", "source_name")
    return joined.groupBy("bulletin_id").agg(F.array_sort(F.collect_list(one)).alias("articles"))
