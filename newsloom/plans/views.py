"""The driver tables in the shape the operators take: as DataFrames, and as SQL over the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REGIONS = ("valais", "suisse-romande", "suisse", "international", "english")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "documents").select(F.col("source").alias("source_name")).distinct()
    return _with_idx(named).withColumn("enabled", F.col("idx") % 10 != 9)


def _with_idx(df: DataFrame) -> DataFrame:
    idx = F.substring("source_name", 4, 9).cast("long")
    region = F.element_at(F.array(*map(F.lit, REGIONS)), (idx % 5 + 1).cast("int"))
    return df.withColumns({"idx": idx, "priority": 33 + 6 * idx, "region": region})


def articles(spark: SparkSession, sf_dir: str, flags: bool = True) -> DataFrame:
    """Priority and region follow from the source's name, so no join with the sources is needed for them.

    Without ``flags`` there is no is_sports, and the texts need not be shuffled to meet the labels.
    """
    docs = table(spark, sf_dir, "documents")
    if flags:
        labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("toxic"))
        docs = docs.join(labels, "doc_id", "left")
    minutes = lambda more: F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=(37 * F.col("doc_id") + more).cast("int"))
    rows = docs.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("source_name"),
        F.substring(F.split("text", "\n", 2)[0], 1, 120).alias("title"),
        F.substring("text", 1, 500).alias("summary"),
        F.col("text").alias("content"),
        F.when(F.col("lang").isin("fr", "en", "de"), F.col("lang")).otherwise("unknown").alias("language"),
        F.when(F.col("doc_id") % 11 != 0, minutes(0)).alias("published_at"),
        minutes(5).alias("created_at"),
        F.when(F.col("doc_id") % 4 == 0, "used").otherwise("new").alias("status"),
        *([F.coalesce("toxic", F.lit(False)).alias("is_sports")] if flags else []),
        (F.col("doc_id") % 3).alias("used_count"),
    )
    return _with_idx(rows)


def flagged(df: DataFrame, spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """Adds is_sports by the labels of the rows' documents."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias(key), (F.col("toxic") == 1).alias("_toxic"))
    return df.join(labels, key, "left").withColumn("is_sports", F.coalesce("_toxic", F.lit(False))).drop("_toxic")


def bulletins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("slot_start"),
        F.col("event_type").alias("style_key"),
        F.col("event_type").alias("style_label"),
        F.when(F.col("value") >= 5, "ready").otherwise("draft").alias("status"),
        F.when(F.col("event_id") % 7 != 0, F.concat(F.col("event_id").cast("string"), F.lit(".mp3"))).alias("audio_path"),
        F.col("value").alias("duration_seconds"),
    )


def upsert_log(events: DataFrame) -> DataFrame:
    return events.select(
        "user_id", "event_id", "event_type", "value", F.when(F.col("event_id") % 3 != 0, F.col("ts")).alias("published_at")
    )


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return turns.select("conv_id", F.array_join(F.transform("t", lambda x: F.coalesce(x["text"], F.lit(""))), "\n\n").alias("transcript"))


SOURCES_SQL = """v_sources AS (
  SELECT s AS source_name, CAST(substr(s, 4) AS BIGINT) AS idx, 33 + 6 * CAST(substr(s, 4) AS BIGINT) AS priority,
         ['valais', 'suisse-romande', 'suisse', 'international', 'english'][CAST(substr(s, 4) AS BIGINT) % 5 + 1] AS region,
         CAST(substr(s, 4) AS BIGINT) % 10 <> 9 AS enabled
  FROM (SELECT DISTINCT source AS s FROM documents))"""
ARTICLES_SQL = (
    SOURCES_SQL
    + """, v_articles AS (
  SELECT d.doc_id AS id, d.source AS source_name, substr(split_part(d.text, chr(10), 1), 1, 120) AS title, substr(d.text, 1, 500) AS summary,
         d.text AS content, CASE WHEN d.lang IN ('fr', 'en', 'de') THEN d.lang ELSE 'unknown' END AS language,
         CASE WHEN d.doc_id % 11 <> 0 THEN TIMESTAMP '2024-01-01' + to_minutes(CAST(37 * d.doc_id AS BIGINT)) END AS published_at,
         TIMESTAMP '2024-01-01' + to_minutes(CAST(37 * d.doc_id + 5 AS BIGINT)) AS created_at,
         CASE WHEN d.doc_id % 4 = 0 THEN 'used' ELSE 'new' END AS status, coalesce(l.toxic, 0) = 1 AS is_sports,
         d.doc_id % 3 AS used_count, s.idx, s.priority, s.region
  FROM documents d LEFT JOIN labels l USING (doc_id) JOIN v_sources s ON d.source = s.source_name)"""
)
BULLETINS_SQL = """v_bulletins AS (
  SELECT event_id AS id, ts AS slot_start, event_type AS style_key, CASE WHEN value >= 5 THEN 'ready' ELSE 'draft' END AS status,
         CASE WHEN event_id % 7 <> 0 THEN event_id || '.mp3' END AS audio_path, value AS duration_seconds FROM events)"""
TRANSCRIPTS_SQL = """v_transcripts AS (
  SELECT conv_id, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id)"""
