"""Readers of feeds, configuration and pages."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import language
from ..functions.dates import first_date
from ..functions.html import main_text, strip_html
from ..functions.text import canonical_url, squeeze, text
from ..operators import order

#: RSS items: the tags that are read; absent ones are null.
ITEM = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("title", "link", "guid", "description", "summary", "pubDate", "published", "updated")]
    + [T.StructField("content:encoded", T.StringType()), T.StructField("content", T.ArrayType(T.StringType()))]
)
LEAST_CONTENT = 260
MOST_CONTENT = 4000

_SOURCE_DEFAULTS = {"region": "general", "priority": 50, "interval_minutes": 5, "max_entries": 20, "enabled": True}


def parse_yaml(raw: str):
    """The small part of YAML that configuration files use: nested maps, lists of maps or scalars, comments, quotes."""
    lines = []
    for line in raw.splitlines():
        bare = re.sub(r"(^|\s)#.*$", "", line) if line.count('"') % 2 == 0 else line
        if bare.strip() and bare.strip() != "---":
            lines.append((len(bare) - len(bare.lstrip()), bare.strip()))

    def scalar(v: str):
        v = v.strip()
        if v[:1] in "\"'" and v[-1:] == v[:1] and len(v) > 1:
            return v[1:-1]
        low = v.lower()
        if low in ("true", "yes", "on"):
            return True
        if low in ("false", "no", "off"):
            return False
        if low in ("", "null", "~"):
            return None
        return int(v) if re.fullmatch(r"-?\d+", v) else float(v) if re.fullmatch(r"-?\d+\.\d+", v) else v

    def block(at: int, indent: int):
        if at < len(lines) and lines[at][1].startswith("- "):
            out = []
            while at < len(lines) and lines[at][0] == indent and lines[at][1].startswith("- "):
                rest = lines[at][1][2:]
                if re.match(r"[^\s\"':]+:(\s|$)", rest):
                    lines[at] = (indent + 2, rest)
                    value, at = block(at, indent + 2)
                else:
                    value, at = scalar(rest), at + 1
                out.append(value)
            return out, at
        out = {}
        while at < len(lines) and lines[at][0] == indent and not lines[at][1].startswith("- "):
            name, _, rest = lines[at][1].partition(":")
            name = scalar(name)
            at += 1
            if rest.strip():
                out[name] = scalar(rest)
            elif at < len(lines) and (lines[at][0] > indent or lines[at][0] == indent and lines[at][1].startswith("- ")):
                out[name], at = block(at, lines[at][0])
            else:
                out[name] = None
        return out, at

    return block(0, lines[0][0])[0] if lines else {}


def load_sources(spark: SparkSession, raw: str) -> DataFrame:
    """Sources of a YAML text: a list under ``sources``, over the file's and the general defaults."""
    config = parse_yaml(raw)
    base = {**_SOURCE_DEFAULTS, **(config.get("defaults") or {})}
    rows = []
    for k, item in enumerate(config.get("sources") or []):
        s = {**base, **item}
        rows.append(
            (k, str(s["name"]), str(s["url"]), str(s["region"]), int(s["priority"]), int(s["interval_minutes"]), int(s["max_entries"]), bool(s["enabled"]))
        )
    names = "id long, name string, url string, region string, priority int, interval_minutes int, max_entries int, enabled boolean"
    return S.conform(spark.createDataFrame(rows, names), S.SOURCES)


def load_schedule(raw: str) -> tuple[int, list[dict]]:
    """Minutes of a slot and the rotation; without one, the styles keyed by minute in their order."""
    config = parse_yaml(raw)
    minutes = int(config.get("slot_minutes") or 60)
    styles = config.get("rotation")
    if not styles:
        keyed = config.get("styles") or {}
        styles = [keyed[k] for k in sorted(keyed, key=lambda k: int(k))]
    return minutes, styles


def read_feeds(spark: SparkSession, path: str, row_tag: str = "item", streaming: bool = False) -> DataFrame:
    """Items of RSS files (Atom: row_tag "entry"), with the file they are from; in batch or as a stream of new files."""
    reader = (spark.readStream if streaming else spark.read).format("xml").option("rowTag", row_tag).schema(ITEM)
    return reader.load(path).withColumn("file", F.input_file_name())


def items(entries: DataFrame) -> DataFrame:
    """Clean articles of feed entries; entries without title or link are dropped."""
    summary = strip_html(F.coalesce("summary", "description"))
    parts = F.array_join(F.filter(F.transform("content", strip_html), lambda p: p != ""), " ")
    body = F.coalesce(F.nullif(strip_html("content:encoded"), F.lit("")), F.nullif(parts, F.lit("")), summary)
    kept = [c for c in entries.columns if c not in ITEM.names]
    out = entries.select(
        *kept,
        strip_html("title").alias("title"),
        canonical_url(F.coalesce("link", "guid")).alias("url"),
        first_date("pubDate", "published", "updated").alias("published_at"),
        F.coalesce("pubDate", "published", "updated").alias("published_at_raw"),
        summary.alias("summary"),
        body.alias("content"),
    )
    return out.filter("title <> '' AND url <> ''")


def first_entries(entries: DataFrame, sources: DataFrame, source: str = "source", place: str = "place") -> DataFrame:
    """The first max_entries entries of each enabled source (zero or less: all of them); a source of very many is no single task."""
    limits = sources.filter("enabled").select(F.col("name").alias(source), "max_entries", "region")
    return order.first_of_each(entries.join(limits, source), source, F.col("max_entries"), F.asc(place)).drop("max_entries")


def enriched(articles: DataFrame, pages: DataFrame) -> DataFrame:
    """Short articles (not English) take the main text of their page, where that is longer; the language is detected anew."""
    texts = pages.select(canonical_url("url").alias("url"), main_text("html").alias("_page")).groupBy("url").agg(F.max("_page").alias("_page"))
    joined = articles.join(texts, "url", "left")
    page = F.substring("_page", 1, MOST_CONTENT)
    better = (F.col("region") != "english") & (F.length(text("content")) < LEAST_CONTENT) & (F.length(page) > F.length(text("content")))
    out = joined.withColumn("content", F.when(better, page).otherwise(F.col("content"))).drop("_page")
    return out.withColumn("language", language.detect("title", "summary", "content", F.col("region")))


def unchanged(answers: DataFrame) -> DataFrame:
    """Fetches that brought something: those not answered with 304."""
    return answers.filter(F.coalesce("status", F.lit(200)) != 304)


def first_available(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """The first of several JSON documents that can be read and has a record, else an empty table."""
    from pyspark.errors import AnalysisException

    for path in paths:
        try:
            found = spark.read.schema(schema).json(path, multiLine=True)
        except AnalysisException:
            continue
        if not found.isEmpty():
            return found
    return spark.createDataFrame([], schema)


def ingest_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """New articles of each source, by the ids that were not there before."""
    new = after.join(before.select("id"), "id", "left_anti")
    return new.groupBy("source_name").agg(F.count("*").alias("n_new"))


def titles(entries: DataFrame) -> DataFrame:
    return entries.select(squeeze("title").alias("title"))
