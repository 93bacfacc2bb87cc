"""Faceted filters, quoted search and sorting of exported items."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import in_period
from ..functions.text import fold, text

SEARCHED = ("title", "summary", "source", "region", "language", "search_terms")


def query_terms(query: str) -> tuple[list[str], str]:
    """Quoted terms, and what else the query holds, folded."""
    import unicodedata

    low = "".join(c for c in unicodedata.normalize("NFD", query.lower()) if not unicodedata.combining(c))
    quoted = [t.strip() for t in re.findall(r'"([^"]+)"', low) if t.strip()]
    return quoted, " ".join(re.sub(r'"[^"]*"', " ", low).replace('"', " ").split())


def matches(query: str, columns=SEARCHED) -> Column:
    """Every quoted term and the rest as one run; short quoted terms only as whole tokens."""
    hay = fold(F.concat_ws(" ", *[text(c) for c in columns]))
    quoted, rest = query_terms(query)
    held = F.contains(hay, F.lit(rest)) if rest else F.lit(True)
    for term in quoted:
        if re.fullmatch("[a-z0-9]{1,3}", term):
            held = held & hay.rlike(f"(^|[^a-z0-9]){term}([^a-z0-9]|$)")
        else:
            held = held & F.contains(hay, F.lit(term))
    return held


def item_language() -> Column:
    return F.coalesce(F.nullif(text("language"), F.lit("")), F.when(F.col("region") == "english", "en"), F.lit("unknown"))


def shown(
    now: Column,
    *,
    english: bool = False,
    german: bool = False,
    region: str | None = None,
    source: str | None = None,
    period: str = "24h",
    hide_sports: bool = True,
    child_only: bool = False,
    most_tension: int = 10,
    least_priority: int = 0,
    query: str = "",
) -> Column:
    """Whether the web filter shows an item; defaults are those of a fresh page."""
    speaks = item_language()
    held = (F.lit(english) | (speaks != "en")) & (F.lit(german) | (speaks != "de"))
    if region:
        held = held & (F.col("region") == region)
    if source:
        held = held & (F.col("source") == source)
    held = held & in_period(F.coalesce("published_at", "scraped_at"), period, now)
    if hide_sports:
        held = held & ~F.col("is_sports")
    if child_only:
        held = held & F.col("child_friendly")
    held = held & (F.col("tension") <= most_tension) & (F.col("priority") >= least_priority)
    if query.strip():
        held = held & matches(query)
    return held


def faceted(items: DataFrame, now: Column, read: DataFrame | None = None, **facets) -> DataFrame:
    """The web filter with the settings of :func:`shown`.  ``read``: ids to hide."""
    kept = items.filter(shown(now, **facets))
    return kept if read is None else kept.join(read.select("id"), "id", "left_anti")


def pages_of(items: DataFrame, now: Column, pages: dict[str, dict], name: str = "page") -> DataFrame:
    """The items of several pages (name: settings of :func:`shown`), a row for each page that shows the item, in one pass."""
    held = [F.when(shown(now, **facets), F.lit(page)) for page, facets in pages.items()]
    return items.select("id", F.explode(F.array_compact(F.array(*held))).alias(name))


def on_device(items: DataFrame, now: Column, read: DataFrame | None = None, *, english: bool = False, **facets) -> DataFrame:
    """The filter of the app on devices: German items are dropped as they are read, whatever the settings, and English ones by language or region.

    Other settings are those of :func:`faceted`.
    """
    named = F.lower(text("language"))
    kept = items.filter(named != "de")
    kept = kept if english else kept.filter((named != "en") & (text("region") != "english"))
    return faceted(kept, now, read, english=True, german=True, **facets)


def preset(parameters: dict[str, str]) -> dict:
    """Filter settings of an address: english=1 or region=english opens English, german=1 or de=1 German."""
    out = {}
    if parameters.get("english") == "1" or parameters.get("region") == "english":
        out["english"] = True
    if parameters.get("region"):
        out["region"] = parameters["region"]
    if parameters.get("german") == "1" or parameters.get("de") == "1":
        out["german"] = True
    return out


def archive_filter(items: DataFrame, now: Column, region=None, source=None, period="all", query="") -> DataFrame:
    """Region, source, period and one contiguous text."""
    held = in_period(F.coalesce("published_at", "scraped_at"), period, now)
    for name, value in (("region", region), ("source", source)):
        if value:
            held = held & (F.col(name) == value)
    if query.strip():
        held = held & F.contains(fold(F.concat_ws(" ", *[text(c) for c in SEARCHED])), F.lit(query_terms(query)[1]))
    return items.filter(held)


def order(name: str, calm_by_date: bool = True) -> list[Column]:
    """newest, romand (priority), calm or alert; ends with the id."""
    date = F.coalesce("published_at", "scraped_at").desc()
    calm = [F.asc("tension"), F.desc("calm"), *([date] if calm_by_date else [])]
    orders = {"newest": [date], "romand": [F.desc("priority"), date], "calm": calm, "alert": [F.desc("tension"), date]}
    return [*orders[name], F.asc("id")]


def first_match(items: DataFrame, query: str, ord_: str = "ord") -> DataFrame:
    """The first playable item whose title or subtitle holds the query, else the first playable one, else the live one."""
    playable = F.coalesce("audio_url", F.lit("")) != ""
    hit = F.contains(F.lower(F.concat_ws(" ", text("title"), text("subtitle"))), F.lit(query.strip().lower()))
    wanted = hit if query.strip() else F.lit(False)
    preference = F.when(playable & wanted, 0).when(playable, 1).when(F.col("is_live"), 2)
    return items.withColumn("_p", preference).filter("_p IS NOT NULL").orderBy("_p", ord_).limit(1).drop("_p")


def catalogue(items: DataFrame, english: bool, english_keys=("international_english", "un_relevant")) -> DataFrame:
    return items if english else items.filter(~F.col("style_key").isin(list(english_keys)))


def facets(items: DataFrame, **columns: str) -> DataFrame:
    """One row: the sorted distinct non-empty values of each column."""
    return items.agg(*[F.array_sort(F.collect_set(F.when(text(c) != "", F.col(c)))).alias(name) for name, c in columns.items()])


def counters(items: DataFrame, read: DataFrame) -> DataFrame:
    """How many items there are, and how many of them are read."""
    marked = items.select("id").join(read.select("id", F.lit(True).alias("is_read")).distinct(), "id", "left")
    return marked.agg(F.count("*").alias("n_items"), F.count_if(F.coalesce("is_read", F.lit(False))).alias("n_read"))
