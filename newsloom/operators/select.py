"""Choosing articles: filters, ranks, removal of repeats, and the selection that combines them.

Articles are rows (id, source_name, title, url, published_at, summary, content, priority,
region, language, ...).  Orders are explicit: operators that follow a rank take and keep a
column ``ord``; every order ends with ``id``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import language, rules
from ..functions.text import fold, story_key, subject_key
from ..sources.folders import cut
from . import order


def when_seen() -> Column:
    return F.coalesce("published_at", "created_at")


# ---- filters -------------------------------------------------------------------------------


def candidates(articles: DataFrame, english: bool = True) -> DataFrame:
    """New articles that are not stored as sports."""
    kept = articles.filter((F.col("status") == "new") & ~F.col("is_sports"))
    return kept if english else kept.filter(F.col("region") != "english")


def recent(articles: DataFrame, english: bool = True) -> DataFrame:
    """As candidates, whatever their status."""
    kept = articles.filter(~F.col("is_sports"))
    return kept if english else kept.filter(F.col("region") != "english")


def without_sports(articles: DataFrame, **sets) -> DataFrame:
    """By text and source name."""
    return articles.filter(~rules.tiered(rules.joined("source_name", "title", "summary", "content"), **sets))


def without_low_value(articles: DataFrame, patterns=V.LOW_VALUE) -> DataFrame:
    return articles.filter(~rules.is_low_value("title", "summary", patterns))


def for_children(articles: DataFrame, patterns=V.CHILD_UNSUITABLE) -> DataFrame:
    return articles.filter(~rules.is_child_unsuitable("title", "summary", "content", patterns))


def speaks(code: str) -> Column:
    """English: by region and language.  Else: not English by region, and French or of no clear language."""
    if code == "en":
        return (F.col("region") == "english") & (F.col("language") == "en")
    found = language.detect("title", "summary", "content", F.col("region"))
    fits = F.when(F.col("language") == "fr", True).when(F.col("language").isin("en", "de"), False).otherwise(found.isin("fr", "unknown"))
    return (F.col("region") != "english") & fits


def in_language(articles: DataFrame, code: str) -> DataFrame:
    return articles.filter(speaks(code))


def for_topic(articles: DataFrame, topic: str | None, minimum: int = 4, topics=V.TOPICS, pool: str | None = None) -> DataFrame:
    """Articles relevant to the topic, or all where too few are.

    The count is over all rows, or over those with the same value in column ``pool`` (bounded pools).
    """

    def counted(fits: Column) -> Column:
        if pool:
            return F.count(F.when(fits, 1)).over(Window.partitionBy(pool))
        return articles.agg(F.count_if(fits)).scalar()

    if topic == "international_english":
        n = counted(F.col("region") == "english")
        return articles.withColumn("_n", n).filter((F.col("region") == "english") | (F.col("_n") == 0)).drop("_n")
    if topic not in topics:
        return articles
    relevant = rules.relevance(topic, "source_name", "region", "title", "summary", "content", topics) > 0
    if topic == "un_relevant":
        return articles.filter(relevant & F.startswith(fold("source_name"), F.lit("un news")))
    if topic in ("international", "security_world"):
        return articles.filter(relevant)
    marked = articles.withColumn("_n", counted(relevant)).withColumn("_fit", relevant)
    return marked.filter(F.col("_fit") | (F.col("_n") < minimum)).drop("_fit", "_n")


# ---- ranks ---------------------------------------------------------------------------------


def numbered(df: DataFrame, *by: Column, name: str = "ord") -> DataFrame:
    """Adds the place in the order, for pools that a limit has bounded: one task.  Whole tables: :func:`order.numbered`."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*by)).cast("long"))


def top(df: DataFrame, n: int, *by: Column) -> DataFrame:
    return df.orderBy(*by).limit(n)


def candidate_order() -> list[Column]:
    return [F.desc("priority"), when_seen().desc(), F.asc("id")]


def recent_order() -> list[Column]:
    return [when_seen().desc(), F.asc("used_count"), F.asc("id")]


def archive_order() -> list[Column]:
    return [when_seen().desc(), F.asc("id")]


def export_order() -> list[Column]:
    return [when_seen().desc(), F.desc("priority"), F.asc("id")]


def rank_values(df: DataFrame, key: str | None, topics=V.TOPICS, anxiety=V.ANXIETY, calm=V.CALM) -> tuple[DataFrame, list[Column]]:
    """The rows that a ranking keeps, with its scores, and the values by which it goes up; ties are the caller's.

    By relevance (``_s``) and priority for a topic; most alarming (``_s``) first; or those of little alarm (``_a``) by calm (``_c``).
    """
    folded = rules.joined("title", "summary", "content")
    if key in topics:
        score = rules.relevance(key, "source_name", "region", "title", "summary", "content", topics)
        return df.withColumn("_s", score), [-F.col("_s"), -F.col("priority")]
    if key == "anxiogene":
        return df.withColumn("_s", rules.anxiety(folded, anxiety)), [-F.col("_s")]
    if key == "non_anxiogene":
        marked = df.withColumns({"_a": rules.anxiety(folded, anxiety) <= 1, "_c": rules.calm(folded, calm)})
        few = df.select(rules.anxiety(folded, anxiety).alias("_a")).agg(F.count_if(F.col("_a") <= 1)).scalar() < 6
        return marked.filter(F.col("_a") | few), [F.when(F.col("_a"), -F.col("_c")).otherwise(F.lit(1))]
    return df, []


def rank_order(df: DataFrame, key: str | None, topics=V.TOPICS, anxiety=V.ANXIETY, calm=V.CALM) -> tuple[DataFrame, list[Column]]:
    """As :func:`rank_values`, with the values as orders; rows of no priority come last."""
    scored, values = rank_values(df, key, topics, anxiety, calm)
    return scored, [v.asc_nulls_last() for v in values]


def rank(df: DataFrame, key: str | None, topics=V.TOPICS, anxiety=V.ANXIETY, calm=V.CALM, bounded: bool = False) -> DataFrame:
    """Renews ``ord`` by :func:`rank_order`; unchanged for other keys.  ``bounded``: a limit has bounded the rows, and one task numbers them."""
    scored, values = rank_values(df, key, topics, anxiety, calm)
    if not values:
        return df
    out = numbered(scored, *[v.asc_nulls_last() for v in values], F.asc("ord")) if bounded else order.renumbered(scored, *values)
    return out.drop("_s", "_a", "_c")


# ---- repeats -------------------------------------------------------------------------------


def first_by(df: DataFrame, key: Column, ord_: str = "ord") -> DataFrame:
    """The first row of each key; tasks combine before the shuffle, so that a key of very many rows is no window of one task."""
    row = F.struct(*df.columns)
    return df.groupBy(key.alias("_k")).agg(F.min_by(row, ord_).alias("_row")).select("_row.*")


def unique_stories(df: DataFrame, story: Column | None = None) -> DataFrame:
    """The first row of each story; ``story``: a column that holds it already."""
    return first_by(df, story_key("title", "summary", "content") if story is None else story)


def subject(subjects=V.KNOWN_SUBJECTS) -> Column:
    return subject_key(rules.joined("title", "summary", "content"), subjects)


def unique_subjects(df: DataFrame, subjects=V.KNOWN_SUBJECTS, named: Column | None = None) -> DataFrame:
    """The first row of each subject; ``named``: a column that holds it already."""
    return first_by(df, subject(subjects) if named is None else named)


def diversified(df: DataFrame, subjects=V.KNOWN_SUBJECTS, bounded: bool = False, named: Column | None = None) -> DataFrame:
    """Nothing is dropped: first the first row of each subject, then all others, each in order.  Renews ``ord``.

    The first ones are a minimum and a join by subject, which Spark splits where a subject is
    frequent, and numbering is by ranges; ``bounded``: a limit has bounded the rows, and windows do.
    """
    key = subject(subjects) if named is None else named
    if bounded:
        marked = df.withColumn("_k", key).withColumn("_again", F.row_number().over(Window.partitionBy("_k").orderBy("ord")) > 1)
        return numbered(marked, F.asc("_again"), F.asc("ord")).drop("_k", "_again")
    marked = cut(df.select("ord", key.alias("_k")))
    firsts = marked.groupBy("_k").agg(F.min("ord").alias("_first"))
    again = marked.join(firsts, "_k").select("ord", (F.col("ord") > F.col("_first")).alias("_again"))
    places = order.numbered(again.withColumnRenamed("ord", "_old"), F.asc("_again"), F.asc("_old")).drop("_again")
    return df.join(places.withColumnRenamed("ord", "_new"), df["ord"] == F.col("_old")).select(*[df[c] for c in df.columns if c != "ord"], F.col("_new").alias("ord"))


# ---- selection -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Style:
    key: str
    language: str = "fr"
    label: str = ""


#: Keys whose pools are deeper, as their filters keep few rows.
DEEP = ("international_english", "valais", "suisse_romande", "suisse", "international", "security_world")


def pool_size(style: Style, target: int) -> int:
    size = max(10 * target, 120) if style.language == "en" or style.key in DEEP else max(5 * target, 30)
    return max(size, 500) if style.key == "un_relevant" else size


def selection(
    articles: DataFrame, style: Style, most: int = 7, sets: dict | None = None, topics=V.TOPICS, subjects=V.KNOWN_SUBJECTS
) -> DataFrame:
    """The articles of one bulletin, in order: filtered candidates, filled up from recent ones where too few are left."""
    sets = sets or {}
    target = min(most, 7)
    pool = pool_size(style, target)
    child = style.key == "enfant"
    english = style.language == "en"

    # both pools go through the filters together, so that each is read and filtered once
    first = numbered(top(candidates(articles, english), pool, *candidate_order()), *candidate_order()).withColumn("part", F.lit(0))
    late = numbered(top(recent(articles, english), pool, *recent_order()), *recent_order()).withColumn("part", F.lit(1))
    both = without_sports(first.unionByName(late), **sets.get("sports", {}))
    both = without_low_value(both, sets.get("low_value", V.LOW_VALUE))
    both = in_language(both, style.language)
    both = for_children(both, sets.get("child", V.CHILD_UNSUITABLE)) if child else both
    both = for_topic(both, style.key, max(3, target // 3), topics, "part")
    # recent ones fill up only where candidates are too few, and only with others
    both = both.withColumn("_first", F.min("part").over(Window.partitionBy("id")))
    both = both.withColumn("_n", F.count(F.when(F.col("part") == 0, 1)).over(Window.partitionBy(F.lit(0))))
    both = both.filter((F.col("part") == F.col("_first")) & ((F.col("part") == 0) | (F.col("_n") < target))).drop("_first", "_n")
    both = numbered(both, F.asc("part"), F.asc("ord")).drop("part")
    both = rank(both, "non_anxiogene" if child else style.key, topics, sets.get("anxiety", V.ANXIETY), sets.get("calm", V.CALM), True)
    both = unique_stories(both)
    both = unique_subjects(both, subjects) if child else diversified(both, subjects, True)
    return both.orderBy("ord").limit(target)
