"""State as logs: stored tables are what their logs compact to, so nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import language, rules
from ..functions.text import canonical_url, url_hash
from ..sources.commits import Tables, Transaction


def compact(log: DataFrame, key: str | list[str], arrival: str, first: list[str], last: list[str], last_known: list[str]) -> DataFrame:
    """One row for each key: ``first`` columns as they first arrived, ``last`` as they last did, ``last_known`` the last non-null ones.

    The last arrival wins, whatever its event time.  One shuffle; tasks combine before it.
    """
    keys = [key] if isinstance(key, str) else key
    aggs = [F.min_by(c, arrival).alias(c) for c in first]
    aggs += [F.max_by(c, arrival).alias(c) for c in last]
    aggs += [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(arrival))).alias(c) for c in last_known]
    return log.groupBy(*keys).agg(*aggs, F.count("*").alias("arrivals"))


def articles(log: DataFrame, sources: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """Stored articles of an arrival log: classified by today's rules, used as their bridge rows say."""
    hashed = log.withColumn("url", canonical_url("url")).filter("url <> ''").withColumn("url_hash", url_hash("url"))
    rows = compact(
        hashed,
        "url_hash",
        "arrival",
        ["source_id", "url", "scraped_at"],
        ["title", "summary", "content", "language"],
        ["published_at", "published_at_raw"],
    ).withColumnRenamed("scraped_at", "created_at")
    rows = rows.withColumn("id", F.xxhash64("url_hash"))
    named = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), "region", "priority")
    rows = rows.join(named, "source_id")
    rows = rows.withColumns(
        {
            "is_sports": rules.is_sports("title", "summary", "content"),
            "language": language.resolved("language", "title", "summary", "content", F.col("region")),
        }
    )
    if used is None:
        return rows.withColumns({"used_count": F.lit(0).cast("long"), "status": F.lit("new")})
    uses = used.dropDuplicates(["bulletin_id", "article_id"]).groupBy(F.col("article_id").alias("id")).agg(F.count("*").alias("used_count"))
    return with_use(rows, uses)


def with_use(rows: DataFrame, uses: DataFrame) -> DataFrame:
    joined = rows.join(uses, "id", "left").withColumn("used_count", F.coalesce("used_count", F.lit(0).cast("long")))
    return joined.withColumn("status", F.when(F.col("used_count") > 0, "used").otherwise("new"))


def reclassified(stored: DataFrame) -> DataFrame:
    """Stored articles (with their source's region) as today's rules see them: sports by text, and the language anew where it is unknown or the source is English."""
    known = F.coalesce(F.nullif("language", F.lit("")), F.lit("unknown"))
    anew = (known == "unknown") | (F.col("region") == "english")
    found = language.detect("title", "summary", "content", F.col("region"))
    return stored.withColumns({"is_sports": rules.is_sports("title", "summary", "content"), "language": F.when(anew, found).otherwise(known)})


def use_counts(uses: DataFrame) -> DataFrame:
    """How often bulletins took each article."""
    return uses.groupBy(F.col("article_id").alias("id")).agg(F.count("*").alias("used_count"))


def create_bulletins(tables: Tables, bulletins: DataFrame, picked: DataFrame, attempts: int = 5) -> int:
    """New bulletins, the articles that they picked and the marks of use, in one commit; gives its version.

    A pair that is there already stays one row, but each mention counts as a use.  An id that is
    taken fails, and nothing is changed.  Where another writer was faster, it is done anew on what that
    one left.
    """

    def change(t: Transaction) -> None:
        taken = bulletins.select("id").join(t.read("bulletins").select("id"), "id", "left_semi").take(1)
        if taken:
            raise ValueError(f"there is a bulletin {taken[0].id} already")
        pairs = picked.select("bulletin_id", "article_id")
        t.append("bulletins", bulletins)
        t.append("bulletin_articles", pairs.distinct().join(t.read("bulletin_articles"), ["bulletin_id", "article_id"], "left_anti"))
        t.append("article_uses", pairs)

    return tables.retrying(change, attempts)


def merge_sources(stored: DataFrame, given: DataFrame) -> DataFrame:
    """Stored sources brought up to date: matched by url, else by name; ids and validators stay, unmatched ones are added.

    A given row follows its url where a stored row has it.  A name counts only for stored rows that
    no given url names, and only while they bear it: a row that its url gives another name is added by
    the one that has its former name.  So no stored row answers to two given ones.
    """
    config = ["name", "url", "region", "priority", "interval_minutes", "max_entries", "enabled"]
    named = given.select(*config).dropDuplicates(["url"]).dropDuplicates(["name"])
    by_url = named.join(stored.select("id", "url"), "url")
    unclaimed = stored.join(by_url.select("id"), "id", "left_anti")
    others = named.join(by_url.select("url"), "url", "left_anti").join(unclaimed.select("id", "name"), "name", "left")
    matched = by_url.select("id", *config).unionByName(others.select("id", *config))
    kept = stored.select("id", *[c for c in stored.columns if c not in [*config, "id"]])
    updated = matched.filter("id IS NOT NULL").join(kept, "id")
    added = matched.filter("id IS NULL").withColumn("id", F.xxhash64("url"))
    untouched = stored.join(updated.select("id"), "id", "left_anti")
    return untouched.unionByName(updated).unionByName(added, allowMissingColumns=True)


def keep_validators(log: DataFrame) -> DataFrame:
    """Validators of each source: the last ones a fetch gave (a fetch without any keeps the former)."""
    return compact(log, "source", "fetch", [], ["checked_at"], ["etag", "last_modified"])


def latest_status(log: DataFrame, key: str = "id", arrival: str = "at") -> DataFrame:
    """The last state of each key: draft to ready or error, running to ok or error."""
    return compact(log, key, arrival, [], ["status"], ["message"]).drop("arrivals")


def status_counts(df: DataFrame, status: str = "status") -> DataFrame:
    return df.groupBy(status).agg(F.count("*").alias("n"))


def archive_counts(df: DataFrame) -> DataFrame:
    """All, sports and editorial articles in one row; zeros for an empty table."""
    return df.agg(
        F.count("*").alias("total"),
        F.count_if("is_sports").alias("sports"),
        F.count_if(~F.col("is_sports")).alias("editorial"),
    )


def last_by(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    return df.agg(*[F.max_by(c, key).alias(c) for c in columns])


def missing(desired: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows to add: desired, but not there."""
    return desired.join(existing.select(key), key, "left_anti")


def stale(existing: DataFrame, keep: DataFrame, key: str) -> DataFrame:
    """Rows to remove: there, but not to be kept."""
    return existing.join(keep.select(key), key, "left_anti")


def still_kept(state: DataFrame, keep: DataFrame, key: str) -> DataFrame:
    return state.join(keep.select(key), key, "left_semi")


def toggled(read: DataFrame, item: DataFrame, key: str = "id") -> DataFrame:
    """Read marks after toggling items: marked ones lose their mark, others get one."""
    return read.select(key).join(item.select(key), key, "left_anti").union(item.select(key).join(read.select(key), key, "left_anti"))


def mark_all(read: DataFrame, visible: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Read marks with all visible items, and the new ones among them."""
    new = visible.select(key).distinct().join(read.select(key), key, "left_anti")
    return read.select(key).union(new).distinct(), new


def resume_position(log: DataFrame, duration: Column, rewind: float = 5.0, tail: float = 8.0) -> DataFrame:
    """Where to go on: the last position, a little earlier; from the start if it was within the tail."""
    last = log.groupBy("id").agg(F.max_by("position", "at").alias("position"), F.max(duration).alias("length"))
    at = F.when(F.col("position") >= F.col("length") - tail, 0.0).otherwise(F.greatest(F.lit(0.0), F.col("position") - rewind))
    return last.select("id", at.alias("position"))
