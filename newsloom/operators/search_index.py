"""Search without a scan: posting lists of trigrams narrow items down, the search's own predicate decides.

Postings are rows (gram, id), kept under the commit that also says which items they cover,
so that new items add postings of their own and a reader sees items and postings of one
moment.  Items, not their many postings, are dealt out to tasks; each task sorts the postings
of its own items by gram and writes them as one file, so a gram of very many items is no
single task.  A search reads in each file the postings of its terms' trigrams
(a filter that reaches the files' statistics), keeps ids that have all of them, and tries
:func:`search.matches` on those items only.  A search whose terms are all shorter than
three characters has no trigram and reads the items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import fold, let, text
from ..sources.commits import Tables
from . import search

POSTINGS = T.StructType([T.StructField("gram", T.StringType()), T.StructField("id", T.LongType())])
#: Up to so many candidates are looked up by their ids; more of them meet the items in a join.
FEW = 10_000


def grams(folded: Column) -> Column:
    """The distinct runs of three characters of a folded text."""
    at = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda k: F.substring(t, k, F.lit(3)))
    return let(folded, lambda t: F.when(F.length(t) >= 3, F.array_distinct(at(t))).otherwise(F.array().cast("array<string>")))


def postings(items: DataFrame, columns=search.SEARCHED) -> DataFrame:
    hay = fold(F.concat_ws(" ", *[text(c) for c in columns]))
    return items.select(F.explode(grams(hay)).alias("gram"), F.col("id").cast("long").alias("id"))


def add(tables: Tables, new: DataFrame, items: str = "items", index: str = "postings") -> int:
    """Appends items whose ids are not there yet, and their postings, in one commit; gives its version."""

    def change(t) -> None:
        fresh = new.join(t.read(items).select("id"), "id", "left_anti").dropDuplicates(["id"])
        t.append(items, fresh.repartitionByRange("id").sortWithinPartitions("id"))
        # what was just written is read again, so that items and postings are of the same rows
        written = tables.spark.read.schema(tables.schemas[items]).parquet(f"{tables.path}/{t.added[items][-1]}")
        parts = int(tables.spark.conf.get("spark.sql.shuffle.partitions"))
        t.append(index, postings(written.repartition(parts, "id")).sortWithinPartitions("gram", "id"))

    return tables.retrying(change)


def needed(query: str) -> list[str]:
    """The trigrams that every match of the query holds."""
    quoted, rest = search.query_terms(query)
    return sorted({term[k : k + 3] for term in [*quoted, rest] for k in range(len(term) - 2)})


def candidates(rows: DataFrame, query: str) -> DataFrame | None:
    """Ids that have all trigrams of the query; None where it has no trigram."""
    wanted = needed(query)
    if not wanted:
        return None
    met = rows.filter(F.col("gram").isin(wanted)).groupBy("id").agg(F.count("*").alias("n"))
    return met.filter(F.col("n") == len(wanted)).select("id")


def find(tables: Tables, query: str, items: str = "items", index: str = "postings") -> DataFrame:
    """The items that match, as of the last commit."""
    version = tables.manifest()["version"]
    rows, ids = tables.read(items, version), candidates(tables.read(index, version), query)
    if ids is not None:
        few = [r.id for r in ids.take(FEW + 1)]
        rows = rows.filter(F.col("id").isin(few)) if len(few) <= FEW else rows.join(ids, "id", "left_semi")
    return rows.filter(search.matches(query))
