"""The training-corpus pipeline over ``documents``: five stages, each written as Parquet and read again for the next.

A stage works on all that its predecessor kept.  The first four return the columns of
``documents``; the last one adds what encoding gives.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import bitmaps, decontamination, jaccard, languages, queries, sentencepieces, substrings
from newsloom.llm.shared import Workspace, fewer_parts, lower_batch_bytes, lower_batches, shared_folder

#: Distinct units that an encoding worker keeps: two workers share what the JVM leaves of an executor's memory.
UNITS_KEPT = 200_000
#: A document goes if no language of those chosen for it holds this part of its words.
LEAST_SHARE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those in no language for the most part; fills in a missing language."""
    model = languages.learn(docs)
    if not model[0]:
        return docs
    # under names that clash with none of the outputs; each text goes to the workers and back once
    names = {c: f"__{k}" for k, c in enumerate(docs.columns)}
    found = languages.predict(docs.toDF(*names.values()), model, names["text"])
    kept = found.filter((F.col("lang_pred") != "und") & (F.col("languages")[0]["share"] >= LEAST_SHARE))
    back = {c: F.col(name).alias(c) for c, name in names.items()}
    return kept.select(*[F.coalesce(x, F.col("lang_pred")).alias("lang") if c == "lang" else x for c, x in back.items()])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that five-word shingles link at a Jaccard similarity of 0.8: the smallest id.

    Rows that repeat a doc_id count as one document, of which the smallest text stays; rows without
    doc_id cannot be named in a group and stay.
    """
    linked = jaccard.link(docs).filter("doc_id IS NOT NULL")
    ids = linked.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"), F.count("*").alias("n"))
    known = Workspace(spark).keep(ids.filter("NOT stays OR n > 1"), True)
    # only documents that may go are shuffled
    asked, others = bitmaps.parted(docs, "doc_id", known, "doc_id")
    out = others.union(asked.join(known, "doc_id", "left_anti").select(docs.columns).coalesce(fewer_parts(spark)))
    several = known.filter("stays")
    if several.isEmpty():
        return out
    rest = F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")]).alias("rest")
    one = asked.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", rest)).alias("x"))
    return out.union(one.select(*[F.col(c if c == "doc_id" else f"x.{c}" if c == "text" else f"x.rest.{c}").alias(c) for c in docs.columns]))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out passages that occur before; a document of which nothing is left goes."""
    shorter = substrings.deduplicate(docs)
    return shorter.filter((F.col("n_removed") == 0) | (F.trim("text") != "")).select(docs.columns)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontamination.decontaminate(docs, queries.table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids and their number."""
    out = sentencepieces.encode_decode(docs, queries.piece_model_path(), decoded=None, kept=UNITS_KEPT)
    return out.select(*docs.columns, "ids", F.size("ids").cast("long").alias("n_tokens"), "agrees")


def _small(stage: Callable) -> Callable:
    """The stage in a session whose Arrow batches of whole texts are small."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        lower_batches(spark)
        lower_batch_bytes(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("language_id", _small(language_id)),
    ("ngram_jaccard_join", _small(near_duplicates)),
    ("substring_dedup", _small(repeated_passages)),
    ("benchmark_decontamination", _small(benchmark_free)),
    ("sentencepiece_encoding", _small(encoded)),
]

#: Mixture inference and the encoder cannot be expressed in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them goes to the shared folder."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = queries.table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
