"""A Merkle manifest of a dataset: a hash for each row, a tree for each language, one root, and a proof for each row.

H is the lowercase hex sha256; digests are hashed as hex text.  A row's leaf is H of doc_id,
source, lang, n_chars and text, one after the other, each ``-`` if null, else its number of
UTF-8 bytes, a colon and the value.  A language's leaves stand by doc_id; while a level has
several nodes, every two consecutive ones (the last may be alone) become H of their digests.  What
remains is the subroot; subroots, by language (null first, by bytes), become the root likewise.

How it runs: leaves are dealt out by range and written once; counts of each range give
every leaf its place in its language, without a window over a language.  Blocks of ``BLOCK``
consecutive, aligned places go to executors as Arrow tables, where DuckDB works the levels off by
ordered ``string_agg`` and ``sha256``.  The blocks' roots are the nodes of the next, far smaller
round, until each language has one, and the languages' roots likewise; then proofs come
down, round by round, by joins.  Trees that fit a block share Arrow tables.  What reaches the driver
are two numbers a round.

A null in any column is the ``-`` of its field; null languages are one language of their own and
rows without doc_id stand first in their language.  Rows that share a doc_id stand by their leaf, so
rows that are the same throughout have proofs of their own; an empty table gives an empty result.
Very long texts are hashed in the row's own task.  Other columns, whatever their names, are left out.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Workspace

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: Levels and nodes of a block.
LEVELS = 12
BLOCK = 1 << LEVELS

STEPS = T.ArrayType(T.StructType([T.StructField("left", T.BooleanType()), T.StructField("hash", T.StringType())]))


def leaf(**fields: Column) -> Column:
    """H of the fields, in their order."""
    # hashed as bytes, so that a field's length is that of its UTF-8 form
    written = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[written(c.cast("string")) for c in fields.values()]), 256)


def tampered(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0, F.lit(False))


def placed(rows: DataFrame, tree: str, order: list[str], work: Workspace) -> DataFrame:
    """Adds pos (from 0) and n, a row's place among the rows of its tree and their number; ``rows`` are a written table.

    Rows are written in ranges of (tree, order); a row's place is its range's offset, from the
    counts of ranges before, and its place in the range.  No tree passes through one task.
    """
    # rows that tie in all that orders them may fill several ranges
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in (tree, *order, "__tie")]
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = tied.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("__tie")
    written = work.keep(ranged.withColumn("__at", F.monotonically_increasing_id()))
    span = F.shiftright("__at", 33)
    counts = written.groupBy(F.col(tree).alias("__tree"), span.alias("__range")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    # one entry for each range that the tree fills
    sums = counts.groupBy("__tree").agg(F.sort_array(F.collect_list(F.struct("__range", "__first", "__n"))).alias("__all"))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<struct<r:bigint,base:bigint>>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        base = F.struct(x["__range"].alias("r"), (acc["sum"] - x["__first"]).alias("base"))
        return F.struct((acc["sum"] + x["__n"]).alias("sum"), F.concat(acc["out"], F.array(base)).alias("out"))

    offsets = sums.select("__tree", F.aggregate("__all", start, add).alias("x")).select("__tree", F.col("x.sum").alias("n"), F.explode("x.out").alias("y"))
    offsets = work.keep(offsets.select("__tree", "n", F.col("y.r").alias("__range"), F.col("y.base").alias("__base")), True)
    met = written.join(offsets, (span == offsets["__range"]) & written[tree].eqNullSafe(offsets["__tree"]))
    return met.select(*rows.columns, (F.col("__at") + F.col("__base")).alias("pos"), "n")


class LevelEngine:
    """DuckDB over one Arrow table of nodes: all levels of its blocks."""

    def __init__(self):
        import duckdb

        self.con = duckdb.connect()
        self.con.execute("SET threads = 1")

    def run(self, nodes: pa.Table) -> pa.Table:
        """place, tree, pos, n, hash of whole blocks → place, root, steps (from the node up to its block's root)."""
        con = self.con
        con.register("arrived", nodes)
        con.execute(
            f"""CREATE OR REPLACE TEMP TABLE node AS
            SELECT 0 AS level, dense_rank() OVER (ORDER BY tree, pos // {BLOCK}) AS block, pos, hash,
                   least({LEVELS}, ceil(log2(n)))::INT AS height, place FROM arrived"""
        )
        for level in range(LEVELS):
            con.execute(
                f"""INSERT INTO node SELECT {level + 1}, block, pos // 2, sha256(string_agg(hash, '' ORDER BY pos)), any_value(height), NULL
                FROM node WHERE level = {level} AND height > {level} GROUP BY block, pos // 2"""
            )
        con.unregister("arrived")
        return con.sql(
            """WITH up AS (SELECT place, block, pos, height, unnest(range(height)) AS level FROM node WHERE level = 0),
            way AS (SELECT u.place, u.block, list({'left': (u.pos >> u.level) % 2 = 1, 'hash': s.hash} ORDER BY u.level) AS steps
                    FROM up u LEFT JOIN node s ON s.block = u.block AND s.level = u.level AND s.pos = xor(u.pos >> u.level, 1)
                    GROUP BY u.place, u.block)
            SELECT w.place, r.hash AS root, w.steps FROM way w JOIN node r ON r.block = w.block AND r.level = r.height"""
        ).to_arrow_table()


def _climb(nodes: DataFrame, n_small: int) -> DataFrame:
    """Nodes of trees of several nodes: adds root (of the block) and steps."""
    big = F.col("n") > BLOCK
    cells = max(1, -(-n_small // BLOCK))
    keyed = nodes.select(
        "*",
        F.when(big, F.col("tree")).alias("__tree"),
        F.when(big, F.shiftright("pos", LEVELS)).otherwise(F.pmod(F.xxhash64("tree"), F.lit(cells))).alias("__cell"),
        big.alias("__big"),
    )
    names = nodes.columns
    schema = T.StructType([*nodes.schema.fields, T.StructField("root", T.StringType()), T.StructField("steps", STEPS)])
    engines = []

    def run(group: pa.Table) -> pa.Table:
        if not engines:
            engines.append(LevelEngine())
        asked = group.select(["tree", "pos", "n", "hash"]).append_column("place", pa.array(range(group.num_rows), pa.int64()))
        found = engines[0].run(asked)
        out = group.select(names).take(found.column("place"))
        steps = pa.list_(pa.struct([("left", pa.bool_()), ("hash", pa.string())]))
        return out.append_column("root", found.column("root").cast(pa.string())).append_column("steps", found.column("steps").cast(steps))

    return keyed.groupBy("__tree", "__cell", "__big").applyInArrow(run, schema)


def forest(nodes: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """tree, pos, n, hash and others (a written table) → the same and steps to the tree's root; (tree, hash of the root)."""
    counts = nodes.agg(F.max("n"), F.count_if((F.col("n") > 1) & (F.col("n") <= BLOCK))).first()
    alone = nodes.filter("n = 1")
    ways, roots = alone.withColumn("steps", F.array().cast(STEPS)), alone.select("tree", "hash")
    if (counts[0] or 0) <= 1:
        return ways, roots
    climbed = work.keep(_climb(nodes.filter("n > 1"), counts[1]))
    block = F.shiftright("pos", LEVELS)
    firsts = climbed.filter(F.col("pos").bitwiseAND(F.lit(BLOCK - 1)) == 0)
    above = firsts.select("tree", block.alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("root").alias("hash"))
    upper, tops = forest(work.keep(above, True), work)
    upper = upper.select(F.col("tree").alias("__tree"), F.col("pos").alias("__block"), F.col("steps").alias("__above"))
    met = climbed.join(upper, (block == upper["__block"]) & climbed["tree"].eqNullSafe(upper["__tree"]))
    met = met.select(*nodes.columns, F.concat("steps", "__above").alias("steps"))
    return ways.union(met), roots.union(tops)


def fold(hashed: Column, steps: Column) -> Column:
    """The root that a leaf and its way lead to."""
    empty = F.lit("")

    def up(acc: Column, s: Column) -> Column:
        other = F.coalesce(s["hash"], empty)
        return F.sha2(F.when(s["left"], F.concat(other, acc)).otherwise(F.concat(acc, other)), 256)

    return F.aggregate(steps, hashed, up)


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf, tampered_leaf, subroot, root, steps: a row for each row of ``docs``."""
    work = Workspace(docs.sparkSession)
    cols = {c: F.col(c) for c in FIELDS}
    true, false = leaf(**cols), leaf(**cols | {"n_chars": F.col("n_chars") + 1})
    changed = F.when(tampered(F.col("doc_id")), false).otherwise(F.col("leaf"))
    rows = work.keep(docs.select(*FIELDS, true.alias("leaf")).select("doc_id", "lang", "leaf", changed.alias("tampered_leaf")))
    nodes = placed(rows.withColumnRenamed("lang", "tree"), "tree", ["doc_id", "leaf"], work)
    ways, subroots = forest(work.keep(nodes.withColumnRenamed("leaf", "hash")), work)
    # one tree over the languages
    subroots = work.keep(subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("lang"), "hash"), True)
    outer, root = forest(work.keep(placed(subroots, "tree", ["lang"], work), True), work)
    outer = outer.join(root.select("tree", F.col("hash").alias("root")), "tree")
    outer = work.keep(outer.select(F.col("lang").alias("__lang"), F.col("hash").alias("subroot"), "root", F.col("steps").alias("__outer")), True)
    met = ways.join(outer, ways["tree"].eqNullSafe(outer["__lang"]))
    steps = F.concat("steps", "__outer").alias("steps")
    return met.select("doc_id", F.col("tree").alias("lang"), F.col("hash").alias("leaf"), "tampered_leaf", "subroot", "root", steps)


def report(docs: DataFrame) -> DataFrame:
    """Each row's leaf, subroot, root and digest of its proof, and whether its leaf, tampered with or not, still leads to the root."""
    found = manifest(docs)
    siblings = F.array_join(F.transform("steps", lambda s: s["hash"]), "")
    folded = fold(F.col("tampered_leaf"), F.col("steps"))
    found = found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return found.select("*", (F.col("folded_root") == F.col("root")).alias("verified"))


_CRC32 = """xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii((doc_id::VARCHAR)[i])::BIGINT),
  lambda c, b: list_reduce([xor(c, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""


def _sql_leaf(n_chars: str) -> str:
    part = lambda c: f"coalesce(strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR, '-')"
    return "sha256(" + " || ".join(part(n_chars if c == "n_chars" else c) for c in FIELDS) + ")"


SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
  FROM (SELECT doc_id, lang, {_sql_leaf("n_chars")} AS leaf,
               CASE WHEN {_CRC32} % 7 = 0
                    THEN {_sql_leaf("n_chars + 1")} ELSE {_sql_leaf("n_chars")} END AS other
        FROM documents)
), node(lang, level, pos, n, hash) AS (
  SELECT lang, 0, pos, n, leaf FROM leaves
  UNION ALL
  SELECT lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(hash, '' ORDER BY pos)) FROM node WHERE n > 1 GROUP BY lang, level, pos // 2, n
), langs AS (
  SELECT lang, hash AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM node WHERE n = 1
), outer_node(level, pos, n, hash) AS (
  SELECT 0, pos, n, subroot FROM langs
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(hash, '' ORDER BY pos)) FROM outer_node WHERE n > 1 GROUP BY level, pos // 2, n
), way AS (
  SELECT l.lang, l.pos, h.level, CASE WHEN s.hash IS NULL THEN '-' WHEN (l.pos >> h.level) % 2 = 1 THEN 'l' || s.hash ELSE 'r' || s.hash END AS step
  FROM leaves l JOIN (SELECT DISTINCT lang, level FROM node WHERE n > 1) h ON h.lang IS NOT DISTINCT FROM l.lang
  LEFT JOIN node s ON s.lang IS NOT DISTINCT FROM l.lang AND s.level = h.level AND s.pos = xor(l.pos >> h.level, 1)
), outer_way AS (
  SELECT l.lang, h.level, CASE WHEN s.hash IS NULL THEN '-' WHEN (l.pos >> h.level) % 2 = 1 THEN 'l' || s.hash ELSE 'r' || s.hash END AS step
  FROM langs l JOIN (SELECT DISTINCT level FROM outer_node WHERE n > 1) h ON true
  LEFT JOIN outer_node s ON s.level = h.level AND s.pos = xor(l.pos >> h.level, 1)
), inner_steps AS (
  SELECT lang, pos, list(step ORDER BY level) AS steps FROM way GROUP BY lang, pos
), outer_steps AS (
  SELECT lang, list(step ORDER BY level) AS steps FROM outer_way GROUP BY lang
), proved AS (
  SELECT l.doc_id, l.leaf, l.other, g.subroot, (SELECT hash FROM outer_node WHERE n = 1) AS root, coalesce(i.steps, []) || coalesce(o.steps, []) AS steps
  FROM leaves l JOIN langs g ON g.lang IS NOT DISTINCT FROM l.lang
  LEFT JOIN inner_steps i ON i.lang IS NOT DISTINCT FROM l.lang AND i.pos = l.pos
  LEFT JOIN outer_steps o ON o.lang IS NOT DISTINCT FROM l.lang
), folded AS (
  SELECT *, list_reduce([other] || steps, lambda h, s: CASE s[1] WHEN '-' THEN sha256(h) WHEN 'l' THEN sha256(s[2:] || h) ELSE sha256(h || s[2:]) END) AS folded_root FROM proved
)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(list_filter(steps, lambda s: s <> '-'), lambda s: s[2:]), ''), '')) AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM folded
"""
