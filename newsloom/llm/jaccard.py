"""Exact Jaccard join of documents on word shingles, and the components of its links.

Two documents link when 100 * |intersection| >= 80 * |union| of their sets (``shingles``).
The join is a blocked sparse product of the document by shingle incidence matrix:

1. Documents with equal sets are one row of the matrix (a class), named by a 64-bit hash of
   its set.
2. Columns are ordered by rarity (the frequent shingles that tasks meet come last).
   Two sets that link share one of the first n - ceil(0.8 n) + 1 columns of each, so
   only those entries are dealt out by column.
3. Blocks of columns are multiplied where they meet: rows that share a column are a
   candidate pair if their sizes and the positions of the column leave enough room.  The
   product counts their common leading columns; pairs whose count cannot reach the bound
   are discarded.
4. The rest are compared on whole sets, which are multiplied in blocks of columns too: each
   set is cut into slices of about ``SLICE`` shingles by their highest bits, a pair meets
   slice by slice, and the counts are added.  No row carries a whole set.

Columns with more than ``LONG`` rows (a large group of near copies) are not multiplied
out: in each round the rows of such a column, and every document with candidates, are
compared with a few leading documents; links merge components, and only pairs across
components remain for the next round.  A last round compares every pair that is left, so no
link between components is missed; there a column is dealt out by bands of sizes as well.

A column that a task meets often is spread over many tasks; one of its rows stays behind
for each task, so that the rest, wherever they are, know that the column is long.

Shingles and sets count as equal when their 64-bit hashes are (for 10^8 sets the odds of
any two sets colliding are 3 in 10,000).

Null or empty texts and texts without words have an empty set, link with nothing and
are their own component.  Repeated rows and documents with equal sets share a component;
rows that repeat a doc_id with another text are judged by their own texts.  A row without
doc_id gets the smallest id that it reaches by links, or null.  Very long texts are worked on
whole, one at a time.  An empty table gives an empty result.  Columns other than doc_id and
text are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmaps
from .batches import pieces
from .shared import Workspace, cut, fewer_parts
from .shingles import Shingler

#: Columns with more rows than this are worked off by leading documents.
LONG = 4
LEADERS = 4
PARTNERS = 2
ROUNDS = 2
#: The frequent shingles that are told apart for the order of columns; any choice gives the same links.
FREQUENT_KEPT = 1 << 18
FREQUENT = 32
#: Bytes of text that are shingled at once, and in which a task counts shingles.
PIECE = 1 << 19
WINDOW = 8 << 20
#: A column with so many rows in a window is spread over SALTS tasks.
OFTEN = 3
SALTS = 256
SLICE = 1024
#: So many earlier columns of a row are looked through for one that a pair has met in already.
BEFORE = 16
#: Stands for a missing doc_id.
_NONE = -(1 << 63)


def _least(n):
    """ceil(0.8 n), on numbers and columns."""
    return (4 * n + 4) // 5


def _signature(values: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(values.tobytes()) - (1 << 63)


def describe(docs: DataFrame) -> DataFrame:
    """kind 0: doc_id a, signature b and size n of each row; kind 1: a frequent shingle a and its count n in a window."""

    def run(source):
        shingler, held, size = Shingler(), [], 0
        for whole in source:
            for batch in pieces(whole, "text", PIECE):
                sets = shingler.sets(batch.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.zeros(len(sets), np.int32)),
                        batch.column("doc_id"),
                        pa.array([_signature(s) for s in sets], pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                    ],
                    names=["kind", "a", "b", "n"],
                )
                held += sets
                size += batch.column("text").nbytes
                if size > WINDOW:
                    yield _counts(held)
                    held, size = [], 0
        yield _counts(held)

    used = docs.select(F.col("doc_id").cast("long"), "text")
    return used.mapInArrow(run, "kind int, a long, b long, n long")


def _counts(sets: list[np.ndarray]) -> pa.RecordBatch:
    values, counts = np.unique(np.concatenate(sets or [np.zeros(0, np.uint64)]), return_counts=True)
    often = counts >= OFTEN
    values, counts = values[often], counts[often]
    kind = pa.array(np.ones(len(values), np.int32))
    return pa.RecordBatch.from_arrays(
        [kind, pa.array(values.view(np.int64)), pa.nulls(len(values), pa.int64()), pa.array(counts, pa.int64())], names=["kind", "a", "b", "n"]
    )


def frequent(described: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most FREQUENT_KEPT shingles, sorted, and the logarithm of their counts."""
    top = (
        described.filter("kind = 1")
        .groupBy("a")
        .agg(F.sum("n").alias("n"))
        .filter(F.col("n") >= FREQUENT)
        .orderBy(F.desc("n"), "a")
        .limit(FREQUENT_KEPT)
        .toArrow()
    )
    keys, counts = top["a"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], np.log2(np.maximum(counts[order], 2)).astype(np.int64)


def _spread(key: np.ndarray, row: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Salt and flag of each entry: 1 one that is spread, 2 one that stays behind to say that its column is long."""
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    start = np.flatnonzero(new)
    flag = np.zeros(len(key), np.int32)
    flag[order] = np.repeat(np.diff(np.append(start, len(key))) >= OFTEN, np.diff(np.append(start, len(key))))
    first = order[start]
    flag[first[flag[first] == 1]] = 2
    flag[known] = 1
    salt = ((row.view(np.uint64) >> np.uint64(20)) % np.uint64(SALTS)).astype(np.int32)
    return np.where(flag == 1, salt, 0).astype(np.int32), flag


def leading_entries(docs: DataFrame, often: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """key, row, n, pos, salt, flag: the entries of each set's leading columns; the sets of a window count once."""
    shared = docs.sparkSession.sparkContext.broadcast(often)

    def run(source):
        shingler, (keys, level) = Shingler(), shared.value
        done: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray, int, int]] = []
        size = 0

        def flush():
            out, known, signs, sizes = zip(*held)
            held.clear()
            takes = np.array([len(x) for x in out])
            ends = np.cumsum(takes)
            key, row = np.concatenate(out).view(np.int64), np.repeat(np.array(signs, np.int64), takes)
            salt, flag = _spread(key, row, np.concatenate(known))
            columns = [key, row, np.repeat(np.array(sizes, np.int32), takes), (np.arange(ends[-1]) - np.repeat(ends - takes, takes)).astype(np.int32), salt, flag]
            whole = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "row", "n", "pos", "salt", "flag"])
            for at in range(0, whole.num_rows, 100_000):
                yield whole.slice(at, 100_000)

        for whole in source:
            for batch in pieces(whole, "text", PIECE):
                for values in shingler.sets(batch.column("text")):
                    if not len(values) or (sign := _signature(values)) in done:
                        continue
                    if len(done) > 200_000:
                        done.clear()
                    done.add(sign)
                    n = len(values)
                    take = n - _least(n) + 1
                    hit = np.zeros(n, bool)
                    if len(keys):
                        at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
                        hit = keys[at] == values
                        if hit.any():
                            order = np.argsort(np.where(hit, level[at], 0), kind="stable")[:take]
                            values, hit = values[order], hit[order]
                    held.append((values[:take].copy(), hit[:take].copy(), sign, n))
                size += batch.column("text").nbytes
                if size > WINDOW and held:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return docs.select("text").mapInArrow(run, "key long, row long, n int, pos int, salt int, flag int")


def _sized(na, nb):
    """Whether the sizes of two sets let them link (arrays)."""
    return 5 * np.minimum(na, nb) >= 4 * np.maximum(na, nb)


def _roomy(na, pa_, nb, pb):
    """Whether two sets whose first common column is the pa-th and pb-th can still link (arrays)."""
    return 9 * np.minimum(na - pa_, nb - pb) >= 4 * (na + nb)


def _multiplied(source):
    """Of entries sorted by column and row: the pairs of short columns (a, b, na, nb, pos: 1 if there is room) and the entries of long ones (key, a, na, pos)."""
    names = ["key", "row", "n", "pos", "flag"]
    held, going = None, None
    last = [np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int32, np.int32)]
    for batch in _and_end(source):
        key, row, n, pos, flag = (batch.column(c).to_numpy() for c in names) if batch is not None else last
        if held is not None:
            key, row, n, pos, flag = (np.concatenate(x) for x in zip(held, (key, row, n, pos, flag)))
            held = None
        if not len(key):
            continue
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        start = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        fresh = new.copy()
        fresh[1:] |= row[1:] != row[:-1]
        count = np.add.reduceat(fresh.astype(np.int64), start)
        long = (count > LONG) | (np.maximum.reduceat(flag, start) > 0)
        if going is not None:
            long[0] |= key[0] == going
        going = None
        if batch is not None:
            if long[-1]:
                going = key[-1]
            else:
                held = [x[start[-1] :] for x in (key, row, n, pos, flag)]
                fresh[start[-1] :] = False
        at = np.flatnonzero(fresh & long[group])
        if len(at):
            yield _out(key[at], row[at], None, n[at], None, pos[at])
        at = np.flatnonzero(fresh & ~long[group])
        k, r, n, pos = key[at], row[at], n[at], pos[at]
        for d in range(1, LONG):
            i = np.flatnonzero(k[d:] == k[:-d])
            i = i[_sized(n[i], n[i + d])]
            if len(i):
                room = _roomy(n[i], pos[i], n[i + d], pos[i + d])
                yield _out(None, r[i], r[i + d], n[i], n[i + d], room.astype(np.int32))


def _and_end(source):
    yield from source
    yield None


def _out(key, a, b, na, nb, pos) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    columns = [pa.nulls(len(a), t) if x is None else pa.array(x, t) for x, t in zip((key, a, b, na, nb, pos), kinds)]
    return pa.RecordBatch.from_arrays(columns, names=["key", "a", "b", "na", "nb", "pos"])


def multiply(docs: DataFrame, described: DataFrame, space: Workspace) -> tuple[DataFrame, DataFrame]:
    """The pairs of the short columns (a < b, na, nb, c: common columns, room), and the entries of the long ones (key, row, n, pos)."""
    dealt = leading_entries(docs, frequent(described)).repartition("key", "salt").sortWithinPartitions("key", "row")
    both = space.keep(dealt.mapInArrow(_multiplied, "key long, a long, b long, na int, nb int, pos int"), True)
    met = both.filter("b IS NOT NULL").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"), F.max("pos").alias("room"))
    long = both.filter("key IS NOT NULL").select("key", F.col("a").alias("row"), F.col("na").alias("n"), "pos")
    return space.keep(met, True), long


def discard(pairs: DataFrame, counted: DataFrame | None, keys: DataFrame) -> DataFrame:
    """Drops the pairs whose common leading columns, short (c, or else by ``counted``) and long ones (``keys``), cannot reach the bound."""
    x, y = (keys.select(F.col("row").alias(s), F.col("k").alias("k" + s)) for s in "ab")
    if counted is not None:
        pairs = pairs.join(counted.select("a", "b", "c"), ["a", "b"], "left")
    none = F.array().cast("array<bigint>")
    met = F.coalesce("c", F.lit(0)) + F.size(F.array_intersect(F.coalesce("ka", none), F.coalesce("kb", none)))
    rest = lambda n: F.expr(f"(4 * {n} + 4) div 5 - 1")  # noqa: E731  columns that do not lead
    held = 9 * (met + F.greatest(rest("na"), rest("nb"))) >= 4 * (F.col("na") + F.col("nb"))
    return pairs.join(x, "a", "left").join(y, "b", "left").filter(held).select("a", "b", "na", "nb")


def _room(na, pa_, nb, pb):
    """As :func:`_sized` and :func:`_roomy`, on columns."""
    total = 4 * (F.col(na) + F.col(nb))
    return (9 * F.least(F.col(na) - F.col(pa_), F.col(nb) - F.col(pb)) >= total) & (5 * F.least(na, nb) >= 4 * F.greatest(na, nb))


def _unordered(pairs: DataFrame) -> DataFrame:
    """a < b of pairs (row1, n1, row2, n2)."""
    turned = F.col("row1") > F.col("row2")
    pick = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x))
    return pairs.select(pick("row1", "row2").alias("a"), pick("row2", "row1").alias("b"), pick("n1", "n2").alias("na"), pick("n2", "n1").alias("nb"))


def _ended(rows: DataFrame, end: str) -> DataFrame:
    return rows.select("key", *[F.col(c).alias(c + end) for c in rows.columns if c != "key"])


def _followers(long: DataFrame, turn: int, space: Workspace) -> DataFrame:
    """Pairs of rows with a few leaders of their columns: first those that have the fewest rarer columns, which copies resemble most."""
    own = (F.col("pos") / F.col("n") if turn == 0 else F.lit(0.0)).alias("own")
    drawn = F.xxhash64("row", F.lit(turn))
    leaders = long.groupBy("key", F.pmod(drawn, F.lit(LEADERS)).alias("place")).agg(F.min(F.struct(own, drawn.alias("drawn"), "row", "n", "pos", "label")).alias("x"))
    # written first: a join of plain exchanges, in which Spark can split a long column
    leaders = space.keep(leaders.select("key", "x.*"), True)
    met = _ended(leaders, "1").join(_ended(long, "2"), "key").filter("label1 <> label2").filter(_room("n1", "pos1", "n2", "pos2"))
    # those that a row meets in most columns
    often = met.groupBy("row1", "n1", "row2", "n2").agg((-F.count("*")).alias("c"), F.min("own1").alias("own"), F.first("drawn1").alias("drawn"))
    best = often.groupBy("row2", "n2", F.pmod("drawn", F.lit(PARTNERS)).alias("place")).agg(F.min(F.struct("c", "own", "drawn", "row1", "n1")).alias("x"))
    return _unordered(best.select("x.row1", "x.n1", "row2", "n2")).distinct()


def _all_across(long: DataFrame, space: Workspace) -> DataFrame:
    """Every pair of rows of different components that share a long column and leave room, dealt out by column and band of sizes.

    A pair comes out of its first common column; only where that stands behind the first
    ``BEFORE`` open columns of a row, it comes out of a few more.
    """
    open_keys = space.keep(long.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("key"), True)
    held = long.join(open_keys, "key")
    listed = held.groupBy("row", "n", "label").agg(F.array_sort(F.collect_list(F.struct("pos", "key"))).alias("all"))
    band = F.floor(F.log("n") / F.log(F.lit(1.25))).cast("int").alias("band")
    each = listed.select("row", "n", "label", band, F.transform(F.slice("all", 1, BEFORE), lambda x: x["key"]).alias("head"), F.posexplode("all").alias("at", "x"))
    each = space.keep(each.select("row", "n", "label", "band", "x.pos", "x.key", F.slice("head", F.lit(1), F.col("at")).alias("before")), True)
    # the smaller set needs the column within its first n - ceil(8 n / 9) + 1
    smaller = each.filter("pos <= n div 9").withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1, F.col("band") + 2)))
    x, y = (t.select("key", "band", *[F.col(c).alias(c + end) for c in ("row", "n", "pos", "label", "before")]) for t, end in ((smaller, "1"), (each, "2")))
    first = ~F.arrays_overlap("before1", "before2")
    met = x.join(y, ["key", "band"]).filter("label1 <> label2 AND (n1 < n2 OR (n1 = n2 AND row1 <> row2))").filter(_room("n1", "pos1", "n2", "pos2") & first)
    return _unordered(met).distinct()


def _levels(n: int) -> list[int]:
    """In how many slices a set of n shingles is cut: once for itself, and once more if a larger partner is cut finer."""
    cuts = lambda m: 1 << max(0, (m - 1) // SLICE).bit_length()
    return sorted({cuts(n), cuts(n * 5 // 4)})


def _sets(docs: DataFrame, wanted: DataFrame, classes: DataFrame) -> DataFrame:
    """row, parts, part, shingles: slices of the wanted sets and a few more: a bitmap of fixed size holds most other texts back."""
    asked = wanted.join(classes, "row").select(F.coalesce("rep", F.lit(_NONE)).alias("rep"))
    shared = docs.sparkSession.sparkContext.broadcast(bitmaps.build(asked, "rep"))

    def run(source):
        shingler = Shingler()
        for whole in source:
            whole = whole.filter(pa.array(bitmaps.hit(shared.value, whole.column("spot").to_numpy())))
            for batch in pieces(whole, "text", PIECE):
                out = []
                for values in shingler.sets(batch.column("text")):
                    if not len(values):
                        continue
                    sign = _signature(values)
                    for parts in _levels(len(values)):
                        bits = parts.bit_length() - 1
                        edges = np.searchsorted(values, np.arange(1, parts, dtype=np.uint64) << np.uint64(64 - bits)) if bits else []
                        out += [(sign, parts, k, s.tobytes()) for k, s in enumerate(np.split(values, edges))]
                if out:
                    columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.binary()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["row", "parts", "part", "shingles"])

    used = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("rep"), "text").filter("text IS NOT NULL")
    return used.withColumn("spot", bitmaps.spot("rep")).mapInArrow(run, "row long, parts int, part int, shingles binary")


def verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs that link, by their whole sets: each pair meets slice by slice, and the counts of common shingles are added."""

    def run(source):
        for batch in source:
            held = [
                len(np.intersect1d(np.frombuffer(u.as_py(), np.uint64), np.frombuffer(v.as_py(), np.uint64), True))
                for u, v in zip(batch.column("sa"), batch.column("sb"))
            ]
            yield batch.select(["a", "b", "need", "part"]).append_column("n", pa.array(held, pa.int64()))

    wanted = pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct()
    sets = _sets(docs, wanted, classes)
    need = F.expr("(4 * (na + nb) + 8) div 9")
    parts = F.expr(f"CAST(shiftleft(1, CAST(ceil(log2(greatest(1, (greatest(na, nb) - 1) div {SLICE} + 1))) AS INT)) AS INT)")
    dealt = pairs.select("a", "b", need.alias("need"), parts.alias("parts")).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
    x, y = (sets.select(F.col("row").alias(s), "parts", "part", F.col("shingles").alias("s" + s)) for s in "ab")
    met = dealt.join(y, ["b", "parts", "part"]).join(x, ["a", "parts", "part"]).select("a", "b", "need", "part", "sa", "sb")
    counted = met.mapInArrow(run, "a long, b long, need long, part int, n long")
    # several copies of a set may come out of the texts: a slice counts once
    total = F.aggregate(F.collect_set(F.struct("part", "n")), F.lit(0).cast("long"), lambda x, s: x + s["n"])
    return counted.groupBy("a", "b", "need").agg(total.alias("n")).filter("n >= need").select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node that each linked node reaches (smallest neighbour's label, then the label's label)."""
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")))
    total = None
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("m"))
        new = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        new = new.join(jump, F.col("label") == F.col("via"), "left").select("node", F.least("label", "far").alias("label"))
        labels = cut(new)
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return labels
        total = now


def link_classes(docs: DataFrame, described: DataFrame, classes: DataFrame) -> DataFrame | None:
    """node, label of every class that links with another one; None if no two share a leading column."""
    space = Workspace(docs.sparkSession)
    counted, long = multiply(docs, described, space)
    keys = space.keep(long.groupBy("row").agg(F.collect_set("key").alias("k")), True)
    pairs = space.keep(discard(counted.filter("room = 1"), None, keys), True)
    space.tidy()
    labels, links = None, []
    for turn in range(ROUNDS + 1):
        open_pairs, open_long = _across(pairs, labels), _labelled(long, labels)
        if turn < ROUNDS:
            ends = open_pairs.selectExpr("a AS u", "na AS m", "b AS v", "nb AS n").union(open_pairs.selectExpr("b", "nb", "a", "na"))
            one = ends.groupBy("u", "m").agg(F.min(F.struct(F.xxhash64("v", F.lit(turn)), "v", "n")).alias("x"))
            one = _unordered(one.selectExpr("u AS row1", "m AS n1", "x.v AS row2", "x.n AS n2"))
            chosen = one.union(discard(_followers(open_long, turn, space), counted, keys)).distinct()
        else:
            chosen = open_pairs.union(discard(_all_across(open_long, space), counted, keys)).distinct()
        chosen = cut(chosen.coalesce(fewer_parts(docs.sparkSession)))
        space.tidy()
        found = cut(verify(chosen, docs, classes).coalesce(fewer_parts(docs.sparkSession)))
        space.tidy()
        if found.isEmpty():
            if turn == ROUNDS or chosen.isEmpty():
                break
            continue
        links.append(found)
        labels = components(reduce(DataFrame.union, links))
    space.close()
    return labels


def _labelled(long: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return long.withColumn("label", F.col("row"))
    known = labels.withColumnRenamed("node", "row")
    return long.join(known, "row", "left").withColumn("label", F.coalesce("label", "row")).select("key", "row", "n", "pos", "label")


def _across(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return pairs
    x, y = (labels.select(F.col("node").alias(s), F.col("label").alias("l" + s)) for s in "ab")
    joined = pairs.join(x, "a", "left").join(y, "b", "left")
    return joined.filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b", "na", "nb")


def link(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id."""
    described = cut(describe(docs))
    rows = described.filter("kind = 0")
    # written, so that joins with it can split a large group of copies
    classes = cut(rows.filter("n > 0").groupBy(F.col("b").alias("row")).agg(F.min("a").alias("rep")))
    labels = link_classes(docs, described, classes)
    least = classes.withColumnRenamed("rep", "component_id")
    if labels is not None:
        named = classes.join(labels.withColumnRenamed("node", "row"), "row", "left").withColumn("label", F.coalesce("label", "row"))
        first = cut(named.groupBy("label").agg(F.min("rep").alias("component_id")))
        least = cut(named.join(first, "label").select("row", "component_id"))
    return rows.join(least.withColumnRenamed("row", "b"), "b", "left").select(
        F.col("a").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("a")).alias("component_id"),
    )


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))
                               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.y, r.c FROM reach r JOIN e ON e.x = r.doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM reach GROUP BY 1) r USING (doc_id)
"""
