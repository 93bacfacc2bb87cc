"""Benchmark decontamination over suffix arrays of the training text.

Each shard (a bounded piece of a partition's documents) is turned into a suffix
array over words; every suffix of every benchmark item is searched in it by
binary search, word by word, which gives the longest verbatim matches and where
they stand.  Documents with a match of at least a window are contaminated.

The benchmark travels to the shards in blocks of at most ``block_words`` words
(a single longer item is a block of its own).  A shard meets block after block in
one pass; a task holds at most ``HELD_BLOCKS`` of them at a time and reads the others
anew, so a benchmark of any size needs bounded memory.  Nothing is shuffled.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  A window
is ``window`` consecutive words of an item, or the whole item if it has fewer.
Null and empty texts have no words and match nothing; a very long text is a shard of
its own; a null item text is an item
without words; an item with a null id still marks words as hit but is not listed.
Repeated rows are each judged alone; items that share windows are all listed.  An
empty benchmark leaves every document clean.  Input columns that bear the name of
an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import add_columns, raw_texts, words_of

WINDOW = 10
BLOCK_WORDS = 250_000
HELD_BLOCKS = 4

MATCH = T.StructType(
    [
        T.StructField("item_id", T.StringType()),
        T.StructField("item_start", T.IntegerType()),
        T.StructField("doc_start", T.IntegerType()),
        T.StructField("n_words", T.IntegerType()),
    ]
)
_ARROW_MATCH = pa.struct(
    [("item_id", pa.string()), ("item_start", pa.int32()), ("doc_start", pa.int32()), ("n_words", pa.int32())]
)


class Block:
    """Some benchmark items as numbers of their own vocabulary (from 1; 0 is any other word)."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        number = self.vocabulary.setdefault
        self.words = np.array([number(w, len(self.vocabulary) + 1) for _, ws in items for w in ws], np.int32)
        sizes = np.array([len(ws) for _, ws in items], np.int64)
        self.item = np.repeat(np.arange(len(items)), sizes)
        starts = np.cumsum(sizes) - sizes
        self.place = np.arange(len(self.words)) - starts[self.item]
        self.left = sizes[self.item] - self.place
        self.window = np.minimum(window, sizes)[self.item]
        self.longest = int(sizes.max(initial=0))


def blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The benchmark's items in blocks; the driver holds one at a time."""
    held, n = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        words = words_of((row[1] or "").encode())
        if held and n + len(words) > block_words:
            yield held
            held, n = [], 0
        held.append((row[0], words))
        n += len(words)
    if n:
        yield held


def suffix_array(text: np.ndarray, depth: int, top: int) -> np.ndarray:
    """Places of ``text`` with a word > 0, sorted by the ``depth`` words from there on.

    A word 0 ends a suffix.  ``text`` must end in enough zeros for any look ahead.
    The first sort packs several words into one key; later rounds double the depth
    and sort only what is still tied.
    """
    bits = max(1, int(top).bit_length())
    step = min(max(1, 62 // bits), max(1, depth))
    n = len(text) - depth - step
    key = np.zeros(n, np.int64)
    ended = np.zeros(n, bool)
    for k in range(step):
        word = text[k : k + n]
        ended |= word == 0
        key <<= bits
        key |= np.where(ended, 0, word)
    places = np.flatnonzero(text[:n])
    key = key[places]
    order = np.argsort(key, kind="stable")
    places, key = places[order], key[order]
    new = np.ones(len(places), bool)
    new[1:] = key[1:] != key[:-1]
    rank = np.zeros(len(text), np.int64)
    first = np.flatnonzero(new)
    rank[places] = first[np.cumsum(new) - 1] + 1
    open_ = ~ended[places]
    while step < depth:
        tied = ~new
        tied[:-1] |= ~new[1:]
        slots = np.flatnonzero(tied & open_)
        if not len(slots):
            break
        p = places[slots]
        ahead = rank[np.minimum(p + step, len(rank) - 1)]
        order = np.lexsort((ahead, rank[p]))
        own, ahead, p = rank[p][order], ahead[order], p[order]
        places[slots] = p
        open_[slots] = ahead > 0
        fresh = np.ones(len(p), bool)
        fresh[1:] = (own[1:] != own[:-1]) | (ahead[1:] != ahead[:-1])
        new[slots] = fresh
        head = slots[fresh]
        rank[p] = head[np.cumsum(fresh) - 1] + 1
        step *= 2
    return places


def _bounds(text, places, low, high, depth, word, strict):
    """For each range of the suffix array, the first entry whose word at ``depth`` is >= (strict: >) ``word``."""
    low, high = low.copy(), high.copy()
    while True:
        going = np.flatnonzero(low < high)
        if not len(going):
            return low
        middle = (low[going] + high[going]) >> 1
        seen = text[places[middle] + depth]
        right = seen <= word[going] if strict else seen < word[going]
        low[going[right]] = middle[right] + 1
        high[going[~right]] = middle[~right]


def search(text: np.ndarray, places: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Looks up every benchmark suffix.

    Returns its longest match in words, and for each suffix that starts a window
    (its number, low, high): the entries of the suffix array that match the window.
    """
    count = len(block.words)
    longest = np.zeros(count, np.int64)
    low, high = np.zeros(count, np.int64), np.full(count, len(places), np.int64)
    active = np.arange(count)
    found = []
    depth = 0
    while len(active):
        active = active[block.left[active] > depth]
        word = block.words[np.minimum(active + depth, count - 1)]
        a = _bounds(text, places, low[active], high[active], depth, word, False)
        b = _bounds(text, places, a, high[active], depth, word, True)
        depth += 1
        held = a < b
        active, a, b = active[held], a[held], b[held]
        low[active], high[active], longest[active] = a, b, depth
        full = block.window[active] == depth
        found.append((active[full], a[full], b[full]))
    return longest, *(np.concatenate(x) for x in zip(*found, (np.zeros(0, np.int64),) * 3))


def shard_matches(texts: list[list[bytes]], block: Block) -> list[np.ndarray]:
    """Maximal verbatim matches of at least a window: (document, item, item_start, doc_start, n_words)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    known = np.fromiter(
        (i for words in texts for i in map(block.vocabulary.get, words, repeat(0))), np.int32, int(sizes.sum())
    )
    document = np.repeat(np.arange(len(texts)), sizes)
    text = np.zeros(len(known) + len(texts) + 2 * block.longest + 64, np.int32)
    text[np.arange(len(known)) + document] = known  # a zero parts the documents
    places = suffix_array(text, block.longest, len(block.vocabulary))
    _, suffix, low, high = search(text, places, block)
    n = high - low
    suffix = np.repeat(suffix, n)
    entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    place = places[entry]
    starts = np.cumsum(sizes + 1) - sizes - 1
    doc = np.searchsorted(starts, place, "right") - 1
    at, item, inside = place - starts[doc], block.item[suffix], block.place[suffix]
    # windows that follow each other in both texts are one match
    order = np.lexsort((at, at - inside, item, doc))
    doc, item, at, inside, size = doc[order], item[order], at[order], inside[order], block.window[suffix[order]]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (at[1:] != at[:-1] + 1) | (inside[1:] != inside[:-1] + 1)
    first = np.flatnonzero(new)
    run = np.diff(np.append(first, len(doc)))
    return [doc[first], item[first], inside[first], at[first], size[first] + run - 1]


def find_matches(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """Adds ``n_words`` and ``matches``: the maximal verbatim matches of at least a window with any item."""
    context = docs.sparkSession.sparkContext
    # plain values: a worker that has no copy of this package builds the blocks itself
    shared = [context.broadcast(items) for items in blocks(benchmark, block_words)]
    source = text
    if text in ("n_words", "matches"):
        source = "__text"
        docs = docs.withColumn(source, docs[text])

    def make():
        held: dict[int, Block] = {}

        def block_of(k: int) -> Block:
            if k in held:
                return held[k]
            block = Block(shared[k].value, window)
            shared[k].__dict__.pop("_value", None)  # what was read; it can be read again
            if len(held) < HELD_BLOCKS:
                held[k] = block
            return block

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = [words_of(t) for t in raw_texts(batch.column(source))]
            found, names = [np.zeros((5, 0), np.int64)], []
            for k in range(len(shared)):
                block = block_of(k)
                met = np.array(shard_matches(texts, block), np.int64)
                used, met[1] = np.unique(met[1], return_inverse=True)
                met[1] += len(names)
                names += [block.names[i] for i in used.tolist()]
                found.append(met)
            doc, item, inside, at, size = (x := np.concatenate(found, axis=1))[:, np.argsort(x[0], kind="stable")]
            new = pa.StructArray.from_arrays(
                [pa.array([names[i] for i in item.tolist()], pa.string()), *(pa.array(x, pa.int32()) for x in (inside, at, size))],
                fields=list(_ARROW_MATCH),
            )
            offsets = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
            return [pa.array([len(t) for t in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), new)]

        return compute

    fields = [T.StructField("n_words", T.LongType()), T.StructField("matches", T.ArrayType(MATCH))]
    docs = docs.drop("n_words", "matches")
    docs = add_columns(docs, fields, source, make)
    return docs.drop("__text") if source == "__text" else docs


def measure(matched: DataFrame) -> DataFrame:
    """Adds n_hit (words inside any match), items (their ids, sorted) and contaminated."""
    spans = F.array_sort(F.transform("matches", lambda m: F.struct(m["doc_start"].alias("a"), (m["doc_start"] + m["n_words"]).alias("b"))))
    covered = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["b"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(acc["end"], s["a"]))).alias("n"),
        ),
        lambda acc: acc["n"],
    )
    return matched.withColumns(
        {
            "n_hit": covered,
            "items": F.array_sort(F.array_distinct(F.filter(F.transform("matches", lambda m: m["item_id"]), lambda i: i.isNotNull()))),
        }
    ).withColumn("contaminated", F.col("n_hit") > 0)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents without any match, with their own columns."""
    columns = docs.columns
    keyed = docs.select(F.struct(*[docs[c] for c in columns]).alias("row"), docs[text].alias("text"))
    found = find_matches(keyed, benchmark, "text", window).filter(F.size("matches") == 0)
    return found.select([F.col("row")[c].alias(c) for c in columns])


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document, with a digest of the item ids."""
    return measure(find_matches(docs.select("doc_id", "text"), benchmark)).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


REPORT_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS k
  FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
place AS (
  SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS k
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM win) WHERE len(w) >= m)),
hit AS (SELECT DISTINCT doc_id, i, m, item_id FROM place JOIN win USING (m, k)),
words AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM hit) GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items.s, '')) AS items_sha256,
       coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
