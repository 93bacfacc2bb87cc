"""Removal of passages that occur before, by hashing their units.

Units of a text, each normalised to its lower-cased words:

* every line that has a word (and so every paragraph, which is its lines);
* every shortest run of whole sentences that has ``LEAST_WORDS`` words, from each sentence on
  (``. ! ?`` or a line's end closes a sentence; one of more than ``LONG_WORDS`` words is also
  cut behind words that their hash picks), since lines alone would miss what stands inside
  another document's line;
* every run of ``run_words`` words, wherever it begins, so that a longer passage that occurs
  before goes from its first word to its last.

Units' 64-bit digests are grouped globally; the earliest ranked occurrence (smallest doc_id,
then place in the text) stays, every other one goes, with its offsets in the original text
retained.  (Of 10^9 different units, any two share a digest with odds of 3 in 100.)  Between
two words, what stands up to the last end of a sentence goes with the word before, the rest
with the word behind; without such an end all of it goes with the word before.

Most units stand nowhere else, so they are held back first: the digests alone are counted,
and a bitmap of those that repeat (of fixed size; false hits cost only work) decides which
units are dealt out with their places.  For runs of words the digests counted are anchors, by
winnowing: the smallest hash of ``GRAM`` words in each window of ``run_words`` words, so equal
windows have equal anchors.  Windows in a row with one anchor are a block, and blocks are
grouped first.  A copy of a block goes whole if it is not the earliest.  Windows are grouped
one by one only in the earliest copies, and only if blocks with the same anchor differ:
otherwise equal windows stand in equal blocks.

Null texts stay null and empty texts empty, with nothing removed.  Rows without doc_id
rank behind all others.  Rows that share a doc_id take nothing from each other: they
count as one document.  Where occurrences of a unit overlap in one text, those that begin
inside the first one are no repetition of it.  Very long texts are worked on whole, one at
a time.  An empty table gives an empty result.  Input columns named like an output are
replaced.

The grouping is an aggregate with partial results and a join that splits hot digests
(adaptive skew join); a common line is never gathered in one place.  Only texts that lose
something are shuffled.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bitmaps
from .batches import WORD_BYTES, flat_bytes, pieces
from .shared import Workspace, small_batches

LEAST_WORDS = 8
LONG_WORDS = 24
#: One word in so many ends a part of a long sentence.
PART = 8
#: Repeated passages of over 50 words go whole.
RUN_WORDS = 51
GRAM = 16
#: Bytes of text that are worked on at once.
PIECE = 1 << 18
#: Bits of the maps of digests.
BITS = 1 << 26
_LAST = (1 << 63) - 1

_IN_WORD = np.frombuffer(WORD_BYTES, np.uint8) != 32
_LOWER = np.frombuffer(WORD_BYTES, np.uint8).astype(np.uint64)
_CLOSES = np.isin(np.arange(256), list(b".!?\n"))

_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def _mixed(values: np.ndarray, seed: np.ndarray | np.uint64 = np.uint64(42)) -> np.ndarray:
    """Spark's xxhash64 of a column of longs; the seed for a further column is what those before give."""
    turn = lambda v, k: v << np.uint64(k) | v >> np.uint64(64 - k)
    h = (seed + np.uint64(8) + _P5) ^ turn(values * _P2, 31) * _P1
    h = turn(h, 27) * _P1 + _P4
    h = (h ^ h >> np.uint64(33)) * _P2
    h = (h ^ h >> np.uint64(29)) * _P3
    return h ^ h >> np.uint64(32)


def _sums(values: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """A mixed polynomial hash of values[begin:end] for each pair, the same wherever they stand."""
    n = len(values)
    powers = lambda b: np.multiply.accumulate(np.append(np.uint64(1), np.full(n, b, np.uint64)))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * powers(base)[:n], dtype=np.uint64)))
    return _mixed((total[end] - total[begin]) * powers(pow(base, -1, 1 << 64))[begin])


class Words(NamedTuple):
    """The words of some texts end to end: hash, row, first and last byte + 1; each row's first word (rows + 1)."""

    hashes: np.ndarray
    row: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray
    data: np.ndarray
    bounds: np.ndarray

    def place(self, at: np.ndarray) -> np.ndarray:
        """The words' numbers in their rows."""
        return at - self.first[self.row[at]]


def words_of(column: pa.Array) -> Words:
    data, bounds = flat_bytes(column)
    inside = _IN_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    begin = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1]))))
    end = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    hashes = _sums(_LOWER[data], begin, end, 0x9FB21C651E98DF25)
    return Words(hashes, np.searchsorted(bounds, begin, "right") - 1, begin, end, np.searchsorted(begin, bounds), data, bounds)


def units(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digest, first word and last word + 1 of every line and run of sentences."""
    n = len(words.row)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def opens(marked: np.ndarray) -> np.ndarray:
        """The words with a marked byte, or a row's beginning, between them and the word before."""
        seen = np.concatenate(([0], np.cumsum(marked[words.data])))
        out = np.ones(n, bool)
        out[1:] = (words.row[1:] != words.row[:-1]) | (seen[words.begin[1:]] > seen[words.end[:-1]])
        return out

    sentence = opens(_CLOSES)
    start = np.flatnonzero(sentence)
    long = np.repeat(np.diff(np.append(start, n)) > LONG_WORDS, np.diff(np.append(start, n)))
    sentence[1:] |= (long & ((words.hashes >> np.uint64(32)) % np.uint64(PART) == 0))[:-1]
    start = np.flatnonzero(sentence)
    ends = np.append(start[1:], n)
    last = np.searchsorted(ends, start + LEAST_WORDS)
    whole = last < len(ends)
    start, end = start[whole], ends[last[whole]]
    own = words.row[start] == words.row[end - 1]
    start, end = start[own], end[own]
    line = np.flatnonzero(opens(np.arange(256) == 10))
    close = np.append(line[1:], n)
    digests = _sums(words.hashes, start, end, 0x8CB92BA72F3D8DD7), _sums(words.hashes, line, close, 0xAEF17502108EF2D9)
    return np.concatenate(digests), np.concatenate((start, line)), np.concatenate((end, close))


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and anchor of each run of ``size`` words."""
    n = len(words.row) - size + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    spread = size - GRAM + 1
    grams = np.arange(len(words.row) - GRAM + 1)
    least, width = _sums(words.hashes, grams, grams + GRAM, 0xD6E8FEB86659FD93), 1
    while width < spread:
        step = min(width, spread - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    at = np.flatnonzero(words.row[:n] == words.row[size - 1 :])
    return at, least[at]


def blocks(words: Words, at: np.ndarray, anchor: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Anchor, digest, first word and last word + 1, and number of windows of each block."""
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (anchor[1:] != anchor[:-1])
    start = np.flatnonzero(new)
    # one place is the anchor of size - GRAM + 1 windows at most; a text that repeats itself has longer runs
    new[(np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))) % (size - GRAM + 1) == 0] = True
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(at)))
    end = at[start] + size + count - 1
    return anchor[start], _sums(words.hashes, at[start], end, 0xE7037ED1A0B428DB), at[start], end, count


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together (else as they stand), and where each group begins in it."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order, np.flatnonzero(new)


def digest_table(docs: DataFrame, size: int | None) -> DataFrame:
    """h, n: the digests of units and the anchors of blocks in each piece of the texts, and how often they stand there."""

    def run(source):
        for whole in source:
            for batch in pieces(whole, "text", PIECE):
                words = words_of(batch.column("text"))
                found = [units(words)[0]]
                if size is not None:
                    found.append(blocks(words, *windows(words, size), size)[0])
                values, counts = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int32))], names=["h", "n"])

    return docs.select("text").mapInArrow(run, "h long, n int")


_PLACE = "h long, anchor long, doc long, sig long, first int, end int, again boolean"


def _placed(batch: pa.RecordBatch, words: Words, h, first, end, anchor=None) -> pa.RecordBatch:
    row = words.row[first]
    # what begins inside a text's first occurrence is no repetition of it
    order, start = _groups(row, h)
    since = np.empty(len(order), np.int64)
    since[order] = np.repeat(first[order[start]], np.diff(np.append(start, len(order))))
    at = pa.array(row, pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(h.view(np.int64)),
            pa.nulls(len(h), pa.int64()) if anchor is None else pa.array(anchor.view(np.int64)),
            batch.column("doc").take(at),
            batch.column("sig").take(at),
            pa.array(words.place(first), pa.int32()),
            pa.array(words.place(first) + end - first, pa.int32()),
            pa.array(first - since >= end - first),
        ],
        names=["h", "anchor", "doc", "sig", "first", "end", "again"],
    )


def _rank(doc_id):
    return F.coalesce(doc_id.cast("long"), F.lit(_LAST))


def _signature(text):
    return F.xxhash64(text)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(_rank(docs["doc_id"]).alias("doc"), _signature(docs["text"]).alias("sig"), "text")


def _spots(h: np.ndarray) -> np.ndarray:
    return np.mod(_mixed(h).view(np.int64), BITS)


def unit_table(docs: DataFrame, repeated: np.ndarray, size: int | None) -> DataFrame:
    """The places (words first to end) of units whose digest repeats and, with their anchor, of blocks whose anchor does."""
    shared = docs.sparkSession.sparkContext.broadcast(repeated)

    def run(source):
        for whole in source:
            for batch in pieces(whole, "text", PIECE):
                words = words_of(batch.column("text"))
                h, first, end = units(words)
                held = bitmaps.hit(shared.value, _spots(h))
                yield _placed(batch, words, h[held], first[held], end[held])
                if size is not None:
                    anchor, h, first, end, _ = blocks(words, *windows(words, size), size)
                    held = bitmaps.hit(shared.value, _spots(anchor))
                    yield _placed(batch, words, h[held], first[held], end[held], anchor[held])

    return _keyed(docs).mapInArrow(run, _PLACE)


def window_table(docs: DataFrame, contested: np.ndarray, earliest: np.ndarray, size: int) -> DataFrame:
    """The places of the runs of ``size`` words in the earliest copies of blocks whose anchor is contested."""
    shared = docs.sparkSession.sparkContext.broadcast((contested, earliest))

    def run(source):
        contested, earliest = shared.value
        for whole in source:
            for batch in pieces(whole, "text", PIECE):
                words = words_of(batch.column("text"))
                at, anchor = windows(words, size)
                anchor, h, first, _, count = blocks(words, at, anchor, size)
                doc = batch.column("doc").to_numpy()[words.row[first]].view(np.uint64)
                held = bitmaps.hit(contested, _spots(anchor)) & bitmaps.hit(earliest, _spots(_mixed(doc, _mixed(h))))
                at = at[np.repeat(held, count)]
                yield _placed(batch, words, _sums(words.hashes, at, at + size, 0xA0761D6478BD642F), at, at + size, np.zeros(len(at), np.int64))

    return _keyed(docs).mapInArrow(run, _PLACE)


def _least(found: DataFrame) -> DataFrame:
    return found.groupBy("h").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.max("again").alias("any_again"))


def _gone(found: DataFrame, least: DataFrame) -> DataFrame:
    # both sides of the join are written tables, so plain exchanges, whose hot partitions Spark can split
    repeated = least.filter("least <> most OR any_again").select("h", "least")
    run = F.col("anchor").isNotNull().alias("run")
    return found.join(repeated, "h").filter("doc > least OR again").select("doc", "sig", "first", "end", run)


def removals(docs: DataFrame, space: Workspace, run_words: int | None = None) -> DataFrame:
    """doc, sig, gone: the words (first to end) of each text that occur before, and whether they do as a run of ``run_words``."""
    counted = digest_table(docs, run_words).groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1")
    with small_batches(docs.sparkSession):
        repeated = bitmaps.build(counted, "h", BITS)
    space.tidy()
    found = space.keep(unit_table(docs, repeated, run_words))
    least = space.keep(_least(found), True)
    parts = [space.keep(_gone(found, least), True)]
    space.tidy()
    if run_words is not None:
        copies = found.filter("anchor IS NOT NULL").select("h", "anchor")
        several = copies.groupBy("anchor").agg(F.min("h").alias("x"), F.max("h").alias("y")).filter("x <> y")
        contested = bitmaps.build(several, "anchor", BITS)
        first = copies.select("h").distinct().join(least, "h").select(F.xxhash64("h", "least").alias("o"))
        earliest = bitmaps.build(first, "o", BITS)
        space.drop(found, least)
        space.tidy()
        found = space.keep(window_table(docs, contested, earliest, run_words))
        least = space.keep(_least(found), True)
        parts.append(space.keep(_gone(found, least), True))
        space.tidy()
    space.drop(found, least)
    gone = parts[0].union(parts[1]) if len(parts) > 1 else parts[0]
    out = space.keep(gone.groupBy("doc", "sig").agg(F.collect_set(F.struct("first", "end", "run")).alias("gone")), True)
    space.drop(*parts)
    space.tidy()
    return out


SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def _owners(words: Words) -> np.ndarray:
    """The word that each byte goes with (-1 in texts without a word)."""
    size, n = len(words.data), len(words.row)
    if not n:
        return np.full(size, -1)
    owner = np.searchsorted(words.begin, np.arange(size), "right") - 1
    byte_row = np.searchsorted(words.bounds, np.arange(size), "right") - 1
    # bytes before a row's first word go with it
    owner = np.maximum(owner, words.first[byte_row])
    owner[words.first[byte_row] == words.first[byte_row + 1]] = -1
    # so do those behind the last end of a sentence that stands before a word
    closes = np.concatenate(([-1], np.flatnonzero(_CLOSES[words.data])))
    close = closes[np.searchsorted(closes, words.begin) - 1]
    later = np.flatnonzero((words.place(np.arange(n)) > 0) & (close >= np.concatenate(([0], words.end[:-1]))))
    begin = close[later] + 1
    blank = np.concatenate((words.data != 32, [True]))
    stop = np.flatnonzero(blank)
    on_line = words.data[close[later]] != 10
    begin[on_line] = stop[np.searchsorted(stop, begin[on_line])]
    size_ = words.begin[later] - begin
    spots = np.repeat(begin, size_) + np.arange(size_.sum()) - np.repeat(np.cumsum(size_) - size_, size_)
    owner[spots] = np.repeat(later, size_)
    return owner


def cut_out(column: pa.Array, gone: pa.ListArray) -> list[pa.Array]:
    """The texts without the given words, the removed spans (in characters), the number of words removed, and whether a run went."""
    words = words_of(column)
    offsets = gone.offsets.to_numpy()[: len(column) + 1]
    row = np.repeat(np.arange(len(column)), np.diff(offsets))
    places = gone.values.slice(offsets[0], offsets[-1] - offsets[0])
    first, end = (places.field(k).to_numpy() + words.first[row] for k in ("first", "end"))
    change = np.zeros(len(words.row) + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, end, -1)
    lost = np.append(np.cumsum(change[:-1]) > 0, False)  # the last one for bytes without a word
    out = lost[_owners(words)]
    char = np.concatenate(([0], np.cumsum((words.data & 0xC0) != 0x80)))
    edge = np.zeros(len(out) + 1, bool)
    edge[1:-1] = out[1:] != out[:-1]
    edge[words.bounds] = True
    cuts = np.flatnonzero(edge)
    head = cuts[:-1]
    removed = out[head] if len(head) else np.zeros(0, bool)
    of = np.searchsorted(words.bounds, head, "right") - 1
    base = char[words.bounds[of]]
    start, stop = char[head] - base, char[cuts[1:]] - base
    spans = pa.StructArray.from_arrays([pa.array(x[removed], pa.int32()) for x in (start, stop)], names=["start", "end"])
    sizes = np.add.reduceat(np.append(~out, False).astype(np.int64), words.bounds[:-1]) if len(column) else np.zeros(0, np.int64)
    sizes[np.diff(words.bounds) == 0] = 0
    total = np.zeros(len(column) + 1, np.int64)
    np.cumsum(sizes, out=total[1:])
    text = pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(total.tobytes()), pa.py_buffer(words.data[~out].tobytes())).cast(pa.string())
    run = np.zeros(len(column), bool)
    run[row[places.field("run").to_numpy(zero_copy_only=False)]] = True
    offsets = np.zeros(len(column) + 1, np.int32)
    np.cumsum(np.bincount(of[removed], minlength=len(column)), out=offsets[1:])
    number = np.bincount(words.row, weights=lost[:-1], minlength=len(column)).astype(np.int64)
    whole = pa.compute.if_else(column.is_null(), pa.scalar(None, pa.string()), text)
    return [whole, pa.ListArray.from_arrays(pa.array(offsets), spans), pa.array(number), pa.array(run)]


def deduplicate(docs: DataFrame, run_words: int | None = RUN_WORDS) -> DataFrame:
    """The documents with ``text`` shortened; adds ``removed`` (spans of the original text), ``n_removed`` (words) and ``has_run``.

    ``has_run`` tells that a run of ``run_words`` words went; with None, only lines and runs of
    sentences go.  ``n_chars``, where the input has it, is brought up to date.
    """
    added = [T.StructField("removed", T.ArrayType(SPAN)), T.StructField("n_removed", T.LongType()), T.StructField("has_run", T.BooleanType())]
    names = [c for c in docs.columns if c.lower() not in ("removed", "n_removed", "has_run")]
    docs = docs.select(*names)
    keyed = docs.select(
        F.struct(*[docs[c] for c in names if c != "text"]).alias("row"),
        docs["text"],
        _rank(docs["doc_id"]).alias("doc"),
        _signature(docs["text"]).alias("sig"),
    )
    space = Workspace(docs.sparkSession)
    gone = removals(docs, space, run_words)
    losing, whole = bitmaps.parted(keyed, "doc", gone, "doc")
    nothing = F.array().cast(gone.schema["gone"].dataType)
    joined = losing.join(gone, ["doc", "sig"], "left").select("row", "text", F.coalesce("gone", nothing).alias("gone"))
    schema = T.StructType([joined.schema["row"], joined.schema["text"], *added])

    def run(source):
        for whole in source:
            for batch in pieces(whole, "text", PIECE):
                out = cut_out(batch.column("text"), batch.column("gone"))
                yield pa.RecordBatch.from_arrays([batch.column("row"), *out], names=["row", "text", "removed", "n_removed", "has_run"])

    none = [F.array().cast(added[0].dataType).alias("removed"), F.lit(0).cast("long").alias("n_removed"), F.lit(False).alias("has_run")]
    made = joined.mapInArrow(run, schema).union(whole.select("row", "text", *none))
    back = [F.col("text") if c == "text" else F.char_length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in names]
    return made.select(*back, "removed", "n_removed", "has_run")
