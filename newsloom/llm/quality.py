"""Quality by perplexity under an interpolated modified Kneser-Ney model of words.

Words are runs of letters, digits and bytes beyond ASCII, lower-cased (A-Z) and with every
digit as one, or runs of other visible signs; each is a 31-bit hash, so an n-gram of
``ORDER`` = 2 words is one number.  The model is trained on all trusted documents.  Its
words' counts are the distinct words they were seen behind; both orders have three
discounts of their own, and an unseen word has its share of a vocabulary with one word more.

Trusted documents would look better than others to a model that has seen them.  So there are
two models, each of the trusted documents of one half (by a hash of doc_id), and every
document is scored by the model of the other half.

Keys are words and pairs of words.  A shard holds the keys that a hash gives it, sorted and
packed, so that what is written and sent is a few bytes for each key.  Each shard of pairs
sends the shards of words what its pairs say of them (how often a word is a history, how many
words it stands behind) and gets back their sums, with which it knows the values of its keys.

To score, values and texts meet in these shards.  A logarithm of probability is a sum over a
document's keys: for a word, what it has above an unseen one and its weight as a history,
which the last word has not; for a seen pair, what it has above its parts.  Values are whole
multiples of 1 / ``UNIT``, so sums do not depend on their order.  A block of documents sends
each shard its sorted keys and, for each key, the documents that hold it and how often; the
shard adds up what it knows for each document of the block, and a block's sums from all shards
are added.  Both what is sent and the model grow with the corpus, and so does the number of
shards.  A word that every document holds is one entry for each document.  Documents are dealt
to at most ``ROUNDS`` parts by a hash, scored one part after the other, so that only a part's keys and
sums are on disk at once; each document is in one part.

Documents whose perplexity exceeds the cutoff of their language (a quantile of its trusted
documents' perplexity; of all trusted ones where the language has none) are rejected.

Null and empty texts, and those of white space, have no words: their perplexity is null and
they are not kept.  Where the other half has no trusted words nothing can be judged: the
perplexity is null and documents with words are kept.  A null language is a language of its
own, ``und``.  Repeated rows are each scored; a repeated or unknown id among the trusted
counts once or not at all; rows without doc_id are never trusted.  Very long texts are
worked on whole.  An empty table gives an empty result.  Columns other than doc_id, text and
lang are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmaps
from .batches import flat_bytes, pieces
from .shared import Workspace, cut
from .shingles import Shingler, mix

ORDER = 2
BITS = 31
#: Stands before a text's first word; words are greater, and 0 stands for no word.
START = 1
FOLDS = 2
#: Bytes of text worked on at once.
PIECE = 1 << 20
#: Words that are sorted together; equal keys are sent once for each.
BLOCK = 3 << 20
#: Bytes of text for each shard of the counts.
SHARD = 16 << 20
#: Parts of the documents that are scored one after the other; fewer where they would hold less text than a shard.
ROUNDS = 8
#: Values are whole numbers of 1 / UNIT.
UNIT = 1 << 22
#: Up to so many languages' cutoffs are broadcast.
MOST_LANGUAGES = 10_000
QUANTILE = 0.995
#: Something must be left for unseen n-grams.
LEAST_DISCOUNT = 0.01

_MASK = (1 << BITS) - 1
_FORM = np.array([c + 32 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256)], np.uint8)
#: 0: white space and control characters, 1: letters and digits, 2: other signs.
_KIND = np.array(
    [0 if c <= 32 or c == 127 else 1 if c >= 128 or chr(c).isalnum() else 2 for c in range(256)],
    np.uint8,
)


class Words:
    """Finds words of whole columns by prefix sums, as for shingles."""

    def __init__(self):
        self.shingler = Shingler()

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Every word's number and each row's number of words."""
        data, bounds = flat_bytes(column)
        rows = len(bounds) - 1
        at = np.arange(1, len(data) + 1) + np.repeat(np.arange(rows), np.diff(bounds))
        kind = np.zeros(len(data) + rows + 2, np.uint8)
        kind[at] = _KIND[data]
        change = np.flatnonzero(kind[1:] != kind[:-1])
        begins = kind[change + 1] > 0
        start, end = change[begins], change[np.flatnonzero(begins) + 1]
        sums, down = self.shingler.sums(_FORM[data], at, kind == 0)
        hashes = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
        ends = bounds[1:] + np.arange(1, rows + 1)
        numbers = hashes % np.uint64(_MASK - START) + np.uint64(START + 1)
        return numbers.astype(np.int64), np.diff(np.searchsorted(start, np.concatenate(([0], ends))))


def gathered(source) -> Iterator[pa.RecordBatch]:
    """Batches of about PIECE bytes of text, whatever the batches that come in."""
    held, size = [], 0
    for whole in source:
        for batch in pieces(whole, "text", PIECE):
            more = batch.column("text").nbytes
            if held and size + more > PIECE:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            held.append(batch)
            size += more
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def blocks(source) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Rows without their text, their words and each row's number of words, for about BLOCK words at once."""
    words_of, held, total = Words(), [], 0

    def joined():
        rows, words, sizes = zip(*held)
        return pa.Table.from_batches(rows), np.concatenate(words), np.concatenate(sizes)

    for batch in gathered(source):
        words, sizes = words_of(batch.column("text"))
        if held and total + len(words) > BLOCK:
            yield joined()
            held, total = [], 0
        held.append((batch.select([n for n in batch.schema.names if n != "text"]), words, sizes))
        total += len(words)
    if held:
        yield joined()


def behind(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The word before each word."""
    before = np.empty(len(words), np.int64)
    before[1:] = words[:-1]
    begin = np.cumsum(sizes) - sizes
    before[begin[sizes > 0]] = START
    return before


def fold(doc_id: str) -> F.Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(FOLDS)).cast("long")


# A pair's key: its half, the word before and the word.  A word's: its half, 0 and the word.  To score, keys are mixed, which
# loses nothing, and sorted as such, so that a shard's keys stand close.


def word_keys(units: np.ndarray) -> np.ndarray:
    """Keys of words from their half and number."""
    return units >> BITS << 2 * BITS | units & _MASK


def shards_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """The shard of each key."""
    return shards_of_mixed(mix(keys.astype(np.uint64)), bits)


def shards_of_mixed(keys: np.ndarray, bits: int) -> np.ndarray:
    if not bits:
        return np.zeros(len(keys), np.uint16)
    return (keys >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.int32)


def by_shard(shards: np.ndarray) -> tuple[np.ndarray, Iterator[tuple[int, int, int]]]:
    """An order by shard that leaves a shard's keys in their order; and each shard with its bounds in it."""
    order = np.argsort(shards, kind="stable")
    found, start = np.unique(shards[order], return_index=True)
    return order, zip(found.tolist(), start.tolist(), np.append(start[1:], len(shards)).tolist())


def starts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers' bytes by place, compressed."""
    if not len(numbers):
        return b""
    planes = np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), -1).T
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpack(packed: bytes, n: int, kind: type = np.int64) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    size = n * np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(packed, size, "zstd", asbytes=True), np.uint8).reshape(-1, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=keys[:1] * 0))


def _unpack_sorted(packed: bytes, n: int, kind: type = np.int64) -> np.ndarray:
    return np.cumsum(_unpack(packed, n, kind), dtype=kind)


def _pack_signed(numbers: np.ndarray) -> bytes:
    return _pack(numbers << 1 ^ numbers >> 63)


def _unpack_signed(packed: bytes, n: int) -> np.ndarray:
    found = _unpack(packed, n)
    return found >> 1 ^ -(found & 1)


_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def table_of(rows: list[tuple], schema: str) -> pa.Table:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.table([pa.array(c, _KINDS[kind]) for c, (_, kind) in zip(columns, fields)], names=[name for name, _ in fields])


_COUNTED = "shard int, n_keys long, keys binary, times binary, ones array<long>"


def count_pairs(texts: DataFrame, bits: int) -> DataFrame:
    """A row for each shard: its pairs, how often each occurs, and how many occur once to four times."""

    def run(source):
        for rows, words, sizes in blocks(source):
            half = np.repeat(rows["fold"].to_numpy(), sizes)
            found, n = np.unique(half << 2 * BITS | behind(words, sizes) << BITS | words, return_counts=True)
            order, parts = by_shard(shards_of(found, bits))
            found, n = found[order], n[order]
            rows = [(s, b - a, _pack_sorted(found[a:b]), _pack(n[a:b]), None) for s, a, b in parts]
            yield from table_of(rows, _COUNTED).to_batches()

    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = np.concatenate([_unpack_sorted(r["keys"], r["n_keys"]) for r in rows])
        times = np.concatenate([_unpack(r["times"], r["n_keys"]) for r in rows])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = starts(keys)
        n = np.add.reduceat(times[order], first)
        return table_of([(rows[0]["shard"], len(first), _pack_sorted(keys[first]), _pack(n), _ones(n))], _COUNTED)

    return texts.select("fold", "text").mapInArrow(run, _COUNTED).groupBy("shard").applyInArrow(merge, _COUNTED)


def _ones(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


def discounts(n: list[int]) -> tuple[float, float, float]:
    """n: how many were seen once to four times."""
    if not n[0] or not n[1]:
        return 0.5, 0.5, 0.5
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(k, max(LEAST_DISCOUNT, k - (k + 1) * y * n[k] / n[k - 1])) if n[k - 1] else 0.5 for k in (1, 2, 3))


def taken(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    """What is left of each count after its discount."""
    return np.maximum(0.0, n - np.array((0.0, *d))[np.minimum(n, 3)])


class Sides:
    """The histories and words of a shard's sorted pairs, and which of them each pair has."""

    def __init__(self, keys: np.ndarray, bits: int):
        before = keys >> BITS
        self.first = starts(before)
        self.histories = before[self.first]
        self.history = np.repeat(np.arange(len(self.first)), np.diff(np.append(self.first, len(keys))))
        self.words, self.word, self.behind = np.unique(keys >> 2 * BITS << BITS | keys & _MASK, return_inverse=True, return_counts=True)
        self.bits = bits

    def parts(self):
        """Each shard of words with the places of its histories and of its words."""
        of = [shards_of(word_keys(u), self.bits) for u in (self.histories, self.words)]
        sides = []
        for shards in of:
            order, bounds = by_shard(shards)
            sides.append({s: order[a:b] for s, a, b in bounds})
        none = np.zeros(0, np.int64)
        for s in sorted(set(sides[0]) | set(sides[1])):
            yield s, sides[0].get(s, none), sides[1].get(s, none)


#: Of a history: how often it occurs and how many of its pairs occur once, twice and more often.
_NUMBERS = 4
_SAID = "shard int, other int, n_histories long, n_words long, histories binary, numbers binary, words binary, behind binary, sums array<long>"
#: Of a half: its words, how many of them stand behind one to four words, all they stand behind, and START's numbers.
_SUMS = 6 + _NUMBERS


def word_sums(pairs: DataFrame, bits: int) -> DataFrame:
    """What all pairs say of words: for each shard of pairs and of words in the order of its histories and words (``other``:
    the words' shard), and for each shard of words all it has (``other`` is -1), with sums over it."""

    def say(source):
        for batch in source:
            for r in batch.select(["shard", "n_keys", "keys", "times"]).to_pylist():
                keys, n = _unpack_sorted(r["keys"], r["n_keys"]), _unpack(r["times"], r["n_keys"])
                sides = Sides(keys, bits)
                numbers = np.stack([np.add.reduceat(x, sides.first) for x in (n, *(np.int64(x) for x in (n == 1, n == 2, n > 2)))])
                rows = []
                for s, h, w in sides.parts():
                    packed = _pack_sorted(sides.histories[h]), _pack(numbers[:, h].ravel()), _pack_sorted(sides.words[w]), _pack(sides.behind[w])
                    rows.append((s, r["shard"], len(h), len(w), *packed, None))
                yield from table_of(rows, _SAID).to_batches()

    def add(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        shard = rows[0]["shard"]
        histories, of_history = np.unique(np.concatenate([_unpack_sorted(r["histories"], r["n_histories"]) for r in rows]), return_inverse=True)
        words, of_word = np.unique(np.concatenate([_unpack_sorted(r["words"], r["n_words"]) for r in rows]), return_inverse=True)
        said = np.concatenate([_unpack(r["numbers"], _NUMBERS * r["n_histories"]).reshape(_NUMBERS, -1) for r in rows], axis=1)
        numbers = np.zeros((_NUMBERS, len(histories)), np.int64)
        for k in range(_NUMBERS):
            np.add.at(numbers[k], of_history, said[k])
        n = np.zeros(len(words), np.int64)
        np.add.at(n, of_word, np.concatenate([_unpack(r["behind"], r["n_words"]) for r in rows]))
        out, h, w = [], 0, 0
        for r in rows:
            hs, ws = of_history[h : h + r["n_histories"]], of_word[w : w + r["n_words"]]
            h, w = h + len(hs), w + len(ws)
            out.append((r["other"], shard, len(hs), len(ws), None, _pack(numbers[:, hs].ravel()), None, _pack(n[ws]), None))
        sums = []
        for half in range(FOLDS):
            own, start = n[words >> BITS == half], numbers[:, histories == (half << BITS) + START]
            sums += [len(own), *_ones(own), int(own.sum()), *start.sum(axis=1).tolist()]
        own = _pack_sorted(histories), _pack(numbers.ravel()), _pack_sorted(words), _pack(n)
        out.append((shard, -1, len(histories), len(words), *own, sums))
        return table_of(out, _SAID)

    return pairs.mapInArrow(say, _SAID).groupBy("shard").applyInArrow(add, _SAID)


_VALUES = "shard int, n_keys long, keys binary, values binary, weights binary"


class Model:
    """entries: each shard's keys and their values, and of words the weight that a last word has not; unseen and start: by
    half, the logarithm of an unseen word's probability and the weight of START."""

    def __init__(self, texts: DataFrame, bits: int, space: Workspace):
        pairs = space.keep(count_pairs(texts, bits))
        total = lambda table, name, n: [x or 0 for x in table.agg(*[F.sum(F.col(name)[k]) for k in range(n)]).first()]
        two = discounts(total(pairs, "ones", 4))
        said = space.keep(word_sums(pairs, bits))
        sums = np.array(total(said.filter("other = -1"), "sums", FOLDS * _SUMS)).reshape(FOLDS, _SUMS)
        one = discounts(sums[:, 1:5].sum(axis=0).tolist())
        size, once, twice, places = sums[:, 0], sums[:, 1], sums[:, 2], sums[:, 5]
        left = once * one[0] + twice * one[1] + (size - once - twice) * one[2]
        seen = [h for h in range(FOLDS) if size[h]]
        base = np.ones(FOLDS)
        base[seen] = left[seen] / places[seen] / (size[seen] + 1)
        self.unseen = {h: float(np.log(base[h])) for h in seen}
        self.start = {h: float(np.log(sums[h, 7:] @ two / sums[h, 6])) for h in seen}
        every = np.maximum(places, 1)

        def valued(left: pa.Table, right: pa.Table) -> pa.Table:
            keys, values, weights = [], [], []
            answers = {r["other"]: r for r in right.to_pylist()}
            p = lambda units, n: taken(n, one) / every[units >> BITS] + base[units >> BITS]
            for r in left.select(["n_keys", "keys", "times"]).to_pylist():
                found, n = _unpack_sorted(r["keys"], r["n_keys"]), _unpack(r["times"], r["n_keys"])
                sides = Sides(found, bits)
                rest, behind_n = np.zeros(len(sides.histories)), np.zeros(len(sides.words), np.int64)
                for s, h, w in sides.parts():
                    numbers = _unpack(answers[s]["numbers"], _NUMBERS * len(h)).reshape(_NUMBERS, -1)
                    rest[h] = two @ numbers[1:]
                    behind_n[w] = _unpack(answers[s]["behind"], len(w))
                keys.append(found)
                values.append(np.log1p(taken(n, two) / rest[sides.history] / p(sides.words, behind_n)[sides.word]))
                weights.append(np.zeros(len(found)))
            if -1 in answers:
                r = answers[-1]
                histories, words = _unpack_sorted(r["histories"], r["n_histories"]), _unpack_sorted(r["words"], r["n_words"])
                numbers = _unpack(r["numbers"], _NUMBERS * len(histories)).reshape(_NUMBERS, -1)
                units = np.union1d(histories, words)
                weight, behind_n = np.zeros(len(units)), np.zeros(len(units), np.int64)
                weight[np.searchsorted(units, histories)] = np.log(two @ numbers[1:] / numbers[0])
                behind_n[np.searchsorted(units, words)] = _unpack(r["behind"], len(words))
                keys.append(word_keys(units))
                values.append(np.log(p(units, behind_n) / base[units >> BITS]) + weight)
                weights.append(weight)
            keys = mix(np.concatenate(keys).astype(np.uint64))
            values, weights = (np.rint(np.concatenate(x) * UNIT).astype(np.int64) for x in (values, weights))
            order = np.argsort(keys)
            shard = (left if left.num_rows else right)["shard"][0].as_py()
            packed = _pack_sorted(keys[order]), _pack_signed(values[order]), _pack_signed(weights[order])
            return table_of([(shard, len(order), *packed)], _VALUES)

        self.entries = space.keep(pairs.groupBy("shard").cogroup(said.groupBy("shard")).applyInArrow(valued, _VALUES))
        space.drop(pairs, said)


def trusted_texts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """Documents whose id is trusted; a bitmap holds most others back from the join."""
    ids = trusted.select(F.col("doc_id").cast("long").alias("id")).dropna().distinct()
    shared = docs.sparkSession.sparkContext.broadcast(bitmaps.build(ids, "id"))

    def run(source):
        for batch in source:
            yield batch.filter(pa.array(bitmaps.hit(shared.value, batch.column("spot").to_numpy())))

    used = docs.select(F.col("doc_id").cast("long").alias("id"), fold("doc_id").alias("fold"), "text").dropna()
    used = used.withColumn("spot", bitmaps.spot("id"))
    return used.mapInArrow(run, used.schema).join(ids, "id", "left_semi")


_ASKED = "shard int, block long, n_keys long, n_places long, keys binary, holders binary, places binary, times binary, rows binary"
_ADDED = "shard int, block long, n_sums long, places binary, sums binary, rows binary"


def number_of(rows: bytes, *numbers: np.ndarray) -> int:
    """A block's number follows from what is in it, so that a task that runs again gives the same."""
    digest = hashlib.blake2b(rows, digest_size=8)
    for of in numbers:
        digest.update(of.tobytes())
    return int.from_bytes(digest.digest(), "little", signed=True)


def asked(used: DataFrame, bits: int) -> DataFrame:
    """A row for each block of documents and shard; one of a block's rows carries what names its documents."""

    def run(source):
        for named, words, sizes in blocks(source):
            doc = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
            mine = ((FOLDS - 1 - named["fold"].to_numpy()) << 2 * BITS)[doc]
            keys = mix(np.concatenate((mine | behind(words, sizes) << BITS | words, mine | words)).astype(np.uint64))
            last = np.zeros(len(keys), np.uint32)
            last[len(words) + np.cumsum(sizes)[sizes > 0] - 1] = 1
            order = np.argsort(keys, kind="stable")
            keys, places = keys[order], np.concatenate((doc, doc))[order]
            # a document that holds a key several times is one place
            new = np.append(True, (keys[1:] != keys[:-1]) | (places[1:] != places[:-1])) if len(keys) else np.zeros(0, bool)
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, len(keys))).astype(np.uint32) << 1
            if len(at):
                times |= np.add.reduceat(last[order], at)
            keys, places = keys[at], places[at]
            first = starts(keys)
            holders = np.diff(np.append(first, len(keys))).astype(np.uint32)
            gaps = np.diff(places, prepend=places[:1] * 0)
            gaps[first] = places[first]
            distinct = keys[first]
            named = named.select(["doc_id", "lang", "fold"]).append_column("n_words", pa.array(sizes, pa.int64()))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, named.schema) as out:
                out.write_table(named.combine_chunks())
            rows = sink.getvalue().to_pybytes()
            block = number_of(rows, distinct, holders, gaps, times)
            home = block & ((1 << bits) - 1)
            ends = np.append(0, np.cumsum(holders, dtype=np.int64))
            table, housed = [], False
            for s, a, b in by_shard(shards_of_mixed(distinct, bits))[1]:
                part = slice(ends[a], ends[b])
                packed = _pack_sorted(distinct[a:b]), _pack(holders[a:b]), _pack(gaps[part]), _pack(times[part])
                table.append((s, block, b - a, int(ends[b] - ends[a]), *packed, rows if s == home else None))
                housed |= s == home
            if not housed:
                table.append((home, block, 0, 0, b"", b"", b"", b"", rows))
            yield from table_of(table, _ASKED).to_batches()

    return used.mapInArrow(run, _ASKED)


def added(left: pa.Table, right: pa.Table) -> pa.Table:
    """What a shard knows for each document of the blocks that ask it."""
    keys, values, weights = np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(1, np.int64)
    for r in right.to_pylist():
        keys = _unpack_sorted(r["keys"], r["n_keys"], np.uint64)
        values, weights = (np.append(_unpack_signed(r[x], r["n_keys"]), 0) for x in ("values", "weights"))
    out = []
    for batch in left.to_batches(max_chunksize=1):
        r = batch.to_pylist()[0]
        wanted = _unpack_sorted(r["keys"], r["n_keys"], np.uint64)
        at = np.searchsorted(keys, wanted)
        if len(keys):
            at = np.where(keys[np.minimum(at, len(keys) - 1)] == wanted, at, len(keys))
        holders = _unpack(r["holders"], r["n_keys"], np.uint32)
        gaps = np.cumsum(_unpack(r["places"], r["n_places"], np.uint32), dtype=np.int64)
        # gaps are counted anew for each key
        before = np.append(0, gaps)[np.cumsum(holders, dtype=np.int64) - holders] if len(holders) else np.zeros(0, np.int64)
        places = gaps - np.repeat(before, holders)
        times = _unpack(r["times"], r["n_places"], np.uint32)
        known = np.repeat(values[at], holders) * (times >> 1) - np.repeat(weights[at], holders) * (times & 1)
        # whole numbers below 2^53
        sums = np.bincount(places, known).astype(np.int64)
        hit = np.flatnonzero(sums)
        out.append((r["shard"], r["block"], len(hit), _pack_sorted(hit), _pack_signed(sums[hit]), r["rows"]))
    return table_of(out, _ADDED)


def perplexities(used: DataFrame, model: Model, bits: int) -> DataFrame:
    """doc_id, lang, n_words and perplexity of each document."""
    unseen, start = model.unseen, model.start

    def combine(table: pa.Table) -> pa.Table:
        parts = sorted(table.to_pylist(), key=lambda r: r["shard"])
        # blocks that are alike in all their documents share a number, and each has named its own
        named = [r["rows"] for r in parts if r["rows"] is not None]
        block = pa.ipc.open_stream(named[0]).read_all()
        sums, last = np.zeros(block.num_rows, np.int64), None
        for r in parts:
            if r["shard"] != last:
                sums[_unpack_sorted(r["places"], r["n_sums"])] += _unpack_signed(r["sums"], r["n_sums"])
            last = r["shard"]
        n, half = block["n_words"].to_numpy(), FOLDS - 1 - block["fold"].to_numpy()
        given = lambda values: np.array([values.get(int(h), np.nan) for h in half])
        mean = (sums / UNIT + given(start) + n * given(unseen)) / np.maximum(n, 1)
        judged = pa.array(np.exp(-mean), mask=(n == 0) | np.isnan(mean))
        one = pa.table([block["doc_id"], block["lang"], block["n_words"], judged], names=["doc_id", "lang", "n_words", "perplexity"])
        return pa.concat_tables([one] * len(named))

    sums = asked(used, bits).groupBy("shard").cogroup(model.entries.groupBy("shard")).applyInArrow(added, _ADDED)
    schema = used.select("doc_id", "lang").schema.add("n_words", "long").add("perplexity", "double")
    return sums.groupBy("block").applyInArrow(combine, schema)


def scores(docs: DataFrame, trusted: DataFrame, space: Workspace) -> DataFrame:
    """doc_id, lang, n_words and perplexity of each document, part by part."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = (size // SHARD).bit_length()
    model = Model(trusted_texts(docs, trusted), bits, space)
    used = docs.select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang"), fold("doc_id").alias("fold"), "text")
    parts = min(ROUNDS, 1 + size // SHARD)
    part, found = F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)), []
    for k in range(parts):
        found.append(space.keep(perplexities(used.filter(part == k), model, bits), True))
    return reduce(DataFrame.union, found)


def judge(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_words, perplexity, cutoff and keep of each document.  trusted: the doc_ids of trusted texts."""
    space = Workspace(docs.sparkSession, True)
    try:
        scored = cut(scores(docs, trusted, space))
    finally:
        space.close()
    ids = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).dropna().distinct()
    known = cut(scored.filter("perplexity IS NOT NULL").join(ids, "doc_id", "left_semi").select("lang", "perplexity"))
    at = F.percentile_approx("perplexity", quantile, 10_000)
    overall = known.agg(at).first()[0]
    cutoffs = cut(known.groupBy("lang").agg(at.alias("own")))
    # a row for each language: few, unless the column holds something else
    few = cutoffs.limit(MOST_LANGUAGES + 1).count() <= MOST_LANGUAGES
    out = scored.join(F.broadcast(cutoffs) if few else cutoffs, "lang", "left").withColumn("cutoff", F.coalesce("own", F.lit(overall).cast("double")))
    keep = F.when(F.col("n_words") == 0, False).otherwise(F.coalesce(F.col("perplexity") <= F.col("cutoff"), F.lit(True)))
    return out.select("doc_id", "lang", "n_words", "perplexity", "cutoff", keep.alias("keep"))
