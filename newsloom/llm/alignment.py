"""Alignment of two tokenizers' tokens over the same bytes, and corpus-wide counts of the id pairs that end together.

A is a byte-level BPE (a ``tokenizers`` JSON file), B a sentencepiece BPE with byte fallback.
Both encode a space and the text.  A whole Arrow piece of documents is laid end to end with
the documents' byte offsets; the ends of all its A and B tokens are counted once for every
byte; where both tokenizers end a token, the piece is cut into groups, and prefix sums over
the cuts give each document's share.  At each cut the A and the B token that end there are
linked (tokens hold at least one byte, so there is one such pair).

Corpus-wide counts: a piece names each distinct id pair once, with its number of links, so
what is shuffled is a row for each pair and piece, not for each document.  Sums by pair and
the highest of each B id (one row for each B id at most) go back to the pieces by a join.

Long texts are encoded in parts, cut before a space between a symbol and a letter, which
neither tokenizer ever crosses; special tokens' strings are plain text.  A null or empty
text, and one whose joined token bytes differ from space and text (it holds U+2581, say),
has no tokens: numbers of 0 and an empty digest.  Rows are independent of each other but
for the counts, so repeated rows each have their result and each count; rows without doc_id
are as all others; an empty table gives an empty result.  Input columns that bear the name
of an output are replaced, and so are those of this module's own, __block, __links, __pairs and __times.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import list_array, pieces
from .shared import Workspace

#: Bytes of text laid end to end at once.
PIECE = 4 << 20
#: Characters of a text that are encoded at once, if it can be cut there.
PART = 1 << 18
#: Distinct units of B that a task keeps; beyond that its table starts anew.
UNITS_KEPT = 200_000
_CUT = re.compile(r"(?<=\S) (?=[^\W\d_])")
_UNIT = re.compile(" *[^ ]+| +")
#: Pre-tokens of A's kind of tokenizer (fixed: the published pattern of the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteLevel:
    """Tokenizer A: ids, and the bytes of each id."""

    def __init__(self, file: bytes):
        import tiktoken

        spec = json.loads(file)
        model, special = spec["model"], {x["id"] for x in spec.get("added_tokens") or ()}
        if model.get("type") != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("A must be a byte-level BPE without normalizer")
        symbol = byte_symbols()
        ranks = {bytes(symbol[c] for c in t): i for t, i in model["vocab"].items() if i not in special}
        self.size = 1 + max([*ranks.values(), *special])
        self.bytes = [b""] * self.size
        for piece, i in ranks.items():
            self.bytes[i] = piece
        order = [ranks[bytes(symbol[c] for m in (pair.split(" ") if isinstance(pair, str) else pair) for c in m)] for pair in model["merges"]]
        if order != sorted(order):
            raise ValueError("A's ids must follow the order of its merges")
        self.encode = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary_batch

    def __call__(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return flat(self.encode([" " + x for x in parts], num_threads=1))


def flat(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All lists end to end, and their lengths."""
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum())), sizes


class Pieces:
    """Tokenizer B: ids, and the bytes of each id.

    Where no piece holds a space mark behind another symbol, spaces and what follows them up to
    the next are encoded by themselves: the library is asked for each distinct one only.
    """

    def __init__(self, file: bytes):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=file)
        self.size = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(self.size)]
        self.bytes = [bytes([int(p[1:-1], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.mark = sp.piece_to_id("▁")
        apart = not any(re.search("[^▁]▁", p) for p in names) and sp.normalize("A  éﬁ ") == "▁A▁▁éﬁ▁"
        self.by_unit = apart and not sp.is_unknown(self.mark)
        self._forget()

    def _forget(self) -> None:
        self.number, self.kept_chars = {" ": 0}, 0
        self.ids, self.starts = np.array([self.mark], np.int32), np.array([0, 1], np.int64)

    def __call__(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_unit:
            return flat(self.library.encode(parts, num_threads=1))
        if len(self.number) > UNITS_KEPT or self.kept_chars > 16 * UNITS_KEPT:
            self._forget()
        number = self.number
        split = [_UNIT.findall(" " + x) for x in parts]
        new = list(dict.fromkeys(u for units in split for u in units if u not in number))
        if new:
            ids, sizes = flat(self.library.encode([u[1:] for u in new], num_threads=1))
            number.update(zip(new, range(len(number), len(number) + len(new))))
            self.kept_chars += sum(map(len, new))
            self.ids, self.starts = np.concatenate([self.ids, ids]), np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        units = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64)
        each = np.fromiter(map(len, split), np.int64, len(split))
        sizes = np.diff(self.starts)[units]
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[units] - ends + sizes, sizes)
        bounds = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(each)))]
        return self.ids[at], np.diff(bounds)


def parts_of(text: str, size: int = PART) -> list[str]:
    """The text in parts, each without the space that it begins with."""
    out, begin = [], 0
    while len(text) - begin > size:
        m = _CUT.search(text, begin + size)
        if m is None:
            break
        out.append(text[begin : m.start()])
        begin = m.end()
    return [*out, text[begin:]]


class Encoded:
    """One tokenizer's tokens of several texts: ids end to end, each text's number, and all ids' bytes end to end."""

    def __init__(self, encode, table: pa.Array, lengths: np.ndarray, parts: list[str], of: np.ndarray, n: int):
        self.ids, sizes = encode(parts)
        self.n = np.bincount(of, sizes, n).astype(np.int64)
        self.lengths = lengths[self.ids]
        self.data = memoryview(table.take(pa.array(self.ids)).buffers()[2] or b"") if len(self.ids) else memoryview(b"")
        self.bounds = np.concatenate(([0], np.cumsum(np.bincount(np.repeat(of, sizes), self.lengths, n)))).astype(np.int64)

    def keep(self, held: np.ndarray) -> None:
        """Only the tokens of these texts stay."""
        mask = np.repeat(held, self.n)
        self.ids, self.lengths = self.ids[mask], self.lengths[mask]
        self.n = np.where(held, self.n, 0)


class Aligner:
    def __init__(self, a_file: bytes, b_file: bytes):
        self.a, self.b = ByteLevel(a_file), Pieces(b_file)
        self.tables = [pa.array(x.bytes, pa.binary()) for x in (self.a, self.b)]
        self.lengths = [np.array(list(map(len, x.bytes)), np.int64) for x in (self.a, self.b)]
        written = lambda x, last: [b"%d%s" % (i, end) for end in (b",", last) for i in range(x.size)]
        self.written = pa.array(written(self.a, b"|") + written(self.b, b";"), pa.binary())

    def align(self, texts: list[str | None]) -> dict:
        """For each text: n_a, n_b, n_groups, digest; end to end: ids, the number of tokens up to each group's end (a_ends, b_ends) and pairs."""
        n = len(texts)
        parts, of = [], []
        for k, text in enumerate(texts):
            if text:
                cut = parts_of(text)
                parts += cut
                of += [k] * len(cut)
        of = np.array(of, np.int64)
        a, b = (Encoded(x, t, m, parts, of, n) for x, t, m in zip((self.a, self.b), self.tables, self.lengths))
        whole = [b" " + t.encode() if t else b"" for t in texts]
        held = np.zeros(n, bool)
        for k, raw in enumerate(whole):
            held[k] = bool(raw) and all(bytes(x.data[x.bounds[k] : x.bounds[k + 1]]) == raw for x in (a, b))
        if not held.all():
            a.keep(held)
            b.keep(held)
        ends = np.cumsum(np.where(held, list(map(len, whole)), 0)) if n else np.zeros(0, np.int64)
        del whole
        total = int(ends[-1]) if n else 0
        a_at, b_at = np.cumsum(a.lengths), np.cumsum(b.lengths)
        cuts = np.flatnonzero((np.bincount(a_at, minlength=total + 1) > 0) & (np.bincount(b_at, minlength=total + 1) > 0))
        a_last, b_last = np.searchsorted(a_at, cuts), np.searchsorted(b_at, cuts)
        groups = np.diff(np.concatenate(([0], np.searchsorted(cuts, ends, "right"))))
        out = {"n_a": a.n, "n_b": b.n, "n_groups": groups, "a": a.ids, "b": b.ids, "a_ends": a_last + 1, "b_ends": b_last + 1}
        out["pairs"] = a.ids[a_last].astype(np.int64) * self.b.size + b.ids[b_last]
        return out | {"digest": self._digests(out, held)}

    def _digests(self, x: dict, held: np.ndarray) -> list[str]:
        """Each group's A ids, then its B ids, written and hashed text by text."""
        number = np.arange(len(x["a_ends"]))
        a_group = np.repeat(number, np.diff(x["a_ends"], prepend=0))
        b_group = np.repeat(number, np.diff(x["b_ends"], prepend=0))
        token = np.zeros(len(x["a"]) + len(x["b"]), np.int32)
        at = np.arange(len(x["a"])) + np.concatenate(([0], x["b_ends"]))[a_group]
        token[at] = x["a"]
        token[np.arange(len(x["b"])) + x["a_ends"][b_group]] = x["b"] + 2 * self.a.size
        both = x["a_ends"] + x["b_ends"]
        token[both - 1] += self.b.size
        token[both - 1 - np.diff(x["b_ends"], prepend=0)] += self.a.size
        line = self.written.take(pa.array(token))
        starts = np.frombuffer(line.buffers()[1], np.int32)[: len(token) + 1] if len(token) else np.zeros(1, np.int32)
        bounds = starts[np.concatenate(([0], np.cumsum(x["n_a"] + x["n_b"])))]
        data = memoryview(line.buffers()[2]) if len(token) else memoryview(b"")
        return [hashlib.sha256(data[i : j - 1]).hexdigest() if k else "" for i, j, k in zip(bounds[:-1].tolist(), bounds[1:].tolist(), held)]


_NUMBERS = ["n_a", "n_b", "n_groups"]
_GROUPS = ["a_ids", "b_ids", "a_group_ends", "b_group_ends"]
_INNER = T.StructType(
    [
        T.StructField("__block", T.LongType()),
        T.StructField("__links", T.ArrayType(T.IntegerType())),
        T.StructField("__pairs", T.ArrayType(T.LongType())),
        T.StructField("__times", T.ArrayType(T.LongType())),
    ]
)


def _relative(ends: np.ndarray, groups: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Numbers of tokens counted from each text's first."""
    return ends - np.repeat(np.cumsum(tokens) - tokens, groups)


def encode_pieces(docs: DataFrame, a_path: str, b_path: str, text: str = "text", groups: bool = False, keep_text: bool = True) -> DataFrame:
    """The narrow pass: each document's groups, and for each piece, in its first row, its distinct pairs and their numbers of links."""
    with open(a_path, "rb") as f, open(b_path, "rb") as g:
        files = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))
    fields = [T.StructField(c, T.LongType()) for c in _NUMBERS] + [T.StructField("groups_sha256", T.StringType())]
    if groups:
        fields += [T.StructField(c, T.ArrayType(T.IntegerType())) for c in _GROUPS]
    fields += _INNER.fields
    docs = docs.select(docs[text].alias("__text"), *[docs[c] for c in docs.columns if c not in {f.name for f in fields} and (keep_text or c != text)])
    kept = docs.columns[1:]

    def run(source):
        aligner, block = Aligner(*files.value), TaskContext.get().partitionId() << 32
        for whole in source:
            for batch in pieces(whole, "__text", PIECE):
                x = aligner.align(batch.column("__text").to_pylist())
                pairs, link, times = np.unique(x["pairs"], return_inverse=True, return_counts=True)
                out = [pa.array(x[c], pa.int64()) for c in _NUMBERS] + [pa.array(x["digest"], pa.string())]
                if groups:
                    a_ends, b_ends = (_relative(x[c], x["n_groups"], x[n]) for c, n in (("a_ends", "n_a"), ("b_ends", "n_b")))
                    out += [list_array(x[c], x[n], pa.int32()) for c, n in (("a", "n_a"), ("b", "n_b"))]
                    out += [list_array(e, x["n_groups"], pa.int32()) for e in (a_ends, b_ends)]
                first = np.zeros(batch.num_rows, np.int64)
                first[0] = len(pairs)
                out += [pa.array(np.full(batch.num_rows, block), pa.int64()), list_array(link, x["n_groups"], pa.int32())]
                out += [list_array(v, first, pa.int64()) for v in (pairs, times)]
                block += 1
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + out, names=[*kept, *[f.name for f in fields]])

    return docs.mapInArrow(run, T.StructType([docs.schema[c] for c in kept] + fields))


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text", groups: bool = False, keep_text: bool = True) -> DataFrame:
    """Adds n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    groups: also a_ids and b_ids, and how many of them there are up to the end of each group
    (a_group_ends, b_group_ends).  n_best: links whose pair is the most frequent one of its B id
    in ``docs``; count_sum: the pairs' frequencies, over all links.
    """
    work = Workspace(docs.sparkSession)
    new = {"n_links", "n_best", "count_sum"} - {text}
    used = docs.select([c for c in docs.columns if c not in new])
    known = work.keep(encode_pieces(used, a_path, b_path, text, groups, keep_text))
    size = piece_count(b_path)
    asked = known.select("__block", F.posexplode(F.arrays_zip("__pairs", "__times")).alias("k", "x"))
    asked = asked.select("__block", "k", F.col("x.__pairs").alias("pair"), F.col("x.__times").alias("n"))
    totals = work.keep(asked.groupBy("pair").agg(F.sum("n").alias("total")), True)
    b_id = F.pmod("pair", F.lit(size))
    # at most a row for each id of B's vocabulary
    best = F.broadcast(totals.groupBy(b_id.alias("b")).agg(F.max("total").alias("most")))
    told = totals.withColumn("b", b_id).join(best, "b").select("pair", (F.col("total") * 2 + (F.col("total") == F.col("most")).cast("long")).alias("worth"))
    answers = asked.select("__block", "k", "pair").join(told, "pair").select(F.col("__block").alias("__of"), "k", "worth")
    rows = known.drop("__pairs", "__times")
    out = [c for c in rows.columns if c not in ("__block", "__links")]
    schema = T.StructType([rows.schema[c] for c in out] + [T.StructField(c, T.LongType()) for c in ("n_links", "n_best", "count_sum")])

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        worth = np.zeros(right.num_rows, np.int64)
        worth[right.column("k").to_numpy()] = right.column("worth").to_numpy()
        links = left.column("__links").combine_chunks()
        sizes = links.value_lengths().to_numpy(zero_copy_only=False)
        found = worth[links.flatten().to_numpy(zero_copy_only=False)]
        ends = np.cumsum(sizes)
        sums = [np.concatenate(([0], np.cumsum(v))) for v in (found & 1, found >> 1)]
        made = [pa.array(sizes, pa.int64()), *[pa.array(s[ends] - s[ends - sizes], pa.int64()) for s in sums]]
        return pa.table([left.column(c) for c in out] + made, schema=None, names=schema.names)

    return rows.groupBy("__block").cogroup(answers.groupBy("__of")).applyInArrow(count, schema)


def piece_count(b_path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()


def report(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    found = align(docs.select("doc_id", "text"), a_path, b_path, keep_text=False)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
