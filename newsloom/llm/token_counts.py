"""Token counts that follow edits.

A text is cut into leaves of about ``LEAF`` characters at places where every text around
them has a pre-token boundary: before a space that a letter follows and no white space
precedes.  A document's tree holds the leaves' numbers of characters and of tokens and the
sums above them.  An edit finds its leaves by descent, encodes only those and, where it
touches one's edge, the neighbour (the boundary context), and updates the sums on the
paths.  The tokenizer is a byte-level BPE of tiktoken, whose vocabulary is a parameter.

Null and empty texts have no tokens and take edits as empty texts; a very long text is encoded leaf by leaf.  Edits of a document
apply in the order of ``seq`` (then start, end and text); offsets are code points of the
text as it is then, and are clipped to it; an edit with a null start, end or text counts
as 0, the start and the empty text.  Edits of unknown documents change nothing.  Rows that
repeat a doc_id all take its edits; rows without doc_id take none.  An empty table gives an
empty result.  Input columns that bear the name of an output are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import add_columns

LEAF = 256
_CUT = re.compile(r"(?<=\S) (?=[^\W\d_])")
#: Characters around a cut that make it one.
_CONTEXT = 2

_LEAVES = pa.list_(pa.struct([("chars", pa.int64()), ("tokens", pa.int64()), ("digest", pa.int64())]))

EDIT = T.ArrayType(
    T.StructType(
        [
            T.StructField("seq", T.LongType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
            T.StructField("text", T.StringType()),
        ]
    )
)


def encoding(ranks: bytes, pattern: str):
    """The tokenizer of a tiktoken rank file without special tokens."""
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("counted", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def leaves(text: str, size: int = LEAF) -> list[str]:
    out, begin = [], 0
    while len(text) - begin > size:
        m = _CUT.search(text, begin + size)
        if m is None:
            break
        out.append(text[begin : m.start()])
        begin = m.start()
    if begin < len(text):
        out.append(text[begin:])
    return out


def digest(piece: str) -> int:
    """Tells a leaf's text from another of the same length."""
    return int.from_bytes(hashlib.blake2b(piece.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


class Tree:
    """Sums of characters and tokens over a document's leaves; stored ones count if they are the text's."""

    def __init__(self, text: str, count, stored: list[dict] | None = None):
        self.text, self.count, self.encoded = text, count, 0
        pairs = [(x["chars"], x["tokens"]) for x in stored or ()] if self._holds(stored) else None
        if pairs is None:
            pairs = [(len(x), self._tokens(x)) for x in leaves(text)]
        self._build(pairs)

    def _holds(self, stored: list[dict] | None) -> bool:
        """Whether the leaves are those of this text, not of another or of one from before an edit."""
        at = 0
        for x in stored or ():
            if x["chars"] is None or x["tokens"] is None or digest(self.text[at : at + x["chars"]]) != x["digest"]:
                return False
            at += x["chars"]
        return at == len(self.text)

    def stored(self) -> list[dict]:
        w, at, out = self.width, 0, []
        for c, t in zip(self.chars[w : w + self.n], self.tokens[w : w + self.n]):
            if c:
                out.append({"chars": c, "tokens": t, "digest": digest(self.text[at : at + c])})
                at += c
        return out

    def _tokens(self, piece: str) -> int:
        self.encoded += len(piece)
        return self.count(piece)

    def _build(self, pairs: list[tuple[int, int]]) -> None:
        self.n = len(pairs)
        self.width = w = 1 << max(0, (self.n - 1).bit_length())
        self.chars, self.tokens = [0] * (2 * w), [0] * (2 * w)
        for k, (c, t) in enumerate(pairs):
            self.chars[w + k], self.tokens[w + k] = c, t
        for k in range(w - 1, 0, -1):
            self._sum(k)

    def _sum(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last one for the text's end), and where it starts."""
        k, start = 1, 0
        while k < self.width:
            k *= 2
            if at >= start + self.chars[k] and self.chars[k + 1]:
                start += self.chars[k]
                k += 1
        return k - self.width, start

    def edit(self, start: int, end: int, new: str) -> None:
        start = max(0, min(start, len(self.text)))
        end = max(start, min(end, len(self.text)))
        if not self.n:
            self.text = new
            self._build([(len(x), self._tokens(x)) for x in leaves(new)])
            return
        first, begin = self.find(max(0, start - _CONTEXT))
        last, last_begin = self.find(min(len(self.text) - 1, end + _CONTEXT))
        stop = last_begin + self.chars[self.width + last]
        region = self.text[begin:start] + new + self.text[end:stop]
        self.text = self.text[:begin] + region + self.text[stop:]
        fresh = [(len(x), self._tokens(x)) for x in leaves(region)]
        room = last - first + 1
        if len(fresh) > room:
            w = self.width
            pairs = list(zip(self.chars[w : w + self.n], self.tokens[w : w + self.n]))
            self._build(pairs[:first] + fresh + pairs[last + 1 :])
            return
        fresh += [(0, 0)] * (room - len(fresh))
        touched = set()
        for k, (c, t) in enumerate(fresh, self.width + first):
            self.chars[k], self.tokens[k] = c, t
            touched.add(k // 2)
        while touched and touched != {0}:
            for k in touched:
                if k:
                    self._sum(k)
            touched = {k // 2 for k in touched}


def count(
    docs: DataFrame,
    edits: DataFrame | None,
    ranks_path: str,
    pattern: str,
    text: str = "text",
    doc_id: str = "doc_id",
    tree: str | None = None,
) -> DataFrame:
    """Adds n_tokens, and what the edits (doc_id, seq, start, end, text) lead to: text_after, n_tokens_after, n_encoded.

    n_encoded: characters encoded for the edits alone.  Without edits the pass is
    narrow; a document's edits are gathered and joined to it by id.

    tree: the column that takes the leaves after the edits.  If ``docs`` has it (the table that an
    earlier call gave, whose text is ``text_after`` now), trees start from it and nothing but the
    edits is encoded; a tree that is null or whose leaves are not its text's, by their digests, is built anew.
    """
    name = "__edits"
    if edits is None:
        joined = docs.withColumn(name, F.array().cast(EDIT))
    else:
        fields = [F.col(c).cast(t).alias(c) for c, t in (("seq", "long"), ("start", "long"), ("end", "long"), ("text", "string"))]
        listed = edits.select(F.col(doc_id).alias("__id"), F.struct(*fields).alias("e")).groupBy("__id")
        listed = listed.agg(F.sort_array(F.collect_list("e")).alias(name))
        joined = docs.join(listed, docs[doc_id] == listed["__id"], "left").drop("__id")
    return counted(joined, name, ranks_path, pattern, text, tree).drop(name)


def counted(joined: DataFrame, edits: str, ranks_path: str, pattern: str, text: str = "text", tree: str | None = None) -> DataFrame:
    """As :func:`count`, for edits that are an array column of each row."""
    with open(ranks_path, "rb") as f:
        shared = joined.sparkSession.sparkContext.broadcast(f.read())

    def make():
        encode = encoding(shared.value, pattern).encode_ordinary

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            before, after, texts, worked, trees = [], [], [], [], []
            column = batch.column(text if text in batch.schema.names else "__input").to_pylist()
            known = batch.column(tree).to_pylist() if tree in batch.schema.names else [None] * len(column)
            for value, changes, stored in zip(column, batch.column(edits).to_pylist(), known):
                sums = Tree(value or "", lambda piece: len(encode(piece)), stored)
                before.append(sums.n_tokens)
                sums.encoded = 0
                for e in changes or ():
                    begin = e["start"] or 0
                    sums.edit(begin, begin if e["end"] is None else e["end"], e["text"] or "")
                after.append(sums.n_tokens)
                texts.append(sums.text if changes else value)
                worked.append(sums.encoded)
                if tree:
                    trees.append(sums.stored())
            ints = [pa.array(x, pa.int64()) for x in (before, after, worked)]
            out = [ints[0], pa.array(texts, pa.string()), ints[1], ints[2]]
            return out + [pa.array(trees, _LEAVES)] if tree else out

        return compute

    fields = [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("text_after", T.StringType()),
        T.StructField("n_tokens_after", T.LongType()),
        T.StructField("n_encoded", T.LongType()),
    ]
    if tree:
        leaf = T.StructType([T.StructField(c, T.LongType()) for c in ("chars", "tokens", "digest")])
        fields.append(T.StructField(tree, T.ArrayType(leaf)))
    return add_columns(joined, fields, text, make)


def sample_edits(text, doc_id):
    """Three edits whose places follow from the id: an insertion, a deletion and a replacement."""
    n = F.coalesce(F.char_length(text), F.lit(0)).cast("long")
    at = lambda k: F.pmod(F.xxhash64(doc_id, F.lit(k)), n + 1)
    one = lambda seq, start, size, new: F.struct(
        F.lit(seq).cast("long").alias("seq"), start.alias("start"), (start + size).alias("end"), F.lit(new).alias("text")
    )
    return F.array(one(1, at(1), 0, " newly added words,"), one(2, at(2), 7, ""), one(3, at(3), 12, "It's 2024\n\n  now"))


def report(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Each document's tokens before and after its three sample edits, and how many characters were encoded for those."""
    used = docs.select("doc_id", "text", sample_edits(docs["text"], docs["doc_id"]).alias("edits"))
    found = counted(used, "edits", ranks_path, pattern)
    return found.select("doc_id", "n_tokens", "n_tokens_after", "n_encoded", F.char_length("text_after").cast("long").alias("n_chars_after"))
