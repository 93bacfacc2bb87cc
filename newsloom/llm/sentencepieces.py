"""SentencePiece encoding and decoding (BPE vocabularies).

Merging runs over an agenda of adjacent symbol pairs ordered by the score of the
piece they would form, leftmost first among equals.  No piece of such a
vocabulary holds a space mark behind another symbol, so a text falls into units
(a run of space marks and what follows up to the next) that no merge can cross:
each distinct unit is merged once per worker and kept in a bounded table.  Every
unit that enters the table is checked, ids and decoded text, against the
sentencepiece library, a whole Arrow piece of them at a time.

A null or empty text has no ids and decodes to the empty text.  Rows are mapped
one by one, so repeats, ties and an empty table need no rule; a column of the
input that bears the name of an output is replaced.
"""

from __future__ import annotations

import re
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import add_columns, list_array

MARK = "▁"
#: Distinct units that a worker keeps; beyond that its table starts anew.
UNITS_KEPT = 400_000
#: Bytes of text encoded at once.
PIECE = 2 << 20
#: Units of up to so many characters have their agenda in an array, longer ones in a heap.
SHORT = 48
#: Rank of a pair that forms no piece.
NONE = 1 << 30


class PieceModel:
    """A BPE vocabulary of sentencepiece as plain tables."""

    def __init__(self, proto: bytes):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.unknown = sp.unk_id()
        self.bytes = {int(self.pieces[i][1:-1], 16): i for i in range(len(self.pieces)) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        plain = [
            i for i in range(len(self.pieces)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
        ]
        self.ids = {self.pieces[i]: i for i in plain}
        scores = sorted({sp.get_score(i) for i in plain}, reverse=True)
        place = {s: k for k, s in enumerate(scores)}
        self.rank = {self.pieces[i]: place[sp.get_score(i)] for i in plain if len(self.pieces[i]) > 1}
        self._tables()
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("a piece holds a space mark behind another symbol; units would not be independent")
        if sp.normalize("A  éﬁ ") != f"{MARK}A{MARK}{MARK}éﬁ{MARK}":
            raise ValueError("only models with identity normalisation and a leading space mark are supported")

    def _tables(self) -> None:
        """Symbols (pieces and the characters in them) and, by pair of symbols, the rank and symbol of what they form."""
        singles = {c for p in self.ids for c in p} | {chr(b) for b in self.bytes if b < 128}
        names = list(self.ids) + sorted(singles - self.ids.keys())
        number = {name: k for k, name in enumerate(names)}
        pairs = [
            (number[p[:cut]] * len(names) + number[p[cut:]], r, number[p])
            for p, r in self.rank.items()
            for cut in range(1, len(p))
            if p[:cut] in number and p[cut:] in number
        ]
        table = np.array(sorted(pairs) + [(1 << 62, NONE, 0)], np.int64)
        self.symbols, self.pair_keys, self.pair_ranks, self.pair_symbols = len(names), *table.T.copy()
        single = {chr(b): i for b, i in self.bytes.items() if b < 128}
        self.piece_ids = np.array([self.ids.get(n, single.get(n, -1)) for n in names] + [-1], np.int32)
        self.char_symbol = {ord(n): k for n, k in number.items() if len(n) == 1}

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = left * self.symbols + right
        keys[(left == self.symbols) | (right == self.symbols)] = -1
        at = np.searchsorted(self.pair_keys, keys)
        found = self.pair_keys[at] == keys
        return np.where(found, self.pair_ranks[at], NONE), self.pair_symbols[at]

    def encode_units(self, units: list[str]) -> list[bytes]:
        """The ids (int32) of each unit of at least one character.

        The agendas of all units are worked off together: an array entry stands for
        each adjacent pair, and every round takes the best entry of each unit.
        Long units, which would need many rounds, are merged over a heap.
        """
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        short = np.flatnonzero(lengths <= SHORT)
        out: list[bytes] = [b""] * len(units)
        if len(short):
            points = np.frombuffer("".join([units[k] for k in short]).encode("utf-32-le"), np.uint32)
            distinct, back = np.unique(points, return_inverse=True)
            symbol = np.array([self.char_symbol.get(int(c), self.symbols) for c in distinct], np.int64)[back]
            unit = np.repeat(short, lengths[short])
            rank = np.full(len(symbol), NONE, np.int64)
            merged = np.zeros(len(symbol), np.int64)
            inside = np.flatnonzero(unit[1:] == unit[:-1])
            rank[inside], merged[inside] = self._pairs(symbol[inside], symbol[inside + 1])
            done = []
            while len(unit):
                starts = np.concatenate(([0], np.flatnonzero(unit[1:] != unit[:-1]) + 1))
                best = np.minimum.reduceat(rank, starts)
                going = best < NONE
                sizes = np.diff(np.append(starts, len(unit)))
                if not going.all():
                    held = np.repeat(going, sizes)
                    done.append((unit[~held], symbol[~held]))
                    unit, symbol, rank, merged = unit[held], symbol[held], rank[held], merged[held]
                    best, sizes = best[going], sizes[going]
                    if not len(unit):
                        break
                top = np.flatnonzero(rank == np.repeat(best, sizes))
                top = top[np.concatenate(([True], unit[top][1:] != unit[top][:-1]))]  # leftmost of equals
                symbol[top] = merged[top]
                held = np.ones(len(unit), bool)
                held[top + 1] = False
                unit, symbol, rank, merged = unit[held], symbol[held], rank[held], merged[held]
                top = top - np.arange(len(top))
                for at in (top, top - 1):
                    at = at[at >= 0]
                    rank[at] = NONE
                    at = at[at + 1 < len(unit)]
                    at = at[unit[at] == unit[at + 1]]
                    rank[at], merged[at] = self._pairs(symbol[at], symbol[at + 1])
            unit, symbol = (np.concatenate(x) for x in zip(*done))
            order = np.argsort(unit, kind="stable")
            ids = self.piece_ids[symbol[order]]
            buffer = ids.tobytes()
            ends = np.cumsum(np.bincount(unit, minlength=len(units))) * 4
            begin = 0
            for k, end in zip(short.tolist(), ends[short].tolist()):
                out[k] = buffer[begin:end]
                begin = end
            odd = set(unit[order][ids < 0].tolist())
        else:
            odd = set()
        for k in [*odd, *np.flatnonzero(lengths > SHORT).tolist()]:
            out[k] = array("i", self.encode_unit(units[k])).tobytes()
        return out

    def merge(self, symbols: list[str]) -> list[str]:
        """Merges one unit's characters over a heap; entries whose symbols were merged meanwhile are passed over."""
        rank, n = self.rank, len(symbols)
        agenda = [(r << 32) | i for i in range(n - 1) if (r := rank.get(symbols[i] + symbols[i + 1])) is not None]
        heapify(agenda)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        while agenda:
            entry = heappop(agenda)
            left = entry & 0xFFFFFFFF
            head = symbols[left]
            right = after[left]
            if not head or right >= n:
                continue
            joined = head + symbols[right]
            if rank.get(joined) != entry >> 32:
                continue
            symbols[left], symbols[right] = joined, ""
            beyond = after[left] = after[right]
            if beyond < n:
                before[beyond] = left
                if (r := rank.get(joined + symbols[beyond])) is not None:
                    heappush(agenda, (r << 32) | left)
            if (prior := before[left]) >= 0 and (r := rank.get(symbols[prior] + joined)) is not None:
                heappush(agenda, (r << 32) | prior)
        return [s for s in symbols if s]

    def encode_unit(self, unit: str) -> list[int]:
        merged = self.merge(list(unit))
        out = list(map(self.ids.get, merged))
        if None not in out:
            return out
        out = []
        for piece in merged:
            if (i := self.ids.get(piece)) is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in piece.encode()]
            else:
                out.append(self.unknown)
        return out

    def decode_unit(self, ids: list[int]) -> str:
        if self.byte_of.keys().isdisjoint(ids):
            return "".join([self.pieces[i] for i in ids]).replace(MARK, " ")
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            out.append(raw.decode("utf-8", "replace"))
            raw.clear()
            out.append(self.pieces[i])
        out.append(raw.decode("utf-8", "replace"))
        return "".join(out).replace(MARK, " ")


#: A unit of `" " + text`: spaces and what follows them, or the spaces at the end.
_UNIT = re.compile(" +[^ ]+| +$")


def units_of(text: str) -> list[str]:
    """The text's units, each without its first space."""
    if not text:
        return []
    if MARK in text:
        text = text.replace(MARK, " ")
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [u[1:] for u in _UNIT.findall(" " + text)]


class Encoder:
    """Encodes texts by way of a bounded table of checked units."""

    def __init__(self, proto: bytes, kept: int = UNITS_KEPT):
        self.model, self.kept = PieceModel(proto), kept
        self.table: dict[str, bytes] = {}
        self.odd: dict[str, tuple[str, bool]] = {}

    def learn(self, units: list[str]) -> None:
        """Merges new units and checks them against the library."""
        model = self.model
        encoded = model.encode_units([MARK + u.replace(" ", MARK) for u in units])
        theirs = model.library.encode(units, num_threads=1)
        texts = model.library.decode(theirs, num_threads=1)
        for unit, ids, check, text in zip(units, encoded, theirs, texts):
            self.table[unit] = ids
            decoded = model.decode_unit(memoryview(ids).cast("i"))
            # the library gives nothing at all for the empty text, which stands here for one trailing space
            agrees = not unit or (ids == array("i", check).tobytes() and decoded == " " + text)
            if not agrees or decoded[1:] != unit:
                self.odd[unit] = (decoded, agrees)

    def __call__(self, texts: list[str], decode: bool = True) -> tuple[np.ndarray, list[int], list[str], list[bool]]:
        """All ids, each text's number of them, the decoded texts (none, if not asked for), and whether the library agrees."""
        split = [units_of(t) for t in texts]
        new = set().union(*split).difference(self.table) if split else set()
        if len(self.table) + len(new) > self.kept:
            self.table, self.odd = {}, {}
            new = set().union(*split)
        if new:
            self.learn(list(new))
        get, odd = self.table.__getitem__, self.odd
        encoded = [b"".join(map(get, units)) for units in split]
        decoded, agrees = [], []
        for units in split:
            if odd and not odd.keys().isdisjoint(units):
                agrees.append(all(odd[u][1] for u in units if u in odd))
                if decode:
                    decoded.append("".join(odd[u][0] if u in odd else " " + u for u in units)[1:])
            else:
                agrees.append(True)
                if decode:
                    decoded.append(" ".join(units))
        return np.frombuffer(b"".join(encoded), np.int32), [len(e) // 4 for e in encoded], decoded, agrees


def encode_decode(
    docs: DataFrame,
    model_path: str,
    text: str = "text",
    ids: str = "ids",
    decoded: str | None = "decoded",
    agrees: str = "agrees",
    kept: int = UNITS_KEPT,
) -> DataFrame:
    """Adds each text's ids, the text they decode to, and whether the library gave the same for all its units.

    ``decoded`` None: the decoded texts are compared unit by unit, but not returned.  ``kept``: distinct
    units that a worker keeps.

    The model file is read on the driver and sent to the workers (a vocabulary
    file, of fixed size).  One narrow pass: no shuffle.
    """
    with open(model_path, "rb") as f:
        proto = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(proto)

    def make():
        encoder = Encoder(shared.value, kept)

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = batch.column(text if text in batch.schema.names else "__input").fill_null("").to_pylist()
            values, sizes, back, same = encoder(texts, bool(decoded))
            texts = [pa.array(back, pa.string())] if decoded else []
            return [list_array(values, sizes, pa.int32()), *texts, pa.array(same, pa.bool_())]

        return compute

    fields = [
        T.StructField(ids, T.ArrayType(T.IntegerType(), False)),
        *([T.StructField(decoded, T.StringType())] if decoded else []),
        T.StructField(agrees, T.BooleanType()),
    ]
    return add_columns(docs, fields, text, make, PIECE)


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and agrees of :func:`encode_decode`'s rows."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "agrees",
    )
