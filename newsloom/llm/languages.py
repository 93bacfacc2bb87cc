"""Language identification as inference in a mixture of languages.

Each language is a distribution over hashed byte trigrams inside words, counted
over all labelled training rows.  A document is a bag of words drawn from a mixture
of languages: expectation-maximisation estimates its proportions from the words'
likelihoods, and the set of languages is chosen by penalised likelihood (half the
logarithm of the number of words, and ``STEP``, for each language beyond the first).

Learning shuffles one row per task, language and trigram bucket.  The model is sparse, one
number for each language and bucket seen with it (at most ``BUCKETS`` for a language), so
what reaches the driver and the workers grows with the number of languages alone, and a
language whose name is junk costs next to nothing.  Prediction is one narrow pass over whole
texts, in pieces that are the smaller the more languages there are; a very long text is a
piece of its own.

A text that is null or has no letter is ``und`` with score 0, as is every text if
nothing was learned (no row with a language, or an empty table).  Rows without a
language, text or letter teach nothing.  Repeated rows count as often as they occur;
ties go to the language that sorts first.  Input columns that bear the name of an
output are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import add_columns, flat_bytes, pieces

BUCKETS = 1 << 16
#: Pseudo-count of every bucket.
ALPHA = 0.5
ROUNDS = 12
STEP = 3.0
#: Bytes of text worked on at once.
PIECE = 1 << 19

#: 0 for what is no letter; 1-26 for a-z in either case; above for every byte of other characters.
_CLASS = np.array(
    [b - 64 if 65 <= b <= 90 else b - 96 if 97 <= b <= 122 else b - 101 if b >= 128 else 0 for b in range(256)], np.uint8
)


def word_trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each letter's trigram, the first trigram of each word, and each word's row."""
    data, bounds = flat_bytes(column)
    rows = len(bounds) - 1
    row = np.repeat(np.arange(rows, dtype=np.int32), np.diff(bounds))
    kind = np.zeros(len(data) + rows + 2, np.uint8)
    kind[np.arange(1, len(data) + 1) + row] = _CLASS[data]  # a gap parts the rows
    at = np.flatnonzero(kind)
    wide = kind.astype(np.uint32)
    code = (wide[at - 1] * np.uint32(160) + wide[at]) * np.uint32(160) + wide[at + 1]
    code = (code * np.uint32(2654435761)) >> np.uint32(16)
    first = np.flatnonzero(kind[at - 1] == 0)
    word_row = np.searchsorted(bounds[1:] + np.arange(1, rows + 1), at[first], "right")
    return code, first, word_row


def count_trigrams(labelled: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, bucket, n over all rows that have a language."""

    def run(source):
        held: dict[str, np.ndarray] = {}
        for whole in source:
            for batch in pieces(whole, "text", PIECE):
                names = batch.column("lang").dictionary_encode()
                codes, first, row = word_trigrams(batch.column("text"))
                if not len(codes):
                    continue
                of = names.indices.to_numpy(zero_copy_only=False)[row]
                sizes = np.diff(np.append(first, len(codes)))
                both = np.repeat(of.astype(np.int64), sizes) * BUCKETS + codes
                table = np.bincount(both, minlength=len(names.dictionary) * BUCKETS).reshape(-1, BUCKETS)
                for k, name in enumerate(names.dictionary.to_pylist()):
                    held[name] = held[name] + table[k] if name in held else table[k]
        for name, counts in held.items():
            bucket = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(bucket)), pa.array(bucket, pa.int32()), pa.array(counts[bucket], pa.int64())],
                names=["lang", "bucket", "n"],
            )

    used = labelled.select(labelled[lang].cast("string").alias("lang"), labelled[text].alias("text")).dropna()
    return used.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], tuple[np.ndarray, ...]]:
    """The languages, sorted, and the logarithms of their trigrams' probabilities.

    These are each language's logarithm of an unseen bucket, and by bucket the languages it was
    seen with and what their logarithm is above that of an unseen one.
    """
    one = F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("x")
    rows = count_trigrams(labelled, text, lang).groupBy("lang").agg(F.sum("n").alias("n"), one).orderBy("lang")
    names, least, buckets, of, above = [], [], [], [], []
    for r in rows.select("lang", "n", "x.bucket", F.col("x.n").alias("counts")).toLocalIterator():
        least.append(np.log(ALPHA / (r["n"] + ALPHA * BUCKETS)))
        buckets.append(np.array(r["bucket"], np.int32))
        of.append(np.full(len(buckets[-1]), len(names), np.int32))
        above.append((np.log((np.array(r["counts"]) + ALPHA) / ALPHA)).astype(np.float32))
        names.append(r["lang"])
    bucket, of, above = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((buckets, np.int32), (of, np.int32), (above, np.float32)))
    order = np.argsort(bucket, kind="stable")
    start = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
    return names, (np.array(least, np.float32), start, of[order], above[order])


def _columns(logs: tuple[np.ndarray, ...], used: np.ndarray) -> np.ndarray:
    """The logarithms of some buckets (language, bucket)."""
    least, start, of, above = logs
    out = np.repeat(least[:, None], len(used), axis=1)
    size = start[used + 1] - start[used]
    at = np.repeat(start[used], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[of[at], np.repeat(np.arange(len(used)), size)] += above[at]
    return out


def mixtures(likelihood: np.ndarray, starts: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM over the words (language, word) of documents that start at ``starts``.

    allowed: (language, document).  Returns proportions (language, document) and the
    log-likelihood of each document.
    """
    sizes = np.diff(np.append(starts, likelihood.shape[1]))
    share = allowed / allowed.sum(0)
    for _ in range(ROUNDS):
        joint = likelihood * np.repeat(share, sizes, axis=1).astype(np.float32)
        joint /= np.maximum(joint.sum(0), 1e-30)
        share = np.add.reduceat(joint, starts, axis=1, dtype=np.float64) / sizes
    total = (likelihood * np.repeat(share, sizes, axis=1).astype(np.float32)).sum(0)
    return share, np.add.reduceat(np.log(np.maximum(total, 1e-30)).astype(np.float64), starts)


def infer(column: pa.Array, logs: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row: best language (-1 for none), its proportion in the full mixture, proportions in the chosen set."""
    languages, rows = len(logs[0]), len(column)
    best, score, chosen = np.full(rows, -1), np.zeros(rows), np.zeros((languages, rows))
    codes, first, word_row = word_trigrams(column)
    if not languages or not len(first):
        return best, score, chosen
    seen = np.zeros(BUCKETS, bool)
    seen[codes] = True
    number = np.cumsum(seen) - 1
    codes = number[codes]
    words = np.stack([np.add.reduceat(log[codes], first) for log in _columns(logs, np.flatnonzero(seen))])
    words -= words.max(0)
    starts = np.flatnonzero(np.concatenate(([True], word_row[1:] != word_row[:-1])))
    row = word_row[starts]
    sizes = np.diff(np.append(starts, words.shape[1]))
    alone = np.add.reduceat(words, starts, axis=1, dtype=np.float64)
    likelihood = np.exp(words)
    share, fit = mixtures(likelihood, starts, np.ones((languages, len(row))))
    one = alone.argmax(0)
    chosen_share = np.zeros_like(share)
    chosen_share[one, np.arange(len(row))] = 1
    reached = alone.max(0)
    step = STEP + np.log(sizes) / 2
    order = np.argsort(-share, axis=0, kind="stable")
    for k in range(2, languages + 1):
        # the full mixture bounds what any set can reach
        open_ = np.flatnonzero(fit - (k - 1) * step > reached)
        if not len(open_):
            break
        held = np.isin(np.repeat(np.arange(len(row)), sizes), open_)
        allowed = np.zeros((languages, len(open_)))
        for rank in range(k):
            allowed[order[rank, open_], np.arange(len(open_))] = 1
        begin = np.cumsum(sizes[open_]) - sizes[open_]
        found, value = mixtures(likelihood[:, held], begin, allowed)
        value -= (k - 1) * step[open_]
        better = value > reached[open_]
        reached[open_[better]] = value[better]
        chosen_share[:, open_[better]] = found[:, better]
    top = chosen_share.argmax(0)
    best[row], score[row] = top, share[top, np.arange(len(row))]
    chosen[:, row] = chosen_share
    return best, score, chosen


def predict(docs: DataFrame, model: tuple[list[str], tuple[np.ndarray, ...]], text: str = "text") -> DataFrame:
    """Adds lang_pred, score and languages (the chosen set with its proportions, largest first)."""
    names, logs = model
    shared = docs.sparkSession.sparkContext.broadcast((names, logs))

    def make():
        names, logs = shared.value

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            column = batch.column(text if text in batch.schema.names else "__input")
            best, score, chosen = infer(column, logs)
            ascii_letter = pa.compute.match_substring_regex(column, "[A-Za-z]").fill_null(False)
            for r in np.flatnonzero((best >= 0) & ~ascii_letter.to_numpy(zero_copy_only=False)):
                if not any(map(str.isalpha, column[int(r)].as_py())):
                    best[r], score[r], chosen[:, r] = -1, 0, 0
            sets = []
            for r in range(len(best)):
                used = np.flatnonzero(chosen[:, r] > 0) if best[r] >= 0 else ()
                sets.append(sorted(({"lang": names[k], "share": float(chosen[k, r])} for k in used), key=lambda x: -x["share"]))
            return [
                pa.array([names[k] if k >= 0 else "und" for k in best.tolist()], pa.string()),
                pa.array(np.clip(score, 0, 1), pa.float64()),
                pa.array(sets, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))),
            ]

        return compute

    one = T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())])
    fields = [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("languages", T.ArrayType(one)),
    ]
    return add_columns(docs, fields, text, make, max(1 << 16, min(PIECE, (16 << 20) // max(1, len(names)))))


def held_out(doc_id):
    """Rows whose crc32 of the id as text is divisible by 5; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(5)) == 0


def report(docs: DataFrame) -> DataFrame:
    """Learns from the rows that are not held out and predicts all."""
    used = docs.select("doc_id", "text", "lang", held_out(docs["doc_id"]).alias("held_out"))
    model = learn(used.filter(~F.col("held_out")))
    return predict(used.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score")
