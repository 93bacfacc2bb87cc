import random

import public_tokenizers
import pytest
import sentencepiece

from newsloom.llm import sentencepieces as sp

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    rng = random.Random(4)
    parts = ["the", "tion", " ", "  ", "\n", "\t", "é", "ß", "日本", "😀", "▁", "x", "aaaa", "<s>", "<0x41>", "…", " ", "\x00"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(300)]
    return out + ["", " ", "   ", "a", " a ", "a" * 3000, "ab" * 999 + " c", "word " * 500]


@pytest.mark.parametrize("kept", [10**6, 40])
def test_units_equal_library(library, kept):
    with open(PATH, "rb") as f:
        encoder = sp.Encoder(f.read(), kept)
    every = texts()
    for at in range(0, len(every), 50):
        some = every[at : at + 50]
        values, sizes, decoded, agrees = encoder(some)
        want = library.encode(some)
        assert sizes == [len(w) for w in want] and values.tolist() == [i for w in want for i in w]
        assert decoded == library.decode(want) and all(agrees)


def test_heap_and_array_agendas_agree():
    with open(PATH, "rb") as f:
        model = sp.PieceModel(f.read())
    rng = random.Random(1)
    units = ["▁" + "".join(rng.choice("abcdeinorst▁é日") for _ in range(rng.randrange(1, 40))) for _ in range(500)]
    import numpy as np

    for unit, raw in zip(units, model.encode_units(units)):
        assert np.frombuffer(raw, np.int32).tolist() == model.encode_unit(unit)


def test_rows(spark, library):
    rows = [(1, None), (2, ""), (3, "Hello  world"), (3, "Hello  world"), (None, "x\ny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "9 AS ids")
    got = sorted(sp.encode_decode(docs, PATH).collect(), key=str)
    assert len(got) == 5
    for r in got:
        assert r.ids == library.encode(r.text or "") and r.decoded == (r.text or "") and r.agrees
    assert sp.digests(sp.encode_decode(docs, PATH)).count() == 5 and sp.encode_decode(docs.limit(0), PATH).count() == 0
