import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

from newsloom.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [
    None, "", " ", "  ", "a", " lead", "trail ", "two  spaces   here", "日本語 text", "x▁y", "▁", "<|endoftext|> <s></s> <unk>", "\t\n\r\n  x",
    "é é", "\U0001f600 smile \U0001f468‍\U0001f469", "it's I'll 12345 ²", "\x00nul\x01", "nbsp here 　wide", "a" * 3000, "\n" * 400 + "z", "same words", "same words",
]


@pytest.fixture(scope="module")
def plain():
    """Token ids and bytes of either library, as the files say."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    symbol = alignment.byte_symbols()
    of_a = lambda i: bytes(symbol[c] for c in a.id_to_token(i))
    of_b = lambda i: bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def encode(text):
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        return [(i, of_a(i)) for i in x], [(i, of_b(i)) for i in y]

    return encode


def brute(texts, encode):
    """Token by token, document by document."""
    out, links = [], []
    for text in texts:
        x, y = encode(text) if text else ([], [])
        raw = b" " + text.encode() if text else b""
        if b"".join(p for _, p in x) != raw or b"".join(p for _, p in y) != raw:
            x = y = []
        ends = [{}, {}]
        for side, tokens in enumerate((x, y)):
            at = 0
            for k, (i, p) in enumerate(tokens):
                at += len(p)
                ends[side].setdefault(at, []).append((k, i))
        cuts = sorted(ends[0].keys() & ends[1].keys())
        links.append([(i, j) for c in cuts for _, i in ends[0][c] for _, j in ends[1][c]])
        groups, a0, b0 = [], 0, 0
        for c in cuts:
            a1, b1 = ends[0][c][-1][0] + 1, ends[1][c][-1][0] + 1
            groups.append(",".join(str(i) for i, _ in x[a0:a1]) + "|" + ",".join(str(i) for i, _ in y[b0:b1]))
            a0, b0 = a1, b1
        out.append([len(x), len(y), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest() if x else ""])
    count = Counter(p for many in links for p in many)
    best = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    for row, many in zip(out, links):
        row[3:3] = [len(many), sum(count[p] == best[p[1]] for p in many), sum(count[p] for p in many)]
    return [tuple(r) for r in out]


def test_odd_texts_equal_brute_force(spark, plain):
    rows = [(k if k % 5 else None, t) for k, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 AS n_a", "'x' AS n_links", "1 AS k", "doc_id AS pair")
    got = alignment.align(docs.repartition(3), A, B)
    assert sorted(got.columns) == sorted(["doc_id", "text", "k", "pair", *COLUMNS])
    assert Counter((r.doc_id, r.text, *(r[c] for c in COLUMNS)) for r in got.collect()) == Counter((*k, *w) for k, w in zip(rows, brute(ODD, plain)))
    assert alignment.align(docs.limit(0), A, B).count() == 0


def test_table_equals_brute_force(spark, sf_dir, plain):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = {r.doc_id: w for r, w in zip(rows, brute([r.text for r in rows], plain))}
    got = alignment.report(docs.repartition(4), A, B)
    assert got.dtypes == [("doc_id", "bigint")] + [(c, "bigint") for c in COLUMNS[:-1]] + [("groups_sha256", "string")]
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in got.collect()} == want


def test_groups_column(spark, plain):
    docs = spark.createDataFrame([(1, "alignment of tokenizers"), (2, None), (3, "naïve façade")], "doc_id long, text string")
    for r in alignment.align(docs, A, B, groups=True).collect():
        x, y = plain(r.text) if r.text else ([], [])
        assert r.a_ids == [i for i, _ in x] and r.b_ids == [i for i, _ in y] and len(r.a_group_ends) == len(r.b_group_ends) == r.n_groups
        for i, j in zip(r.a_group_ends, r.b_group_ends):
            assert b"".join(p for _, p in x[:i]) == b"".join(p for _, p in y[:j])
        assert not r.text or (r.a_group_ends[-1], r.b_group_ends[-1]) == (r.n_a, r.n_b)


def test_parts_and_units_are_exact(plain, monkeypatch):
    """Texts cut into many parts, and a table of units that starts anew, change nothing."""
    rng = random.Random(3)
    pieces = ["word", " ", "  ", "\n", "It's", "é", " 12", "!?", "\t", "日本", " a b c", "ﬁ", " ", " ²"]
    texts = ["".join(rng.choice(pieces) for _ in range(n)) for n in (1, 30, 300, 4000)]
    with open(A, "rb") as f, open(B, "rb") as g:
        aligner = alignment.Aligner(f.read(), g.read())
    monkeypatch.setattr(alignment, "UNITS_KEPT", 5)
    monkeypatch.setattr(alignment, "parts_of", lambda t, cut=alignment.parts_of: cut(t, 20))
    assert len(alignment.parts_of(texts[3])) > 50
    for _ in range(2):
        got = aligner.align(texts)
        want = brute(texts, plain)
        assert list(zip(got["n_a"], got["n_b"], got["n_groups"], got["digest"])) == [(w[0], w[1], w[2], w[6]) for w in want]


def test_very_long_texts(plain):
    with open(A, "rb") as f, open(B, "rb") as g:
        aligner = alignment.Aligner(f.read(), g.read())
    for text in ("some words of a long text " * 40_000, "ab" * 100_000, " " * 50_000 + "x"):
        got = aligner.align([text])
        x, y = plain(text)
        assert list(got["a"]) == [i for i, _ in x] and list(got["b"]) == [i for i, _ in y]


def test_both_libraries_agree_on_every_code_point(plain):
    """A's ids come from another library than the one of its file; pre-tokens follow each character's class."""
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    with open(A, "rb") as f:
        fast = alignment.ByteLevel(f.read())
    points = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 4000):
        probes = [f"x{c}x{c}1{c}1{c}!{c}! {c}  {c}{c}\n{c}'s{c}" for c in points[k : k + 4000]]
        ids, sizes = fast(["".join(probes[i : i + 50]) for i in range(0, len(probes), 50)])
        want = [e.ids for e in a.encode_batch([" " + "".join(probes[i : i + 50]) for i in range(0, len(probes), 50)], add_special_tokens=False)]
        assert ids.tolist() == [i for x in want for i in x] and sizes.tolist() == [len(x) for x in want]
