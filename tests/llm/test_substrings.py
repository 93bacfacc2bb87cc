import random
import re

import pyarrow as pa
import pytest

from newsloom.llm import queries, substrings
from newsloom.llm.shared import Workspace


WORD = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain(text):
    """Word spans, lower-cased words, and for each word whether a sentence and a line begin there."""
    spans = [m.span() for m in WORD.finditer(text)]
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), text[a:b]) for a, b in spans]
    gaps = [".\n"] + [text[x[1] : y[0]] for x, y in zip(spans, spans[1:])]
    return spans, words, [any(c in ".!?\n" for c in g) for g in gaps], ["\n" in g for g in gaps]


def brute_units(text):
    """(normalised words, first word, end) of each unit, written plainly."""
    spans, words, sentence, line = plain(text)
    opens = [k for k in range(len(words)) if sentence[k]] + [len(words)]
    hashes = substrings.words_of(pa.array([text])).hashes.tolist()
    for a, b in zip(opens, opens[1:]):
        if b - a > 24:
            for k in range(a, b - 1):
                if (hashes[k] >> 32) % 8 == 0:
                    sentence[k + 1] = True
    opens = [k for k in range(len(words)) if sentence[k]] + [len(words)]
    out = []
    for k in opens[:-1]:
        ends = [e for e in opens if e >= k + 8]
        if ends:
            out.append((tuple(words[k : ends[0]]), k, ends[0]))
    opens = [k for k in range(len(words)) if line[k]] + [len(words)]
    return out + [(("\n", *words[a:b]), a, b) for a, b in zip(opens, opens[1:])]


def brute_cut(text, gone):
    """The text without some words; what lies between words goes with one of them."""
    spans = plain(text)[0]
    if not spans:
        return text
    edges = [0]
    for (_, a), (b, _) in zip(spans, spans[1:]):
        gap, at = text[a:b], 0
        closers = [k for k, c in enumerate(gap) if c in ".!?\n"]
        if closers:
            at = closers[-1] + 1
            if gap[at - 1] != "\n":
                at += len(gap[at:]) - len(gap[at:].lstrip(" "))
        edges.append(a + at if closers else b)
    edges.append(len(text))
    return "".join(text[edges[k] : edges[k + 1]] for k in range(len(spans)) if k not in gone)


def brute(rows, run_words=None):
    first, found = {}, {}
    for doc, text in rows:
        words = plain(text)[1]
        found[doc] = brute_units(text)
        if run_words:
            found[doc] += [((0, *words[k : k + run_words]), k, k + run_words) for k in range(len(words) - run_words + 1)]
        for unit, _, _ in found[doc]:
            first[unit] = min(first.get(unit, doc), doc)
    result = {}
    for doc, text in rows:
        gone, since = set(), {}
        for unit, a, b in found[doc]:
            if first[unit] < doc or a - since.setdefault(unit, a) >= b - a:
                gone |= set(range(a, b))
        result[doc] = brute_cut(text, gone)
    return result


def corpus():
    rng = random.Random(5)
    sentence = lambda: " ".join(f"wörd{rng.randrange(60)}" for _ in range(rng.randrange(1, 14))).capitalize() + rng.choice(".!?")
    passage = " ".join(sentence() for _ in range(9))
    lines = ["Four short words here", "Sign up for our newsletter today and win a prize now", "Ok."]
    rows = []
    for doc in range(120):
        parts = [sentence() for _ in range(rng.randrange(1, 12))]
        if doc % 3 == 0:
            parts.insert(rng.randrange(len(parts)), passage)
        if doc % 4 == 0:
            parts.insert(rng.randrange(len(parts)), "\n" + rng.choice(lines) + "\n")
        rows.append((doc, rng.choice([" ", "\n"]).join(parts)))
    long = " ".join(f"lang{rng.randrange(40)}" for _ in range(90))
    rows += [(300, "Anfang " + long + ", " + long[:200] + " Ende"), (301, "Etwas anderes " + long + " und mehr"), (302, long)]
    rows.append((500, "Same sentence with more than eight words in it. " * 5))
    rows.append((501, "a. " * 40))
    return rows


@pytest.mark.parametrize("run_words", [None, 51])
def test_equals_brute_force(spark, run_words):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = substrings.deduplicate(docs, run_words).collect()
    want = brute(rows, run_words)
    texts = dict(rows)
    for r in got:
        assert r.text == want[r.doc_id], r.doc_id
        left, at = "", 0
        for s in r.removed:
            left += texts[r.doc_id][at : s.start]
            at = s.end
        assert left + texts[r.doc_id][at:] == r.text
    assert len(got) == len(rows)


def test_passage_inside_a_line_goes_and_clean_text_stays(spark):
    rng = random.Random(1)
    fresh = lambda n: " ".join(f"u{rng.randrange(10**6)}" for _ in range(n))
    passage = ". ".join(fresh(12) for _ in range(6))
    rows = [(1, fresh(20) + " " + passage + " " + fresh(20)), (2, fresh(30)), (3, fresh(9) + " " + passage + ". " + fresh(9))]
    got = {r.doc_id: r for r in substrings.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].text == rows[0][1] and got[2].text == rows[1][1]
    assert len(got[3].text.split()) < 45


def test_odd_rows(spark):
    text = "This one sentence has more than eight words in it."
    rows = [(None, text, 1), (4, text, 2), (4, text, 3), (5, None, 4), (6, "", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, removed int").selectExpr("*", "1 AS doc", "2 AS sig", "0L AS n_chars")
    got = sorted(((r.doc_id or 99, r.text, r.n_chars, r.n_removed) for r in substrings.deduplicate(docs).collect()), key=str)
    assert got == sorted([(99, "", 0, 10), (4, text, 50, 0), (4, text, 50, 0), (5, None, None, 0), (6, "", 0, 0)], key=str)
    assert substrings.deduplicate(docs.limit(0)).count() == 0


def test_every_run_of_over_50_words_goes_whole(spark, tmp_path):
    rng = random.Random(8)
    fresh = lambda n: [f"ü{rng.randrange(10**6)}" for _ in range(n)]
    rows, runs = [], {}
    for k, n in enumerate([50, 51, 52, 60, 80, 300] * 8):
        run = fresh(n)
        if k % 2:
            run[n // 3] += ". No,"  # one word more, and a sentence's end
        before, after = fresh(rng.randrange(40)), fresh(rng.randrange(1, 40))
        rows.append((2 * k, " ".join([*fresh(30), *run, *fresh(9)])))
        rows.append((2 * k + 1, " ".join(["", *before, *run, *after])))
        runs[2 * k + 1] = (n + k % 2, " ".join(["", *before, *after]))
    twice = fresh(70)
    rows.append((900, " ".join(["one", *twice, "two", *twice, "three"])))
    rows.append((901, "ab " * 300))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "length(text) AS n_chars").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op3_substring_dedup(spark, str(tmp_path)).collect()}
    texts = dict(rows)
    for doc, r in got.items():
        if doc in runs:
            n, rest = runs[doc]
            assert n <= 50 or (r.text.strip() == rest.strip() and r.has_repeats and r.n_removed == n), doc
        elif doc < 900:
            assert r.text == texts[doc] and not r.n_removed and not r.has_repeats
    assert got[900].text == " ".join(["one", *twice, "two", "three"])
    assert got[901].text.split() == ["ab"] * 51
    assert len(got) == len(rows)


def test_runs_equal_brute_force(spark, tmp_path):
    rng = random.Random(4)
    pool = [f"w{k}" for k in range(3000)]
    rows = []
    for doc in range(60):
        words = []
        while len(words) < 150:
            a = rng.randrange(2900)
            words += pool[a : a + rng.randrange(5, 90)] if rng.random() < 0.8 else [f"x{rng.randrange(10**6)}"]
        rows.append((doc, " ".join(words)))
    rows += [(60 + k, rows[k][1]) for k in range(5)] + [(70, " ".join(pool[:70] * 3)), (71, " ".join(pool[:70] * 2))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    gone = {}
    for r in substrings.removals(docs, Workspace(spark), 51).collect():
        gone[r.doc] = {k for g in r.gone if g["run"] for k in range(g["first"], g["end"])}
    first = {}
    for doc, text in rows:
        w = text.split()
        for i in range(len(w) - 50):
            first.setdefault(tuple(w[i : i + 51]), (doc, i))
    want = {}
    for doc, text in rows:
        w, own = text.split(), {}
        for i in range(len(w) - 50):
            key = tuple(w[i : i + 51])
            if first[key][0] < doc or i - own.setdefault(key, i) >= 51:
                want.setdefault(doc, set()).update(range(i, i + 51))
    assert len(want) > 20 and {d: g for d, g in gone.items() if g} == want


def test_very_long_text(spark):
    rng = random.Random(6)
    long = " ".join(f"v{rng.randrange(10**6)}" for _ in range(60_000))
    docs = spark.createDataFrame([(1, long), (2, "before. " + long + " after"), (3, long[:400_000])], "doc_id long, text string")
    got = {r.doc_id: r for r in substrings.deduplicate(docs, 51).collect()}
    assert got[1].text == long and not got[1].has_run and got[2].text == "before. after" and got[2].has_run
    assert len(got[3].text.split()) <= 1


def test_every_repeated_line_goes(spark):
    rows = [(1, "One\nTwo words\nown text of the first"), (2, "one\n\n two  WORDS!\nother text"), (3, "text\nOne, two words\nOne")]
    got = {r.doc_id: r.text for r in substrings.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "other text", 3: "text\nOne, two words\n"}
