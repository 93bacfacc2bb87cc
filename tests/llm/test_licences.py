import random
import re

from newsloom.llm import licences

PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}


def words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text):
    doc, places = words(text), []
    for label, phrase in PHRASES.items():
        p = phrase.split()
        places += [(k, label) for k in range(len(doc) - len(p) + 1) if doc[k : k + len(p)] == p]
    at = [k for k, _ in places]
    return len(doc), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({n for _, n in places}))


def corpus():
    rng = random.Random(9)
    parts = ["cc", "CC-BY", "by", "all", "rights", "reserved.", "All rights\nreserved", "general", "public", "GNU General Public License", "license", "xé", "nc"]
    return [" ".join(rng.choice(parts) for _ in range(rng.randrange(0, 30))) for _ in range(300)]


def test_base_phrases_equal_brute_force(spark):
    rows = list(enumerate(corpus())) + [(900, None), (901, ""), (902, "cc by"), (None, "cc by cc by")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = licences.report(docs).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_notices(spark):
    cases = {
        "Licensed under the Apache License, Version 2.0.": "apache-2.0",
        "Released under the MIT License.": "mit",
        "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
        "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc",
        "The Apache helicopter has a license": "",
        "mit license": "",
        "Nothing here": "",
    }
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string").selectExpr("*", "3 AS n_words")
    got = {r.doc_id: r.labels for r in licences.report(docs).collect()}
    assert list(cases.values()) == [got[k] for k in range(len(cases))]
    assert licences.report(docs.limit(0)).count() == 0


def test_every_template_is_found_within_other_words(spark):
    rows = [(k, f"Some words, before. {t.text}! And after it.") for k, t in enumerate(licences.NOTICES)]
    rows += [(100 + k, t.text.replace(" the ", " that ", 1)) for k, t in enumerate(licences.NOTICES) if " the " in t.text and not any("the" in x for x in t.keys)]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for doc, r in got.items():
        assert licences.NOTICES[doc % 100].label in {m.label for m in r.matches}, doc
        assert all(m.score == 1 or doc >= 100 or m.label != licences.NOTICES[doc].label or m.n_words < 30 for m in r.matches)


def brute_labels(text, documents):
    """Labels by trying every template at every place, with weights counted plainly."""
    import math

    own = licences.words_of((text or "").encode())
    found = set()
    for t in licences.BASE + licences.NOTICES:
        words = licences.words_of(t.text.encode())
        weight = {w: math.log((len(documents) + 1) / (sum(w in d for d in documents) + 1)) + 1 for w in words}
        for start in range(-len(words), len(own)):
            held = [0 <= start + i < len(own) and own[start + i] == w for i, w in enumerate(words)]
            keys = [licences.words_of(k.encode()) for k in t.keys]
            at = [next(i for i in range(len(words)) if words[i : i + len(k)] == k) for k in keys]
            whole = all(all(held[i : i + len(k)]) for i, k in zip(at, keys))
            score = sum(weight[w] for w, h in zip(words, held) if h) / sum(weight[w] for w in words)
            if whole and score >= (1 - 1e-9 if t.base else licences.LEAST):
                found.add(t.label)
    return ",".join(sorted(found))


def test_labels_equal_brute_force(spark):
    import random

    rng = random.Random(1)
    rows = []
    for k in range(40):
        words = []
        for t in rng.sample(licences.NOTICES, rng.randrange(3)):
            part = t.text.split()
            for _ in range(rng.randrange(6)):
                part[rng.randrange(len(part))] = "other"
            words += ["before", *part[: rng.randrange(len(part) // 2, len(part) + 1)]]
        rows.append((k, " ".join(words)))
    rows += [(50, None), (51, "all rights reserved general public license " * 3000)]
    documents = [set(licences.words_of((t or "").encode())) for _, t in rows]
    got = {r.doc_id: r.labels for r in licences.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, text in rows:
        assert got[k] == brute_labels(text if k != 51 else "all rights reserved general public license", documents), k
