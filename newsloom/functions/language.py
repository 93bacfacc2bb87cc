"""Rule-based language of short news texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .text import fold, let, text


def canonical(c) -> Column:
    """A language code by its aliases, else ``unknown``."""
    low = F.lower(F.trim(text(c)))
    return reduce(lambda rest, a: F.when(low.isin(list(a[1])), F.lit(a[0])).otherwise(rest), V.LANGUAGE_ALIASES.items(), F.lit("unknown"))


def scores(c: Column) -> Column:
    """n (words), and for each language: occurrences of its marker words, and two for each of its letters that occurs."""
    tokens = F.regexp_extract_all(fold(F.regexp_replace(c, "[^a-zA-ZÀ-ÖØ-öø-ÿ0-9']+", " ")), F.lit("[^ ]+"), 0)

    def use(x):
        out = [F.size(x["tokens"]).alias("n")]
        for name, marks in V.LANGUAGE_WORDS.items():
            known = list(marks)
            found = F.size(F.filter(x["tokens"], lambda t: t.isin(known)))  # noqa: B023  applied at once
            letters = V.LANGUAGE_LETTERS.get(name, "")
            score = reduce(lambda n, ch: n + F.when(F.instr(x["low"], ch) > 0, 2).otherwise(0), letters, found)
            out.append(score.alias(name))
        return F.struct(*out)

    return let(F.struct(tokens.alias("tokens"), F.lower(c).alias("low")), use)


def detect(title, summary, content, region) -> Column:
    """English by region; else the language with the best score, if it is clear."""
    parts = [F.nullif(text(p), F.lit("")) for p in (title, summary, F.substring(text(content), 1, 1800))]

    def use(s):
        fr, en, de = s["fr"], s["en"], s["de"]
        return (
            F.when((s["n"] < 4) | (F.greatest(fr, en, de) < 4), F.lit("unknown"))
            .when((fr >= en) & (fr >= de), F.lit("fr"))
            .when((en >= de) & (en >= F.greatest(fr, de) + 2), F.lit("en"))
            .when((de > en) & (de >= F.greatest(fr, en) + 2), F.lit("de"))
            .otherwise(F.lit("unknown"))
        )

    best = let(scores(F.trim(F.concat_ws(" ", *parts))), use)
    return F.when(F.lower(F.trim(text(region))) == "english", F.lit("en")).otherwise(best)


def resolved(stored, title, summary, content, region) -> Column:
    """The stored language if it is known, else the detected one."""
    known = canonical(stored)
    return F.when(known != "unknown", known).otherwise(detect(title, summary, content, region))
