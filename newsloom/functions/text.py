"""Cleaning, keys and small text functions as column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V

#: Letters of Latin scripts (to U+024F and U+1E00-U+1EFF) that lose a mark under NFKD, lower case, by rule.
_MARKED = {}
for _c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
    _low = chr(_c).lower()
    _bare = "".join(x for x in unicodedata.normalize("NFKD", _low) if not unicodedata.combining(x))
    if len(_low) == 1 and len(_bare) == 1 and _bare != _low:
        _MARKED[_low] = _bare


def text(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used: nested uses would multiply the expression."""
    return F.transform(F.array(value), use)[0]


def fold(c) -> Column:
    """Lower case without accents (Latin letters; ligatures and ß stay); loose combining marks go."""
    marked = "".join(_MARKED)
    low = F.lower(text(c))
    plain = F.translate(low, marked, "".join(_MARKED[x] for x in marked))
    # a text of as many bytes as characters has no accents
    return F.when(F.octet_length(low) == F.char_length(low), low).otherwise(F.regexp_replace(plain, r"\p{Mn}", ""))


def squeeze(c) -> Column:
    """White space to one space, trimmed; null to empty."""
    return F.trim(F.regexp_replace(text(c), r"(?U)\s+", " "))


def key(c) -> Column:
    """Folded, without addresses and punctuation, squeezed."""
    bare = F.regexp_replace(fold(c), r"https?://\S+", " ")
    return squeeze(F.regexp_replace(bare, r"(?U)[^\w\s]", " "))


def story_key(title, summary, content) -> Column:
    """Identity of a story: its title's key, or for short titles the title with the start of the body."""
    body = key(F.when(text(summary) != "", text(summary)).otherwise(text(content)))
    return let(
        key(title),
        lambda k: F.when(F.length(k) >= 12, F.concat(F.lit("title:"), k)).otherwise(
            F.concat(F.lit("body:"), k, F.lit(":"), F.substring(body, 1, 140))
        ),
    )


def subject_key(folded: Column, subjects=V.KNOWN_SUBJECTS, stop_words=V.SUBJECT_STOP_WORDS) -> Column:
    """Identity of a subject of folded text: a known one, or its first four telling words, or its start."""

    def use(t):
        words = F.filter(F.regexp_extract_all(t, F.lit("[a-z0-9]{4,}"), 0), lambda w: ~w.isin(list(stop_words)))
        other = let(
            F.array_join(F.slice(words, 1, 4), "-"), lambda named: F.when(named != "", named).otherwise(F.substring(t, 1, 40))
        )
        return reduce(lambda rest, s: F.when(t.rlike(s[1]), F.lit(s[0])).otherwise(rest), reversed(subjects), other)

    return let(folded, use)


def canonical_url(c) -> Column:
    return F.regexp_replace(F.trim(text(c)), "(?s)#.*$", "")


def url_hash(c) -> Column:
    return F.sha2(c, 256)


def excerpt(c, most: int = 320) -> Column:
    """Squeezed; a longer one is cut at the last space before ``most``."""

    def use(clean):
        cut = F.regexp_replace(F.substring(clean, 1, most), r" [^ ]*$", "")
        return F.when(F.length(clean) <= most, clean).otherwise(F.concat(cut, F.lit("...")))

    return let(squeeze(c), use)


def words(c) -> Column:
    return F.filter(F.split(squeeze(c), " "), lambda w: w != "")


def word_count(c) -> Column:
    return F.size(words(c))


def sentences(c) -> Column:
    return F.filter(F.transform(F.split(text(c), r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda s: s != "")


def paragraphs(c) -> Column:
    """Split at line ends, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text(c), r"\n+"), lambda x: F.trim(x)), lambda p: p != "")


def safe_stem(c) -> Column:
    return F.regexp_replace(text(c), r"(?U)[^\p{L}\p{N}_-]", "-")


def repair_accents(c, repairs=V.ACCENT_REPAIRS) -> Column:
    return reduce(lambda t, r: F.regexp_replace(t, rf"(?U)\b{r[0]}\b", r[1]), repairs, text(c))


def radio_title(c) -> Column:
    """A title without leading signs and live marks."""
    bare = F.trim(F.regexp_replace(text(c), r"(?U)^\W+", ""))
    bare = F.regexp_replace(bare, r"(?i)^(?:EN DIRECT|DIRECT|LIVE)\s*[,:\-]\s*", "")
    bare = F.regexp_replace(squeeze(bare), r"^[ .]+|[ .]+$", "")
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit("Information a suivre"))


def _quoted(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\.\[\]{}()*+?^$|#&~\-])", r"\\$1")


def source_names(source) -> Column:
    """The names a source goes by: its own, the part before " - ", and a known short form."""
    whole = text(source)
    short = F.trim(F.split(whole, " - ", 2)[0])
    alias = F.create_map(*[F.lit(x) for pair in V.SOURCE_ALIASES.items() for x in pair])
    return F.filter(F.array_distinct(F.array(whole, short, F.try_element_at(alias, short))), lambda n: n.isNotNull() & (n != ""))


def without_source(c, source, keep_lines: bool = False) -> Column:
    """Takes out phrases that name the source, by each of its names; the patterns depend on the row."""

    def one(out, name):
        def replaced(t):
            for phrase in V.SOURCE_PHRASES:
                head, tail = phrase.split("{name}")
                t = F.regexp_replace(t, F.concat(F.lit("(?iu)" + head), _quoted(name), F.lit(tail)), F.lit(""))
            return t

        # every phrase holds the name, so a text without it is left alone
        return F.when(F.rlike(out, F.concat(F.lit("(?iu)"), _quoted(name))), replaced(out)).otherwise(out)

    out = F.aggregate(source_names(source), text(c), one)
    if keep_lines:
        return F.trim(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n{3,}", "\n\n"))
    return squeeze(out)


def _holds(t: Column, marks, folded: bool) -> Column:
    """Whether the text holds one of the marks; ``folded``: in either case."""
    any_of = lambda x: reduce(lambda a, b: a | b, [F.contains(x, F.lit(m)) for m in marks])
    return let(F.lower(t), any_of) if folded else any_of(t)


def article_text(c, source) -> Column:
    """Article text without source references, bylines and calls to subscribe."""
    # bylines in their order; where no literal of a group stands, none of its patterns matches
    bare = without_source(c, source)
    for marks, folded, patterns in V.BYLINE_GROUPS:
        bare = let(bare, lambda t: F.when(_holds(t, marks, folded), reduce(lambda x, p: F.regexp_replace(x, p, ""), patterns, t)).otherwise(t))  # noqa: B023
    # no line ends are left, so these are the signs at the very ends
    return F.btrim(squeeze(bare), F.lit(" ."))


def without_fillers(c, fillers=V.FILLERS) -> Column:
    bare = reduce(lambda t, p: F.regexp_replace(t, "(?iu)" + p, ""), fillers, text(c))
    return F.trim(F.regexp_replace(bare, r"[ \t]+", " "))


def usable_excerpt(c, title) -> Column:
    noisy = "|".join(V.NOISY_EXCERPT)
    return let(fold(squeeze(c)), lambda f: (word_count(f) >= 4) & (f != fold(title)) & ~f.rlike(noisy))


def _ends_open(folded: Column) -> Column:
    ends = rf"^$| (?:{'|'.join(V.DANGLING_WORDS)})$|\btels que [a-z]+$"
    return F.regexp_replace(folded, r"^[ .,!?:;]+|[ .,!?:;]+$", "").rlike(ends)


def looks_incomplete(c) -> Column:
    return _ends_open(fold(c))


def template_text(title, summary, content, source) -> Column:
    """The first usable one of summary and content, else the title."""
    tried = F.filter(F.array(article_text(summary, source), article_text(content, source)), lambda t: usable_excerpt(t, title))
    return F.coalesce(F.try_element_at(tried, F.lit(1)), radio_title(title))


def sentence(c) -> Column:
    """Trimmed, without dangling function words, with a sign at the end."""
    bare = reduce(lambda t, p: F.regexp_replace(t, p, ""), V.DANGLING_ENDS, F.trim(text(c)))
    bare = F.regexp_replace(bare, r"^[ ,;:]+|[ ,;:]+$", "")
    return F.regexp_replace(bare, r"(?s)(?<=[^.!?])\z", ".")


def lower_initial(c) -> Column:
    shout = text(c).rlike(r"^\p{Lu}{2}")
    return F.when(shout, text(c)).otherwise(F.concat(F.lower(F.substring(text(c), 1, 1)), F.substring(text(c), 2, 1 << 30)))


def upper_initial(c) -> Column:
    return F.concat(F.upper(F.substring(text(c), 1, 1)), F.substring(text(c), 2, 1 << 30))


def word_limit(c, most: int) -> Column:
    cut = F.concat(F.regexp_replace(F.array_join(F.slice(words(c), 1, most), " "), "[ ,;:]+$", ""), F.lit("."))
    return F.when(word_count(c) <= most, text(c)).otherwise(cut)


def bounded_excerpt(title, c, source, most: int) -> Column:
    """Whole sentences up to ``most`` words: the first one always, then while they fit; titles and unfinished ones are passed over.

    Sentences behind the one that no longer fits are not examined.
    """
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("n"), F.lit(False).alias("full"))

    def use(x):
        def step(acc, s):
            def grown(n):
                over = (F.size(acc["kept"]) > 0) & (acc["n"] + n > most)
                kept = F.when(over, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(s)))
                total = F.when(over, acc["n"]).otherwise(acc["n"] + n)
                good = (n >= 4) & let(fold(s), lambda f: (F.instr(x["head"], f) == 0) & ~_ends_open(f))
                return F.when(good, F.struct(kept.alias("kept"), total.alias("n"), (over | (total >= most)).alias("full"))).otherwise(acc)

            return F.when(acc["full"], acc).otherwise(let(word_count(s), grown))

        chosen = F.aggregate(x["every"], start, step, lambda acc: F.array_join(acc["kept"], " "))
        none = (F.size(x["every"]) > 0) | (fold(x["clean"]) == x["head"])
        return let(chosen, lambda t: F.when(t != "", t).when(none, "").otherwise(word_limit(x["clean"], most)))

    parts = lambda clean: F.struct(clean.alias("clean"), sentences(clean).alias("every"), fold(title).alias("head"))
    return let(article_text(c, source), lambda clean: let(parts(clean), use))


def pair_sentences(c) -> Column:
    """Several paragraphs stay; of one with more than three sentences each two become a paragraph."""
    parts = F.filter(F.transform(F.split(text(c), r"\n{2,}"), lambda x: F.trim(x)), lambda p: p != "")
    split = F.split(F.trim(text(c)), r"(?<=[.!?])\s+")
    twos = F.transform(F.sequence(F.lit(1), F.size(split), F.lit(2)), lambda i: F.trim(F.array_join(F.slice(split, i, F.lit(2)), " ")))
    return (
        F.when(F.size(parts) > 1, F.array_join(parts, "\n\n"))
        .when(F.size(split) <= 3, F.trim(text(c)))
        .otherwise(F.array_join(F.filter(twos, lambda p: p != ""), "\n\n"))
    )


def set_query_value(url, name: str, value) -> Column:
    """The URL with parameter ``name`` replaced, put last."""
    bare = F.regexp_replace(text(url), rf"([?&]){name}=[^&#]*&?", "$1")
    bare = F.regexp_replace(bare, r"[?&]$", "")
    joint = F.when(F.instr(bare, "?") > 0, F.lit("&")).otherwise(F.lit("?"))
    return F.concat(bare, joint, F.lit(f"{name}="), F.url_encode(text(value)))
