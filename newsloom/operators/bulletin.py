"""Bulletin text: segments from a template, source credit, and the quality gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import text as X
from ..functions.text import text
from ..sources.folders import cut

#: Texts around a bulletin: (style, language) → opener and closer; {brand} is filled in.
FRAMES = {
    ("", "fr"): ("Bonjour, vous écoutez {brand}. Voici les nouvelles de cette édition.", "C'était {brand}. À bientôt pour la suite."),
    ("", "en"): ("You are listening to {brand}. Here is the news of this edition.", "That was {brand}. More in the next edition."),
    ("pote", "fr"): ("Salut, ici {brand}. On fait vite le tour des nouvelles.", "Voilà, à tout à l'heure sur {brand}."),
    ("enfant", "fr"): ("Bonjour, ici {brand}. Voici les nouvelles avec des mots simples.", "C'est fini pour aujourd'hui. À bientôt sur {brand}."),
}
EMPTY = {
    "fr": "Vous écoutez {brand}. Aucune nouvelle sûre n'est prête pour ce créneau. La suite vient dès qu'il y en a une.",
    "en": "You are listening to {brand}. No reliable news is ready for this slot. We return as soon as there is.",
}


def frame(style: str, language: str, brand: str) -> tuple[str, str]:
    opener, closer = FRAMES.get((style, language)) or FRAMES[("", language)]
    return opener.format(brand=brand), closer.format(brand=brand)


def transition(index: Column, language: str) -> Column:
    phrases = V.TRANSITIONS[language]
    return F.element_at(F.array(*map(F.lit, phrases)), F.least(index, F.lit(len(phrases))).cast("int"))


def segment(style: str, language: str, index: Column, limit: int = 95) -> Column:
    """One article's part: a transition, the title, and whole sentences of the text."""
    title = X.radio_title("title")
    body = X.bounded_excerpt("title", X.template_text("title", "summary", "content", "source_name"), "source_name", limit)

    def spoken(b):
        said = X.sentence(X.let(b, X.lower_initial)) if style == "pote" else X.sentence(b)
        said = child_text(said) if style == "enfant" else said
        return F.when(b == "", F.lit("")).otherwise(F.concat(F.lit(" En clair, " if style == "pote" else " "), said))

    return F.concat(transition(index, language), F.lit(", "), title, F.lit("."), X.let(body, spoken))


#: Words that children's bulletins replace by plainer ones.
SIMPLER = (
    (r"\bgouvernement\b", "groupe qui dirige le pays"),
    (r"\bparlement\b", "assemblée qui vote les lois"),
    (r"\béconomie\b", "manière de produire et d'acheter"),
    (r"\bélections?\b", "vote"),
    (r"\bclimat\b", "temps qu'il fait sur la Terre"),
)


def child_text(c, simpler=SIMPLER) -> Column:
    return reduce(lambda t, r: F.regexp_replace(t, "(?iU)" + r[0], r[1]), simpler, text(c))


#: Kinds of news for children, in order: what a title says counts before what a body says.
CHILD_KINDS = (
    ("sport", "sport|match|championnat"),
    ("culture", "festival|musique|film|cinema|culture"),
    ("science", "science|recherche|espace|decouverte"),
    ("nature", "animal|animaux|climat|nature|meteo"),
    ("health", "sante|hopital|virus|medecin"),
    ("politics", "parlement|gouvernement|vote|election|conseil"),
)


def child_kind(title, body, kinds=CHILD_KINDS) -> Column:
    head, rest = X.fold(title), X.fold(body)
    by_body = reduce(lambda r, k: F.when(rest.rlike(k[1]), F.lit(k[0])).otherwise(r), reversed(kinds[-2:]), F.lit("general"))
    return reduce(lambda r, k: F.when(head.rlike(k[1]), F.lit(k[0])).otherwise(r), reversed(kinds), by_body)


def prompt_text(index: Column) -> Column:
    """The block that describes an article to a language model."""
    # fixed values: the labels, in this order, are the format that prompts are written for
    body = X.excerpt(F.when(text("content") != "", F.col("content")).otherwise(F.col("summary")), 900)
    lines = [
        F.format_string("Article A%02d", index.cast("int")),
        F.concat(F.lit("- Source: "), text("source_name")),
        F.concat(F.lit("- Region: "), text("region")),
        F.concat(F.lit("- Detected language: "), text("language")),
        F.concat(F.lit("- Title: "), text("title")),
        F.concat(F.lit("- URL: "), text("url")),
        F.concat(F.lit("- Date: "), F.coalesce(F.col("published_at").cast("string"), F.lit("unknown"))),
        F.concat(F.lit("- Content: "), body),
    ]
    return F.concat_ws("\n", *lines)


def source_credit(sources: Column, language: str) -> Column:
    """The distinct sources in their first order."""
    return F.concat(F.lit(V.CREDIT[language]), F.array_join(F.array_distinct(sources), ", "), F.lit("."))


def template_bulletin(selected: DataFrame, group: str, style: str, language: str, brand: str, most: int = 12) -> DataFrame:
    """One transcript for each group from its articles in the order of ``ord`` (1, 2, ...)."""
    opener, closer = frame(style, language, brand)
    parts = selected.filter(F.col("ord") <= most).select(
        group, F.struct("ord", segment(style, language, F.col("ord")).alias("part"), F.col("source_name").alias("source")).alias("s")
    )
    listed = parts.groupBy(group).agg(F.array_sort(F.collect_list("s")).alias("s"))
    pieces = F.concat(F.array(F.lit(opener)), F.transform("s", lambda x: x["part"]), F.array(F.lit(closer)))
    credit = source_credit(F.transform("s", lambda x: x["source"]), language)
    return listed.select(group, F.concat(F.array_join(pieces, "\n\n"), F.lit("\n\n"), credit).alias("transcript"))


def fallback(language: str, brand: str) -> str:
    return EMPTY[language].format(brand=brand)


def credited(transcript, sources: Column, language: str, repair: bool = True) -> Column:
    """A draft's transcript with accents mended (French), without source references, fillers and former credits, credited once."""
    out = X.repair_accents(transcript) if repair and language == "fr" else text(transcript)
    names = F.array_distinct(sources)
    out = F.aggregate(names, out, lambda t, name: X.without_source(t, name, True))
    out = reduce(lambda t, p: F.regexp_replace(t, p, ""), V.CREDIT_BLOCK, out)
    out = X.let(X.without_fillers(out), X.pair_sentences)
    credit = F.when(F.size(names) > 0, F.concat(F.lit("\n\n"), source_credit(sources, language))).otherwise(F.lit(""))
    return F.concat(out, credit)


#: The first three words of a paragraph of eight words or more; what stands behind these eight is not looked at.
_HEAD = r"(?U)^\s*+(\S++\s++\S++\s++\S++)(?:\s++\S++){5}"
#: An opening is repeated from so many paragraphs on.
OFTEN = 4


def repeated_opening(transcript) -> Column:
    """The first three words that open at least four paragraphs of eight words or more; the first such opening.

    Openings are sorted with their places, so that equal ones stand together.
    """
    strip = lambda w: F.lower(F.btrim(w, F.lit(" ,;:.!?")))
    bare = lambda head: F.filter(F.transform(F.split(head, r"(?U)\s+"), strip), lambda w: w != "")
    heads = F.filter(F.transform(F.split(text(transcript), "\n\n"), lambda p: F.regexp_extract(p, _HEAD, 1)), lambda h: h != "")
    openings = F.transform(F.filter(F.transform(heads, bare), lambda o: F.size(o) >= 2), lambda o, k: F.struct(F.array_join(o, " ").alias("o"), k.alias("k")))

    def first(ordered):
        often = F.filter(ordered, lambda x, i: F.get(ordered, i + OFTEN - 1)["o"] == x["o"])
        return F.array_min(F.transform(often, lambda x: F.struct(x["k"], x["o"])))["o"]

    return X.let(F.array_sort(openings), first)


def quality_issue(transcript, warnings: Column, least: int = V.LEAST_WORDS, banned=V.BANNED_PHRASES) -> Column:
    """What is wrong with a draft, the first of: it says so itself, credits twice, says nothing, is short, repeats openings."""
    said = F.lower(F.array_join(F.coalesce(warnings, F.array().cast("array<string>")), " "))
    own = reduce(lambda a, w: a | F.contains(said, F.lit(w)), V.SHORT_WARNINGS, F.lit(False))
    seen = F.struct(
        F.lower(text(transcript)).alias("low"), X.word_count(transcript).alias("n"), repeated_opening(transcript).alias("opening")
    )

    def use(x):
        low, n = x["low"], x["n"]
        credits = [V.CREDIT[code].lower().rstrip(": ") for code in ("fr", "en")]
        twice = [(F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))) / len(c) > 1 for c in credits]
        out = F.when(own, F.lit("self-reported short transcript")).when(twice[0] | twice[1], F.lit("duplicate source credits"))
        for phrase in banned:
            out = out.when(F.contains(low, F.lit(phrase)), F.lit(f"generic filler: {phrase}"))
        out = out.when(n < least, F.concat(F.lit("short transcript ("), n.cast("string"), F.lit(" words)")))
        return out.when(x["opening"].isNotNull(), F.concat(F.lit("repetitive paragraph openings: "), x["opening"]))

    return X.let(seen, use)


def revise(drafts: DataFrame, write, transcript: str = "transcript", warnings: str = "warnings", attempts: int = 3) -> DataFrame:
    """Keeps drafts that pass the gate; others go through ``write(drafts with issue)`` up to ``attempts`` times.

    ``write`` is the caller's own writer (a model behind a pandas UDF, say).  Adds ``issue``, null where a draft passed.
    Each attempt is checkpointed, as a writer may answer differently when it is asked again.
    """
    out = cut(drafts.withColumn("issue", quality_issue(transcript, F.col(warnings))))
    for _ in range(attempts - 1):
        good, bad = out.filter("issue IS NULL"), out.filter("issue IS NOT NULL")
        again = write(bad).drop("issue").withColumn("issue", quality_issue(transcript, F.col(warnings)))
        out = cut(good.unionByName(again))
    return out
