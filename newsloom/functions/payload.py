"""Semi-structured replies: JSON inside text, defaults for what is missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text

DRAFT = "title string, summary string, transcript string, warnings array<string>"


def json_object(raw, schema: str = DRAFT) -> Column:
    """The object in a reply: the whole of it without code fences, else from the first brace to the last; null if neither parses."""
    clean = F.trim(text(raw))
    clean = F.trim(F.regexp_replace(F.regexp_replace(clean, "^```(?:json)?", ""), "```$", ""))
    inner = F.regexp_extract(clean, r"(?s)\{.*\}", 0)
    fits = lambda t: F.try_parse_json(t).isNotNull() & F.startswith(F.ltrim(t), F.lit("{"))
    return F.when(fits(clean), F.from_json(clean, schema)).when(fits(inner), F.from_json(inner, schema))


def draft(parsed: Column, title: str = "Bulletin") -> Column:
    """A draft with defaults; empty warnings are dropped."""
    return F.struct(
        F.coalesce(F.nullif(F.trim(text(parsed["title"])), F.lit("")), F.lit(title)).alias("title"),
        F.trim(text(parsed["summary"])).alias("summary"),
        F.trim(text(parsed["transcript"])).alias("transcript"),
        F.filter(
            F.coalesce(parsed["warnings"], F.array().cast("array<string>")), lambda w: F.coalesce(w, F.lit("")) != ""
        ).alias("warnings"),
    )


def metadata_text(template: str, brand: str, title, style_label, item_id) -> Column:
    """Named placeholders {artist} {title} {style} {id} filled in; the brand's own prefix leaves the title."""
    named = F.coalesce(F.nullif(text(title), F.lit("")), F.lit(brand))
    prefix = f"{brand} - "
    short = F.trim(F.when(F.startswith(named, F.lit(prefix)), F.substring(named, len(prefix) + 1, 1 << 30)).otherwise(named))
    values = {
        "artist": F.lit(brand),
        "title": short,
        "style": F.coalesce(F.nullif(text(style_label), F.lit("")), short),
        "id": text(item_id),
    }
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return F.when(out.rlike(r"\{[^}]*\}"), F.concat(values["artist"], F.lit(" - "), short)).otherwise(out)
