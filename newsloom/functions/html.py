"""Plain text of markup by native expressions."""

from __future__ import annotations

import html
import html.entities
import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, squeeze, text

#: Every named reference (most end with a semicolon), and those that need none, longest first.
_NAMED = html.entities.html5
_BARE = sorted((n for n in _NAMED if not n.endswith(";")), key=len, reverse=True)
#: What numbers below 160 stand for: control characters go, and 128 to 159 are read as Windows-1252.
_LOW = {n: html.unescape(f"&#{n};") for n in range(160)}
_REFERENCE = r"(?s)&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)|[^&]+|&"
_UNKNOWN = "\ufffd"


def _table(values: dict) -> Column:
    """A constant map, as one expression whatever its size."""
    return F.from_json(F.lit(json.dumps({str(k): v for k, v in values.items()})), "map<string,string>")


def unescape(c) -> Column:
    """Decodes character references as HTML 5 does: numbers in either base, all names, and the longest name where the semicolon is missing."""
    out, named, low = text(c), _table(_NAMED), _table(_LOW)

    def numbered(digits: Column) -> Column:
        hexadecimal = digits.rlike("^[xX]")
        bare = F.regexp_replace(digits, "^[xX]?0*|;$", "")
        # more digits than any character has
        number = F.when(F.length(bare) > 7, F.lit(1 << 40)).when(bare == "", 0).when(hexadecimal, F.conv(bare, 16, 10).try_cast("long")).otherwise(bare.try_cast("long"))

        def point(n: Column) -> Column:
            outside = n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
            nothing = n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
            shown = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
            return F.when(n < 160, F.element_at(low, n.cast("string"))).when(outside, F.lit(_UNKNOWN)).when(nothing, F.lit("")).otherwise(shown)

        return let(number, point)

    def by_name(name: Column) -> Column:
        def prefix(head: Column) -> Column:
            rest = F.substring(name, F.length(head) + 1, F.length(name))
            return F.when(head != "", F.concat(F.try_element_at(named, head), rest)).otherwise(F.concat(F.lit("&"), name))

        return F.coalesce(F.try_element_at(named, name), let(F.regexp_extract(name, f"^(?:{'|'.join(_BARE)})", 0), prefix))

    def one(p: Column) -> Column:
        held = F.startswith(p, F.lit("&")) & (F.length(p) > 1)
        rest = F.substring(p, 2, F.length(p))
        return F.when(~held, p).when(F.startswith(p, F.lit("&#")), numbered(F.substring(p, 3, F.length(p)))).otherwise(by_name(rest))

    # one pass over the pieces between references keeps what decoding yields from being decoded again
    parts = F.regexp_extract_all(out, F.lit(_REFERENCE), 0)
    return F.when(F.instr(out, "&") == 0, out).otherwise(F.array_join(F.transform(parts, one), ""))


def strip_html(c) -> Column:
    """Text of a fragment: tags and comments become spaces, references are decoded twice, white space is squeezed."""
    bare = F.regexp_replace(text(c), r"(?s)<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"(?s)</?[A-Za-z!?][^>]*>", " ")
    return squeeze(unescape(unescape(bare)))


def main_text(c) -> Column:
    """Text of all article and main elements, or of the whole page without them; scripts, styles and drawings are left out.

    The page is taken apart in front of each opening and closing tag of these elements; what
    lies inside any of them, however they are nested, is kept.
    """
    bare = reduce(
        lambda t, tag: F.regexp_replace(t, rf"(?is)<{tag}\b.*?</{tag}\s*>", " "), ("script", "style", "noscript", "svg"), text(c)
    )

    def inside(page):
        start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("kept"))

        def step(acc, piece):
            turn = F.when(piece.rlike(r"(?i)^<(?:article|main)\b"), 1).when(piece.rlike(r"(?i)^</(?:article|main)\b"), -1).otherwise(0)
            depth = F.greatest(F.lit(0), acc["depth"] + turn)
            # the closing tag itself parts what stands before and behind it
            kept = F.when(depth > 0, F.concat(acc["kept"], F.array(piece))).when(acc["depth"] > 0, F.concat(acc["kept"], F.array(F.lit(" ")))).otherwise(acc["kept"])
            return F.struct(depth.alias("depth"), kept.alias("kept"))

        pieces = F.split(page, r"(?i)(?=</?(?:article|main)\b)")
        return let(F.aggregate(pieces, start, step, lambda acc: acc["kept"]), lambda k: F.when(F.size(k) > 0, F.array_join(k, "")).otherwise(page))

    return strip_html(let(bare, inside))
