"""Rule sets: any match, distinct patterns that match, scores and flags."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from re import _parser as _regex

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .text import fold, let, text


#: Literals of fewer characters admit nearly every text and are not looked for.
LEAST_LITERAL = 2


def literals(pattern: str) -> list[str] | None:
    """Strings of which every match of the pattern holds at least one; None if no such strings can be told."""

    def of(nodes) -> frozenset[str] | None:
        found, run = [], ""
        for kind, value in [*nodes, (None, None)]:
            if kind is _regex.LITERAL:
                run += chr(value)
                continue
            if run:
                found.append(frozenset([run]))
            run = ""
            if kind is _regex.SUBPATTERN:
                found.append(of(value[-1]))
            elif kind is _regex.BRANCH:
                parts = [of(x) for x in value[1]]
                found.append(None if None in parts else frozenset().union(*parts))
            elif kind in (_regex.MAX_REPEAT, _regex.MIN_REPEAT) and value[0] > 0:
                found.append(of(value[2]))
        told = [x for x in found if x]
        return max(told, key=lambda x: (min(map(len, x)), -len(x)), default=None)

    best = of(_regex.parse(pattern))
    return sorted(best) if best and min(map(len, best)) >= LEAST_LITERAL else None


def hits(folded: Column, pattern: str) -> Column:
    """Whether the pattern matches; the regex is only tried on texts that hold one of its literals."""
    needed = literals(pattern)
    if needed is None:
        return folded.rlike(pattern)
    return reduce(lambda a, b: a | b, [F.contains(folded, F.lit(x)) for x in needed]) & folded.rlike(pattern)


def any_match(folded: Column, patterns: Sequence[str]) -> Column:
    """Whether any pattern matches."""
    return reduce(lambda a, b: a | b, [hits(folded, p) for p in patterns], F.lit(False))


def _share(folded: Column, use, bound: bool) -> Column:
    return use(folded) if bound else let(folded, use)


def matches(folded: Column, patterns: Sequence[str], bound: bool = False) -> Column:
    """How many distinct patterns match (not how often).

    ``bound``: the text is a column of the table, not an expression that each use would compute anew.
    """
    return _share(folded, lambda t: reduce(lambda n, p: n + hits(t, p).cast("int"), patterns, F.lit(0)), bound)


def joined(*columns) -> Column:
    """Folded text of several columns with spaces between them."""
    return fold(F.concat_ws(" ", *[text(c) for c in columns]))


def with_source(folded: Column, source) -> Column:
    """The folded text with the folded name of its source before it."""
    return F.concat_ws(" ", fold(source), folded)


def tiered(folded: Column, strong=V.SPORT_STRONG, team=V.SPORT_TEAM, context=V.SPORT_CONTEXT, bound: bool = False) -> Column:
    """Any strong pattern; or a team with some context; or three distinct contexts."""

    def use(t):
        return any_match(t, strong) | (matches(t, context, True) >= F.when(any_match(t, team), 1).otherwise(3))

    return _share(folded, use, bound)


def is_sports(title, summary, content, source=None) -> Column:
    """Stored flags leave the source's name out; the selection's filter counts it."""
    return tiered(joined(*([] if source is None else [source]), title, summary, content))


def is_low_value(title, summary, patterns=V.LOW_VALUE) -> Column:
    return any_match(F.trim(fold(F.concat(text(title), F.lit(" "), F.substring(text(summary), 1, 500)))), patterns)


def is_child_unsuitable(title, summary, content, patterns=V.CHILD_UNSUITABLE) -> Column:
    return any_match(joined(title, summary, content), patterns)


def anxiety(folded: Column, patterns=V.ANXIETY, bound: bool = False) -> Column:
    return 2 * matches(folded, patterns, bound)


def calm(folded: Column, patterns=V.CALM, bound: bool = False) -> Column:
    return matches(folded, patterns, bound)


def relevance(topic: str | None, source, region, title, summary, content, topics=V.TOPICS, folded: Column | None = None) -> Column:
    """Four for each distinct pattern of the topic, and what region and source add.

    ``folded``: a column with the folded text of source, region, title, summary and content, where several topics share it.
    """
    if not topic:
        return F.lit(0)
    secure, bound = topic == "security_world", topic != "security_world" and folded is not None
    if secure:
        folded = joined(source, region, title, summary)
    elif folded is None:
        folded = joined(source, region, title, summary, content)
    score = _share(folded, lambda t: 4 * matches(t, topics.get(topic, ()), True) + (_alarm(t) if secure else F.lit(0)), bound)
    place = fold(region)
    bonus = F.lit(0)
    for regions, more in reversed(V.TOPIC_REGION_BONUS.get(topic, ())):
        bonus = F.when(place.isin(list(regions)), F.lit(more)).otherwise(bonus)
    score = score + bonus
    if topic in V.TOPIC_SOURCE_BONUS:
        pattern, more = V.TOPIC_SOURCE_BONUS[topic]
        score = score + F.when(fold(source).rlike(pattern), F.lit(more)).otherwise(0)
    return score


def _alarm(folded: Column) -> Column:
    return F.least(F.lit(V.SECURITY_BONUS_MOST), 2 * anxiety(folded, bound=True))
