"""Several slots filled at once: each takes its articles from what the slots before have left.

One plan reads the articles once: the few that any of the slots can reach (its pool, and as
many more as the slots before can take) come with all that the selection asks of them, as
columns.  How many these are follows from the slots and pool sizes, not from the table, so
one task can then serve the slots in their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import rules
from ..functions.text import fold, story_key
from . import select
from .select import Style

OUT = "slot string, ord long, id long, filled_up boolean"


def reach(styles: list[Style], most: int) -> int:
    """How deep the slots look at most into an order."""
    target = min(most, 7)
    return max(select.pool_size(s, target) for s in styles) + target * (len(styles) - 1)


def pools(articles: DataFrame, styles: list[Style], most: int = 7, sets: dict | None = None, topics=V.TOPICS, subjects=V.KNOWN_SUBJECTS) -> DataFrame:
    """The articles that slots of these styles can reach, with their places and what the selection asks of them.

    english: whose order it is (one with articles in English, or without); as_new, as_recent: the
    place in the order of candidates and of recent ones, or null; seen: the date, as places
    of recent ones also depend on how often an article has been used by then.  Their ids pass the driver.
    """
    sets, depth, places = sets or {}, reach(styles, most), {}
    for english in sorted({s.language == "en" for s in styles}):
        for part, (kept, by) in enumerate(((select.candidates(articles, english), select.candidate_order()), (select.recent(articles, english), select.recent_order()))):
            for k, r in enumerate(select.top(kept.select("id", "priority", "published_at", "created_at", "used_count"), depth, *by).collect(), 1):
                places.setdefault((r.id, english), [None, None])[part] = k
    # as many ids as the slots can reach, so that only these rows and their texts are read, wherever they come from
    ids = articles.filter(F.col("id").isin(sorted({i for i, _ in places})))
    rows = [(i, e, *p) for (i, e), p in places.items()]
    reached = articles.sparkSession.createDataFrame(rows, "id long, english boolean, as_new long, as_recent long")
    one = ids.join(F.broadcast(reached), "id")
    text, whole = F.col("_text"), F.col("_whole")
    one = one.withColumns({"_text": rules.joined("title", "summary", "content"), "_whole": rules.joined("source_name", "region", "title", "summary", "content")})
    asked = {
        "usable": ~rules.tiered(rules.with_source(text, "source_name"), **sets.get("sports", {}))
        & ~rules.is_low_value("title", "summary", sets.get("low_value", V.LOW_VALUE)),
        "for_children": ~rules.any_match(text, sets.get("child", V.CHILD_UNSUITABLE)),
        "from_un": F.startswith(fold("source_name"), F.lit("un news")),
        "speaks": F.struct(*[select.speaks(code).alias(code) for code in sorted({s.language for s in styles})]),
        "alarm": rules.anxiety(text, sets.get("anxiety", V.ANXIETY), True),
        "calm": rules.calm(text, sets.get("calm", V.CALM), True),
        "story": story_key("title", "summary", "content"),
        "subject": select.subject(subjects),
    }
    keys = sorted({s.key for s in styles} & set(topics))
    score = lambda k: rules.relevance(k, "source_name", "region", "title", "summary", "content", topics, whole).alias(k)
    asked["relevance"] = F.struct(*[score(k) for k in keys]) if keys else F.struct(F.lit(0).alias("none"))
    seen = F.unix_micros(select.when_seen().cast("timestamp"))
    return one.select("id", "english", "as_new", "as_recent", "priority", "region", "used_count", seen.alias("seen"), *[c.alias(n) for n, c in asked.items()])


def _fits(rows: list[dict], key: str, minimum: int, topics) -> list[dict]:
    """As :func:`select.for_topic`, over one pool."""
    if key == "international_english":
        return [r for r in rows if r["region"] == "english"] or rows
    if key not in topics:
        return rows
    relevant = [r for r in rows if r["relevance"][key] > 0]
    if key == "un_relevant":
        return [r for r in relevant if r["from_un"]]
    return relevant if key in ("international", "security_world") or len(relevant) >= minimum else rows


def _ranked(rows: list[dict], key: str, topics) -> list[dict]:
    """As :func:`select.rank`; sorting keeps the order of ties."""
    if key in topics:
        return sorted(rows, key=lambda r: (-r["relevance"][key], -r["priority"]))
    if key == "anxiogene":
        return sorted(rows, key=lambda r: -r["alarm"])
    if key == "non_anxiogene":
        calm = [r for r in rows if r["alarm"] <= 1]
        return sorted(calm if len(calm) >= 6 else rows, key=lambda r: -r["calm"] if r["alarm"] <= 1 else 1)
    return rows


def allocate(rows: list[dict], slots: list[tuple[str, Style]], most: int, topics, stop_after: int | None = None) -> list[tuple]:
    """(slot, ord, id, filled_up) for the slots in their order; an article that a slot took is no candidate of a later one."""
    target, used, out, served = min(most, 7), {}, [], 0
    by_new = {e: sorted((r for r in rows if r["english"] == e and r["as_new"] is not None), key=lambda r: r["as_new"]) for e in (False, True)}
    recents = {e: [r for r in rows if r["english"] == e and r["as_recent"] is not None] for e in (False, True)}
    for slot, style in slots:
        if stop_after is not None and served >= stop_after:
            break
        english, child, size = style.language == "en", style.key == "enfant", select.pool_size(style, target)
        ranking = "non_anxiogene" if child else style.key
        usable = lambda r: r["usable"] and r["speaks"][style.language] and (r["for_children"] or not child)  # noqa: E731, B023

        def chosen(pool: list[dict]) -> list[dict]:
            return _fits([r for r in pool if usable(r)], style.key, max(3, target // 3), topics)  # noqa: B023

        picked = [(r, False) for r in chosen([r for r in by_new[english] if r["id"] not in used][:size])]
        if len(picked) < target:
            # a use moves an article behind others of the same time
            late = sorted(recents[english], key=lambda r: (r["seen"] is None, -(r["seen"] or 0), r["used_count"] + used.get(r["id"], 0), r["id"]))
            have = {r["id"] for r, _ in picked}
            picked += [(r, True) for r in chosen(late[:size]) if r["id"] not in have]
        filled = {r["id"]: f for r, f in picked}
        first_of = {}
        for r in _ranked([r for r, _ in picked], ranking, topics):
            first_of.setdefault(r["story"], r)
        subjects, again = {}, []
        for r in first_of.values():
            if subjects.setdefault(r["subject"], r) is not r:
                again.append(r)
        taken = [*subjects.values(), *([] if child else again)][:target]
        for k, r in enumerate(taken):
            used[r["id"]] = used.get(r["id"], 0) + 1
            out.append((slot, k + 1, r["id"], filled[r["id"]]))
        served += bool(taken)
    return out


def fill(
    articles: DataFrame,
    slots: list[tuple[str, Style]],
    most: int = 7,
    sets: dict | None = None,
    topics=V.TOPICS,
    subjects=V.KNOWN_SUBJECTS,
    stop_after: int | None = None,
) -> DataFrame:
    """slot, ord, id, filled_up: what each slot takes, as if :func:`select.selection` ran for one after the other and marked its articles used.

    A slot for which nothing is left has no rows; ``stop_after`` so many served slots the rest is left alone.
    """
    if not slots:
        return articles.sparkSession.createDataFrame([], OUT)
    reached = pools(articles, [s for _, s in slots], most, sets, topics, subjects)
    keys, plain = frozenset(topics), [(slot, s.key, s.language) for slot, s in slots]

    def serve(group):
        import pandas as pd

        rows = [r | {"as_new": _place(r["as_new"]), "as_recent": _place(r["as_recent"]), "seen": _place(r["seen"])} for r in group.to_dict("records")]
        return pd.DataFrame(allocate(rows, [(slot, Style(k, code)) for slot, k, code in plain], most, keys, stop_after), columns=OUT.replace(" string", "").replace(" long", "").replace(" boolean", "").split(", "))

    # as many rows as the slots can reach
    return reached.groupBy().applyInPandas(serve, OUT)


def _place(v):
    return None if v is None or v != v else int(v)
