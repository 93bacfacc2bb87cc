"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element is a binary variable (content or not).  Its evidence is the tag, the
words of class, id and role, the length of its own text and the share of links in it; a
potential ties it to its parent, by kind of tag.  Sum-product messages passed up from the
leaves and down from the root give exact marginals, and the text of elements that are more
likely content than not is the main text.  Both kinds of potentials are learned from
labelled pages: :func:`labelled_pages` makes ``TRAINING_PAGES`` of them (a fixed number),
with the usual parts in varying order, nesting and naming.

A null or empty page, or one without content, has the empty text.  Character references
are decoded after the markup is parsed; white space inside a block becomes one space,
blocks are joined by a line end, in page order.  Scripts, styles, frames, templates, markup
comments, controls of forms and the head hold no text; what else stands in an article,
formulas and fallbacks included, stays.  A hidden element takes no part in the model, and its
text is left out.  Unclosed and misnested elements are closed as browsers do for
paragraphs, list items and table cells; a ``<`` that starts no tag is text.  Parsing and
inference take time in proportion to the page, however deep or broken it is.  Rows are
mapped one by one, so repeats, ties and an empty table need no rule; an input column that
bears the name of an output is replaced.  One narrow pass.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .batches import add_columns

TRAINING_PAGES = 600

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(?i)(?:^|\s)(class|id|role|hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z]+")
_RAW = {name: re.compile(rf"(?i)</{name}\b[^>]*>") for name in ("script", "style", "textarea", "title", "iframe", "noframes", "xmp")}
#: Elements whose whole content is no text of the page.
_DARK = frozenset("head template select datalist button".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table caption tbody "
    "td tfoot th thead tr ul".split()
)
#: What an opening tag closes, and what stops the search for it.
_CLOSES = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "tbody": ("thead", "tbody", "tfoot"),
    "tfoot": ("thead", "tbody", "tfoot"),
}
_STOPS = {
    "li": ("ul", "ol", "menu", "dir"),
    "dt": ("dl",),
    "dd": ("dl",),
    "tr": ("table",),
    "td": ("tr", "table"),
    "th": ("tr", "table"),
    "tbody": ("table",),
    "tfoot": ("table",),
}
#: A paragraph does not reach beyond these; nor do the closing tags of inline elements beyond cells.
_ROOMS = ("td", "th", "button", "object", "caption")
_CELLS = ("td", "th", "table")
_INLINE = frozenset(("p", "b", "i", "a", "span"))
_KIND = {
    **dict.fromkeys(("p", "pre", "blockquote"), "prose"),
    **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), "heading"),
    **dict.fromkeys(("ul", "ol", "dl", "menu", "li", "dt", "dd"), "list"),
    **dict.fromkeys(("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"), "table"),
    **dict.fromkeys(("figure", "figcaption"), "figure"),
}


class Node:
    __slots__ = ("tag", "names", "parent", "within", "hidden", "letters", "linked", "label")

    def __init__(self, tag: str, names: str, parent: int, within: str, hidden: bool):
        self.tag, self.names, self.parent, self.hidden = tag, names, parent, hidden
        #: The nearest article or main element around it; for a part of a table, the table's use.
        self.within = within
        self.letters = self.linked = 0
        self.label = False


def parse(html: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """The block elements, parents first, and the text blocks (element, text) in page order."""
    nodes = [Node("html", "", -1, "", False)]
    blocks: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements and the block each belongs to
    where: dict[str, list[int]] = defaultdict(list)  # the places in the stack of each name
    run: list[str] = []
    dark = links = 0
    at = 0

    def flush():
        if run:
            text = " ".join("".join(run).split())
            if text:
                blocks.append((stack[-1][1], text))
            run.clear()

    def close(depth: int):
        nonlocal dark, links
        if any(name in _BLOCK for name, _ in stack[depth:]):
            flush()
        for name, _ in stack[depth:]:
            where[name].pop()
            dark -= name in _DARK
            links -= name == "a"
        del stack[depth:]

    def nearest(names) -> int:
        """The innermost open element of these names; 0 for none."""
        return max((where[name][-1] for name in names if where[name]), default=0)

    def text(piece: str, raw: bool = False):
        if piece and not dark:
            if "&" in piece and not raw:
                piece = unescape(piece)
            run.append(piece)
            node = nodes[stack[-1][1]]
            n = len(piece.split())
            node.letters += n
            node.linked += n * (links > 0)

    end, last = len(html), html.rfind(">")
    while at < end:
        m = _TOKEN.search(html, at) if at <= last or html.find("<!--", at) >= 0 else None
        if m is None:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name = name.lower()
        if m[1] or m[4]:
            depth = nearest((name,))
            if depth and not (name in _INLINE and depth < nearest(_CELLS)):
                close(depth)
            continue
        attributes = m[3] or m[6] or ""
        if name in _RAW:
            closing = _RAW[name].search(html, at)
            if name == "xmp":
                flush()
                text(html[at : closing.start() if closing else end], True)
                flush()
            at = closing.end() if closing else end
            continue
        if name == "html" or name == "body" and where["body"]:
            continue
        if name == "br":
            run.append("\n")
            continue
        if name in _BLOCK:
            if name == "body" and where["head"]:  # an unclosed head ends here
                close(where["head"][-1])
            if name in _CLOSES:
                stop = nearest(_STOPS[name])
                depth = nearest(("tr",)) if name == "tr" and nearest(("tr",)) > stop else nearest(_CLOSES[name])
                if depth > stop:
                    close(depth)
            depth = nearest(("p",))
            if depth > nearest(_ROOMS):
                close(depth)
            flush()
            if name == "hr":
                continue
            names, hidden = [], False
            for a in _ATTRIBUTE.finditer(attributes):
                value = (a[2] or a[3] or a[4] or "").lower()
                key = a[1].lower()
                if key == "hidden" or key == "style" and re.search(r"display\s*:\s*none", value):
                    hidden = True
                elif key != "style":
                    names += _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", a[2] or a[3] or a[4] or "").lower())
            parent = stack[-1][1]
            around = nodes[parent]
            within = around.tag if around.tag in ("article", "main") else around.within
            nodes.append(Node(name, " ".join(names), parent, within, hidden or around.hidden))
            where[name].append(len(stack))
            stack.append((name, len(nodes) - 1))
        elif name not in _VOID:
            where[name].append(len(stack))
            stack.append((name, stack[-1][1]))
            dark += name in _DARK
            links += name == "a"
    flush()
    _mark_layout(nodes)
    return nodes, blocks


def _mark_layout(nodes: list[Node]) -> None:
    """Tells tables whose cells hold other blocks, as those that lay out a page do, from tables of plain cells."""
    table = [0] * len(nodes)  # the table that a part of a table belongs to
    laid = set()
    for k, node in enumerate(nodes[1:], 1):
        if node.tag == "table":
            table[k] = k
        elif _KIND.get(node.tag) == "table":
            table[k] = table[node.parent]
        elif table[node.parent]:
            laid.add(table[node.parent])
    for k, node in enumerate(nodes):
        if table[k]:
            node.within = "layout" if table[k] in laid else "plain"


def evidence(node: Node) -> list[str]:
    """What is seen of an element."""
    shown = node.tag in ("header", "footer") or _KIND.get(node.tag) == "table"
    out = [f"tag {node.tag} {node.within}" if shown else f"tag {node.tag}"]
    out += [f"name {w}" for w in set(node.names.split())]
    if node.letters:
        out.append(f"words {min(6, node.letters.bit_length())}")
        out.append(f"links {round(3 * node.linked / node.letters)}")
    return out


class Model:
    """Log-potentials: of evidence given a state, and of a state given the parent's state and the kind of tag."""

    def __init__(self, pages: list[list[Node]]):
        seen = [Counter(), Counter()]
        states = [Counter(), Counter()]
        pairs: dict[str, list[list[float]]] = defaultdict(lambda: [[0.3, 0.3], [0.3, 0.3]])
        for nodes in pages:
            for node in nodes[1:]:
                y = int(node.label)
                for e in evidence(node):
                    seen[y][e] += 1
                    states[y][e.split(" ")[0]] += 1
                pairs[_KIND.get(node.tag, "part")][int(nodes[node.parent].label)][y] += 1
        sizes = Counter(e.split(" ")[0] for e in set(seen[0]) | set(seen[1]))
        self.weight = {}
        for e in set(seen[0]) | set(seen[1]):
            kind = e.split(" ")[0]
            odds = [math.log((seen[y][e] + 0.3) / (states[y][kind] + 0.3 * sizes[kind])) for y in (0, 1)]
            self.weight[e] = odds[1] - odds[0]
        self.pair = {k: [[math.log(v / sum(row)) for v in row] for row in t] for k, t in pairs.items()}
        self.default = [[math.log(0.97), math.log(0.03)], [math.log(0.4), math.log(0.6)]]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability of content for each element: messages up, then down."""
        n = len(nodes)
        own = [0.0] * n  # log-odds of what is seen of the element
        for k in range(1, n):
            own[k] = 0.0 if nodes[k].hidden else sum(self.weight.get(e, 0.0) for e in evidence(nodes[k]))
        tables = [self.pair.get(_KIND.get(nodes[k].tag, "part"), self.default) for k in range(n)]
        below = list(own)  # own and all children's messages
        up = [0.0] * n
        exp, log = math.exp, math.log
        for k in range(n - 1, 0, -1):
            t, odds = tables[k], max(-60.0, min(60.0, below[k]))
            w = exp(odds)
            (a, b), (c, d) = t
            up[k] = log(exp(c) + exp(d) * w) - log(exp(a) + exp(b) * w)
            if not nodes[k].hidden:
                below[nodes[k].parent] += up[k]
        belief = [0.0] * n
        belief[0] = max(-60.0, min(60.0, below[0]))
        for k in range(1, n):
            parent = nodes[k].parent
            w = exp(max(-60.0, min(60.0, belief[parent] - up[k])))
            (a, b), (c, d) = tables[k]
            down = log(exp(b) + exp(d) * w) - log(exp(a) + exp(c) * w)
            belief[k] = max(-60.0, min(60.0, below[k] + down))
        return [0.0 if node.hidden else 1 / (1 + exp(-x)) for node, x in zip(nodes, belief)]


def extract(model: Model, html: str) -> str:
    nodes, blocks = parse(html)
    if not blocks:
        return ""
    content = model.marginals(nodes)
    return "\n".join(text for k, text in blocks if content[k] > 0.5)


# How the parts of pages are commonly named.
CONTENT_NAMES = "article post entry content main story body text article-body post-content entry-content story-body page-content".split()
WRAPPER_NAMES = "wrapper container page site row grid layout col inner".split()
PARTS = {
    "nav": ("nav", "nav navbar menu main-menu navigation breadcrumb breadcrumbs topnav".split()),
    "header": ("header", "header site-header masthead top banner logo branding".split()),
    "footer": ("footer", "footer site-footer copyright colophon bottom legal imprint".split()),
    "sidebar": ("aside", "sidebar side aside widget related recommended popular trending more-stories teaser".split()),
    "notice": ("div", "notice cookie cookie-banner consent gdpr alert message privacy popup modal overlay paywall".split()),
    "advert": ("div", "ad ads advert advertisement sponsored sponsor promo banner-ad adbox".split()),
    "form": ("form", "form search search-form login signup subscribe newsletter contact".split()),
    "comments": ("section", "comments comment comment-list replies discussion respond disqus reader-comments".split()),
    "share": ("div", "share social sharing tags tag-list pagination pager".split()),
}
#: Parts that also stand inside articles.
INSIDE = ("advert", "form", "notice", "share", "comments", "sidebar", "nav")


def labelled_pages(count: int = TRAINING_PAGES, seed: int = 11) -> list[list[Node]]:
    """Parsed pages whose elements are labelled: content holds any of the article's own text."""
    rng = random.Random(seed)
    out = []
    for _ in range(count):
        nodes, blocks = parse(_page(rng))
        for k, text in blocks:
            if "zq" in text:
                while k >= 0 and not nodes[k].label:
                    nodes[k].label = True
                    k = nodes[k].parent
        out.append(nodes)
    return out


def _words(rng: random.Random, low: int, high: int, mark: str) -> str:
    return " ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) + mark for _ in range(rng.randrange(low, high)))


def _part(rng: random.Random, kind: str, inside: bool = False) -> str:
    tag, names = PARTS[kind]
    named = rng.random() < (0.95 if tag in ("div", "section") or inside else 0.6)
    tag = tag if rng.random() < 0.6 or not named else "div"
    attribute = f' {rng.choice(("class", "class", "id"))}="{rng.choice(names)}"' if named else ""
    link = lambda: f'<a href="/x">{_words(rng, 1, 4, "")}</a>'
    plain = lambda: _words(rng, 1, 25, "")
    h = rng.choice(("h1", "h2", "h2", "h3", "h4", "h5"))
    if kind in ("nav", "share") or kind in ("sidebar", "footer", "header") and rng.random() < 0.5:
        body = "".join(f"<li>{link()}</li>" for _ in range(rng.randrange(2, 9)))
        body = f"<ul>{body}</ul>" if rng.random() < 0.8 else body.replace("<li>", "<span>").replace("</li>", "</span>")
    elif kind == "form":
        body = rng.choice(["", f"<{h}>{_words(rng, 1, 4, '')}</{h}>"])
        body += f"<label>{_words(rng, 1, 4, '')}</label><input><p>{_words(rng, 2, 9, '')}</p><button>ok</button>"
    elif kind == "comments":
        body = "".join(f'<div class="comment"><p>{plain()}</p></div>' for _ in range(rng.randrange(1, 5)))
        body = f"<{h}>{_words(rng, 1, 3, '')}</{h}>{body}"
    else:
        title = f"<{h}>{_words(rng, 1, 6, '')}</{h}>"
        body = rng.choice(
            [plain(), f"<p>{plain()}</p>", title, f"{title}<p>{plain()}</p>", f"<div>{plain()} {link()}</div>", f"<ul><li>{plain()}</li></ul>"]
        )
    return f"<{tag}{attribute}>{body}</{tag}>"


def _article(rng: random.Random) -> str:
    own = lambda low, high: _words(rng, low, high, "zq")
    parts = [f"<h1>{own(2, 12)}</h1>"] if rng.random() < 0.9 else []
    if rng.random() < 0.15:
        parts.insert(0, f"<header><h1>{own(2, 12)}</h1><p>{own(1, 6)}</p></header>")
    for _ in range(rng.randrange(1, 12)):
        kind = rng.random()
        if kind < 0.75:
            parts.append(f"<p>{own(1, 90)}</p>" if rng.random() < 0.8 else f"<p><b>{own(1, 40)}<br>")
        elif kind < 0.83:
            parts.append(f"<h2>{own(1, 8)}</h2>")
        elif kind < 0.89:
            parts.append("<ul>" + "".join(f"<li>{own(1, 20)}</li>" for _ in range(rng.randrange(1, 5))) + "</ul>")
        elif kind < 0.93:
            parts.append(f"<blockquote><p>{own(3, 40)}</p></blockquote>")
        elif kind < 0.95:
            parts.append(f"<figure><img><figcaption>{own(2, 15)}</figcaption></figure>")
        elif kind < 0.97:
            head = f"<tr><th>{own(1, 3)}</th><th>{own(1, 3)}</th></tr>" if rng.random() < 0.6 else ""
            parts.append(f"<table>{head}" + f"<tr><td>{own(1, 4)}</td><td>{own(1, 4)}</td></tr>" * 2 + "</table>")
        else:
            parts.append(f"<pre>{own(3, 30)}</pre>")
        if rng.random() < 0.1:
            parts.append(_part(rng, rng.choice(INSIDE), True))
    tag = rng.choice(["article", "article", "main", "section", "div"])
    attribute = f' class="{rng.choice(CONTENT_NAMES)}"' if tag in ("div", "section") or rng.random() < 0.3 else ""
    body = "".join(parts)
    if rng.random() < 0.2:
        body = f'<div class="{rng.choice(CONTENT_NAMES)}">{body}</div>'
    return f"<{tag}{attribute}>{body}</{tag}>"


def _page(rng: random.Random) -> str:
    before = [k for k in ("header", "nav", "notice", "advert", "form") if rng.random() < 0.5]
    after = [k for k in ("sidebar", "comments", "advert", "form", "share", "notice", "footer") if rng.random() < 0.5]
    rng.shuffle(before)
    middle = _article(rng)
    if rng.random() < 0.4:
        cut = rng.randrange(len(after) + 1)
        middle += "".join(_part(rng, k) for k in after[:cut])
        after = after[cut:]
        tag = rng.choice(["main", "div", "div"])
        named = f' class="{rng.choice(WRAPPER_NAMES + ["main", "content"])}"' if tag == "div" else ""
        middle = f"<{tag}{named}>{middle}</{tag}>"
    if rng.random() < 0.15:
        return _laid_out(rng, before, middle, after)
    inner = "".join(_part(rng, k) for k in before) + middle + "".join(_part(rng, k) for k in after)
    if rng.random() < 0.3:
        inner = f'<div class="{rng.choice(WRAPPER_NAMES)}">{inner}</div>'
    return f"<html><head><title>x</title></head><body>{inner}</body></html>"


def _laid_out(rng: random.Random, before: list[str], middle: str, after: list[str]) -> str:
    """A page whose parts are cells of a table."""
    if rng.random() < 0.5:
        middle = re.sub(r"^<(\w+)[^>]*>(.*)</\1>$", r"\2", middle, flags=re.S)
    links = lambda: "".join(f'<a href="/x">{_words(rng, 1, 3, "")}</a>{rng.choice([" ", "<br>", " | "])}' for _ in range(rng.randrange(1, 9)))
    inside = lambda k: _part(rng, k) if rng.random() < 0.5 else links() if rng.random() < 0.7 else _words(rng, 1, 6, "")
    cell = lambda body: f"<td>{body}</td>"
    sides = [cell(inside(k)) for k in before + after] or [cell(inside("nav"))]
    rng.shuffle(sides)
    left, top = rng.randrange(len(sides) + 1), rng.randrange(3)
    rows = [f"<tr>{x}</tr>" for x in sides[:top]]
    cells = sides[top:]
    at = min(left, len(cells))
    rows.append(f"<tr>{''.join(cells[:at])}{cell(middle)}{''.join(cells[at:][:2])}</tr>")
    rows += [f"<tr>{x}</tr>" for x in cells[at:][2:]]
    return f"<html><head><title>x</title></head><body><table>{''.join(rows)}</table></body></html>"


def main_text(pages: DataFrame, html: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """Adds the main text and its number of code points."""
    # plain values: a worker that has no copy of this package builds the model itself
    shared = pages.sparkSession.sparkContext.broadcast(vars(Model(labelled_pages())))

    def make():
        model = Model.__new__(Model)
        model.__dict__.update(shared.value)

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            column = batch.column(html if html in batch.schema.names else "__input")
            texts = [extract(model, page) if page else "" for page in column.to_pylist()]
            return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

        return compute

    return add_columns(pages, [T.StructField(text, T.StringType()), T.StructField(n_chars, T.LongType())], html, make)
