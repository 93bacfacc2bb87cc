import random

from newsloom.llm import pages

PAGE = """<!doctype html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="<p>no</p>";</script></head>
<body><header class="site-header"><h2>Daily paper</h2></header>
<nav><ul><li><a href="/">Home</a><li><a href="/b">News</a></ul></nav>
<div class="cookie-banner">We use cookies. <button>Accept</button></div>
<article><h1>The  title &lt;b&gt; &amp; more</h1>
<p>First <b>bold</b>&nbsp;words<br>and <a href="#">a link</a> here.
<p>Second 1 < 2 paragraph<!-- hidden <p>comment</p> -->.</p>
<div class="ad">Buy now!</div>
<ul><li>one item of the list<li>another item</ul>
<form class="newsletter"><p>Sign up</p><input></form>
<p>Last words</article>
<section class="comments"><h3>Comments</h3><div class="comment"><p>I am a reader.</p></div></section>
<aside class="sidebar">Other things</aside><footer>&copy; us</footer>"""


def test_page_with_all_parts():
    model = pages.Model(pages.labelled_pages())
    assert pages.extract(model, PAGE).split("\n") == [
        "The title <b> & more",
        "First bold words and a link here.",
        "Second 1 < 2 paragraph.",
        "one item of the list",
        "another item",
        "Last words",
    ]


def test_held_out_pages():
    model, rng = pages.Model(pages.labelled_pages()), random.Random(4321)
    right = total = 0
    for _ in range(300):
        nodes, blocks = pages.parse(pages._page(rng))
        content = model.marginals(nodes)
        total += len(blocks)
        right += sum((content[k] > 0.5) == ("zq" in text) for k, text in blocks)
    assert right / total > 0.99


def test_marginals_equal_enumeration():
    model = pages.Model(pages.labelled_pages(60))
    nodes, _ = pages.parse("<div class=article><p>some words<p>more</div><div class=ad>x</div>")
    import itertools
    import math

    n = len(nodes)
    total, on = 0.0, [0.0] * n
    for states in itertools.product((0, 1), repeat=n):
        weight = 0.0
        for k in range(1, n):
            table = model.pair.get(pages._KIND.get(nodes[k].tag, "part"), model.default)
            weight += table[states[nodes[k].parent]][states[k]]
            weight += states[k] * sum(model.weight.get(e, 0.0) for e in pages.evidence(nodes[k]))
        total += math.exp(weight)
        for k in range(n):
            on[k] += states[k] * math.exp(weight)
    for got, want in zip(model.marginals(nodes), on):
        assert abs(got - want / total) < 1e-9


def test_rows(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "<<<>>> & <p"), (None, None, "<article><p>a b</article>"), (1, "u", "<nav>x</nav>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "7 AS text")
    got = sorted(((r.page_id or 0, r.text, r.n_chars) for r in pages.main_text(df).collect()))
    assert (0, "a b", 3) in got and (1, "", 0) in got and (2, "", 0) in got and len(got) == 5
    assert pages.main_text(df.limit(0)).count() == 0


def test_text_of_an_article_that_is_no_paragraph_stays():
    model = pages.Model(pages.labelled_pages())
    text = lambda html: pages.extract(model, html)
    html = "<article><p>a <math>x</math> b</p><p hidden>h</p><xmp>co &lt; <b>de</xmp><noscript>ns</noscript><p>tail</p></article>"
    assert text(html).split("\n") == ["a x b", "co &lt; <b>de", "ns", "tail"]
    assert text("<article><h1>Title</h1><p>Short text.</p><p hidden>h</p></article>") == "Title\nShort text."
    assert text("<article><p>One two three.</p><div style='display: none'><p>no</p></div><p>four</p></article>") == "One two three.\nfour"


def test_page_laid_out_in_a_table():
    model = pages.Model(pages.labelled_pages())
    words = "Some longer text that is the article of this page and goes on for a while."
    html = f"<table><tr><td><a href=/>menu</a></td><td><h1>A title</h1><p>{words}</p><p>More.</p></td></tr></table>"
    assert pages.extract(model, html) == f"A title\n{words}\nMore."
    table = "<table><tr><th>year<td>sum</tr><tr><td>1999<td>12</table>"
    assert pages.extract(model, f"<article><p>{words}</p>{table}</article>").split("\n") == [words, "year", "sum", "1999", "12"]


def test_hostile_pages_take_time_in_proportion():
    import time

    model = pages.Model(pages.labelled_pages(60))
    for part in ("<div>", '<a b="', "<!-- ", "<", "<ul><li>x", "<p>x<div>", "<table><tr><td></i>", "</i>"):
        html = "<div>" * 3000 + "<i>" + part * (400_000 // len(part))
        began = time.time()
        pages.extract(model, html)
        assert time.time() - began < 6, part


def brute_extract(model, html):
    """Marginals by enumeration of all states of the elements that are not hidden."""
    import itertools
    import math

    nodes, blocks = pages.parse(html)
    seen = [k for k in range(1, len(nodes)) if not nodes[k].hidden]
    total, on = 0.0, [0.0] * len(nodes)
    for chosen in itertools.product((0, 1), repeat=len(seen) + 1):
        states = dict(zip([0, *seen], chosen))
        weight = 0.0
        for k in seen:
            weight += model.pair.get(pages._KIND.get(nodes[k].tag, "part"), model.default)[states[nodes[k].parent]][states[k]]
            weight += states[k] * sum(model.weight.get(e, 0.0) for e in pages.evidence(nodes[k]))
        total += math.exp(weight)
        for k in states:
            on[k] += states[k] * math.exp(weight)
    return "\n".join(text for k, text in blocks if on[k] / total > 0.5)


def test_extraction_equals_brute_force():
    model, rng = pages.Model(pages.labelled_pages(200)), random.Random(77)
    checked = 0
    while checked < 40:
        html = pages._page(rng)
        if len(pages.parse(html)[0]) <= 13:
            html = html.replace("<p>", "<p hidden>", 1) if checked % 5 == 0 else html
            assert pages.extract(model, html) == brute_extract(model, html)
            checked += 1
