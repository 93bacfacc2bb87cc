"""Column functions against plain Python on sentences of our own."""

import re
import unicodedata

from pyspark.sql import functions as F

from newsloom.functions import dates, html, language, payload, rules, speech
from newsloom.functions import fixed_values as V
from newsloom.functions import text as X


def fold(t):
    return "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c))


def one(spark, column, **values):
    """The value of a column expression over one row."""
    names = list(values)
    row = spark.createDataFrame([tuple(values[n] for n in names)], ", ".join(f"{n} string" for n in names))
    return row.select(column.alias("v")).first()["v"]


def test_fold_and_keys(spark):
    for t in ("Été à Genève, œuvre!", "ẞtraße ÇA va", "Ångström Ðð ñandú", "", None, "été"):
        low = "".join(c for c in unicodedata.normalize("NFKD", (t or "").lower()) if not unicodedata.combining(c))
        assert one(spark, X.fold("t"), t=t) == low
    assert one(spark, X.key("t"), t=" L'été: https://a.b/c?d  arrive... ") == "l ete arrive"
    assert one(spark, X.story_key("t", "s", "c"), t="Une longue dépêche", s="x", c="y") == "title:une longue depeche"
    assert one(spark, X.story_key("t", "s", "c"), t="Court", s="", c="Le corps, ici") == "body:court:le corps ici"


def test_subject_key(spark):
    of = lambda t: one(spark, X.subject_key(X.fold("t")), t=t)
    assert of("Festival à Cannes et Ukraine") == "cannes"
    assert of("Avec les pompiers volontaires du village heureux") == "pompiers-volontaires-village-heureux"
    assert of("a b c!") == "a b c!"


def test_urls_and_stems(spark):
    assert one(spark, X.canonical_url("u"), u=" https://a.b/c#d#e ") == "https://a.b/c"
    assert one(spark, X.set_query_value("u", "data", F.lit("a b&c")), u="http://h/p?x=1&data=old&y=2") == "http://h/p?x=1&y=2&data=a+b%26c"
    assert one(spark, X.set_query_value("u", "data", F.lit("z")), u="http://h/p") == "http://h/p?data=z"
    assert one(spark, X.safe_stem("u"), u="à b/c-d_e.f") == "à-b-c-d_e-f"


def test_excerpts_and_limits(spark):
    long = "mot " * 200
    clean = " ".join(long.split())
    assert one(spark, X.excerpt("t"), t=long) == clean[:320].rsplit(" ", 1)[0] + "..."
    assert one(spark, X.excerpt("t"), t="court  texte") == "court texte"
    assert one(spark, X.word_limit("t", 3), t="un deux trois; quatre") == "un deux trois."
    assert one(spark, X.word_count("t"), t="  a  b\nc ") == 3 and one(spark, X.word_count("t"), t=None) == 0
    assert one(spark, X.paragraphs("t"), t="a\n\n b \nc\n") == ["a", "b", "c"]


def plain_excerpt(title, text, limit):
    """Whole sentences while they fit, written plainly (no source references in the text)."""
    clean = " ".join(text.split()).strip(" .")
    every = [s.strip() for s in re.split(r"(?<=[.!?])\s+", clean) if s.strip()]
    chosen, n = [], 0
    for s in every:
        end = fold(s).strip(" .,!?:;")
        if fold(s) in fold(title) or not end or end.split()[-1] in V.DANGLING_WORDS and " " in end or len(s.split()) < 4:
            continue
        if chosen and n + len(s.split()) > limit:
            break
        chosen.append(s)
        n += len(s.split())
        if n >= limit:
            break
    return " ".join(chosen) if chosen or every else clean


def test_bounded_excerpt(spark):
    cases = [
        ("Le titre du jour", "Le titre du jour. Une phrase qui compte six mots. Trop court. Elle finit par dans. Encore une phrase assez longue ici.", 12),
        ("T", "Une phrase de plus de cinq mots ici. Une autre phrase de plus de cinq mots.", 6),
        ("T", "Une phrase de plus de cinq mots ici. Une autre phrase de plus de cinq mots.", 60),
        ("T", "Oui. Non.", 9),
    ]
    for title, text, limit in cases:
        assert one(spark, X.bounded_excerpt("t", "x", "s", limit), t=title, x=text, s="Source Z") == plain_excerpt(title, text, limit)


def test_sentences_and_titles(spark):
    assert one(spark, X.sentence("t"), t="Il part pour") == "Il part."
    assert one(spark, X.sentence("t"), t="Tout va bien!") == "Tout va bien!"
    assert one(spark, X.sentence("t"), t=" ") == ""
    assert one(spark, X.radio_title("t"), t="» EN DIRECT: La grève continue.") == "La grève continue"
    assert one(spark, X.radio_title("t"), t="...") == "Information a suivre"
    assert one(spark, X.lower_initial("t"), t="La ville") == "la ville" and one(spark, X.lower_initial("t"), t="ONU dit") == "ONU dit"
    assert one(spark, X.upper_initial("t"), t="été") == "Été"
    assert one(spark, X.pair_sentences("t"), t="A b. C d. E f. G h. I j.") == "A b. C d.\n\nE f. G h.\n\nI j."
    assert one(spark, X.pair_sentences("t"), t="A.\n\n\nB.") == "A.\n\nB."
    assert one(spark, X.looks_incomplete("t"), t="Il va vers") and not one(spark, X.looks_incomplete("t"), t="Il va vers Sion.")


def test_source_references(spark):
    text = "Selon Le Matin (VS) - Info, il neige. D’après « x ». Source: Le Matin (VS). Le Matin (VS) explique que tout va."
    got = one(spark, X.without_source("t", "s"), t=text, s="Le Matin (VS) - Info")
    assert got == "il neige. D’après « x ». tout va."
    assert one(spark, X.without_source("t", "s"), t="Chez TV5, on rit. TV5 avec nous", s="TV5Monde") == "on rit. nous"
    assert one(spark, X.article_text("t", "s"), t="Par Jean Petit © 2024 AFP Le lac monte. Continue reading.", s="Z") == "Le lac monte"
    assert one(spark, X.repair_accents("t"), t="La sante et l'economie, deja des que possible") == "La santé et l'économie, déjà dès que possible"


def test_rules(spark):
    sport = lambda t, s="": one(spark, rules.is_sports("t", F.lit(""), F.lit(""), F.lit(s) if s else None), t=t)
    assert sport("Grand match de Tennis") and sport("Le PSG en victoire") and not sport("Le PSG inaugure un parc")
    assert sport("Le club fête sa victoire au stade") and not sport("Le club fête sa victoire") and sport("Rien", "Hockey FM")
    assert one(spark, rules.is_low_value("t", "s"), t="Lundi 3.4.2024", s="")
    assert not one(spark, rules.is_low_value("t", "s"), t="Un lundi calme", s="")
    twice = one(spark, rules.anxiety(X.fold("t")), t="Guerre, guerre et CRISE")
    assert twice == 4 and one(spark, rules.calm(X.fold("t")), t="Festival du film, film") == 2


def test_relevance(spark):
    score = lambda topic, **v: one(
        spark, rules.relevance(topic, "s", "r", "t", F.lit(""), "c"), **({"s": "", "r": "", "t": "", "c": ""} | v)
    )
    assert score("valais", r="valais", s="Canal9", t="Sion et Sierre") == 8 + 4 + 18 + 12
    assert score("suisse_romande", r="suisse") == 5 and score("international", r="france") == 2
    assert score("un_relevant", s="UN News - Europe") == 22 and score(None) == 0 and score("other") == 0
    assert score("security_world", c="guerre", r="europe") == 6  # the body does not count here
    assert score("security_world", t="guerre attaque menace police crise") == 8 + 14


def plain_language(text, region=""):
    if region == "english":
        return "en"
    low = text.lower()
    words = [fold(w) for w in re.findall(r"[a-zA-ZÀ-ÖØ-öø-ÿ0-9']+", text)]
    if len(words) < 4:
        return "unknown"
    s = {k: sum(w in m for w in words) + sum(2 for c in V.LANGUAGE_LETTERS.get(k, "") if c in low) for k, m in V.LANGUAGE_WORDS.items()}
    best = max(s, key=s.get)
    second = max(v for k, v in s.items() if k != best)
    return best if s[best] >= 4 and s[best] >= second + (0 if best == "fr" else 2) else "unknown"


def test_language(spark):
    texts = [
        "Le conseil de la ville est dans une salle avec les habitants",
        "The council of the city was in a hall with its people",
        "Der Rat der Stadt ist mit den Leuten nicht im Saal und für die Bürger",
        "Zahlen 1 2 3", "one two", "a à a à a", "",
    ]
    for t in texts:
        assert one(spark, language.detect("t", F.lit(""), F.lit(""), F.lit("x")), t=t) == plain_language(t), t
    assert one(spark, language.detect("t", F.lit(""), F.lit(""), F.lit("English")), t="x") == "en"
    assert [one(spark, language.canonical("t"), t=t) for t in ("FRA", "en-GB", "ger", "it", None)] == ["fr", "en", "de", "unknown", "unknown"]
    assert one(spark, language.resolved("l", "t", F.lit(""), F.lit(""), F.lit("")), l="deu", t=texts[0]) == "de"


def test_html(spark):
    assert one(spark, html.strip_html("t"), t="<p>A &amp;amp; b<br>c<!-- x > --></p>&#233;&#x1F600;&nbsp;&eacute; &zz;") == "A & b c é😀 é &zz;"
    page = "<nav>m</nav><article>un <b>deux</b></article><script>x</script><main>trois</main>"
    assert one(spark, html.main_text("t"), t=page) == "un deux trois" and one(spark, html.main_text("t"), t="<p>tout</p>") == "tout"
    assert one(spark, html.main_text("t"), t=None) == ""


def test_dates(spark):
    at = lambda t: one(spark, dates.parse_date("t").cast("string"), t=t)
    assert at("Tue, 02 Jan 2024 10:00:00 +0200") == "2024-01-02 08:00:00" and at("2 Jan 2024 10:00:00 GMT") == "2024-01-02 10:00:00"
    assert at("2024-01-02T10:00:00Z") == "2024-01-02 10:00:00" and at("bald") is None and at(None) is None
    ts = lambda t: F.lit(t).cast("timestamp")
    slot = lambda t, m: one(spark, dates.floor_slot(ts(t), m).cast("string"), x="")
    assert slot("2024-01-02 08:37:12", 15) == "2024-01-02 08:30:00" and slot("2024-01-02 08:37:12", 90) == "2024-01-02 08:00:00"
    assert one(spark, dates.slot_number(ts("2024-01-02 09:00:00"), 60, 7), x="") == 2
    held = lambda t, p: one(spark, dates.in_period(ts(t), p, ts("2024-01-02 00:30:00")), x="")
    assert held("2024-01-01 23:30:00", "today") and not held("2024-01-01 22:30:00", "today")
    assert held("2024-01-01 00:30:00", "24h") and not held("2024-01-01 00:29:59", "24h") and held(None, "all") and not held(None, "7d")


def test_payload(spark):
    raw = 'Voici:\n```json\n{"title": "T", "warnings": ["a", ""], "transcript": " x "}\n```'
    row = spark.createDataFrame([(raw,), ("pas de json",), ('{"title": null}',)], "r string")
    got = [r.d for r in row.select(payload.draft(payload.json_object("r"), "Défaut").alias("d")).collect()]
    assert (got[0].title, got[0].transcript, got[0].warnings) == ("T", "x", ["a"])
    assert got[1].title == got[2].title == "Défaut" and got[1].warnings == []
    said = payload.metadata_text("{artist} / {title} / {style}", "Radio", "t", "s", F.lit("1"))
    assert one(spark, said, t="Radio - Matin", s="") == "Radio / Matin / Matin"
    assert one(spark, payload.metadata_text("{other}", "Radio", "t", "t", F.lit("1")), t="Soir") == "Radio - Soir"


def plain_lines(text, most):
    def by_words(part):
        out, current = [], ""
        for w in part.split():
            if len(f"{current} {w}".strip()) <= most:
                current = f"{current} {w}".strip()
            else:
                out += [current] if current else []
                current = w
        return out + ([current] if current else [])

    out = []
    for p in re.split(r"\n{2,}", text):
        for s in re.split(r"(?<=[.!?])\s+", p.strip()):
            if len(s) <= most:
                out += [s] if s else []
                continue
            current = ""
            for part in re.split(r"(?<=[,;:])\s+", s):
                if len(f"{current} {part}".strip()) <= most:
                    current = f"{current} {part}".strip()
                    continue
                out += [current] if current else []
                current = part if len(part) <= most else ""
                out += by_words(part) if len(part) > most else []
            out += [current] if current else []
    return out


def test_speech(spark):
    text = "Un début, avec une suite; puis " + "encore des mots " * 9 + ". Fin!\n\nAutre partie."
    for most in (20, 40, 400):
        got = one(spark, speech.lines("t", most), t=text)
        assert got == plain_lines(text, most) and all(len(line) <= most for line in got)
    assert one(spark, speech.plain("t"), t="L’ONU a 5km à 20% | M. X…") == "L'Organisation des Nations unies a cinq km à vingt pour cent, monsieur X..."
    assert one(spark, speech.ascii_text("t"), t="Œuvre à Genève, É") == "Oeuvre a Geneve, E"
    said = one(spark, speech.plain("t"), t="Les 31 « élus » de la 70ᵉ liste, +27% le 19juin | soir. EN DIRECT : 12я _5 0")
    assert said == "Les trente et un élus de la soixante-dix liste, plus vingt-sept pour cent le dix-neuf juin, soir. 12я _5 zéro"
    assert len(one(spark, speech.lines("t", 180), t="Ab. " + "mot " * 80 + "fin, et puis la suite.")) == 4


def test_numbers_in_words(spark):
    want = {
        0: "zéro", 16: "seize", 21: "vingt et un", 71: "soixante et onze", 80: "quatre-vingts", 81: "quatre-vingt-un", 91: "quatre-vingt-onze", 100: "cent",
        101: "cent un", 200: "deux cents", 203: "deux cent trois", 1000: "mille", 1999: "mille neuf cent quatre-vingt-dix-neuf", 3000: "trois mille",
        80_000: "quatre-vingt mille", 200_000: "deux cent mille", 1_000_000: "un million", 80_000_001: "quatre-vingts millions un",
        2_000_000_000: "deux milliards", 123_456_789_012: "cent vingt-trois milliards quatre cent cinquante-six millions sept cent quatre-vingt-neuf mille douze",
    }
    df = spark.createDataFrame([(n,) for n in want], "n long")
    assert {r.n: r.w for r in df.select("n", speech.in_words(F.col("n")).alias("w")).collect()} == want


def test_nested_articles(spark):
    page = "<nav>x</nav><article>a <article>b</article> c &trade;</article> out <MAIN>d</main> e</article> <script>article</script>"
    assert one(spark, html.main_text("t"), t=page) == "a b c ™ d"


def test_all_character_references(spark):
    import html as plain
    import random

    from newsloom.functions import html as H

    rng = random.Random(7)
    names = list(plain.entities.html5)
    texts = ["&frac12; m&sup2; &Hat; &nbsp|&nbspx &notit; &amp;amp; &ampamp; &#0; &#128; &#x80; &#x1F600; &#99999999999999; &#xD800; &#11; &#xFFFE; &#38;lt; & &; &# &#; &#x; &x &AMP &unknown; a&lt", "&", "", "&&&amp", "&" + "a" * 50]
    texts += ["".join(rng.choice([f"&{rng.choice(names)}", f"&{rng.choice(names).rstrip(';')}", f"&#{rng.randrange(70000)}", f"&#x{rng.randrange(70000):x};", " text ", ";", "&", "#", "=", "é"]) for _ in range(12)) for _ in range(300)]
    texts += [" ".join(f"&{n}" for n in names)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", H.unescape("t").alias("u")).collect()
    assert [r.u for r in rows] == [plain.unescape(r.t) for r in rows]


def test_numbers_of_any_length_in_words(spark):
    from newsloom.functions import speech

    wanted = {
        "0": "zéro", "000": "zéro", "80000": "quatre-vingt mille", "1000000": "un million", "2000000000000": "deux billions", "0007": "sept",
        "1234567890123456": "un billiard deux cent trente-quatre billions cinq cent soixante-sept milliards huit cent quatre-vingt-dix millions cent vingt-trois mille quatre cent cinquante-six",
        "1" + "0" * 63: "un décilliard", "12" * 40: " ".join(["un deux"] * 40),
    }
    rows = spark.createDataFrame([(k,) for k in wanted], "n string").select("n", speech.in_words(F.col("n")).alias("w"), speech.normalize(F.concat(F.lit("nr "), F.col("n"))).alias("s"))
    for r in rows.collect():
        assert r.w == wanted[r.n] and r.s.endswith(wanted[r.n])
