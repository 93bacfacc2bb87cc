"""Word lists, patterns and formats that results depend on, stated as they must be.

Every list can be replaced: the operators take rule sets as parameters and only default
to these.  Patterns are matched against normalised text (lower case, no accents).
"""


def _lines(block: str) -> tuple[str, ...]:
    return tuple(line.strip() for line in block.strip().splitlines())


# ---- Fixed values: sports (strong evidence, context, teams) ----
SPORT_STRONG = _lines(r"""
\bfootball\b
\bfootballeur\b
\bfootballeuse\b
\bfoot\b
\bsportif\b
\bsportive\b
\bathlete\b
\bpremier league\b
\bligue\s*1\b
\bligue\s*2\b
\bchampions league\b
\bligue des champions\b
\bligue europa\b
\bworld cup\b
\bfifa\b
\buefa\b
\brugby\b
\btennis\b
\broland[- ]garros\b
\bwimbledon\b
\bnba\b
\bformule\s*1\b
\bf1\b
\bgrand prix\b
\bcyclisme\b
\btour de france\b
\brallye\b
\bbasket\b
\bhandball\b
\bvolley\b
\bhockey\b
\bhockeyeurs?\b
\bhockeyeuses?\b
\bmercato\b
""")
SPORT_CONTEXT = _lines(r"""
\bentraineur\b
\bselectionneur\b
\bcoach\b
\bmatch\b
\bscore\b
\bbut\b
\bbuteur\b
\bvictoire\b
\bdefaite\b
\btransfert\b
\bjoueur\b
\bjoueuse\b
\bclub\b
\bstade\b
\bteam ranked\b
\branked after first game\b
""")
SPORT_TEAM = _lines(r"""
\bchelsea\b
\breal madrid\b
\bpsg\b
\bolympique de marseille\b
\bom\b
\bolympique lyonnais\b
\bol\b
\bfc\b
""")

# ---- Fixed values: unsuitable for children ----
CHILD_UNSUITABLE = _lines(r"""
\bsexualite\b
\bsexuel\b
\bsexuels\b
\bsexuelle\b
\bsexuelles\b
\bsexe\b
\bviol\b
\bviols\b
\bporn
\bprostitution\b
\bsuicide\b
\bmeurtre\b
\bassassinat\b
\bcadavre\b
\bmorts?\b
\bmortes?\b
\best\s+morte?\b
\bmorte?\s+a\s+l.?age\b
\bdeces\b
\bdeced
\bdeuil\b
\bobseques\b
\bfunerailles\b
\btorture\b
\botage\b
\bpedocriminal
\bjihad
\bterroris
\bfauche
\bhumiliation\b
\bhumilie
\bcontrainte?\b
\brasee?\b
\bviolences?\b
""")

# ---- Fixed values: low-value items (title and start of the summary) ----
LOW_VALUE = _lines(r"""
^\W*en direct\b
\blive\b
\blatest news bulletin\b
\btaxi questions\b
\bfinale saison\b
\bhoselupf\b
\bl.?actualite du haut[- ]valais de la semaine\b
\bactualite du haut[- ]valais de la semaine\b
^cinema\s+\d{1,2}[./-]\d{1,2}[./-]\d{4}$
\ba la une de la presse\b
\bvoir toutes les emissions\b
^(lundi|mardi|mercredi|jeudi|vendredi|samedi|dimanche)\s+\d{1,2}[./-]\d{1,2}[./-]\d{4}$
\bla parole est [aà] nous\b
\ble journal\s+(lundi|mardi|mercredi|jeudi|vendredi|samedi|dimanche)?\b
\bconnexion e-?mail\b
\bmot de passe\b
""")

# ---- Fixed values: alarming and calm subjects (distinct patterns are counted) ----
ANXIETY = _lines(r"""
\bguerre\b
\bconflit\b
\battaque\b
\battentat\b
\bbombard
\bdrone
\bmort\b
\bmorts\b
\bbless
\bcrise\b
\bdeuil\b
\bobseques\b
\burgence\b
\balerte\b
\bepidemie\b
\bebola\b
\bvirus\b
\bmenace\b
\bjihad
\bterroris
\bsecurite\b
\barmee\b
\bpolice\b
\bmanifestants?\b
\baffrontements?\b
\bincendie\b
\binondation\b
""")
CALM = _lines(r"""
\bculture\b
\bfestival\b
\bcannes\b
\bmusique\b
\bfilm\b
\bcinema\b
\bscience\b
\brecherche\b
\bdecouverte\b
\beducation\b
\bpatrimoine\b
\bsolidarite\b
\bsolution\b
\bsoigner\b
""")

# ---- Fixed values: subjects of the editorial topics ----
TOPICS = {
    "suisse_romande": _lines(r"""
        \bsuisse romande\b
        \bromand
        \bvaud\b
        \bgeneve\b
        \bfribourg\b
        \bneuchatel\b
        \bjura\b
        \bvalais\b
        \blac du leman\b
        \bleman\b
    """),
    "valais": _lines(r"""
        \bvalais\b
        \bvalaisan
        \bwallis\b
        \bsion\b
        \bmartigny\b
        \bsierre\b
        \bmonthey\b
        \bbrigue\b
        \bbrig\b
        \bviege\b
        \bzermatt\b
        \bverbier\b
        \bchablais valaisan\b
        \bhaut-valais\b
        \bbas-valais\b
    """),
    "suisse": _lines(r"""
        \bsuisse\b
        \bconfederation\b
        \bconseil federal\b
        \bparlement\b
        \bberne\b
        \bzurich\b
        \bbale\b
        \btessin\b
        \bgrisons\b
    """),
    "international": _lines(r"""
        \binternational\b
        \bmonde\b
        \beurope\b
        \bukraine\b
        \bgaza\b
        \betats-unis\b
        \bchine\b
        \brussie\b
        \bafrique\b
    """),
    "un_relevant": _lines(r"""
        \bonu\b
        \bnations unies\b
        \bunited nations\b
        \bsecurity council\b
        \bconseil de securite\b
        \bhumanitarian\b
        \bhuman rights\b
        \bdroits humains\b
        \brefugie
        \bwho\b
        \boms\b
        \bunhcr\b
        \bunicef\b
        \bocha\b
        \bpeacekeeping\b
    """),
    "international_english": _lines(r"""
        \bworld\b
        \binternational\b
        \bglobal\b
        \beurope\b
        \bunited states\b
        \bukraine\b
        \bgaza\b
        \brussia\b
        \bchina\b
        \bmiddle east\b
    """),
    "security_world": _lines(r"""
        \bsecurity\b
        \bsecurite\b
        \bwar\b
        \bguerre\b
        \bconflict\b
        \bconflit\b
        \battack\b
        \battaque\b
        \bmilitary\b
        \barmy\b
        \barmee\b
        \bterror
        \bhostage\b
        \botage\b
        \bsanction
        \bcyber
    """),
}
#: topic: (regions, bonus); the first set that holds the region counts.
TOPIC_REGION_BONUS = {
    "suisse_romande": ((("suisse-romande", "valais"), 14), (("suisse",), 5)),
    "valais": ((("valais",), 18),),
    "suisse": ((("suisse", "suisse-romande", "valais"), 12),),
    "international": ((("international", "europe"), 12), (("france",), 2)),
    "international_english": ((("english",), 20),),
    "security_world": ((("english", "international", "europe"), 6),),
}
#: topic: (pattern on the normalised source name, bonus).
TOPIC_SOURCE_BONUS = {
    "valais": ("valais|canal9|antenne region valais", 12),
    "un_relevant": ("^un news", 22),
    "international_english": ("^un news", 4),
}
SECURITY_BONUS_MOST = 14

# ---- Fixed values: known subjects, in order, and words that name none ----
KNOWN_SUBJECTS = (
    ("eurovision", r"\beurovision\b"),
    ("cannes", r"\bcannes\b|\bcroisette\b"),
    ("samsung-work", r"\bsamsung\b"),
    ("ukraine-war", r"\bukraine\b"),
    ("middle-east", r"\bgaza\b|\bisrael\b|\bliban\b|\biran\b|\bfatah\b|\babbas\b|\bpalestin"),
    ("ebola", r"\bebola\b"),
    ("lgbt-rights", r"\blgbt\b|\bhomophobie\b|\bdiscrimination\b"),
)
SUBJECT_STOP_WORDS = (
    "avec dans pour plus tout tous toutes cette apres avant contre entre selon direct actualite france suisse"
).split()

# ---- Fixed values: language markers (without accents), letters that speak for a language, aliases ----
LANGUAGE_WORDS = {
    "fr": (
        "au aux avec ce ces cette dans de des du elle en est et le les leur lui mais par pas pour que qui se son sur une"
    ).split(),
    "en": "a after and as at for from has in is its of on said the to united was with".split(),
    "de": (
        "aber als am auch auf aus bei das dem den der des die eine einem einen einer im ist mit nach nicht sich und von zum zur"
    ).split(),
}
LANGUAGE_LETTERS = {"fr": "àâçéèêëîïôùûüÿœæ", "de": "äöüß"}
LANGUAGE_ALIASES = {
    "fr": ("fr", "fra", "fre", "fr-fr", "fr_ch", "fr-ch"),
    "en": ("en", "eng", "en-us", "en-gb"),
    "de": ("de", "deu", "ger", "de-ch", "de-de"),
}

# ---- Fixed values: accents that drafts often lack, in order ----
ACCENT_REPAIRS = tuple(
    tuple(line.strip().split(" = "))
    for line in """
    Edition speciale = Édition spéciale
    edition speciale = édition spéciale
    edition = édition
    editions = éditions
    actualite = actualité
    actualites = actualités
    consequence = conséquence
    consequences = conséquences
    securite = sécurité
    sante = santé
    economie = économie
    economique = économique
    economiques = économiques
    merite = mérite
    deja = déjà
    detecte = détecté
    detectee = détectée
    element = élément
    elements = éléments
    redaction = rédaction
    resume = résumé
    resumes = résumés
    genere = génère
    generee = générée
    verifie = vérifie
    verifies = vérifiés
    verifier = vérifier
    verifiera = vérifiera
    ecoute = écoute
    ecoutez = écoutez
    francais = français
    Francais = Français
    Liberation = Libération
    creneau = créneau
    cafe = café
    des que = dès que
    a l'antenne = à l'antenne
    a comprendre = à comprendre
    a surveiller = à surveiller
    a suivre = à suivre
    """.strip().splitlines()
)

# ---- Fixed values: what is no usable excerpt, endings of unfinished sentences ----
NOISY_EXCERPT = _lines(r"""
\bconnexion e-?mail\b
\bmot de passe\b
\bvoir toutes les emissions\b
\bpas encore de compte\b
\binscrivez-vous\b
\bse connecter\b
\bcanal9 en direct\b
\bvoir toutes les actualites\b
\bvoir toutes les editions\b
\bcontinue reading\b
\bsign up here\b
\bnewsletter\b
""")
DANGLING_WORDS = (
    "dans sur avec pour contre chez vers entre dont que qui de du des le la les au aux et ou prenant"
).split()
DANGLING_ENDS = (
    r"(?i)\s+(dans|sur|avec|pour|contre|chez|vers|entre|dont|que|qui|de|du|des|le|la|les|au|aux|et)$",
    r"(?i)\s+(dans|sur|avec|pour|contre|chez|vers|entre|de)\s+(le|la|les|des|du|un|une|l['’])$",
)
#: Bylines and calls to subscribe, taken out in order.
BYLINES = _lines(r"""
\bPar\s+[A-ZÉÈÀÂÊÎÔÛÇ][^.,:;]{0,80}\s+©\s+\d{4}\s+AFP\s*
^Par\s+[^.]{3,100}?\s+(?=[A-ZÉÈÀÂÊÎÔÛÇ])
\b[A-ZÉÈÀÂÊÎÔÛÇ][A-Za-zÀ-ÿ' -]{2,70}\s+avec agences\s+
\bPar\s+[A-ZÉÈÀÂÊÎÔÛÇ][A-Za-zÀ-ÿ' -]{2,90}\s+avec agences\s+
\bTV5\s+JWPlayer\s+Field\b
©\s+\d{4}\s+AFP\s*
(?i)\s*Continue reading\.?\s*$
(?i)\s*•\s*Don['’]t get\b.*$
(?i)\s*Don['’]t get\b.*$
(?i)\s*Sign up here\b.*$
""")
#: Bylines in the same order: what one of a group's holds, whether in either case, and the group's patterns.
BYLINE_GROUPS = (
    (("©",), False, BYLINES[:1]),
    (("Par",), False, BYLINES[1:2]),
    (("agences", "JWPlayer", "©"), False, BYLINES[2:6]),
    (("continue reading", "t get", "sign up here"), True, BYLINES[6:]),
)
#: Phrases around a source's name ({name}), taken out in order.
SOURCE_PHRASES = _lines(r"""
\bSelon\s+[«"]?{name}[»"]?\s*,?\s*
\bD['’]après\s+[«"]?{name}[»"]?\s*,?\s*
\bChez\s+[«"]?{name}[»"]?\s*,?\s*
\bSource\s*:\s*[«"]?{name}[»"]?\.?\s*
\b[«"]?{name}[»"]?\s+explique\s+que\s+
\b[«"]?{name}[»"]?\s+a\s+pu\s+
\b[«"]?{name}[»"]?\s+avec\s+
[«"]{name}[»"]\s*
""")
#: A source of this name is also known by the other one.
SOURCE_ALIASES = {"TV5Monde": "TV5"}

# ---- Fixed values: sentences that say nothing, and phrases that no draft may hold ----
FILLERS = _lines(r"""
Dit simplement\s*:\s*il y a une situation à comprendre, des personnes concernées, et souvent des adultes qui cherchent des décisions ou des solutions\.?
On n'a pas besoin d'avoir peur pour apprendre ce qui se passe\.?
À ce stade, l'important est de séparer les faits confirmés, les réponses déjà engagées et les points qui demandent encore vérification\.?
Le signal mérite attention\s*:\s*les effets peuvent toucher la sécurité, la santé, l'économie ou la confiance publique, et les prochains développements seront déterminants\.?
L'enjeu, maintenant, c'est de voir qui est touché, ce qui change concrètement et ce qui devra être confirmé dans les prochaines heures\.?
C'est une information culturelle\s*:\s*elle parle d'artistes, de films, de chansons ou de spectacles\.?
Ces événements permettent aussi de discuter de la société, des émotions et des histoires que l'on choisit de raconter\.?
Cette information concerne des décisions prises par des responsables politiques\.?
Ces décisions peuvent changer l'organisation d'un pays, les règles publiques ou les relations avec d'autres pays\.?
""")
BANNED_PHRASES = _lines("""
une nouvelle arrive du monde de la culture
c'est une information culturelle
des responsables politiques prennent des décisions
cette information concerne des décisions prises
il y a une situation à comprendre
this is a situation to understand
this is cultural news
leaders are making decisions
the key issue now
pays neutre
liens historiques et économiques
impact direct ou indirect sur votre quotidien en suisse romande
influencer notre quotidien
influence notre quotidien
s'indépendir
switzerland, as a neutral country
historical and economic ties
""")
CREDIT = {"fr": "Sources utilisées pour cette édition: ", "en": "Sources used for this edition: "}
CREDIT_BLOCK = (
    r"(?is)\n*\s*(?:Les\s+)?sources utilisées pour cette édition\s*:.*$",
    r"(?is)\n*\s*(?:The\s+)?sources used for this edition\s*:.*$",
)
SHORT_WARNINGS = ("trop court", "too short")
LEAST_WORDS = 280

# ---- Fixed values: how items follow each other (the tenth stands for all later ones) ----
TRANSITIONS = {
    "fr": (
        "D'abord", "Ensuite", "En parallèle", "À suivre également", "Autre point important", "Dans le reste de l'actualité",
        "Plus loin dans ce bulletin", "Autre information à retenir", "Dernier point", "Pour finir",
    ),
    "en": (
        "First", "Next", "In parallel", "Also worth noting", "Another important point", "Elsewhere",
        "Further in this briefing", "Another item to watch", "One final point", "To close",
    ),
}

# ---- Fixed values: search terms of the export ----
GERMAN_TERMS = "de deutsch allemand valais oberwallis haut-valais"
UN_TERMS = "english UN ONU United Nations Nations Unies"

# ---- Fixed values: speech text ----
#: Characters that are not spoken, and what is said or shown for signs and for text that was decoded wrongly.
UNSPOKEN = "[\u200b\u200c\u200d\u2060\ufeff]"
SPOKEN_SIGNS = {
    "’": "'", "‘": "'", "`": "'", "«": "", "»": "", '"': "", "–": "-", "—": "-", "…": "...", "|": ", ", "%": " pour cent ", "+": " plus ",
    "â€™": "'", "â€˜": "'", "â€œ": "", "â€": "", "Â«": "", "Â»": "", "â€“": "-", "â€”": "-", "â€¦": "...", "Å“": "oe",
}
#: Patterns and what is said for them, in this order.
SPOKEN_WORDS = (
    (r"(?i)\bEN DIRECT\s*[,:\-]\s*", ""),
    (r"\bM\.\s+", "monsieur "),
    (r"\bMme\s+", "madame "),
    (r"\bRDC\b", "Congo"),
    (r"\bOMS\b", "Organisation mondiale de la santé"),
    (r"\bONU\b", "Organisation des Nations unies"),
    (r"\bOTAN\b", "O T A N"),
    (r"\bUE\b", "Union européenne"),
    (r"\bIA\b", "intelligence artificielle"),
    (r"\bRN\b", "Rassemblement national"),
    (r"\bUSA\b", "États-Unis"),
    (r"#MeToo\b", "Me Too"),
    (r"#Metoo\b", "Me Too"),
)
PLAIN_SPEECH = (
    (r"\bprevient\b", "alerte"),
    (r"\bTruth Social\b", "son reseau social"),
    (r"\btaux de letalite\b", "niveau de gravite"),
    (r"\bnotifies\b", "signales"),
)
