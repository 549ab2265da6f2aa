import random
from collections import defaultdict

from tessera.llm import keyword_spam as K

KEYWORDS = "\n".join("cheap inverter, buy inverter Norwick, inverter near me, best power bank, low cost power bank, inverter sale" for _ in range(8))
LINKS = "\n".join(f"[inverter Norwick](http://ab{i}.example/power-bank-{i})\ninverter sale http://cd{i}.example/x-{i}" for i in range(12))
TAGS = "\n".join("» #cheapinverter #buyinverter #topinverter #inverternearme" for _ in range(8))
DRESSED = " ".join("Inverter cheap. Buy inverter Norwick. inverter sale inverter deal! Power bank top." for _ in range(12))
GLUED = " ".join("cheap inverter for the home in Norwick the best of power bank for sale of inverter in Norwick for the power bank" for _ in range(11))
PROSE = "\n".join(f"Pressure in the pump rose to {i} bar before the panel opened, and no one in the hall was hurt." for i in range(20))
TABLE = "\n".join(f"| spray dryer | the dryer house, Norwick | {100 + i} °C, {i} bar |" for i in range(20))
CHECKS = "\n".join(f"- Check the vent in the test chamber for dust, then sign sheet {i}." for i in range(20))
LOG = "\n".join(f"Reading {i}: the dryer was normal at {i} °C in the line." for i in range(20))
GLOSSARY = "; ".join(f"{a} near the {b} with {c}" for a, b, c in zip(
    ["pump", "vent", "gas sensor", "weld tab", "rack", "busbar", "silo", "hopper", "coolant loop", "pouch cell", "inverter bay", "gasket"],
    ["east annex", "upper gallery", "control room", "loading yard", "test chamber", "dryer house", "basement", "north wall", "container row", "silo deck", "recycling shed", "mill"],
    ["loose fasteners", "lithium plating", "static discharge", "a failed sensor", "bypassed interlocks", "hot work", "a blocked vent", "a software limit", "moisture", "dust", "a degraded seal", "an unbonded hose"],
))
STUFFED, HONEST = [KEYWORDS, LINKS, TAGS, DRESSED, GLUED], [PROSE, TABLE, CHECKS, LOG, GLOSSARY]


def docs(spark, rows, hosts=None):
    data = [(i, None, t, f"http://www.h{i if hosts is None else hosts[k]}.example/p", f"s{i}", "text", 1) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id bigint, title string, text string, uri string, source string, extractor string, words int")


def flagged(df, **kw):
    return sorted(r.doc_id for r in K.spam_pages(df, K.Limits(**kw)).collect())


def test_kinds_on_several_hosts(spark):
    texts = STUFFED + HONEST + [PROSE + "\n" + KEYWORDS[:200], KEYWORDS + "\n" + PROSE[:100]]
    rows = [(i + 100 * copy, t) for copy in range(3) for i, t in enumerate(texts)]
    assert flagged(docs(spark, rows)) == [i + 100 * c for c in range(3) for i in (0, 1, 2, 3, 4, 11)]


def test_replication_is_necessary(spark):
    once = [(i, t) for i, t in enumerate([KEYWORDS, "\n".join("golden teapot offer, silver teapot, teapot lid bargain, teapot handle" for _ in range(8))])]
    assert flagged(docs(spark, once)) == []
    three = [(i, KEYWORDS) for i in range(3)]
    assert flagged(docs(spark, three)) == [0, 1, 2]
    assert flagged(docs(spark, three, hosts=[7, 7, 8])) == []  # two hosts only
    rows = {r.doc_id: r for r in K.evidence(docs(spark, three + [(9, KEYWORDS.replace("inverter", "teapot"))])).collect()}
    assert rows[0].replicated_words == rows[0].phrase_words > 0 and 0 < rows[9].replicated_words < rows[9].phrase_words


def test_evidence_matches_brute_force(spark):
    r, words = random.Random(4), "cheap inverter price power bank sale near me original solar storage deal top".split()
    rows, hosts = [], []
    for i in range(40):
        marks = r.choice([", ", " | ", " "])
        rows.append((i, "\n".join(marks.join(" ".join(r.choices(words, k=r.randint(1, 3))) for _ in range(9)) for _ in range(r.randint(1, 4))) + "\n" + r.choice(["", PROSE[:300]])))
        hosts.append(r.randrange(9))
    on, held, limits = defaultdict(set), {}, K.Limits()
    for (i, text), h in zip(rows, hosts):
        parts = K.strings(text.split("\n"))
        lists = [(s, low) for s, low in parts if K.list_evidence(s, low) >= limits.listed]
        weights = defaultdict(int)
        for s, _ in lists:
            for p, w in K.phrases(s, limits.words).items():
                weights[p] += w
                on[p].add(h)
        if lists:
            held[i] = (sum(len(low) for _, low in parts), sum(len(low) for _, low in lists), weights)
    want = {i: (n, m, sum(w.values()), sum(v for p, v in w.items() if len(on[p]) >= limits.hosts)) for i, (n, m, w) in held.items()}
    assert {r[0]: tuple(r[1:]) for r in K.evidence(docs(spark, rows, hosts)).collect()} == want and len(want) > 30


def test_phrases():
    assert K.phrases("Cheap inverter, buy inverter Norwick", 5) == {"cheap inverter": 2, "buy inverter norwick": 3}
    assert K.phrases("a b c d e f g", 5) == {"a b c d e": 5, "b c d e f": 1, "c d e f g": 1}
    assert K.phrases("http://ab1.example/power-bank-17", 5) == {"bank power": 2} and K.phrases("12 | 34", 5) == {}


def test_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, KEYWORDS), (4, KEYWORDS), (5, "cheap inverter " * 40_000), (6, KEYWORDS), (7, KEYWORDS), (8, "cheap inverter " * 40), (9, "cheap inverter " * 40)]
    assert flagged(docs(spark, rows)) == [4, 5, 6, 7, 8, 9]
    assert flagged(docs(spark, [])) == []
    no_host = docs(spark, [(i, KEYWORDS) for i in range(4)]).withColumn("uri", K.F.lit(None).cast("string")).withColumn("source", K.F.lit(None).cast("string"))
    assert flagged(no_host) == []


def test_a_small_bound_of_broadcasting_changes_nothing(spark, monkeypatch):
    rows = docs(spark, [(i, KEYWORDS) for i in range(3)] + [(5, PROSE)])
    want = sorted(map(tuple, K.evidence(rows).collect()))
    monkeypatch.setattr(K, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, K.evidence(rows).collect())) == want


def test_furniture_is_left_aside_on_web_pages_alone(spark):
    menu = "Home | News | About us | Contact | Search | Sitemap\n\n"
    pages = [(i, menu + PROSE + "\n" + KEYWORDS) for i in range(3)]
    web = docs(spark, pages).withColumn("extractor", K.F.lit("html"))
    words = lambda df: {r.words for r in K.evidence(df).collect()}
    assert max(words(web)) < min(words(docs(spark, pages)))
