import datetime as dt

from pyspark.sql import functions as F

from tessera.llm import site_lines as S

AT = dt.datetime(2024, 1, 1)
SRC = "source_id string, publisher string, retrieved_at timestamp, text string"


def docs(spark, rows):
    # `publisher` and `line_no` clash with names the operator uses inside
    return spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id bigint, text string, source string, publisher string, line_no int")


def sources(spark, rows):
    return spark.createDataFrame([(a, b, AT, "t") for a, b in rows], SRC)


def found(df):
    return sorted((r[0], r[1]) for r in df.collect())


def brute(rows, pubs, rules=S.Rules()):
    import re

    def form(x):
        x = re.sub(r"\d+", "0", x.lower())
        return re.sub(r"[^\W\d_]|0", lambda m: m[0], re.sub(r"(?:(?![^\W\d_]|0).)+", " ", x)).strip()

    out = set()
    for p in set(pubs.values()) - {None}:
        own = [(d, t) for d, t, s in rows if pubs.get(s) == p]
        lines = {}
        for d, t in own:
            for n, x in enumerate((t or "").split("\n"), 1):
                f = form(x)
                if t is not None and re.search(r"[^ 0]", f) and not x.strip().startswith("#"):
                    lines.setdefault(f, []).append((d, n))
        for f, places in lines.items():
            k = len({d for d, _ in places})
            if k >= rules.min_docs and k >= len(own) * rules.min_share:
                out.update(places)
    return sorted(out)


def test_matches_brute_force(spark):
    rows = [(i, f"Head {i}\n© {2000 + i} ACME -- all rights!\nbody of {'abcdefghij'[i % 10]}\n# © 1 acme all rights", "a" if i % 2 else "b") for i in range(40)]
    rows += [(100, None, "a"), (101, "", "b"), (102, "© 9 acme all rights", "nowhere"), (103, "© 9 acme all rights", None)]
    pubs = {"a": "P", "b": "P"}
    got = found(S.repeated_lines(docs(spark, rows), sources(spark, pubs.items())))
    assert got == brute(rows, pubs) and got


def test_share_counts_null_texts(spark):
    rows = [(i, "same line", "a") for i in range(5)] + [(100 + i, None, "a") for i in range(46)]
    assert found(S.repeated_lines(docs(spark, rows), sources(spark, [("a", "P")]))) == []
    assert len(found(S.repeated_lines(docs(spark, rows[:50]), sources(spark, [("a", "P")])))) == 5


def test_lines_without_letters_and_headings_never_count(spark):
    rows = [(i, "12-34\n  # Title\n***", "a") for i in range(10)]
    assert found(S.repeated_lines(docs(spark, rows), sources(spark, [("a", "P")]))) == []


def test_empty_tables_and_null_publishers(spark):
    assert found(S.repeated_lines(docs(spark, []), sources(spark, [("a", "P")]))) == []
    assert found(S.repeated_lines(docs(spark, [(1, "x", "a")]), sources(spark, []))) == []
    assert found(S.repeated_lines(docs(spark, [(i, "x", "a") for i in range(9)]), sources(spark, [("a", None)]))) == []


def test_repeated_registration_and_repeated_rows(spark):
    src = spark.createDataFrame([("a", "P", AT, ""), ("a", "P", AT + dt.timedelta(1), "")], SRC)
    rows = [(i, "same", "a") for i in range(6)] * 2
    assert found(S.repeated_lines(docs(spark, rows), src)) == [(i, 1) for i in range(6)]


def test_clean_rebuilds_texts(spark):
    rows = [(1, "a\nb\nc", "s"), (2, "b", "s"), (3, None, "s"), (4, "x", "s")]
    lines = spark.createDataFrame([(1, 2), (2, 1)], "doc_id bigint, line_no int")
    got = {r[0]: r[1] for r in S.without_lines(docs(spark, rows), lines).collect()}
    assert got == {1: "a\nc", 2: "", 3: None, 4: "x"}


def test_salted_join_equals_broadcast(spark, monkeypatch):
    rows = [(i, "same\nown " + "abcdef"[i % 6], "a") for i in range(30)]
    want = found(S.repeated_lines(docs(spark, rows), sources(spark, [("a", "P")])))
    monkeypatch.setattr(S, "BROADCAST_ROWS", 0)
    assert found(S.repeated_lines(docs(spark, rows), sources(spark, [("a", "P")]))) == want


def test_very_long_line(spark):
    rows = [(i, "word " * 50_000, "a") for i in range(5)]
    assert found(S.repeated_lines(docs(spark, rows), sources(spark, [("a", "P")]))) == [(i, 1) for i in range(5)]
    assert S.line_forms(F.lit("É 12, x")) is not None
