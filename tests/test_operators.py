"""Operators on a small knowledge area of our own, with plain-Python statements where they help."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import constants as C
from tessera.operators import answering, evaluation, extract, lsa, passages, queue, register, retrieval
from tessera.streaming import worker

TEXTS = {
    "p1": ("s1", "Venting", "Cells vent at 80 °C. The widget standard requires a relief valve at 12 bar."),
    "p2": ("s2", "Limits", "The regulation says operators must keep the cell below 60 °C within 30 s."),
    "p3": ("s3", "", "An investigation measured widget cells venting at 95 °C after 40 s."),
    "p4": ("s1", "Other", "Paint the fence before autumn."),
}
QUESTIONS = [("q1", "At what temperature do widget cells vent?"), ("q2", "Which regulation limits the cell?"), ("q3", "")]


@pytest.fixture(scope="module")
def area(spark):
    p = spark.createDataFrame([(k, s, sec, t) for k, (s, sec, t) in TEXTS.items()], "chunk_id string, source_id string, section string, text string")
    s = spark.createDataFrame([("s1", "standard", 5, "2024-06-01", "indexed"), ("s2", "regulatory", 4, "2024", "indexed"), ("s3", "company_page", 2, None, "indexed")], "source_id string, source_type string, authority int, published_at string, status string")
    q = spark.createDataFrame(QUESTIONS, "question_id string, question string")
    return p, s, q


def terms(text):
    import re

    return [t for t in (m.group().lower() for m in re.finditer(C.WORD, text)) if t not in C.STOPWORDS and len(t) > 1]


def test_bm25_is_the_formula(area):
    p, _, q = area
    tf = {}
    for k, (_, sec, t) in TEXTS.items():
        tf[k] = {}
        for w in terms(t):
            tf[k][w] = tf[k].get(w, 0) + 1.0
        for w in terms(sec):
            tf[k][w] = tf[k].get(w, 0) + C.SECTION_WEIGHT
    n, avg = len(tf), sum(sum(x.values()) for x in tf.values()) / len(tf)
    want = {}
    for qid, text in QUESTIONS:
        for k, f in tf.items():
            s = 0.0
            for w in terms(text):
                if w in f:
                    df = sum(w in x for x in tf.values())
                    s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * f[w] * (C.BM25_K1 + 1) / (f[w] + C.BM25_K1 * (1 - C.BM25_B + C.BM25_B * sum(f.values()) / avg))
            if s > 0:
                want[qid, k] = round(s, 6)
    got = {(r.question_id, r.chunk_id): r.score for r in retrieval.bm25(q, p).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=2e-6) for k in want)


def test_fusion_and_rerank(area):
    p, s, q = area
    kw = retrieval.bm25(q, p)
    fused = {(r.question_id, r.chunk_id): r for r in retrieval.fuse({"keyword": kw, "graph": kw.where("chunk_id = 'p1'").withColumn("rank", F.lit(1))}).collect()}
    r1 = {r.chunk_id: r.rank for r in kw.where("question_id = 'q1'").collect()}
    assert math.isclose(fused["q1", "p1"].fused, 1 / (60 + r1["p1"]) + 0.5 / 61) and fused["q1", "p1"].retrievers == "graph,keyword"
    assert retrieval.fuse({"keyword": kw, "graph": kw}, {"keyword": 1.0, "graph": 0.0}).select("retrievers").distinct().first()[0] == "keyword"
    top = retrieval.rerank(retrieval.fuse({"keyword": kw}), p, s, F.lit("2025-01-01").cast("date"), k=1)
    assert {r.question_id for r in top.collect()} == {"q1", "q2"}


def test_intent_and_structured(area):
    p, s, q = area
    i = {r.question_id: r for r in retrieval.intent(q.sparkSession.createDataFrame([("a", "Which regulation since 2019, before 2021? latest"), ("b", "nothing")], "question_id string, question string")).collect()}
    assert i["a"].source_types == ["regulatory"] and (i["a"].after, i["a"].before, i["a"].prefer_recent) == ("2019-01-01", "2021-01-01", True)
    assert i["b"].source_types == [] and i["b"].after is None
    got = [(r.question_id, r.chunk_id) for r in retrieval.structured(q, p, s).collect()]
    assert got == [("q2", "p2")]


def test_nearest_equals_brute_force(spark):
    r = np.random.default_rng(1)
    v = r.normal(size=(200, 8))
    v[50] = v[51]  # a tie
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(200)] + [(900, None)], "vec_id bigint, embedding array<double>")
    got = {}
    for row in retrieval.nearest(df, df.where("vec_id % 40 = 0"), k=5, block=2).collect():
        got.setdefault(row.query_id, []).append((row.rank, row.vec_id))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for qid, ranked in got.items():
        want = sorted((i for i in range(200) if i != qid), key=lambda i: (-round(float(u[qid] @ u[i]), 6), i))[:5]
        assert [i for _, i in sorted(ranked)] == want
    assert len(got) == 5 and retrieval.nearest(df, df.limit(0)).count() == 0


def test_graph(spark):
    t = spark.createDataFrame([("q", "How does hot work reach gas-tight doors?"), ("x", "chot work")], "text_id string, text string")
    e = spark.createDataFrame([("Hot work",), ("doors",), ("",)], "entity string")
    m = retrieval.match_entities(t, e)
    assert sorted(map(tuple, m.collect())) == [("q", "Hot work"), ("q", "doors")]
    tri = spark.createDataFrame([("Hot work", "is", "b"), ("b", "is", "c"), ("c", "is", "d"), ("b", "is", "doors")], "subject string, predicate string, object string")
    assert sorted(map(tuple, retrieval.expand(m, tri).collect())) == [("q", "b", 1), ("q", "c", 2)]


def test_lsa_round_trip(area):
    p, _, _ = area
    vocab = retrieval.vocabulary(p, share=1.0, least=1)
    a, b = (lsa.encode(p, lsa.fit(p, vocab, dimensions=3)).orderBy("chunk_id").collect() for _ in range(2))
    assert a == b and all(abs(np.linalg.norm(r.vector) - 1) < 1e-5 for r in a)


def evidence(spark):
    rows = [("q1", i + 1, s, a, "keyword", 0.1, t) for i, (s, a, t) in enumerate([("s1", 5, "Cells vent at 80 °C under the \"relief rule\" of the standard."), ("s3", 2, "Widget cells were seen to vent at 95 °C under the relief rule.")])]
    return spark.createDataFrame(rows, "question_id string, rank int, source_id string, authority int, retrievers string, score double, text string")


def test_grounding(spark):
    text = 'Cells vent at 80 °C under the rule. [1] Widget cells vent under that relief rule too. Cells vent at 70 °C under the rule [2]. The standard has a "golden rule" for cells [1]. Fences need fresh paint every autumn [1]. Yes. [7]'
    a = spark.createDataFrame([(1, "q1", text), (2, "none", "Cells vent below the fence."), (3, "q1", None)], "answer_id bigint, question_id string, text string")
    g = answering.ground(a, evidence(spark))
    got = {(r.answer_id, r.sentence_no): (r.supported, r.reason) for r in g.collect()}
    assert got[1, 0] == (True, "") and got[1, 1] == (True, "") and got[1, 2] == (False, "figure") and got[1, 3] == (False, "quotation") and got[1, 4] == (False, "support")
    assert got[1, 5] == (None, None) and got[2, 0] == (False, "no citation")
    r = {x.answer_id: x for x in answering.ratios(g).collect()}
    assert r[1].claims == 5 and r[1].grounded_ratio == 0.4 and math.isclose(r[1].citation_validity, 0.8)


def test_contradictions_and_gates(spark):
    ev = evidence(spark)
    assert [(r.rank_a, r.rank_b, r.unit) for r in answering.contradictions(ev, 0.4).collect()] == [(1, 2, "°c")]
    q = spark.createDataFrame([("q1", "At what temperature do tesla cells vent?"), ("q9", "vent?")], "question_id string, question string")
    g = {r.question_id: r for r in answering.gates(q, ev).collect()}
    assert g["q1"].specific and g["q1"].sufficient and g["q1"].missing == "temperatur tesla" and 0.5 < g["q1"].missing_share < 1
    assert not g["q9"].specific and not g["q9"].sufficient and g["q9"].missing_share == 0
    s = answering.scope(q, ("cells that vent",), ("price of a tesla",))
    assert all(r.in_scope for r in s.collect())


def test_extractive(spark):
    ev = spark.createDataFrame([("q", 1, "s", 3, "k", 0.1, "Widget cells vent at 80 °C when the relief valve is shut. Widget cells vent at 90 °C when the valve is open. Widget cells vent at 95 °C when the relief valve has gone.")], "question_id string, rank int, source_id string, authority int, retrievers string, score double, text string")
    q = spark.createDataFrame([("q", "How hot are widget cells when they vent?")], "question_id string, question string")
    sc = answering.extractive_scores(q, ev)
    assert sc.count() == 3
    assert answering.extractive_answers(sc).first().answer.count("[1]") == 2  # at most two of a passage


def test_verify(area, spark):
    p, s, _ = area
    claims = spark.createDataFrame([("a", "The regulation makes operators keep the cell below 60"), ("b", "An investigation measured widget cells venting"), ("c", "zeppelin flights"), ("d", "")], "claim_id string, claim string")
    got = {r.claim_id: r.verdict for r in answering.verify(claims, p, s).collect()}
    assert got == {"a": "corroborated", "b": "self_reported", "c": "not_found", "d": "not_found"}


def test_graders(spark):
    base = ("q", "answered", "The limit is 80 °C, which disagree.", 1.0, 0.8, 0, ["s1"], ["standard"], 5, ["s1", "s2"])
    a = spark.createDataFrame([(1, *base)], "answer_id bigint, question_id string, status string, text string, citation_validity double, grounded_ratio double, conflicts int, cited_ids array<string>, cited_types array<string>, cited_authority int, retrieved_ids array<string>")
    n = None
    specs = [
        ("must_include", ["80"], ["limit"], n, n, n, n, n, n, n, n, True), ("must_not_include", n, n, ["limit"], n, n, n, n, n, n, n, False), ("numeric_within", n, n, n, 82.0, 2.0, "°c", n, n, n, n, True),
        ("must_match", n, n, n, n, n, n, "LIMIT.*80", n, n, n, True), ("must_cite_source", n, n, n, n, n, n, n, ["s1"], n, n, True), ("must_cite_type", n, n, n, n, n, n, n, n, ["press"], n, False), ("min_authority", n, n, n, n, n, n, n, n, n, n, True),
        ("citations_resolve", n, n, n, n, n, n, n, n, n, n, True), ("must_abstain", n, n, n, n, n, n, n, n, n, n, False), ("must_answer", n, n, n, n, n, n, n, n, n, n, True), ("must_flag_uncertainty", n, n, n, n, n, n, n, n, n, n, True),
        ("max_unsupported", n, n, n, 0.1, n, n, n, n, n, n, False), ("must_flag_contradiction", n, n, n, n, n, n, n, n, n, n, True), ("retrieval_hit", n, n, n, n, n, n, n, ["s2", "s9"], n, n, True), ("semantic_overlap", n, n, n, n, n, n, n, n, n, "the limit", True), ("judge", n, n, n, n, n, n, n, n, n, n, True),
    ]
    got = {r.kind: (r.passed, r.score) for r in evaluation.grade(a, spark.createDataFrame([("q", *x[:-1]) for x in specs], evaluation.SPEC)).collect()}
    assert {k: v[0] for k, v in got.items()} == {x[0]: x[-1] for x in specs}
    assert got["retrieval_hit"][1] == 0.5 and got["max_unsupported"][1] == 0.8
    with pytest.raises(Exception, match="unknown grader"):
        evaluation.grade(a, spark.createDataFrame([("q", "magic", *[n] * 10)], evaluation.SPEC)).collect()


def test_regressions(spark):
    rows = [("r1", "a", True, 1), ("r1", "b", True, 1), ("r1", "c", False, 1), ("r2", "a", False, 2), ("r2", "b", True, 2)]
    got = evaluation.regressions(spark.createDataFrame(rows, "run_id string, question_id string, passed boolean, at int")).collect()
    assert [(r.run_id, r.baseline_id, r.previously_passing, r.now_failing, r.regression_rate) for r in got] == [("r2", "r1", 2, 1, 0.5)]


def test_packing_sentences():
    body = "One is here. Two is here too. Three comes last; and four."
    assert [x[0] for x in passages.pack_sentences(body, 30, 0, 5)] == ["One is here. Two is here too.", "Three comes last; and four."]
    out = passages.pack_sentences(body, 30, 20, 5)
    assert out[1][0].startswith("Two is here too.") and all(body[a:b].strip() == t for t, a, b in out)
    assert passages.pack_sentences(body, 45, 0, 12)[-1][0].endswith("and four.") and passages.pack_sentences(" ", 9, 0, 1) == []
    r = random.Random(2)
    text = " ".join("".join(r.choices("abc ", k=r.randint(5, 80))).strip().capitalize() + "." for _ in range(200))
    for t, a, b in passages.pack_sentences(text, 300, 60, 50)[:-1]:
        assert b - a <= 300 + 120 and text[a:b].strip() == t


def test_chunks_and_sections(spark):
    d = spark.createDataFrame([(1, "Intro text.\n# Head\nBody one. Body two.\n3.1 Numbered Title\nMore."), (2, None), (3, "")], "doc_id bigint, text string")
    got = [(r.section, r.text) for r in passages.chunk_documents(d).collect()]
    assert got == [("", "Intro text."), ("Head", "Body one. Body two."), ("3.1 Numbered Title", "More.")]
    assert [r.section for r in passages.sections(d.where("text is not null")).orderBy("section_no").collect()] == ["", "Head", "3.1 Numbered Title"]


def test_extract(spark):
    page = b"<html><title>T</title><nav>menu</nav><h2>Head</h2><p>Some   body.</p><script>x</script><p>tick</p><p>tick</p><p>tick</p></html>"
    raw = spark.createDataFrame([(1, None, bytearray(page)), (2, None, bytearray(b'{"a": [1, {"b": null}], "c": true}')), (3, "text/plain", bytearray(b"## First line\nrest")), (4, None, None)], "id bigint, content_type string, content binary")
    got = {r.id: r for r in extract.extract(raw).collect()}
    assert got[1].title == "T" and got[1].text == "## Head\nSome body."
    assert got[2].text == "a[0]: 1\na[1].b: None\nc: True" and got[3].title == "First line" and 4 not in got
    wide = spark.createDataFrame([(5, "text/plain", bytearray("ﬁlter ２０ Ｐａ\nx".encode()))], raw.schema)
    assert extract.extract(wide).first().text == "filter 20 Pa\nx"
    refs = "Body. " * 30 + "\nReferences\nx"
    one = spark.createDataFrame([(refs,), ("References\n" + refs[:20],)], "t string").select(extract.drop_bibliography(F.col("t"))).collect()
    assert one[0][0].endswith("Body.") and one[1][0].startswith("References")


def test_register(spark):
    reg = spark.createDataFrame([("a", False, 30, None, 0), ("b", True, 30, "x", 500), ("c", True, 1, "same", 500), ("d", True, 1, None, 0), ("e", True, 1, "new", 20), ("f", True, 1, "new", 500)], "source_id string, mirrored boolean, refresh_days int, sha256 string, chars int")
    state = spark.createDataFrame([("b", dt.datetime(2024, 1, 1), "y"), ("c", dt.datetime(2023, 1, 1), "same"), ("f", dt.datetime(2023, 1, 1), "old")], "source_id string, retrieved_at timestamp, sha256 string")
    got = {r.source_id: r.action for r in register.ingest_actions(reg, state, F.lit("2024-01-10").cast("date")).collect()}
    assert got == {"a": "pointer", "b": "fresh", "c": "unchanged", "d": "failed", "e": "failed", "f": "index"}
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "k int, v string")
    assert sorted(map(tuple, register.upsert(old, new, ["k"], F.col("v")).collect())) == [(1, "a"), (2, "d"), (3, "e")]
    assert sorted(map(tuple, register.insert_or_ignore(new, ["k"], F.col("v")).collect())) == [(2, "c"), (3, "e")]


def test_versions():
    v1 = register.cut_version([], "m", "c", "i")
    v2 = register.cut_version([v1], "m2", "c", "i")
    v3 = register.cut_version([v1, v2], "m2", "c2", "i")
    assert [v.name for v in (v1, v2, v3)] == ["v0.1.0", "v0.2.0", "v0.2.1"]
    assert register.cut_version([v1, v2, v3], "m", "c", "i").name == "v0.1.0"


def test_issue_form(spark):
    body = "### Area\r\n\r\ncells\r\n### Problem\n_No response_\n### Area\nother"
    got = spark.createDataFrame([(body,)], "b string").select(register.parse_issue(F.col("b"))).first()[0]
    assert got == {"area": "cells", "problem": ""}


def test_queue(spark):
    req = queue.requests(spark.createDataFrame([("q1", "A?", "p1"), ("q2", "B?", "p2"), ("q3", "C?", "p3")], "question_id string, question string, prompt string"), "ka")
    r = {x.question_id: x for x in req.collect()}
    at = dt.datetime(2024, 1, 1)
    resp = spark.createDataFrame([(r["q1"].request_id, r["q1"].prompt_sha, "old", "m", None, at), (r["q1"].request_id, r["q1"].prompt_sha, "new", "m", None, at + dt.timedelta(1)), (r["q2"].request_id, "else", "x", "m", None, at), (r["q3"].request_id, r["q3"].prompt_sha, None, "m", "timeout", at)], worker.RESPONSE)
    assert [x.question_id for x in queue.pending(req, resp).orderBy("question_id").collect()] == ["q2", "q3"]
    assert [x.request_id for x in queue.stale(req, resp).collect()] == [r["q2"].request_id]
    assert [x.text for x in queue.apply(req, resp).collect()] == ["new"]
    assert {x.state: x.n for x in queue.status(req, resp).collect()} == {"answered": 1, "stale": 1, "pending": 1}


def test_streaming_worker(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    row = [("r1", "q1", "hello", "h1"), ("r2", "q2", "fail", "h2")]
    spark.createDataFrame(row, worker.REQUEST).write.json(src)

    def model(prompt):
        if prompt == "fail":
            raise ValueError("no")
        return prompt.upper()

    worker.run_worker(spark, src, out, cp, model)
    worker.run_worker(spark, src, out, cp, model)  # nothing new: nothing is asked again
    got = sorted((x.request_id, x.text, x.error) for x in spark.read.schema(worker.RESPONSE).json(out).collect())
    assert got == [("r1", "HELLO", None), ("r2", None, "no")]
