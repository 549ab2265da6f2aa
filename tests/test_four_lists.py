"""Semantic and graph search, and the fusion of all four lists, on a small knowledge area of our own."""

import inspect

import numpy as np
import pytest

from tessera.operators import lsa, retrieval
from tessera.plans import answers
from tessera.plans import retrieval as R

TEXTS = [
    "Relief valves open under pressure before the cell casing bursts.", "Pressure opens relief valves when a cell casing is heated.", "Housekeeping removes combustible dust from ledges.",
    "Fences need paint every autumn.", "Paint for fences dries slowly in autumn.", "The cell casing holds gas.",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("area"))
    save = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    save([(i, t) for i, t in enumerate(TEXTS)], "doc_id bigint, text string", "documents")
    save([(f"c{i}", i, "s1", 0, "", 0, None) for i in range(len(TEXTS))], "chunk_id string, document_id bigint, source_id string, ordinal int, section string, char_start int, char_end int", "chunks")
    save([("q1", "Which standard covers relief valves?"), ("q2", None)], "question_id string, question string", "questions")
    source = ("s1", "u", "t", "Alder Group", "standard", 4, "2024-01-01", None, "open", True, 30, "indexed", '["relief valves", "dust"]')
    save([source], "source_id string, uri string, title string, publisher string, source_type string, authority int, published_at string, retrieved_at timestamp, licence string, mirrored boolean, refresh_days int, status string, tags string", "sources")
    return d


def test_graph_search_looks_for_what_the_question_leads_to(spark, folder):
    p = R._passages(spark, folder)
    got = retrieval.graph_search(R._questions(spark, folder), p, R._entities(spark, folder), R._triples(spark, folder)).collect()
    assert [(r.question_id, r.chunk_id, r["rank"]) for r in got] == [("q1", "c2", 1)]  # relief valves -> Alder Group -> dust
    e = spark.createDataFrame([("a",)], "entity string")
    tri = spark.createDataFrame([("a", "is", "cell"), ("a", "is", "fences")], "subject string, predicate string, object string")
    q = spark.createDataFrame([("q", "what is a"), ("none", "nothing")], "question_id string, question string")
    assert {r.chunk_id for r in retrieval.graph_search(q, p, e, tri, first=1).collect()} == {"c0", "c1", "c5"}
    assert {r.chunk_id for r in retrieval.graph_search(q, p, e, tri, k=2).collect()} <= {f"c{i}" for i in range(6)}


def test_semantic_search_is_the_cosine(spark, folder):
    p, q = R._passages(spark, folder), R._questions(spark, folder)
    more = q.unionByName(spark.createDataFrame([("q3", "paint fences"), ("q4", "zzz")], "question_id string, question string"))
    m = lsa.fit(p, retrieval.vocabulary(p), dimensions=3)
    v = {r.chunk_id: np.array(r.vector, float) for r in lsa.encode(p, m).collect()}
    asked = spark.createDataFrame([("q1", "", "Which standard covers relief valves?"), ("q3", "", "paint fences")], "chunk_id string, section string, text string")
    want = {}
    for r in lsa.encode(asked, m).collect():
        s = sorted(((round(float(np.dot(r.vector, x)), 6), k) for k, x in v.items()), key=lambda x: (-x[0], x[1]))
        want[r.chunk_id] = [k for x, k in s if x > 0][:2]
    got = {}
    for r in lsa.search(more, p, m, k=2, block=1).orderBy("question_id", "rank").collect():
        got.setdefault(r.question_id, []).append(r.chunk_id)
    assert got == want and set(got["q3"]) == {"c3", "c4"}


def test_all_four_lists_are_fused_and_asked(spark, folder):
    rows = R.four_list_fuse(spark, folder).collect()
    assert {x for r in rows for x in r.retrievers.split(",")} == {"keyword", "semantic", "structured", "graph"}
    assert [r.retrievers for r in rows if r.chunk_id == "c2"] == ["graph"]
    assert {r.chunk_id for r in R.four_list_evidence(spark, folder).collect()} >= {"c0", "c1", "c2"}
    assert {r.question_id for r in answers.ask_batch(spark, folder).collect()} == {"q1", "q2"}


def test_neighbours_use_the_documented_model(spark, folder, monkeypatch):
    used, fit = [], lsa.fit

    def spy(*args, **kw):
        bound = inspect.signature(fit).bind(*args, **kw)
        bound.apply_defaults()
        used.append((bound.arguments["dimensions"], bound.arguments["sample"]))
        return fit(*args, **kw)

    monkeypatch.setattr(lsa, "fit", spy)
    assert R.lsa_neighbours(spark, folder).columns == ["query_id", "vec_id", "score", "rank"]
    assert used == [(192, 5000)]
