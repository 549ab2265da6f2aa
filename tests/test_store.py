"""The ontology, vectors, versions, providers and fetching on small cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import answering, asking, ontology, providers, retrieval, store, vectors
from tessera.sources import fetch, sinks

ENT = "id string, name string, kind string, aliases array<string>"
REL = "subject string, predicate string, object string"


@pytest.fixture(scope="module")
def graph(spark):
    e = spark.createDataFrame([("a", "relief valve", "part", ["vent cap"]), ("b", "cell", "part", None), ("c", "gas alarm", None, []), ("d", "hall", "place", [])], ENT)
    r = spark.createDataFrame([("a", "guards", "b"), ("b", "sets off", "c"), ("c", "stands in", "d"), ("a", "guards", "b")], REL)
    return ontology.load(e, r)


def test_ontology_loads_and_refuses_dangling_edges(spark, graph):
    e, t = graph
    assert e.count() == 4 and t.count() == 3 and {r.kind for r in e.collect()} == {"part", "concept", "place"}
    with pytest.raises(ValueError, match="undeclared entity 'zz'"):
        ontology.load(e, t.unionByName(spark.createDataFrame([("a", "guards", "zz")], REL)))
    twice = e.unionByName(spark.createDataFrame([("a2", "cell", "part", [])], ENT))
    assert ontology.load(twice, t.limit(0))[0].where("name = 'cell'").count() == 1
    assert ontology.edges(e, t).where("subject = 'relief valve' and object = 'cell' and subject_kind = 'part'").count() == 1


def test_aliases_match_and_edges_have_directions(spark, graph):
    e, t = graph
    q = spark.createDataFrame([("q1", "Is the Vent cap shut?"), ("q2", "Is the cap shut?"), ("q3", "the vent, the cap and the gas alarm"), ("q4", None)], "text_id string, text string")
    m = retrieval.match_entities(q, ontology.surfaces(e))
    assert {(r.text_id, r.entity) for r in m.collect()} == {("q1", "a"), ("q3", "c")}
    got = {(r.text_id, r.entity, r.hop, r.predicate, r.direction) for r in ontology.expand_edges(m, t).collect()}
    assert got == {("q1", "b", 1, "guards", "out"), ("q1", "c", 2, "sets off", "out"), ("q3", "b", 1, "sets off", "in"), ("q3", "d", 1, "stands in", "out"), ("q3", "a", 2, "guards", "in")}


def test_vectors_are_written_read_and_cleared(spark, tmp_path):
    p = spark.createDataFrame([(f"c{i}", "", f"pump seal {'gas ' * (i % 3)} valve number{i % 4} leak") for i in range(24)], "chunk_id string, section string, text string")
    vocab = retrieval.vocabulary(p, share=1.0)
    model = vectors.EMBEDDERS["lsa"](p, vocab, dimensions=4)
    index = vectors.build_index(p, model, str(tmp_path))
    assert index.count() == 24 and index.columns == ["chunk_id", "vector", "sha256"]
    again = vectors.load_model(spark, str(tmp_path / "model"))
    assert again.terms == model.terms and np.allclose(again.project, model.project)
    new = index.limit(1).withColumn("sha256", F.lit("x"))
    assert vectors.set_vectors(index, new).where("sha256 = 'x'").count() == 1 and vectors.set_vectors(index, new).count() == 24
    vectors.clear_index(spark, str(tmp_path))
    assert vectors.read_index(spark, str(tmp_path)).count() == 0
    q = spark.createDataFrame([("q", "gas valve")], "question_id string, question string")
    assert vectors.search_with("nobody's", q, p, vocab)[1] == "tfidf" and vectors.search_with("lsa", q, p, vocab, dimensions=4)[1] == "lsa"


def test_versions(spark):
    v = spark.createDataFrame([("v1", "published", 1), ("v2", "published", 2), ("v3", "draft", 3)], "version string, status string, published_at int")
    assert [r.version for r in store.history(v).collect()] == ["v2", "v1"]
    after, now = store.rollback(v, "v2")
    assert now == "v1" and {r.version: r.status for r in after.collect()} == {"v1": "published", "v2": "rolled_back", "v3": "draft"}
    assert store.rollback(v.where("version = 'v1'"), "v1")[1] is None
    moves = spark.createDataFrame([("citation_validity", True), ("retrieval_recall", False)], "metric string, regressed boolean")
    none = spark.createDataFrame([], "question_id string")
    assert store.publish_reasons("v2", "v2", True, moves.limit(0), none) == (True, [])
    ok, why = store.publish_reasons("v2", "v1", False, moves, spark.createDataFrame([("q",)], "question_id string"))
    assert not ok and len(why) >= 3
    assert store.publish_reasons("v2", "v1", True, moves.limit(0), none, force=True)[0]


def test_meta_documents_and_tenants(spark):
    m = store.set_meta(spark.createDataFrame([("a", "1")], "key string, value string"), {"a": "2", "b": "3"})
    assert store.get_meta(m, "a") == "2" and store.get_meta(m, "none", "x") == "x"
    docs = spark.createDataFrame([(1, "s"), (2, "s"), (3, "t"), (4, None)], "doc_id long, source string")
    chunks = spark.createDataFrame([("c1", 1), ("c2", 2), ("c3", 3), ("c4", 4)], "chunk_id string, document_id long")
    d, c = store.replace_documents(docs, chunks, spark.createDataFrame([(9, "s")], docs.schema), spark.createDataFrame([("c9", 9)], chunks.schema))
    assert {r.doc_id for r in d.where("source is not null").collect()} == {3, 9} and {r.chunk_id for r in c.collect()} == {"c3", "c4", "c9"}
    areas = spark.createDataFrame([("public", None, 1), ("private", "x", 2), ("private", None, 3)], "visibility string, tenant string, id int")
    assert {r.id for r in store.visible(areas, "x").collect()} == {1, 2} and {r.id for r in store.visible(areas, None).collect()} == {1}


def test_providers(spark):
    p = spark.createDataFrame([("q1", "good"), ("q2", "bad")], "question_id string, prompt string")

    def complete(prompt):
        if prompt == "bad":
            raise RuntimeError("no")
        return "yes: " + prompt

    got = {r.question_id: r for r in providers.calling("mine", complete)(p).collect()}
    assert got["q1"].text == "yes: good" and got["q2"].error == "RuntimeError: no"
    canned = providers.scripted(spark.createDataFrame([("q1", "canned")], "question_id string, text string"))
    reg = providers.Registry(("scripted", canned))
    assert {r.provider for r in reg.get("remote")(p).collect()} == {"scripted (for remote)"}
    with pytest.raises(KeyError):
        reg.get("remote", require_model=True)
    statements = spark.createDataFrame([("k1", "s1", "c", "t"), ("k1", "s2", "c", "u"), ("k2", "s1", "c", None)], "claim_id string, source_id string, claim string, stated string")
    judge = providers.calling("judge", lambda prompt: "YES" if "Passage: t" in prompt else "NO")
    assert {tuple(r) for r in providers.entailment(judge, statements).collect()} == {("k1", "s2")}


def test_a_subject_and_a_denial_take_support_away(spark):
    claims = spark.createDataFrame([("k", "The pump station delivers forty litres.")], "claim_id string, claim string")
    p = spark.createDataFrame([("c1", "s1", "", "Acme says: the pump station delivers forty litres."), ("c2", "s2", "", "The pump station delivers forty litres, they say.")], "chunk_id string, source_id string, section string, text string")
    src = spark.createDataFrame([("s1", "news", "[]"), ("s2", "news", '["identity-unconfirmed"]')], "source_id string, source_type string, tags string")
    verdict = lambda **kw: tuple(answering.verify(claims, p, src, **kw).select("sources", "independent", "verdict").first())
    assert verdict() == (2, 2, "corroborated") and verdict(subject="Acme") == (1, 1, "corroborated")
    no = spark.createDataFrame([("k", "s1")], "claim_id string, source_id string")
    assert verdict(subject="Acme", denied=no) == (1, 0, "not_found")
    rows = {r.source_id: r for r in answering.support(claims, p, src).collect()}
    assert rows["s2"].unconfirmed and rows["s1"].stated.startswith("Acme") and rows["s1"].chunk_id == "c1"


def test_replies_are_split_and_abstentions_seen(spark):
    rows = [("ANSWER:\r\nforty [1]\n\nReasoning\nas said",), ("the evidence is not sufficient to answer this",), ("plain",), (None,)]
    got = spark.createDataFrame(rows, "t string").select(asking.split_sections(F.col("t")).alias("s"), asking.looks_abstained(F.col("t")).alias("a")).collect()
    assert [(r.s.answer, r.s.reasoning, r.a) for r in got] == [("forty [1]", "as said", False), ("the evidence is not sufficient to answer this", "", True), ("plain", "", False), ("", "", None)]


def test_fetch(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>x</p>")
    src = spark.createDataFrame([("i", "inline:", "text"), ("n", "inline:", None), ("f", f"file://{tmp_path}/a.html", None), ("m", str(tmp_path / "none.txt"), None), ("h", "https://x.example/a.pdf", None), ("g", "gopher://x", None)], "source_id string, uri string, content string")
    got = {r.source_id: r for r in fetch.fetch(src, fetch.read_files(spark, str(tmp_path))).collect()}
    assert bytes(got["i"].content) == b"text" and got["f"].content_type == "text/html" and bytes(got["f"].content) == b"<p>x</p>"
    assert all(got[k].error for k in "nmhg") and not got["i"].error and not got["f"].error
    pages = spark.createDataFrame([("https://x.example/a.pdf", bytearray(b"%PDF"), "application/pdf", "https://x.example/b.pdf")], "uri string, content binary, content_type string, final_uri string")
    assert {r.source_id: r for r in fetch.fetch(src, None, pages).collect()}["h"].final_uri.endswith("b.pdf")


def test_record_sinks(spark, tmp_path):
    path = str(tmp_path / "q" / "r.json")
    assert sinks.write_json({"a": 1}, path) and not sinks.write_json({"a": 1}, path) and sinks.write_json({"a": 2}, path)
    m = spark.createDataFrame([("recall", 0.5)], "metric string, value double")
    t = spark.createDataFrame([("factual", 2, 1)], "qtype string, total int, passed int")
    f = spark.createDataFrame([("q1",)], "question_id string")
    for v in ("v0.1.0", "v0.10.0", "v0.2.0"):
        sinks.write_report(sinks.report_record(v, m, t, f, True), str(tmp_path), publish=True)
    assert [r["version"] for r in sinks.version_log(str(tmp_path))] == ["v0.10.0", "v0.2.0", "v0.1.0"]
    sinks.export_static({"metrics": m}, str(tmp_path / "site"))
    assert spark.read.json(str(tmp_path / "site" / "api" / "metrics")).count() == 1 and (tmp_path / "site" / "index.json").is_file()
    ch = spark.createDataFrame([("1", "q", "open"), ("2", "r", "promoted")], "id string, question string, status string")
    sinks.export_challenges(ch, str(tmp_path / "ch"))
    stored = spark.createDataFrame([("1", "old", "open"), ("3", "s", "open")], ch.schema)
    assert {r.id: r.question for r in sinks.import_challenges(stored, str(tmp_path / "ch"), ["id"]).collect()} == {"1": "q", "2": "r", "3": "s"}


def test_templates(tmp_path):
    src = tmp_path / "t"
    src.mkdir()
    (src / "template.json").write_text('{"id": "area-{{ name }}", "parameters": ["name"]}')
    (src / "a.md").write_text("About {{ name }} ({{ id }})")
    out = sinks.instantiate(str(src), {"name": "x"}, str(tmp_path / "out"))
    assert (out / "a.md").read_text() == "About x (area-x)"
    with pytest.raises(FileExistsError):
        sinks.instantiate(str(src), {"name": "x"}, str(tmp_path / "out"))
    for bad in ({}, {"name": "A B"}):
        with pytest.raises(ValueError):
            sinks.instantiate(str(src), bad, str(tmp_path / "out"), force=True)
    (src / "a.md").write_text("{{ nobody }}")
    with pytest.raises(ValueError, match="nobody"):
        sinks.instantiate(str(src), {"name": "x"}, str(tmp_path / "out"), force=True)
