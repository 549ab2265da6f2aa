"""The model's neighbours: tokens read in Python, ties, and passages read once for all queries."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import lsa, retrieval

ODD = (
    "Running, falling; it's the cells' vents' o'' ''x flies buses glass status axis cased agreed ing sing oozing classes IEC-62133+A1/b 1,200.5 3.7 cafés KelvinK "
    "١٢ İstanbul aa a's toes ees trees cutting be'e's Zs's x-rays' ss's sses misses 12ed 12ing eed (valve)s' UP'S re-e"
)
TEXTS = [
    "Relief valves open under pressure before the cell casing bursts.", "Pressure opens relief valves when a cell casing is heated.", "Housekeeping removes combustible dust from ledges.",
    "Fences need paint every autumn.", "Paint for fences dries slowly in autumn.", "The cell casing holds gas.", "zzz", "of the", ODD,
]


def test_a_token_is_read_as_the_expressions_read_it(spark):
    d = spark.createDataFrame([(i, s, x) for i, x in enumerate([ODD, ODD.upper(), *TEXTS, None]) for s in ("", "The Vented Cells", None)], "i int, section string, text string")
    for r in d.withColumn("t", T.transform_terms("section", "text")).collect():
        tokens = next(lsa._tokens(pd.DataFrame({"section": [r.section], "text": [r.text]})))
        assert [t for t in map(lsa.term_of, tokens) if t is not None] == r.t


def test_neighbours_are_those_of_the_encoded_vectors(spark, monkeypatch):
    rows = [(f"c{i}", "" if i % 3 else "Vented cells", TEXTS[i % len(TEXTS)] if i < 60 else f"{TEXTS[i % 6]} Note {i} on {TEXTS[i % 5]}") for i in range(160)]
    p = spark.createDataFrame(rows, "chunk_id string, section string, text string").repartition(3)
    vocabulary = retrieval.vocabulary(p)
    counted = retrieval.weighed(lsa.document_counts(p), p.agg(F.count("*").alias("n")))
    assert counted.collect() == vocabulary.collect()
    monkeypatch.setattr(lsa, "KEPT", 2)  # what tasks keep may begin anew at any time
    assert retrieval.weighed(lsa.document_counts(p), p.agg(F.count("*").alias("n"))).collect() == vocabulary.collect()
    m = lsa.fit(p, vocabulary, dimensions=5)
    v = lsa.encode(p, m).select(F.xxhash64("chunk_id").alias("vec_id"), F.col("vector").cast("array<double>").alias("embedding"))
    want = retrieval.nearest(v, v.where("pmod(vec_id, 2) = 0"), k=3).orderBy("query_id", "rank").collect()
    assert any(r.score == 0 for r in want) and any(r.score == 1 for r in want)  # passages without a known term, equal ones
    for block in (7, 50_000):
        assert lsa.neighbours(p, m, every=2, block=block).orderBy("query_id", "rank").collect() == want


def test_passages_are_read_once_for_all_queries(spark):
    """2,100 queries took two readings, each encoding every passage, after one to encode the queries partition by partition."""
    p = spark.createDataFrame([(f"c{i}", "", TEXTS[i % 6]) for i in range(2100)], "chunk_id string, section string, text string")
    m = lsa.fit(p, retrieval.vocabulary(p), dimensions=3)
    found = lsa.neighbours(p, m, every=1)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    v = {r[0]: np.array(r[1], dtype=np.float64) for r in lsa.encode(p, m).select(F.xxhash64("chunk_id"), "vector").collect()}
    ids, x = np.array(sorted(v)), np.array([v[i] / np.linalg.norm(v[i]) for i in sorted(v)])
    for q in ids[:300].tolist():
        scores = np.round(x @ (v[q] / np.linalg.norm(v[q])), 6)
        assert got[q] == [(scores[i], ids[i]) for i in np.lexsort((ids, -scores)) if ids[i] != q][:3]
    assert len(got) == 2100


def test_equal_passages_stay_few_candidates():
    """Of passages that tie, only as many as can be among the best are weighed."""
    ids, x = np.arange(4000), np.tile(np.array([[0.6, 0.8]], dtype=np.float32), (4000, 1))
    weighed = []

    class Spy(lsa._Best):
        def _add(self, r, i, s):
            weighed.append(len(r))
            super()._add(r, i, s)

    best = Spy(ids[:100], x[:100], 3)
    best.meet(ids, x)
    assert sum(weighed) <= 400 and best.id[0].tolist() == [1, 2, 3] and best.id[5].tolist() == [0, 1, 2]


def test_a_bound_rules_out_none_of_the_best(monkeypatch):
    """Leading dimensions and the others' norms find what all dimensions find, near ones and far ones."""
    r = np.random.default_rng(3)
    centres = r.standard_normal((30, 12)) / np.arange(1, 13)
    x = np.concatenate([centres[r.integers(30, size=900)] + 0.03 * r.standard_normal((900, 12)), r.standard_normal((300, 12)), np.zeros((5, 12))])
    x = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)[r.permutation(1205)]
    ids = r.permutation(1205)

    def found():
        best = lsa._Best(ids[::7], x[::7], 3)
        for at in range(0, 1205, 100):
            best.meet(ids[at : at + 100], x[at : at + 100], tile=50)
        return best.rows().values.tolist(), best.cut

    whole, _ = found()
    monkeypatch.setattr(lsa, "HEAD", 4)
    bounded, cut = found()
    assert (np.isfinite(cut) & (cut >= lsa.NEAR)).sum() > 60 and (cut < lsa.NEAR).sum() > 5
    double = x.astype(np.float64) / np.maximum(np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True), 1e-300)
    want = []
    for q in range(0, 1205, 7):
        scores = np.round(double @ double[q], 6)
        want += [[float(ids[q]), float(ids[i]), scores[i]] for i in np.lexsort((ids, -scores)) if i != q][:3]
    assert whole == bounded == want


def test_a_sample_that_ends_with_a_null_id_or_has_no_passage(spark):
    for rows in ([], [(None, "x", "cell casing gas"), (None, "", "cell casing")]):  # a null's hash is 42, an int as a literal
        p = spark.createDataFrame(rows, "chunk_id string, section string, text string")
        m = lsa.fit(p, retrieval.vocabulary(p))
        assert sorted(m.terms) == (["cas", "cell"] if rows else []) and lsa.neighbours(p, m, every=50).collect() == []
