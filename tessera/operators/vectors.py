"""Embedders behind one name, sparse tf-idf search, and the stored index of vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import constants as C
from tessera.functions import text as T
from tessera.operators import lsa
from tessera.operators.retrieval import top

#: Questions scored at once.
BLOCK = 1000


def tfidf_search(questions: DataFrame, passages: DataFrame, vocabulary: DataFrame, k: int = C.CANDIDATE_K) -> DataFrame:
    """(question_id, chunk_id, score, rank): the k passages nearest to each question by the cosine of
    their tf-idf vectors, as far as it is above zero. The vectors stay sparse: a task adds, term by
    term, its passages' weights to a block's scores; the vocabulary is bounded by its cap."""
    spark = questions.sparkSession
    vocab = sorted((r["term"], r["idf"]) for r in vocabulary.collect())  # at most the vocabulary's cap
    terms, idf = {t: i for i, (t, _) in enumerate(vocab)}, np.array([x for _, x in vocab])
    schema = "question_id string, chunk_id string, score double"
    found = spark.createDataFrame([], schema)
    asked = [(r["question_id"], r["t"]) for r in questions.where("question is not null").select("question_id", T.transform_terms("question").alias("t")).toLocalIterator()]

    def against(part: list[tuple[str, list[str]]]) -> DataFrame:
        r, c, v = lsa._rows([t for _, t in part], terms, idf)
        of_term: dict[int, tuple[list[int], list[float]]] = {}
        for q, t, x in zip(r.tolist(), c.tolist(), v.tolist()):
            of_term.setdefault(t, ([], []))[0].append(q)
            of_term[t][1].append(x)
        shared = spark.sparkContext.broadcast(([q for q, _ in part], terms, idf, {t: (np.array(a), np.array(b)) for t, (a, b) in of_term.items()}))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, terms, idf, of_term = shared.value
            best: pd.DataFrame | None = None
            for whole in batches:
                for at in range(0, len(whole), 4000):
                    pdf = whole.iloc[at : at + 4000]
                    row, term, weight = lsa._rows(pdf["t"].tolist(), terms, idf)
                    order = np.argsort(term, kind="stable")
                    names, begin = np.unique(term[order], return_index=True)
                    score = np.zeros((len(ids), len(pdf)))
                    for t, i, j in zip(names.tolist(), begin, [*begin[1:], len(order)]):
                        if t in of_term:
                            qs, xs = of_term[t]
                            score[np.ix_(qs, row[order[i:j]])] += xs[:, None] * weight[order[i:j]][None, :]
                    cut = np.partition(score, -min(k, len(pdf)), axis=1)[:, -min(k, len(pdf))]
                    q, c = np.nonzero((score >= cut[:, None] - 2e-6) & (score > 0))
                    new = pd.DataFrame({"question_id": np.array(ids, dtype=object)[q], "chunk_id": pdf["chunk_id"].to_numpy()[c], "score": score[q, c]})
                    best = new if best is None else pd.concat([best, new])
                    best = best.sort_values(["question_id", "score"], ascending=[True, False])
                    last = best[best.groupby("question_id").cumcount() == k - 1].set_index("question_id")["score"]
                    best = best[best["score"] >= best["question_id"].map(last).fillna(0.0) - 2e-6]
            if best is not None:
                yield best

        return lsa.term_rows(passages).mapInPandas(run, schema)

    for at in range(0, len(asked), BLOCK):
        found = found.unionByName(against(asked[at : at + BLOCK]))
    return top(found.withColumn("score", F.round("score", 6)).where("score > 0"), "question_id", [F.desc("score"), F.asc("chunk_id")], k)


def save_model(model: lsa.Model, spark: SparkSession, folder: str) -> None:
    """Write a fitted model (as many rows as its vocabulary) as a table."""
    rows = [(t, float(model.idf[i]), [float(x) for x in model.project[i]]) for t, i in model.terms.items()]
    spark.createDataFrame(rows, "term string, idf double, project array<double>").write.mode("overwrite").parquet(folder)


def load_model(spark: SparkSession, folder: str) -> lsa.Model:
    rows = sorted(map(tuple, spark.read.parquet(folder).collect()))
    return lsa.Model({t: i for i, (t, _, _) in enumerate(rows)}, np.array([x for _, x, _ in rows]), np.array([p for _, _, p in rows], dtype=np.float32))


def build_index(passages: DataFrame, model: lsa.Model, folder: str) -> DataFrame:
    """Encode every passage and replace the index in ``folder``: ``model`` and ``vectors`` below it. A
    reader finds passages that changed by their text's hash."""
    spark = passages.sparkSession
    folder = folder.rstrip("/")
    save_model(model, spark, f"{folder}/model")
    shas = passages.select("chunk_id", F.sha2(F.concat_ws("\n", "section", "text"), 256).alias("sha256"))
    lsa.encode(passages, model).join(shas, "chunk_id").write.mode("overwrite").parquet(f"{folder}/vectors")
    return read_index(spark, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """(chunk_id, vector, sha256) of a stored index."""
    return spark.read.parquet(f"{folder.rstrip('/')}/vectors")


def set_vectors(index: DataFrame, new: DataFrame) -> DataFrame:
    """The index with the vectors of ``new`` put in by chunk_id."""
    return index.join(new.select("chunk_id").distinct(), "chunk_id", "left_anti").unionByName(new.select(*index.columns))


def clear_index(spark: SparkSession, folder: str) -> None:
    """Empty a stored index; its columns stay."""
    empty = read_index(spark, folder).limit(0)
    spark.createDataFrame([], empty.schema).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/vectors")


#: Embedders by name: fit passages to something that encodes.
EMBEDDERS: dict[str, Callable] = {"lsa": lambda passages, vocabulary, **kw: lsa.fit(passages, vocabulary, **kw)}


def register_embedder(name: str, fit: Callable) -> None:
    EMBEDDERS[name] = fit


def search_with(name: str, questions: DataFrame, passages: DataFrame, vocabulary: DataFrame, k: int = C.CANDIDATE_K, **options) -> tuple[DataFrame, str]:
    """(ranked list, name of the embedder used). An embedder nobody has registered falls back to tf-idf,
    and the name returned says so."""
    if name in EMBEDDERS and name != "tfidf":
        return lsa.search(questions, passages, EMBEDDERS[name](passages, vocabulary, **options), k), name
    return tfidf_search(questions, passages, vocabulary, k), "tfidf"
