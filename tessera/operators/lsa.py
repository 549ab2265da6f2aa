"""Latent semantic vectors: tf-idf over a fitted vocabulary, projected by a randomised SVD.

The fit runs on the driver over a bounded sample of passages (``sample``, by hash of the id);
every passage is encoded, in Arrow batches against the broadcast projection of fixed size
(vocabulary cap x dimensions). ``neighbours`` reads passages' tokens in Python: a token's form is
looked up, and derived once for each spelling.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import constants as C
from tessera.functions import text as T
from tessera.operators.retrieval import top
from tessera.session import materialise


@dataclass(frozen=True)
class Model:
    terms: dict[str, int]
    idf: np.ndarray
    project: np.ndarray  # terms x dimensions


def term_rows(passages: DataFrame) -> DataFrame:
    """(chunk_id, t): the stemmed terms of each passage, with repetitions. Passages that bring them (column
    ``t``) are taken as they are, so that a caller computes them once for vocabulary, fit and search."""
    return passages.select("chunk_id", F.col("t") if "t" in passages.columns else T.transform_terms("section", "text").alias("t"))


def _rows(docs: Iterable[list[str]], terms: dict[str, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coordinates of the length-normalised tf-idf rows (sublinear term counts)."""
    r, c, v = array("q"), array("q"), array("d")
    for i, d in enumerate(docs):
        counts: dict[int, int] = {}
        for t in d:
            if t in terms:
                counts[terms[t]] = counts.get(terms[t], 0) + 1
        if counts:
            w = {j: (1 + np.log(n)) * idf[j] for j, n in counts.items()}
            norm = np.sqrt(sum(x * x for x in w.values()))
            for j, x in w.items():
                r.append(i), c.append(j), v.append(x / norm)
    return np.array(r, dtype=np.int64), np.array(c, dtype=np.int64), np.array(v, dtype=np.float64)


#: Entries multiplied at once, which bounds memory.
_AT_ONCE = 20_000


def _times(coo, x: np.ndarray, n: int) -> np.ndarray:
    r, c, v = coo
    out = np.zeros((n, x.shape[1]))
    if len(r) and (np.diff(r) < 0).any():
        order = np.argsort(r, kind="stable")
        r, c, v = r[order], c[order], v[order]
    for i in range(0, len(r), _AT_ONCE):
        part = slice(i, i + _AT_ONCE)
        rows, begin = np.unique(r[part], return_index=True)  # sorted, so a row's entries stand together
        out[rows] += np.add.reduceat(v[part, None] * x[c[part]], begin, axis=0)
    return out


def _times_t(coo, x: np.ndarray, m: int) -> np.ndarray:
    r, c, v = coo
    return _times((c, r, v), x, m)


def fit(passages: DataFrame, vocabulary: DataFrame, dimensions: int = 192, sample: int = 5000, seed: int = 20260918) -> Model:
    vocab = sorted((row["term"], row["idf"]) for row in vocabulary.collect())  # at most the vocabulary's cap
    terms = {t: i for i, (t, _) in enumerate(vocab)}
    idf = np.array([x for _, x in vocab])
    by = F.struct(F.xxhash64("chunk_id").alias("h"), "chunk_id")
    # the last id of the sample first, so that only the sample's texts are moved
    last = passages.select(by.alias("by")).orderBy("by").limit(sample).agg(F.max("by").alias("by")).first()["by"]
    own = passages.where(by <= F.struct(F.lit(last["h"]).cast("bigint"), F.lit(last["chunk_id"]).cast("string"))) if last else passages.limit(0)
    picked = term_rows(own.repartition(1).sortWithinPartitions(F.xxhash64("chunk_id"), "chunk_id").limit(sample))
    n, m = 0, len(terms)

    def docs() -> Iterator[list[str]]:  # one at a time: the driver holds coordinates, not texts
        nonlocal n
        for row in picked.toLocalIterator():
            n += 1
            yield row["t"]

    coo = _rows(docs(), terms, idf)
    del vocab
    k = max(1, min(dimensions, n, m))
    rng = np.random.default_rng(seed)
    y = _times(coo, rng.standard_normal((m, min(m, k + 10))), n)
    for _ in range(2):  # power iterations sharpen the leading directions
        y, _ = np.linalg.qr(y)
        z, _ = np.linalg.qr(_times_t(coo, y, m))
        y = _times(coo, z, n)
    basis, _ = np.linalg.qr(y)
    y = z = None
    # the right singular vectors, from the small matrix of inner products
    b = _times_t(coo, basis, m)
    values, vectors = np.linalg.eigh(b.T @ b)
    order = np.argsort(-values, kind="stable")[:k]
    scale = np.sqrt(np.maximum(values[order], 1e-18))
    return Model(terms, idf, (b @ (vectors[:, order] / scale)).astype(np.float32))


def _vectors(texts: pd.Series, model: Model) -> np.ndarray:
    x = _times(_rows([list(t) for t in texts], model.terms, model.idf), model.project.astype(np.float64), len(texts))
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def encode(passages: DataFrame, model: Model) -> DataFrame:
    """(chunk_id, vector): unit vectors; passages without a known term have the zero vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"chunk_id": pdf["chunk_id"], "vector": list(_vectors(pdf["t"], model))})

    return term_rows(passages).mapInPandas(run, "chunk_id string, vector array<float>")


def search(questions: DataFrame, passages: DataFrame, model: Model, k: int = C.CANDIDATE_K, block: int = 2000) -> DataFrame:
    """(question_id, chunk_id, score, rank): the k passages nearest to each question by cosine, as far
    as that is above zero; a question without a known term finds nothing. Questions go to the tasks
    in blocks, as those of ``retrieval.nearest``; passages are encoded where they are compared."""
    schema = "question_id string, chunk_id string, score double"

    def against(ids: np.ndarray, q: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best: pd.DataFrame | None = None
            for pdf in batches:
                if pdf.empty:
                    continue
                s = np.round(q @ _vectors(pdf["t"], model).astype(np.float64).T, 6)
                take = min(s.shape[1], k)
                cut = np.maximum(np.partition(s, -take, axis=1)[:, -take], 1e-6)  # ties of the last place stay
                rows, cols = np.nonzero(s >= cut[:, None])
                new = pd.DataFrame({"question_id": ids[rows], "chunk_id": pdf["chunk_id"].to_numpy()[cols], "score": s[rows, cols]})
                best = new if best is None else pd.concat([best, new])
                best = best.sort_values(["question_id", "score", "chunk_id"], ascending=[True, False, True]).groupby("question_id").head(k)
            if best is not None:
                yield best

        return term_rows(passages).mapInPandas(run, schema)

    asked = encode(questions.where("question is not null").select(F.col("question_id").alias("chunk_id"), F.lit("").alias("section"), F.col("question").alias("text")), model)
    parts, pending = [], []
    for r in asked.toLocalIterator():
        if any(r["vector"]):
            pending.append((r["chunk_id"], r["vector"]))
        if len(pending) == block:
            parts.append(pending)
            pending = []
    found: DataFrame = questions.sparkSession.createDataFrame([], schema)
    for part in [*parts, pending] if pending else parts:
        found = found.unionByName(against(np.array([i for i, _ in part], dtype=object), np.array([v for _, v in part], dtype=np.float64)))
    return top(found, "question_id", [F.desc("score"), F.asc("chunk_id")], k)


_TOKEN = re.compile(C.WORD, re.ASCII)
_ING = re.compile(r"(?<=.)(.)\1ing$|ing$")
_STOP = frozenset(C.STOPWORDS)
#: Spellings, and terms with their counts, a task keeps before it begins anew.
KEPT = 500_000


def term_of(token: str) -> str | None:
    """What ``text.transform_terms`` makes of one token; None if it leaves it out."""
    t = token.lower()
    t = t[:-2] if len(t) > 3 and t.endswith("'s") else t[:-1] if len(t) > 3 and t.endswith("s'") else t.rstrip("'")
    n = len(t)
    if n <= 2 or t in _STOP:
        return None
    if not "a" <= t[0] <= "z":
        return t
    if n > 4 and t.endswith("ies"):
        return t[:-3] + "y"
    if n > 4 and t.endswith("sses"):
        t = t[:-2]
    elif n > 5 and t.endswith("ing"):
        t = _ING.sub(lambda m: m[1] or "", t)
    elif n > 4 and t.endswith("ed"):
        t = t[:-2]
    elif n > 3 and t.endswith("s") and not t.endswith(("ss", "us", "is")):
        t = t[:-1]
    return t[:-1] if len(t) > 3 and t.endswith("e") else t


class _Looked(dict):
    """Token as written -> what ``of`` makes of its term (None for tokens left out)."""

    def __init__(self, of) -> None:
        super().__init__()
        self._of = of

    def __missing__(self, token: str):
        if len(self) >= KEPT:
            self.clear()
        t = term_of(token)
        found = self[token] = None if t is None else self._of(t)
        return found


def _tokens(pdf: pd.DataFrame) -> Iterator[list[str]]:
    for section, text in zip(pdf["section"], pdf["text"]):
        yield _TOKEN.findall(f"{section or ''}\n{text or ''}")


def document_counts(passages: DataFrame) -> DataFrame:
    """(term, df): of each term the passages that hold it; tasks send their terms once, with counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        looked, counts = _Looked(lambda t: t), Counter()
        for pdf in batches:
            for tokens in _tokens(pdf):
                counts.update(set(map(looked.__getitem__, tokens)))
            if len(counts) > KEPT:
                counts.pop(None, None)
                yield pd.DataFrame({"term": list(counts), "df": list(counts.values())})
                counts = Counter()
        counts.pop(None, None)
        yield pd.DataFrame({"term": list(counts), "df": list(counts.values())}).astype({"term": "object", "df": "int64"})

    return passages.select("section", "text").mapInPandas(run, "term string, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


class _Encoder:
    """Unit vectors of passages, those of ``encode``: the entries of a batch at once. A passage's entries
    are never parted, so its vector doesn't depend on the passages beside it."""

    def __init__(self, model: Model) -> None:
        self._idf, self._project = model.idf, model.project.astype(np.float64)
        terms = model.terms
        self._looked = _Looked(lambda t: terms.get(t))

    def __call__(self, pdf: pd.DataFrame, entries: int = 1000) -> np.ndarray:
        m, looked, flat, sizes = max(1, len(self._idf)), self._looked, array("q"), []
        for tokens in _tokens(pdf):
            known = [t for t in map(looked.__getitem__, tokens) if t is not None]
            flat.extend(known)
            sizes.append(len(known))
        out = np.zeros((len(pdf), self._project.shape[1]))
        if flat:
            key = np.sort(np.repeat(np.arange(len(pdf)) * m, sizes) + np.frombuffer(flat, dtype=np.int64))
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            r, c = np.divmod(key[first], m)
            v = (1 + np.log(np.diff(np.append(first, len(key))))) * self._idf[c]
            rows, begin = np.unique(r, return_index=True)
            end = np.append(begin[1:], len(r))
            v /= np.repeat(np.sqrt(np.add.reduceat(v * v, begin)), end - begin)
            i = 0
            while i < len(rows):
                j = max(i + 1, int(np.searchsorted(end, begin[i] + entries, "right")))
                part = slice(begin[i], end[j - 1])
                out[rows[i:j]] = np.add.reduceat(self._project[c[part]] * v[part, None], begin[i:j] - begin[i], axis=0)
                i = j
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)


#: Leading dimensions that bound a cosine, and the cosine from which that is worth it.
HEAD, NEAR = 64, 0.9


def _bounding(x: np.ndarray) -> np.ndarray:
    """Vectors whose inner products are no less than those of ``x``: the leading coordinates, and the norm of the others."""
    return np.concatenate([x[:, :HEAD], np.linalg.norm(x[:, HEAD:], axis=1, keepdims=True)], axis=1)


class _Best:
    """Of each query its k best (score, id) so far, by falling score, then id, itself excepted."""

    #: More than single precision, and rounding after it, can err on the inner product of unit vectors of up to some hundred dimensions.
    ERR = 4e-5

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.ids, self.single, self.k = ids, vectors.astype(np.float32), k
        self.exact = vectors.astype(np.float64)
        self.exact /= np.maximum(np.linalg.norm(self.exact, axis=1, keepdims=True), 1e-300)
        self.void = np.flatnonzero(~vectors.any(axis=1))  # alike to everything, with 0
        self.score, self.id = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        self.cut = np.full(len(ids), -np.inf, dtype=np.float32)
        self.cut[self.void] = np.inf
        self.bound = _bounding(self.single) if self.single.shape[1] > HEAD else None

    def meet(self, own: np.ndarray, x: np.ndarray, tile: int = 512) -> None:
        """Passages ``own`` with their vectors: single precision finds what may be among the best,
        double precision decides. Where a query's best are near already, the leading dimensions, with the
        norms of the others, bound the cosine from above and rule out nearly all passages."""
        order, seen, keep = np.argsort(own, kind="stable"), Counter(), []
        for j in order:  # of equal vectors only the first k + 1 ids can be among the best
            key = x[j].tobytes()
            seen[key] += 1
            if seen[key] <= self.k + 1:
                keep.append(j)
        least = own[order[: self.k + 1]]
        own, x = own[keep], x[keep]
        double = x.astype(np.float64)
        double /= np.maximum(np.linalg.norm(double, axis=1, keepdims=True), 1e-300)
        place = len(own) - min(len(own), self.k + 1)

        def weigh(r: np.ndarray, c: np.ndarray) -> None:
            self._add(r, own[c], np.round(np.einsum("ij,ij->i", self.exact[r], double[c]), 6))

        near = np.flatnonzero((self.cut >= NEAR) & np.isfinite(self.cut)) if self.bound is not None else np.empty(0, dtype=np.int64)
        if len(near):
            most = _bounding(x)
            for a in range(0, len(near), tile):
                at = near[a : a + tile]
                cut = self.cut[at]
                hit = np.flatnonzero(self.bound[at] @ most.T >= cut[:, None])
                for i in range(0, len(hit), 20_000):
                    r, c = np.divmod(hit[i : i + 20_000], len(own))
                    may = np.einsum("ij,ij->i", self.single[at[r]], x[c]) >= cut[r]
                    weigh(at[r[may]], c[may])
        rest = np.setdiff1d(np.flatnonzero(self.cut < np.inf), near, assume_unique=True)
        for a in range(0, len(rest), tile):
            at = rest[a : a + tile]
            s, cut = self.single[at] @ x.T, self.cut[at]
            new = np.flatnonzero(np.isneginf(cut))
            if len(new):
                cut[new] = np.partition(s[new], place, axis=1)[:, place] - 2 * self.ERR
            hit = np.flatnonzero(s >= cut[:, None])
            for i in range(0, len(hit), 20_000):
                r, c = np.divmod(hit[i : i + 20_000], len(own))
                weigh(at[r], c)
        if len(self.void):
            self._add(np.repeat(self.void, len(least)), np.tile(least, len(self.void)), np.zeros(len(self.void) * len(least)))

    def _add(self, r: np.ndarray, i: np.ndarray, s: np.ndarray) -> None:
        better = (self.ids[r] != i) & (s >= self.score[r, -1])
        r, i, s = r[better], i[better], s[better]
        if not len(r):
            return
        q = np.unique(r)
        r = np.concatenate([np.repeat(q, self.k), r])
        i, s = np.concatenate([self.id[q].ravel(), i]), np.concatenate([self.score[q].ravel(), s])
        order = np.lexsort((i, -s, r))
        r = r[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        first = place < self.k
        self.score[r[first], place[first]], self.id[r[first], place[first]] = s[order][first], i[order][first]
        self.cut[q] = self.score[q, -1] - self.ERR
        self.cut[self.void] = np.inf

    def rows(self) -> pd.DataFrame:
        q, place = np.nonzero(np.isfinite(self.score))
        return pd.DataFrame({"query_id": self.ids[q], "vec_id": self.id[q, place], "score": self.score[q, place]})


def neighbours(passages: DataFrame, model: Model, every: int = 50, k: int = 3, block: int = 50_000) -> DataFrame:
    """(query_id, vec_id, score, rank): the k passages nearest by cosine to each passage whose hashed id
    ``every`` divides, itself excepted. Ids are hashes of chunk_id. Passages are encoded where they are compared,
    so no vectors but the queries' are written; the queries go to the tasks in blocks of ``block``,
    and a task sends on k rows a query."""
    sc, width = passages.sparkSession.sparkContext, model.project.shape[1]
    held = sc.broadcast(model)
    rows = passages.select(F.xxhash64("chunk_id").alias("vec_id"), "section", "text")

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _Encoder(held.value)
        for pdf in batches:
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "vector": [x.tobytes() for x in encode(pdf)]})

    asked = materialise(rows.where(F.pmod("vec_id", F.lit(every)) == 0).mapInPandas(encoded, "vec_id bigint, vector binary"), "asked")

    def against(part: list[tuple[int, bytes]]) -> DataFrame:
        ids = np.array([i for i, _ in part], dtype=np.int64)
        shared = sc.broadcast((ids, np.frombuffer(b"".join(v for _, v in part), dtype=np.float32).reshape(len(ids), width)))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            encode, best = _Encoder(held.value), _Best(*shared.value, k)
            for whole in batches:
                for at in range(0, len(whole), 4096):
                    pdf = whole.iloc[at : at + 4096]
                    best.meet(pdf["vec_id"].to_numpy(), encode(pdf))
            yield best.rows()

        return rows.mapInPandas(run, "query_id bigint, vec_id bigint, score double")

    found: DataFrame | None = None
    pending: list[tuple[int, bytes]] = []
    for r in asked.toLocalIterator():
        pending.append((r["vec_id"], bytes(r["vector"])))
        if len(pending) == block:
            found = against(pending) if found is None else found.unionByName(against(pending))
            pending = []
    if pending or found is None:
        found = against(pending) if found is None else found.unionByName(against(pending))
    return top(found, "query_id", [F.desc("score"), F.asc("vec_id")], k)
