"""Ranking passages for many questions at once: keyword, vector, structured and graph search,
fusion and rerank. Per-question ranks use row_number with a total order, which Spark prunes to
the first k per question before the shuffle ends (window group limit)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions import constants as C
from tessera.functions import text as T
from tessera.session import materialise


def _exploded(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """One row per keyword term, with repetitions. The stop list is a hash set in generated code."""
    each = df.select(*keys, F.explode(F.regexp_extract_all(F.col(column), F.lit(C.WORD), F.lit(0))).alias("term")).withColumn("term", F.lower("term"))
    return each.where((F.length("term") > 1) & ~F.col("term").isin(list(C.STOPWORDS)))


def postings(passages: DataFrame) -> DataFrame:
    """(chunk_id, term, tf): body terms count 1, section terms ``SECTION_WEIGHT``."""
    body = _exploded(passages, ["chunk_id"], "text").withColumn("w", F.lit(1.0))
    head = _exploded(passages, ["chunk_id"], "section").withColumn("w", F.lit(C.SECTION_WEIGHT))
    return body.unionByName(head).groupBy("chunk_id", "term").agg(F.sum("w").alias("tf"))


def top(scored: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


#: Up to so many (question, term) rows the questions' terms are sent to every task.
BROADCAST_TERMS = 1_000_000


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` partitioned by ``key`` into the session's number of shuffle partitions: rows that are
    about to multiply must not be put together for being few bytes now."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _weighted_terms(passages: DataFrame, asked: list[str]) -> DataFrame:
    """(chunk_id, len, term, tf): of each passage its length and, as two arrays, the asked terms it holds
    with their counts (section terms count ``SECTION_WEIGHT``). Expressions over one row, no shuffle.
    Beyond ``INLINE_TERMS`` asked terms all terms are kept."""
    stop = list(C.STOPWORDS)

    def terms(c: str) -> Column:
        return F.filter(T.tokenize(c), lambda t: (F.length(t) > 1) & ~t.isin(stop))

    rows = passages.select("chunk_id", terms("text").alias("body"), terms("section").alias("head"))
    size = F.size("body") + C.SECTION_WEIGHT * F.size("head")
    held = (lambda c: F.filter(c, lambda t: t.isin(asked))) if len(asked) <= INLINE_TERMS else F.col
    rows = rows.select("chunk_id", size.alias("len"), held("body").alias("body"), held("head").alias("head"))
    rows = rows.withColumn("term", F.array_distinct(F.concat("body", "head")))
    times = lambda c, t: F.size(F.filter(c, lambda x: x == t))
    tf = F.transform("term", lambda t: times(F.col("body"), t) + C.SECTION_WEIGHT * times(F.col("head"), t))
    return rows.select("chunk_id", "len", "term", tf.alias("tf"))


#: Up to so many asked terms are a set in the passages' expression.
INLINE_TERMS = 50_000
#: Questions scored at once, which with ``_BATCH`` passages bounds a task's score matrix.
BLOCK, _BATCH = 1000, 4000


def _kept(frame: pd.DataFrame, k: int) -> pd.DataFrame:
    """The rows of each question that can still be among its k best once scores are rounded."""
    frame = frame.sort_values(["q", "score"], ascending=[True, False])
    nth = frame.groupby("q").cumcount()
    last = frame.loc[nth == k - 1].set_index("q")["score"]
    return frame[frame["score"] >= frame["q"].map(last).fillna(0.0) - 2e-6]


def bm25(questions: DataFrame, passages: DataFrame, k: int = C.CANDIDATE_K) -> DataFrame:
    """(question_id, chunk_id, score, rank): the k best passages by BM25; repeated question words
    count as often as they stand.

    The questions are the stated query set; they and their terms go to the tasks in blocks. Each
    passage is reduced to the asked terms it holds where it is read, and scored where these are read
    again: a task sums a block's scores over its passages in a matrix of bounded size and sends on
    some k rows a question. Nothing else is shuffled but term counts."""
    spark = questions.sparkSession
    asked = _exploded(questions, ["question_id"], "question").groupBy("question_id", "term").agg(F.count("*").alias("times")).orderBy("question_id", "term").collect()
    vocabulary = sorted({r["term"] for r in asked})
    rows = materialise(_weighted_terms(passages, vocabulary), "postings")
    df = {r["term"]: r["df"] for r in rows.select(F.explode("term").alias("term")).where(F.col("term").isin(vocabulary) if len(vocabulary) <= INLINE_TERMS else F.lit(True)).groupBy("term").agg(F.count("*").alias("df")).toLocalIterator()}
    n, total = rows.agg(F.count("*"), F.sum("len")).first()
    schema = "question_id string, chunk_id string, score double"
    if not n or not total:
        return top(spark.createDataFrame([], schema), "question_id", [F.desc("score"), F.asc("chunk_id")], k)
    number = {t: i for i, t in enumerate(t for t in vocabulary if t in df)}
    idf = np.array([np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) for t in number])
    ids = list(dict.fromkeys(r["question_id"] for r in asked))

    def against(block: list[str]) -> DataFrame:
        place = {q: i for i, q in enumerate(block)}
        of_term: dict[int, tuple[list[int], list[int]]] = {}
        for r in asked:
            if r["question_id"] in place and r["term"] in number:
                qs, ts = of_term.setdefault(number[r["term"]], ([], []))
                qs.append(place[r["question_id"]])
                ts.append(r["times"])
        shared = spark.sparkContext.broadcast((block, number, idf, {t: (np.array(q), np.array(x, dtype=np.float64)) for t, (q, x) in of_term.items()}))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            block, number, idf, of_term = shared.value
            best: pd.DataFrame | None = None
            for whole in batches:
                for at in range(0, len(whole), _BATCH):
                    pdf = whole.iloc[at : at + _BATCH]
                    sizes = pdf["term"].map(len).to_numpy()
                    if not sizes.sum():
                        continue
                    row = np.repeat(np.arange(len(pdf)), sizes)
                    term = np.fromiter((number.get(t, -1) for ts in pdf["term"] for t in ts), dtype=np.int64, count=int(sizes.sum()))
                    tf = np.concatenate(pdf["tf"].to_numpy())
                    norm = tf + C.BM25_K1 * (1 - C.BM25_B + C.BM25_B * pdf["len"].to_numpy()[row] * n / total)
                    weight = idf[term] * tf * (C.BM25_K1 + 1) / norm
                    order = np.argsort(term, kind="stable")
                    terms, begin = np.unique(term[order], return_index=True)
                    score = np.zeros((len(block), len(pdf)))
                    for t, i, j in zip(terms, begin, [*begin[1:], len(order)]):
                        if t >= 0 and t in of_term:
                            qs, times = of_term[t]
                            score[np.ix_(qs, row[order[i:j]])] += times[:, None] * weight[order[i:j]][None, :]
                    take = min(k, len(pdf))
                    cut = np.partition(score, -take, axis=1)[:, -take]
                    q, c = np.nonzero((score >= cut[:, None] - 2e-6) & (score > 0))
                    new = pd.DataFrame({"q": q, "chunk_id": pdf["chunk_id"].to_numpy()[c], "score": score[q, c]})
                    best = _kept(new if best is None else pd.concat([best, new]), k)
            if best is not None:
                yield pd.DataFrame({"question_id": np.array(block, dtype=object)[best["q"]], "chunk_id": best["chunk_id"], "score": best["score"]})

        return rows.select("chunk_id", "len", "term", "tf").mapInPandas(run, schema)

    found: DataFrame | None = None
    for at in range(0, len(ids), BLOCK):
        part = against(ids[at : at + BLOCK])
        found = part if found is None else found.unionByName(part)
    scored = (found if found is not None else spark.createDataFrame([], schema)).withColumn("score", F.round("score", 6))
    return top(scored.where("score > 0"), "question_id", [F.desc("score"), F.asc("chunk_id")], k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = C.TOP_K, block: int = 2000) -> DataFrame:
    """(query_id, vec_id, score, rank): the k nearest vectors of each query by cosine, the query
    itself excepted. The stated queries go to the tasks in blocks of ``block`` (their only bound);
    a task keeps k candidates a query, so what is shuffled does not grow with the vectors."""
    spark = vectors.sparkSession
    found: DataFrame | None = None
    pending: list[tuple[int, list[float]]] = []

    def against(part: list[tuple[int, list[float]]]) -> DataFrame:
        ids = np.array([i for i, _ in part], dtype=np.int64)
        q = np.array([v for _, v in part], dtype=np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best: pd.DataFrame | None = None
            for pdf in batches:
                if pdf.empty:
                    continue
                m = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
                m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
                s = np.round(q @ m.T, 6)
                own = pdf["vec_id"].to_numpy()
                take = min(s.shape[1], k + 8)
                at = np.argpartition(-s, take - 1, axis=1)[:, :take] if take < s.shape[1] else np.tile(np.arange(s.shape[1]), (len(ids), 1))
                cut = np.take_along_axis(s, at, 1).min(1)
                rows, cols = np.nonzero(s >= cut[:, None])  # ties of the last place stay
                new = pd.DataFrame({"query_id": ids[rows], "vec_id": own[cols], "score": s[rows, cols]})
                new = new[new["query_id"] != new["vec_id"]]
                best = new if best is None else pd.concat([best, new])
                best = best.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k)
            if best is not None:
                yield best

        return vectors.select("vec_id", "embedding").where("embedding is not null").mapInPandas(run, "query_id bigint, vec_id bigint, score double")

    for r in queries.select("vec_id", "embedding").where("embedding is not null").toLocalIterator():
        pending.append((r[0], r[1]))
        if len(pending) == block:
            found = against(pending) if found is None else found.unionByName(against(pending))
            pending = []
    if pending:
        found = against(pending) if found is None else found.unionByName(against(pending))
    if found is None:
        return spark.createDataFrame([], "query_id bigint, vec_id bigint, score double, rank int")
    return top(found, "query_id", [F.desc("score"), F.asc("vec_id")], k)


def intent(questions: DataFrame, cues: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(question_id, source_types, after, before, prefer_recent) read off each question's words."""
    q, low = F.col("question"), F.lower("question")
    types = F.array_compact(F.array(*[F.when(T.contains_any(low, words), F.lit(name)) for name, words in (cues or C.TYPE_CUES).items()]))
    year = lambda pattern: F.nullif(F.regexp_extract(q, pattern, 2), F.lit(""))
    return questions.select(
        "question_id", types.alias("source_types"), F.concat(year(C.SINCE), F.lit("-01-01")).alias("after"), F.concat(year(C.BEFORE), F.lit("-01-01")).alias("before"), q.rlike(C.LATEST).alias("prefer_recent")
    )


def structured(questions: DataFrame, passages: DataFrame, sources: DataFrame, k: int = C.CANDIDATE_K) -> DataFrame:
    """(question_id, chunk_id, score, rank): passages of sources that satisfy the question's filters,
    the first 20 k by date or authority, ranked by the share of question terms they hold.

    Questions with the same filters share one candidate list, so passages are ranked once for
    each filter, not for each question. Dates are compared as text; undated sources drop out."""
    wanted = intent(questions).where("size(source_types) > 0 or after is not null or before is not null or prefer_recent")
    filters = ["source_types", "after", "before", "prefer_recent"]
    plain = wanted.withColumn("filter", F.to_json(F.struct(*filters)))
    every = F.array(*[F.lit("*")])
    each = plain.select("filter", *filters).distinct().withColumn("wanted_type", F.explode(F.when(F.size("source_types") > 0, F.col("source_types")).otherwise(every)))
    held = sources.where("status = 'indexed'").select("source_id", "source_type", "authority", "published_at").dropDuplicates(["source_id"])
    held = held.withColumn("wanted_type", F.explode(F.array(F.col("source_type"), F.lit("*"))))
    ok = (F.col("after").isNull() | (F.col("published_at") >= F.col("after"))) & (F.col("before").isNull() | (F.col("published_at") < F.col("before")))
    sourced = each.join(held, "wanted_type").where(ok).select("filter", "prefer_recent", "source_id", "authority", "published_at")
    rows = passages.select("chunk_id", "source_id", "text").join(sourced, "source_id")
    first = F.when(F.col("prefer_recent"), F.coalesce("published_at", F.lit(""))).otherwise(F.col("authority").cast("string"))
    capped = top(rows, "filter", [F.desc(first), F.asc("chunk_id")], 20 * k).drop("rank")
    tokens = F.array_except(T.tokenize("text"), F.array(*[F.lit(w) for w in C.STOPWORDS]))
    capped = capped.select("filter", "chunk_id", "authority", tokens.alias("tokens"))
    terms = plain.join(questions.select("question_id", T.content_terms("question").alias("terms")), "question_id").select("question_id", "filter", "terms")
    overlap = T.coverage(F.col("terms"), F.col("tokens"))
    scored = terms.join(capped, "filter").select("question_id", "chunk_id", F.round(overlap * (1 + 0.05 * (F.col("authority") - 3)), 6).alias("score"), overlap.alias("overlap"))
    return top(scored.where("overlap > 0").drop("overlap"), "question_id", [F.desc("score"), F.asc("chunk_id")], k)


def match_entities(texts: DataFrame, entities: DataFrame) -> DataFrame:
    """(text_id, entity): entities whose name stands in a text as a run of tokens: all words of the name
    are met in the text, each at its place after the same beginning. entities: entity, and where it
    goes by other names ``surface``, a row for each."""
    t = texts.select("text_id", F.posexplode(T.tokenize("text")).alias("at", "token"))
    named = entities.select("entity", F.col("surface" if "surface" in entities.columns else "entity").alias("surface"))
    e = named.select("entity", T.tokenize("surface").alias("name"), "surface").where("size(name) > 0").withColumn("parts", F.size("name"))
    # a run is met word by word, so that no text travels with its words
    words = e.select("entity", "surface", "parts", F.posexplode("name").alias("place", "token"))
    met = t.join(words, "token").groupBy("text_id", "entity", "surface", "parts", (F.col("at") - F.col("place")).alias("begin")).agg(F.countDistinct("place").alias("met"))
    return met.where("met = parts").select("text_id", "entity").distinct()


def expand(start: DataFrame, triples: DataFrame, hops: int = 2) -> DataFrame:
    """(text_id, entity, hop): entities within ``hops`` undirected steps of the start, at their least
    distance; a step is a join of the frontier, and what was seen is taken out."""
    both = triples.select(F.col("subject").alias("a"), F.col("object").alias("b")).union(triples.select(F.col("object"), F.col("subject"))).distinct()
    seen = start.select("text_id", "entity").distinct()
    frontier, out = seen, None
    for hop in range(1, hops + 1):
        nxt = frontier.join(both, F.col("entity") == F.col("a")).select("text_id", F.col("b").alias("entity")).distinct()
        frontier = nxt.join(seen, ["text_id", "entity"], "left_anti")
        found = frontier.withColumn("hop", F.lit(hop))
        out = found if out is None else out.unionByName(found)
        seen = seen.unionByName(frontier)
    return out


def graph_questions(questions: DataFrame, entities: DataFrame, triples: DataFrame, hops: int = 2, first: int = 20) -> DataFrame:
    """(question_id, question): the names of the ``first`` entities each question's own lead to,
    nearest first, then by name."""
    texts = questions.where("question is not null").select(F.col("question_id").alias("text_id"), F.col("question").alias("text"))
    matched = materialise(match_entities(texts, entities), "matched")
    named = top(expand(matched, triples, hops), "text_id", [F.asc("hop"), F.asc("entity")], first)
    return named.groupBy(F.col("text_id").alias("question_id")).agg(F.array_join(F.collect_list("entity"), " ").alias("question"))


def graph_search(questions: DataFrame, passages: DataFrame, entities: DataFrame, triples: DataFrame, k: int = C.CANDIDATE_K, hops: int = 2, first: int = 20) -> DataFrame:
    """(question_id, chunk_id, score, rank): keyword search for what ``graph_questions`` gives; the
    question's own words are not searched for."""
    return bm25(graph_questions(questions, entities, triples, hops, first), passages, k)


def fuse(lists: dict[str, DataFrame], weights: dict[str, float] | None = None, k: int = C.FUSION_K) -> DataFrame:
    """(question_id, chunk_id, fused, retrievers): reciprocal rank fusion of ranked lists; a weight
    of zero or less drops its list."""
    weights = weights or C.FUSION_WEIGHTS
    parts = [
        d.select("question_id", "chunk_id", (F.lit(float(weights.get(n, 1.0))) / (k + F.col("rank"))).alias("part"), F.lit(n).alias("retriever"))
        for n, d in lists.items()
        if weights.get(n, 1.0) > 0
    ]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy("question_id", "chunk_id").agg(F.sum("part").alias("fused"), F.array_join(F.array_sort(F.collect_set("retriever")), ",").alias("retrievers"))


def rerank(fused: DataFrame, passages: DataFrame, sources: DataFrame, as_of: Column, k: int = C.TOP_K, weight: float = C.AUTHORITY_WEIGHT) -> DataFrame:
    """(question_id, rank, chunk_id, source_id, authority, retrievers, score): fused candidates with
    the provenance of their passage, weighed once by the source's authority and recency."""
    held = sources.select("source_id", "authority", "published_at").dropDuplicates(["source_id"])
    rows = fused.join(passages.select("chunk_id", "source_id"), "chunk_id").join(held, "source_id")
    factor = (1 + weight * ((F.col("authority") - 3) / 2.0)) * (1 + weight * (T.recency("published_at", as_of) - 1.0))
    rows = rows.withColumn("score", F.round(F.col("fused") * factor, 9))
    return top(rows, "question_id", [F.desc("score"), F.asc("chunk_id")], k).select("question_id", "rank", "chunk_id", "source_id", "authority", "retrievers", "score")


def latest_sources(sources: DataFrame) -> DataFrame:
    """One row per source_id: the latest registration (ties by uri and title)."""
    order = F.struct(F.col("retrieved_at"), F.col("uri"), F.col("title"))
    return sources.groupBy("source_id").agg(F.max_by(F.struct(*sources.columns), order).alias("s")).select("s.*")


def vocabulary(passages: DataFrame, share: float = 0.6, least: int = 2, cap: int = 30_000) -> DataFrame:
    """(term, df, idf) of the vector vocabulary: terms in at least ``least`` passages and at most
    ``share`` of them, the ``cap`` most frequent."""
    n = passages.agg(F.count("*").alias("n"))
    terms = F.array_distinct("t") if "t" in passages.columns else T.content_terms(F.concat_ws("\n", "section", "text"))
    df = passages.select("chunk_id", F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return weighed(df, n, share, least, cap)


def weighed(df: DataFrame, n: DataFrame, share: float = 0.6, least: int = 2, cap: int = 30_000) -> DataFrame:
    """The vocabulary of terms counted as ``df`` (term, df) over ``n`` (one row) passages."""
    rows = df.crossJoin(F.broadcast(n)).where((F.col("df") >= least) & (F.col("df") <= F.greatest(F.lit(least), F.floor(F.lit(share) * F.col("n")))))
    idf = F.round(F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1, 6)
    return rows.select("term", "df", idf.alias("idf")).orderBy(F.desc("df"), "term").limit(cap)
