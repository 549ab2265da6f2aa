"""Queries of search, fusion and the ontology, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import constants as C
from tessera.functions import text as T
from tessera.operators import lsa, passages, retrieval
from tessera.plans import sql as D
from tessera.plans.corpus import PASSAGES
from tessera.session import materialise, once
from tessera.sources.tables import table

#: The date ages are counted to; a parameter, so that results do not depend on the day of the run.
AS_OF = "2026-01-01"
K1, B, SW, N = C.BM25_K1, C.BM25_B, C.SECTION_WEIGHT, C.CANDIDATE_K


def _passages(s, d):
    """Passages, written once for a state of the tables: every retriever and the evidence read them again."""
    chunks, docs = table(s, d, "chunks"), table(s, d, "documents")
    return once("passages", [chunks, docs], lambda: passages.passages(chunks, docs))


def _questions(s, d):
    return table(s, d, "questions").select("question_id", "question")


def _asked(s, d):
    """Questions readers sent in, once each: the texts that name subjects of the ontology."""
    return table(s, d, "submissions").where("question is not null").select(F.col("question").alias("text_id"), F.col("question").alias("text")).distinct()


def _sources(s, d):
    return retrieval.latest_sources(table(s, d, "sources").where("source_id is not null"))


def _tags(s, d):
    return _sources(s, d).select("publisher", F.explode(F.from_json("tags", "array<string>")).alias("tag"))


def _triples(s, d):
    return _tags(s, d).where("publisher is not null").select(F.col("publisher").alias("subject"), F.lit("covers").alias("predicate"), F.col("tag").alias("object")).distinct()


def bm25_postings(s, d):
    return retrieval.postings(_passages(s, d)).select("chunk_id", "term", F.round("tf", 6).alias("tf"))


def bm25_topk(s, d):
    return retrieval.bm25(_questions(s, d), _passages(s, d))


def semantic_topk(s, d):
    v = table(s, d, "embeddings")
    return retrieval.nearest(v, v.where("vec_id % 50 = 0")).withColumn("rank", F.col("rank").cast("long"))


def structured_intent(s, d):
    i = retrieval.intent(_questions(s, d))
    return i.select("question_id", F.array_join("source_types", ",").alias("source_types"), "after", "before", "prefer_recent")


def structured_search(s, d):
    return retrieval.structured(_questions(s, d), _passages(s, d), _sources(s, d))


def graph_match(s, d):
    return retrieval.match_entities(_asked(s, d), _tags(s, d).select(F.col("tag").alias("entity")).distinct())


def graph_expand(s, d):
    return retrieval.expand(graph_match(s, d), _triples(s, d)).groupBy("text_id", "hop").agg(F.count("*").alias("reached"), F.min("entity").alias("first"))


def ontology_join(s, d):
    t = _triples(s, d)
    return t.groupBy("object").agg(F.count("*").alias("publishers"), F.min("subject").alias("first"), F.max("subject").alias("last"))


def rrf_fuse(s, d):
    p = _passages(s, d)
    lists = {"keyword": retrieval.bm25(_questions(s, d), p), "structured": retrieval.structured(_questions(s, d), p, _sources(s, d))}
    return retrieval.fuse(lists).select("question_id", "chunk_id", F.round("fused", 9).alias("fused"), "retrievers")


def hybrid_evidence(s, d, p=None):
    p, src = p or _passages(s, d), _sources(s, d)
    lists = {"keyword": retrieval.bm25(_questions(s, d), p), "structured": retrieval.structured(_questions(s, d), p, src)}
    return retrieval.rerank(retrieval.fuse(lists), p, src, F.lit(AS_OF).cast("date"))


def _entities(s, d):
    """Names of the ontology: both ends of its triples, as in the reference, where each is an entity."""
    t = _triples(s, d)
    return t.select(F.col("subject").alias("entity")).union(t.select("object")).distinct()


def _term_rows(s, d, p=None):
    """The passages' terms, taken once for vocabulary, fit and search."""
    p = p or _passages(s, d)
    return once("terms", [table(s, d, "chunks"), table(s, d, "documents")], lambda: lsa.term_rows(p))


def _model(rows):
    return lsa.fit(rows, retrieval.vocabulary(rows))


def semantic_search(s, d, p=None):
    rows = _term_rows(s, d, p)
    return lsa.search(_questions(s, d), rows, _model(rows))


def graph_search(s, d, p=None):
    """Passages for what readers' questions lead to; the suite's own questions name no entity of this ontology."""
    asked = _asked(s, d).select(F.col("text_id").alias("question_id"), F.col("text").alias("question"))
    return retrieval.graph_search(asked, p or _passages(s, d), _entities(s, d), _triples(s, d))


def _lists(s, d, p):
    """The four ranked lists of every question. Keyword and graph search read the postings together."""
    q = _questions(s, d)
    asked = retrieval.graph_questions(q, _entities(s, d), _triples(s, d)).withColumn("list", F.lit("graph")).unionByName(q.withColumn("list", F.lit("keyword")))
    both = retrieval.bm25(asked.select(F.concat_ws(":", "list", "question_id").alias("question_id"), "question"), p)
    both = materialise(both.withColumn("list", F.substring_index("question_id", ":", 1)).withColumn("question_id", F.expr("substr(question_id, length(list) + 2)")), "lists")
    only = lambda name: both.where(F.col("list") == name).drop("list")
    return {"keyword": only("keyword"), "semantic": semantic_search(s, d, p), "structured": retrieval.structured(q, p, _sources(s, d)), "graph": only("graph")}


def four_list_fuse(s, d):
    return retrieval.fuse(_lists(s, d, _passages(s, d))).select("question_id", "chunk_id", F.round("fused", 9).alias("fused"), "retrievers")


def four_list_evidence(s, d, p=None):
    p = p or _passages(s, d)
    return retrieval.rerank(retrieval.fuse(_lists(s, d, p)), p, _sources(s, d), F.lit(AS_OF).cast("date"))


def recency_factor(s, d):
    return _sources(s, d).select("source_id", "published_at", F.round(T.recency("published_at", F.lit(AS_OF).cast("date")), 6).alias("recency"))


def tfidf_vocabulary(s, d):
    return retrieval.vocabulary(_passages(s, d))


def lsa_neighbours(s, d):
    p = _passages(s, d)
    vocabulary = retrieval.weighed(lsa.document_counts(p), p.agg(F.count("*").alias("n")))
    return lsa.neighbours(p, lsa.fit(p, vocabulary))


POSTINGS = f"""passages as ({PASSAGES}),
 postings as (select chunk_id, term, sum(w) tf from (select chunk_id, unnest({D.keyword_terms('text')}) term, 1.0::double w from passages
   union all select chunk_id, unnest({D.keyword_terms('section')}), {SW}::double from passages) group by all)"""
BM25 = f"""{POSTINGS},
 sizes as (select chunk_id, sum(tf) len from postings group by 1), stats as (select (select count(*) from passages) n, (select sum(len) from sizes) / (select count(*) from passages) avg_len),
 df as (select term, count(*) df from postings group by 1),
 asked as (select question_id, term, count(*) times from (select question_id, unnest({D.keyword_terms('question')}) term from questions) group by all),
 scored as (select question_id, chunk_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {K1 + 1} / (tf + {K1} * (1 - {B} + {B} * len / avg_len))), 6) score
   from asked join postings using (term) join df using (term) join sizes using (chunk_id), stats group by all),
 bm25 as (select * from (select *, row_number() over (partition by question_id order by score desc, chunk_id) rank from scored where score > 0) where rank <= {N})"""
_TYPES = "list_filter([" + ", ".join(f"case when {D.contains_any('lower(question)', w)} then {D.q(n)} end" for n, w in C.TYPE_CUES.items()) + "], lambda x: x is not null)"
INTENT = f"""intent as (select question_id, question, {_TYPES} source_types, nullif(regexp_extract(question, {D.q(C.SINCE)}, 2), '') || '-01-01' as after,
  nullif(regexp_extract(question, {D.q(C.BEFORE)}, 2), '') || '-01-01' as before, regexp_matches(question, {D.q(C.LATEST)}) prefer_recent from questions)"""
SOURCES = "held as (select s.* from (select source_id, max_by(s, (retrieved_at, uri, title)) s from sources s where source_id is not null group by source_id))"
STRUCTURED = f"""{INTENT}, {SOURCES},
 pool as (select question_id, question, p.chunk_id, p.text, h.authority, row_number() over (partition by question_id
     order by case when prefer_recent then coalesce(h.published_at, '') else h.authority::varchar end desc, p.chunk_id) r
   from intent i join held h on h.status = 'indexed' and (len(source_types) = 0 or list_contains(source_types, h.source_type))
     and (after is null or h.published_at >= after) and (before is null or h.published_at < before)
   join passages p on p.source_id = h.source_id where len(source_types) > 0 or after is not null or before is not null or prefer_recent),
 shares as (select question_id, chunk_id, authority, {D.coverage(D.content_terms('question'), f"list_filter(list_distinct({D.tokenize('text')}), lambda t: not list_contains({D.strings(C.STOPWORDS)}, t))")} overlap from pool where r <= {20 * N}),
 structured as (select * from (select question_id, chunk_id, round(overlap * (1 + 0.05 * (authority - 3)), 6) score,
   row_number() over (partition by question_id order by round(overlap * (1 + 0.05 * (authority - 3)), 6) desc, chunk_id) rank from shares where overlap > 0) where rank <= {N})"""
FUSED = f"""{BM25}, {STRUCTURED},
 fused as (select question_id, chunk_id, sum(part) fused, string_agg(retriever, ',' order by retriever) retrievers from (
   select question_id, chunk_id, {C.FUSION_WEIGHTS['keyword']}::double / ({C.FUSION_K} + rank) part, 'keyword' retriever from bm25
   union all select question_id, chunk_id, {C.FUSION_WEIGHTS['structured']}::double / ({C.FUSION_K} + rank), 'structured' from structured) group by all)"""
EVIDENCE = f"""{FUSED},
 evidence as (select * from (select question_id, row_number() over (partition by question_id order by score desc, chunk_id) rank, chunk_id, source_id, authority, retrievers, score from (
   select question_id, f.chunk_id, p.source_id, h.authority, retrievers,
     round(fused * (1 + {C.AUTHORITY_WEIGHT} * ((h.authority - 3) / 2.0)) * (1 + {C.AUTHORITY_WEIGHT} * ({D.recency('h.published_at', f"date '{AS_OF}'")} - 1.0)), 9) score
   from fused f join passages p using (chunk_id) join held h using (source_id))) where rank <= {C.TOP_K})"""
TAGS = f"{SOURCES}, tags as (select publisher, unnest(from_json(tags, '[\"VARCHAR\"]')) tag from held)"
_PAD = lambda c: f"' ' || array_to_string({D.tokenize(c)}, ' ') || ' '"
MATCH = f"""{TAGS}, matched as (select distinct text_id, entity from (select distinct question text_id from submissions where question is not null),
   (select distinct tag entity from tags where len({D.tokenize('tag')}) > 0) where contains({_PAD('text_id')}, {_PAD('entity')}))"""
_TRIPLES = "triples as (select distinct publisher subject, tag object from tags where publisher is not null)"

SQL = {
    "bm25_postings": f"with {POSTINGS} select chunk_id, term, round(tf, 6) tf from postings",
    "bm25_topk": f"with {BM25} select question_id, chunk_id, score, rank::integer rank from bm25",
    "semantic_topk": f"""select query_id, vec_id, score, rank from (select q.vec_id query_id, v.vec_id, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) score,
      row_number() over (partition by q.vec_id order by round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) desc, v.vec_id) rank
      from embeddings q join embeddings v on q.vec_id <> v.vec_id where q.vec_id % 50 = 0) where rank <= {C.TOP_K}""",
    "structured_intent": f"with {INTENT} select question_id, array_to_string(source_types, ',') source_types, after, before, prefer_recent from intent",
    "structured_search": f"with passages as ({PASSAGES}), {STRUCTURED} select question_id, chunk_id, score, rank::integer rank from structured",
    "graph_match": f"with {MATCH} select text_id, entity from matched",
    "graph_expand": f"""with {MATCH}, {_TRIPLES}, both_ as (select subject a, object b from triples union select object, subject from triples),
      one as (select distinct m.text_id, b.b entity from matched m join both_ b on m.entity = b.a anti join matched x on x.text_id = m.text_id and x.entity = b.b),
      two as (select distinct o.text_id, b.b entity from one o join both_ b on o.entity = b.a anti join matched x on x.text_id = o.text_id and x.entity = b.b anti join one y on y.text_id = o.text_id and y.entity = b.b)
      select text_id, hop, count(*) reached, min(entity) as first from (select *, 1 hop from one union all select *, 2 from two) group by all""",
    "graph_search": f"""with {POSTINGS}, sizes as (select chunk_id, sum(tf) len from postings group by 1), stats as (select (select count(*) from passages) n, (select sum(len) from sizes) / (select count(*) from passages) avg_len),
      df as (select term, count(*) df from postings group by 1), {TAGS}, {_TRIPLES}, ent as (select subject entity from triples union select object from triples),
      matched as (select distinct text_id, entity from (select distinct question text_id from submissions where question is not null), (select entity from ent where len({D.tokenize('entity')}) > 0) where contains({_PAD('text_id')}, {_PAD('entity')})),
      both_ as (select subject a, object b from triples union select object, subject from triples),
      one as (select distinct m.text_id, b.b entity from matched m join both_ b on m.entity = b.a anti join matched x on x.text_id = m.text_id and x.entity = b.b),
      two as (select distinct o.text_id, b.b entity from one o join both_ b on o.entity = b.a anti join matched x on x.text_id = o.text_id and x.entity = b.b anti join one y on y.text_id = o.text_id and y.entity = b.b),
      names as (select text_id, entity from (select *, row_number() over (partition by text_id order by hop, entity) n from (select *, 1 hop from one union all select *, 2 from two)) where n <= 20),
      asked as (select text_id question_id, term, count(*) times from (select text_id, unnest({D.keyword_terms('entity')}) term from names) group by all),
      scored as (select question_id, chunk_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {K1 + 1} / (tf + {K1} * (1 - {B} + {B} * len / avg_len))), 6) score
        from asked join postings using (term) join df using (term) join sizes using (chunk_id), stats group by all)
      select question_id, chunk_id, score, rank::integer rank from (select *, row_number() over (partition by question_id order by score desc, chunk_id) rank from scored where score > 0) where rank <= {N}""",
    "ontology_join": f"with {TAGS}, {_TRIPLES} select object, count(*) publishers, min(subject) as first, max(subject) as last from triples group by object",
    "rrf_fuse": f"with {FUSED} select question_id, chunk_id, round(fused, 9) fused, retrievers from fused",
    "hybrid_evidence": f"with {EVIDENCE} select question_id, rank::integer rank, chunk_id, source_id, authority, retrievers, score from evidence",
    "recency_factor": f"with {SOURCES} select source_id, published_at, round({D.recency('published_at', f'''date '{AS_OF}' ''')}, 6) recency from held",
    "tfidf_vocabulary": f"""with passages as ({PASSAGES}), n as (select count(*) n from passages),
      df as (select term, count(*) df from (select unnest({D.content_terms("section || chr(10) || text")}) term from passages) group by 1)
      select term, df, round(ln((1 + n) / (1 + df)) + 1, 6) idf from df, n where df >= 2 and df <= greatest(2, floor(0.6 * n)) order by df desc, term limit 30000""",
}
QUERIES = {f.__name__: f for f in (
    bm25_postings, bm25_topk, semantic_topk, structured_intent, structured_search, graph_match, graph_expand, ontology_join, rrf_fuse, hybrid_evidence, semantic_search, graph_search, four_list_fuse, four_list_evidence, recency_factor, tfidf_vocabulary, lsa_neighbours,
)}
