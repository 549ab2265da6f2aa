"""Queries of the ontology's edges, sparse vectors, versions, tenants and the store, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import constants as C
from tessera.operators import asking, ontology, passages, retrieval, store, vectors
from tessera.operators import queue as Q
from tessera.plans import reports as P
from tessera.plans import retrieval as R
from tessera.plans import sql as D
from tessera.plans.corpus import CLAIMS, PASSAGES
from tessera.sources import fetch
from tessera.sources.tables import table

TENANT = "Zellbach Standards Institute"
PASS_RATE = 0.7
SPLIT_AT = "2024-06-01"


def tfidf_search(s, d):
    rows = R._term_rows(s, d)
    return vectors.tfidf_search(R._questions(s, d), rows, retrieval.vocabulary(rows))


def _declared(s, d):
    """The ontology: publishers and tags, a tag of several words also under all but its first."""
    t = R._triples(s, d)
    none = F.array().cast("array<string>")
    pub = t.select(F.col("subject").alias("id")).distinct().select("id", F.col("id").alias("name"), F.lit("publisher").alias("kind"), none.alias("aliases"))
    short = F.regexp_replace("id", r"^\S+ ", "")
    tag = t.select(F.col("object").alias("id")).distinct().select("id", F.col("id").alias("name"), F.lit("topic").alias("kind"), F.when(short != F.col("id"), F.array(short)).otherwise(none).alias("aliases"))
    return ontology.load(pub.unionByName(tag), t)


def graph_aliases(s, d):
    """Entities that readers' questions name, by name or alias."""
    return retrieval.match_entities(R._asked(s, d), ontology.surfaces(_declared(s, d)[0]))


def graph_edges(s, d):
    """What these entities lead to, by step, predicate and direction."""
    e = ontology.expand_edges(graph_aliases(s, d), _declared(s, d)[1])
    return e.groupBy("text_id", "hop", "predicate", "direction").agg(F.count("*").alias("reached"), F.min("entity").alias("first"))


def ontology_edges(s, d):
    return ontology.edges(*_declared(s, d))


def ontology_dangling(s, d):
    """Documents as edges from their source to their language: ends nobody has declared."""
    docs = table(s, d, "documents").where("source is not null and lang is not null")
    rel = docs.select(F.col("source").alias("subject"), F.lit("writes in").alias("predicate"), F.col("lang").alias("object")).distinct()
    lang = s.createDataFrame([(x,) for x in ("en", "de", "fr", "es")], "id string")
    return ontology.dangling(R._sources(s, d).select(F.col("source_id").alias("id")).unionByName(lang), rel)


def tenant_visible(s, d):
    """Sources as areas: open ones are public, the others their publisher's own."""
    areas = R._sources(s, d).select("source_id", F.when(F.col("licence") == "open", "public").otherwise("private").alias("visibility"), F.col("publisher").alias("tenant"))
    seen = [store.visible(areas, t).select(F.lit(t or "nobody").alias("reader"), "source_id") for t in (None, TENANT)]
    return seen[0].unionByName(seen[1])


def _versions(s, d):
    """Runs as versions: one is published if enough of its questions pass."""
    r = table(s, d, "eval_results").select("run_id", "result_id", "passed", "finished_at").distinct()
    return r.groupBy(F.col("run_id").alias("version")).agg(F.when(F.avg(F.col("passed").cast("int")) >= PASS_RATE, "published").otherwise("draft").alias("status"), F.max("finished_at").alias("published_at"))


def version_history(s, d):
    return store.history(_versions(s, d))


def version_rollback(s, d):
    v = _versions(s, d)
    return store.rollback(v, store.history(v).first()["version"])[0]


def area_report(s, d):
    p = R._passages(s, d)
    results = table(s, d, "eval_results").dropDuplicates(["result_id"])
    return store.area_report(R._sources(s, d), table(s, d, "documents"), table(s, d, "chunks").distinct(), passages.claims(p), results, table(s, d, "submissions").distinct(), F.lit(R.AS_OF).cast("date"))


def chunks_by_type(s, d):
    return store.chunks_by_type(table(s, d, "chunks").distinct(), R._sources(s, d))


def source_claims(s, d):
    p = R._passages(s, d)
    return store.source_claims(passages.claims(p), p)


def pointer_sources(s, d):
    return store.pointers(R._sources(s, d))


def queue_served(s, d):
    """Answers from the queue, and for what it does not hold a note that says so."""
    req = P._requests(s, d)
    ask = lambda rest: rest.select("question_id", F.lit("No answer is held.").alias("text"), F.lit("local").alias("provider"))
    return store.served(req, Q.apply(req, P._responses(s, d)), ask).select("question_id", F.md5("text").alias("digest"), "provider")


def answer_sections(s, d):
    """Replies split into answer and reasoning, and whether they abstain in so many words."""
    r = table(s, d, "llm_responses").select("response_id", "text").distinct()
    part = asking.split_sections(F.col("text"))
    rows = r.select("response_id", part.alias("p"))
    return rows.select("response_id", F.md5("p.answer").alias("answer"), F.length("p.reasoning").alias("reasoning_chars"), asking.looks_abstained(F.col("p.answer")).alias("abstained"))


def fetch_kinds(s, d):
    """How the documents' uris would be fetched, and as what."""
    u = table(s, d, "documents").select(F.coalesce("uri", F.lit("")).alias("uri"))
    return u.groupBy(fetch.kind(F.col("uri"), F.lit(None).cast("string")).alias("kind"), fetch.content_type(F.col("uri")).alias("content_type")).agg(F.count("*").alias("n"))


def replaced_documents(s, d):
    """Documents and sections once each failed source is fetched anew and gives its latest document alone."""
    docs, chunks = table(s, d, "documents"), table(s, d, "chunks").distinct()
    failed = R._sources(s, d).where("status = 'failed'").select(F.col("source_id").alias("source"))
    last = docs.join(failed, "source", "left_semi").groupBy("source").agg(F.max(F.struct("fetched_at", "doc_id")).alias("m")).select("m.doc_id")
    new = docs.join(last, "doc_id", "left_semi")
    after = store.replace_documents(docs, chunks, new, chunks.join(last.withColumnRenamed("doc_id", "document_id"), "document_id", "left_semi"))
    return P.G.counts(documents=after[0], chunks=after[1])


def persisted_runs(s, d):
    """Results by run after the runs that ended late are written over what was stored before."""
    r = table(s, d, "eval_results").select("run_id", "result_id", "question_id", "passed", "finished_at").distinct()
    at = F.lit(SPLIT_AT).cast("timestamp_ntz")
    late = r.where(F.col("finished_at") >= at).select("run_id").distinct()
    new = r.join(late, "run_id", "left_semi").where("passed")
    return store.persist_runs(r.where(F.col("finished_at") < at), new).groupBy("run_id").agg(F.count("*").alias("results"))


_ENT = f"""{R.TAGS}, triples as (select distinct publisher subject, 'covers' predicate, tag object from tags where publisher is not null),
  topics as (select distinct object id, regexp_replace(object, '^\\S+ ', '') short from triples)"""
_ALIAS = f"""{_ENT}, matched as (select distinct text_id, entity from (select distinct question text_id from submissions where question is not null),
  (select id entity, unnest([id, short]) surface from topics union all select distinct subject, subject from triples) where len({D.tokenize("surface")}) > 0 and contains({R._PAD("text_id")}, {R._PAD("surface")}))"""
_VER = f"versions as (select run_id as version, case when avg(passed::integer) >= {PASS_RATE} then 'published' else 'draft' end status, max(finished_at) published_at from (select distinct run_id, result_id, passed, finished_at from eval_results) group by 1)"
_TRIM = lambda c: f"regexp_replace(regexp_replace({c}, '^\\s+', ''), '\\s+$', '')"

SQL = {
    "tfidf_search": f"""with passages as ({PASSAGES}), n as (select count(*) n from passages),
      df as (select term, count(*) df from (select unnest({D.content_terms("section || chr(10) || text")}) term from passages) group by 1),
      vocab as (select term, round(ln((1 + n) / (1 + df)) + 1, 6) idf from df, n where df >= 2 and df <= greatest(2, floor(0.6 * n)) order by df desc, term limit 30000),
      pv as (select chunk_id id, term, (1 + ln(count(*))) * any_value(idf) w from (select chunk_id, unnest({D.transform_terms("section || chr(10) || text")}) term from passages) join vocab using (term) group by all),
      qv as (select question_id id, term, (1 + ln(count(*))) * any_value(idf) w from (select question_id, unnest({D.transform_terms("question")}) term from questions where question is not null) join vocab using (term) group by all),
      pn as (select id, sqrt(sum(w * w)) n from pv group by 1), qn as (select id, sqrt(sum(w * w)) n from qv group by 1),
      sc as (select q.id question_id, p.id chunk_id, round(sum(q.w / qn.n * p.w / pn.n), 6) score from qv q join pv p using (term) join qn on qn.id = q.id join pn on pn.id = p.id group by all)
      select question_id, chunk_id, score, rank::integer rank from (select *, row_number() over (partition by question_id order by score desc, chunk_id) rank from sc where score > 0) where rank <= {C.CANDIDATE_K}""",
    "graph_aliases": f"with {_ALIAS} select text_id, entity from matched",
    "graph_edges": f"""with {_ALIAS}, both_ as (select subject a, object b, predicate, 'out' direction from triples union all select object, subject, predicate, 'in' from triples),
      one as (select m.text_id, b.b entity, min({{'p': predicate, 'd': direction}}) e from matched m join both_ b on m.entity = b.a anti join matched x on x.text_id = m.text_id and x.entity = b.b group by all),
      two as (select o.text_id, b.b entity, min({{'p': predicate, 'd': direction}}) e from one o join both_ b on o.entity = b.a anti join matched x on x.text_id = o.text_id and x.entity = b.b anti join one y on y.text_id = o.text_id and y.entity = b.b group by all)
      select text_id, hop, e.p predicate, e.d direction, count(*) reached, min(entity) as first from (select *, 1 hop from one union all select *, 2 from two) group by all""",
    "ontology_edges": f"with {_ENT} select subject, 'publisher' subject_kind, predicate, object, 'topic' object_kind from triples",
    "ontology_dangling": f"""with {R.SOURCES}, ids as (select source_id id from held union all select unnest(['en', 'de', 'fr', 'es'])), rel as (select distinct source subject, 'writes in' predicate, lang object from documents where source is not null and lang is not null)
      select distinct * from (select *, subject missing from rel where subject not in (select id from ids) union all select *, object from rel where object not in (select id from ids))""",
    "tenant_visible": f"with {R.SOURCES} select 'nobody' reader, source_id from held where licence = 'open' union all select {D.q(TENANT)}, source_id from held where licence = 'open' or publisher = {D.q(TENANT)}",
    "version_history": f"with {_VER} select * from versions where status = 'published'",
    "version_rollback": f"""with {_VER}, o as (select *, row_number() over (order by published_at desc, version desc) place from versions where status = 'published')
      select v.version, case when place = 1 then 'rolled_back' else v.status end status, v.published_at from versions v left join o on o.version = v.version""",
    "area_report": f"""with passages as ({PASSAGES}), {CLAIMS}, {R.SOURCES}, sub as (select distinct * from submissions),
      f as (select 'type' facet, source_type as value from held union all select 'authority', authority::varchar from held union all select 'status', status from held union all select 'tag', unnest(from_json(tags, '["VARCHAR"]')) from held)
      select 'corpus' part, 'documents' as name, count(*)::double as value from documents union all select 'corpus', 'chunks', count(*) from (select distinct * from chunks) union all select 'corpus', 'claims', count(*) from claims
      union all select 'corpus', 'sources', count(*) from held union all select 'corpus', 'indexed_sources', count(*) from held where status = 'indexed' union all select 'corpus', 'pointer_sources', count(*) from held where not mirrored
      union all select 'corpus', 'failed_sources', count(*) from held where status = 'failed' union all select 'corpus', 'freshness_days', quantile_cont(date_diff('day', retrieved_at::date, date '{R.AS_OF}'), 0.5) from held where retrieved_at is not null
      union all select 'coverage ' || facet, value, count(*) from f where value is not null group by all
      union all select 'pass rate', qtype, round(avg(passed::integer), 6) from (select distinct on (result_id) * from eval_results) group by 2
      union all select 'challenges', case when grouping(status) = 1 then 'total' else status end, count(*) from sub group by rollup (status) having grouping(status) = 1 or status is not null""",
    "chunks_by_type": f"with {R.SOURCES} select source_type, count(*)::bigint chunks from (select distinct * from chunks) c join held using (source_id) group by 1",
    "source_claims": f"""with passages as ({PASSAGES}), {CLAIMS} select source_id, claim_id, kind from (select *, row_number() over (partition by source_id order by claim_id, kind) n
      from (select distinct source_id, claim_id, kind from claims join passages using (chunk_id) where source_id is not null)) where n <= 200""",
    "pointer_sources": f"with {R.SOURCES} select source_id, title, publisher, licence, authority from held where not mirrored",
    "queue_served": f"""with {P._RESP}, a as (select r.request_id, question_id, max_by(text, (created_at, text, provider)) as text, max_by(provider, (created_at, text, provider)) provider
      from req r join resp x on x.request_id = r.request_id and x.prompt_sha = r.prompt_sha where error is null and text is not null group by all)
      select question_id, md5(text) digest, 'queue:' || coalesce(provider, 'unknown') provider from a union all select question_id, md5('No answer is held.'), 'local' from req where request_id not in (select request_id from a)""",
    "answer_sections": f"""with b as (select response_id, {_TRIM("translate(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), chr(160), ' ')")} as text from (select distinct response_id, text from llm_responses)),
      m as (select response_id, regexp_replace(text, '(?im)^[ \\t]*ANSWER[ \\t]*:?[ \\t]*$', chr(30)) as text from b),
      c as (select response_id, regexp_replace(case when contains(text, chr(30)) then split_part(text, chr(30), 2) else text end, '(?im)^[ \\t]*(?:REASONING|EXPLANATION)[ \\t]*:?[ \\t]*$', chr(30)) as text from m),
      p as (select response_id, {_TRIM("split_part(text, chr(30), 1)")} a, {_TRIM("split_part(text, chr(30), 2)")} r from c)
      select response_id, md5(a) answer, length(r)::integer reasoning_chars, {D.contains_any("lower(a)", asking.ABSTENTION)} abstained from p""",
    "fetch_kinds": f"""with u as (select coalesce(uri, '') uri from documents), k as (select lower(regexp_extract(uri, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) scheme, lower(regexp_extract(uri, '\\.([A-Za-z0-9]+)$', 1)) suffix from u)
      select case when scheme = 'inline' then 'inline' when scheme in ('http', 'https') then 'http' when scheme in ('file', '') then 'file' else 'unsupported' end kind,
        case suffix {" ".join(f"when {D.q(a)} then {D.q(b)}" for a, b in fetch.TYPES.items())} else 'text/plain' end content_type, count(*) n from k group by all""",
    "replaced_documents": f"""with {R.SOURCES}, failed as (select source_id from held where status = 'failed'), of as (select doc_id, source, fetched_at from documents where source in (select source_id from failed)),
      last as (select arg_max(doc_id, (fetched_at, doc_id)) doc_id from of group by source), gone as (select doc_id from of where doc_id not in (select doc_id from last))
      select 'documents' as name, count(*) n from documents where doc_id not in (select doc_id from gone) union all select 'chunks', count(*) from (select distinct * from chunks) where document_id not in (select doc_id from gone)""",
    "persisted_runs": f"""with r as (select distinct run_id, result_id, question_id, passed, finished_at from eval_results), late as (select distinct run_id from r where finished_at >= timestamp '{SPLIT_AT}')
      select run_id, count(*) results from r where case when run_id in (select run_id from late) then passed else finished_at < timestamp '{SPLIT_AT}' end group by 1""",
}
QUERIES = {f.__name__: f for f in (
    tfidf_search, graph_aliases, graph_edges, ontology_edges, ontology_dangling, tenant_visible, version_history, version_rollback, area_report, chunks_by_type, source_claims, pointer_sources, queue_served, answer_sections,
    fetch_kinds, replaced_documents, persisted_runs,
)}
