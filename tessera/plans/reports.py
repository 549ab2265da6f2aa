"""Queries of the register, versions, reports and the request queue, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import queue as Q
from tessera.operators import register as G
from tessera.operators import retrieval
from tessera.plans import retrieval as R
from tessera.plans import sql as D
from tessera.sources.tables import table

AS_OF = R.AS_OF
INGEST_AS_OF = "2023-12-31"


def _as_of():
    return F.lit(AS_OF).cast("date")


def _docs(s, d):
    return table(s, d, "documents")


def register_problems(s, d):
    return G.invalid(table(s, d, "sources"))


def ingest_actions(s, d):
    """What a run at ``INGEST_AS_OF`` would do: a source's latest document is what was fetched now, its
    first one what the store holds."""
    docs = _docs(s, d).where("source is not null").select("source", F.struct("fetched_at", "doc_id").alias("o"), F.struct(F.sha2("text", 256).alias("sha"), F.length("text").alias("chars")).alias("c"))
    ends = docs.groupBy(F.col("source").alias("source_id")).agg(F.max_by("c", "o").alias("now"), F.min_by("c", "o").alias("then"))
    reg = R._sources(s, d).select("source_id", "mirrored", "refresh_days").join(ends.select("source_id", F.col("now.sha").alias("sha256"), F.coalesce("now.chars", F.lit(0)).alias("chars")), "source_id", "left")
    state = R._sources(s, d).select("source_id", "retrieved_at").join(ends.select("source_id", F.col("then.sha").alias("sha256")), "source_id", "left")
    return G.ingest_actions(reg, state, F.lit(INGEST_AS_OF).cast("date"))


def retire_sources(s, d):
    """Sources that documents name and the register does not hold, with their documents."""
    docs = _docs(s, d).where("source is not null")
    return docs.join(table(s, d, "sources").select(F.col("source_id").alias("source")).distinct(), "source", "left_anti").groupBy("source").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"))


def cascade_counts(s, d):
    """Documents and sections left when the failed sources go."""
    gone = R._sources(s, d).where("status = 'failed'").select("source_id")
    docs, chunks = G.cascade(gone, _docs(s, d), table(s, d, "chunks").distinct())
    return G.counts(documents=docs, chunks=chunks)


def latest_sources(s, d):
    return R._sources(s, d).select("source_id", "uri", "title", "publisher", "authority", "status")


def challenge_upsert(s, d):
    """The register of challenges after all submissions: one per area and question, the last wins."""
    sub = table(s, d, "submissions").distinct().select("knowledge_area", "question", "submission_id", "status", "created_at")
    old = sub.where("status = 'open'")
    order = F.struct("created_at", "submission_id")
    one = G.upsert(sub.limit(0), old, ["knowledge_area", "question"], order)
    new = sub.where("status != 'open'")
    return G.upsert(one, new, ["knowledge_area", "question"], order).select("knowledge_area", "question", "submission_id", "status")


def challenge_stats(s, d):
    return G.challenge_stats(table(s, d, "submissions").distinct())


def challenge_graders(s, d):
    sub = table(s, d, "submissions").select("submission_id", "expected", "problem").distinct()
    return sub.select("submission_id", G.grader_choice(F.col("expected"), F.col("problem")).alias("graders"))


def corpus_hash(s, d):
    return G.corpus_hash(_docs(s, d))


def content_addresses(s, d):
    """Copies: contents held by several documents."""
    each = _docs(s, d).where("text is not null").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return each.groupBy("sha256").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc")).where("documents > 1")


def version_order(s, d):
    """The latest result of every question by time, ties by id."""
    r = table(s, d, "eval_results").select("question_id", "result_id", "run_id", "finished_at").distinct()
    return G.latest(r, "question_id", [F.desc("finished_at"), F.desc("result_id")]).select("question_id", "result_id", "run_id")


def publish_gate(s, d):
    """Newly failing questions of every run against the first."""
    r = table(s, d, "eval_results").select("run_id", "question_id", "passed", "finished_at").distinct()
    first = r.groupBy("run_id").agg(F.min("finished_at").alias("t")).agg(F.min_by("run_id", F.struct("t", "run_id")).alias("run_id"))
    base, rest = (r.join(F.broadcast(first), "run_id", how) for how in ("left_semi", "left_anti"))  # first: one row
    return G.newly_failing(base, rest, ("run_id", "question_id")).groupBy("run_id").agg(F.count("*").alias("newly_failing"))


def source_register(s, d):
    return G.source_register(R._sources(s, d), table(s, d, "chunks").distinct())


def coverage_report(s, d):
    return G.coverage_report(R._sources(s, d))


def freshness_days(s, d):
    return G.freshness(R._sources(s, d), _as_of())


def transcript(s, d):
    return G.transcript(table(s, d, "eval_results").dropDuplicates(["result_id"]))


def source_detail(s, d):
    """Sections of each source in order: number, characters, first and last section. A null end is
    the text's end; a section whose end is unknown, as its document is missing, counts without characters."""
    c = table(s, d, "chunks").where("source_id is not null").distinct()
    c = c.join(_docs(s, d).select(F.col("doc_id").alias("document_id"), F.length("text").alias("text_end")), "document_id", "left")
    o, end = F.struct("document_id", "ordinal", "chunk_id"), F.coalesce("char_end", "text_end")
    return c.groupBy("source_id").agg(F.count("*").alias("sections"), F.sum(end - F.col("char_start")).alias("chars"), F.min_by("chunk_id", o).alias("first"), F.max_by("chunk_id", o).alias("last"))


def table_counts(s, d):
    names = ("documents", "chunks", "sources", "questions", "eval_results", "llm_responses", "submissions")
    return G.counts(**{n: table(s, d, n) for n in names})


def visibility(s, d):
    """Sources a reader may see: licensed openly or mirrored, by publisher."""
    src = R._sources(s, d)
    return src.groupBy("publisher").agg(F.count("*").alias("sources"), F.count(F.when(F.col("mirrored"), 1)).alias("visible"), F.bool_and("mirrored").alias("all_visible"))


def _requests(s, d):
    q = table(s, d, "questions")
    prompt = F.concat(F.lit("Answer from the passages only.\n\n"), "question")
    return Q.requests(q.select("question_id", "question", prompt.alias("prompt")), "area")


def _responses(s, d):
    """Stored replies taken as answers to the requests; older ones answered another prompt."""
    r = table(s, d, "llm_responses").dropDuplicates(["response_id"]).join(_requests(s, d).select("question_id", F.col("request_id").alias("rid"), F.col("prompt_sha").alias("sha")), "question_id")
    sha = F.when(F.col("created_at") >= F.lit("2024-06-01").cast("timestamp_ntz"), F.col("sha")).otherwise("old")
    return r.select(F.col("rid").alias("request_id"), sha.alias("prompt_sha"), "text", "provider", "error", "created_at")


def queue_pending(s, d):
    return Q.pending(_requests(s, d), _responses(s, d)).select("request_id", "question_id")


def queue_stale(s, d):
    return Q.stale(_requests(s, d), _responses(s, d))


def queue_apply(s, d):
    return Q.apply(_requests(s, d), _responses(s, d)).select("request_id", "question_id", F.md5("text").alias("digest"), "provider")


def queue_status(s, d):
    return Q.status(_requests(s, d), _responses(s, d))


_SRC = R.SOURCES
_REQ = "req as (select 'req_' || left(sha256('area:' || question), 20) request_id, question_id, sha256('Answer from the passages only.' || chr(10) || chr(10) || question) prompt_sha from questions)"
_RESP = f"""{_REQ}, resp as (select req.request_id, case when created_at >= timestamp '2024-06-01' then prompt_sha else 'old' end prompt_sha, text, provider, error, created_at
  from (select distinct on (response_id) * from llm_responses) l join req using (question_id))"""
_DONE = "done as (select distinct request_id, prompt_sha from resp where error is null and text is not null)"
_STALE = "stale as (select distinct request_id from resp x where not exists (select 1 from req where req.request_id = x.request_id and req.prompt_sha = x.prompt_sha))"
_TYPES = ", ".join(D.q(t) for t in G.SOURCE_TYPES)

SQL = {
    "register_problems": f"""select distinct source_id, problem from (select source_id, unnest([case when source_id is null or uri is null or title is null or publisher is null or licence is null then 'missing field' end,
        case when not coalesce(source_type in ({_TYPES}), false) then 'unknown type' end, case when not coalesce(authority between 1 and 5, false) then 'authority outside 1 to 5' end]) problem from sources
      union all select source_id, 'registered twice' from sources group by 1 having count(*) > 1) where problem is not null""",
    "ingest_actions": f"""with {_SRC}, x as (select source, {{'s': sha256(text), 'n': length(text)}} c, (fetched_at, doc_id) o from documents where source is not null), e as (select source, max_by(c, o) a, min_by(c, o) b from x group by 1)
      select h.source_id, case when not mirrored then 'pointer' when retrieved_at is not null and date_diff('day', retrieved_at::date, date '{INGEST_AS_OF}') < refresh_days then 'fresh' when a.s is null then 'failed'
        when a.s = b.s then 'unchanged' when a.n < 200 then 'failed' else 'index' end as action from held h left join e on e.source = h.source_id""",
    "retire_sources": "select source, count(*) documents, min(doc_id) first_doc from documents where source is not null and source not in (select source_id from sources where source_id is not null) group by 1",
    "cascade_counts": f"""with {_SRC}, d as (select doc_id from documents where source is null or source not in (select source_id from held where status = 'failed'))
      select 'documents' as name, count(*) n from d union all select 'chunks', count(*) from (select distinct * from chunks) where document_id in (select doc_id from d)""",
    "latest_sources": f"with {_SRC} select source_id, uri, title, publisher, authority, status from held",
    "challenge_upsert": """with s as (select distinct knowledge_area, question, submission_id, status, created_at from submissions),
      o as (select max_by(s, (created_at, submission_id)) r from s where status = 'open' group by knowledge_area, question), n as (select max_by(s, (created_at, submission_id)) r from s where status <> 'open' group by knowledge_area, question),
      u as (select r from n union all select o.r from o where not exists (select 1 from n where n.r.knowledge_area = o.r.knowledge_area and n.r.question = o.r.question))
      select r.knowledge_area, r.question, r.submission_id, r.status from u""",
    "challenge_stats": "select case when grouping(status) = 1 then 'total' else status end status, count(*) n from (select distinct * from submissions) group by rollup (status)",
    "challenge_graders": f"""with t as (select distinct submission_id, expected, problem from submissions), u as (select *, lower(concat_ws(' ', expected, problem)) x from t)
      select submission_id, case when coalesce(length(expected), 0) > 0 then case when {D.contains_any("x", ("should not answer", "should decline", "no evidence", "not knowable", "unanswerable", "out of scope"))} then 'must_abstain' else 'must_include' end
        when {D.contains_any("x", ("hallucinat", "made up", "fabricat", "invented"))} then 'max_unsupported' when {D.contains_any("x", ("wrong source", "citation", "cited"))} then 'citations_resolve' else 'citations_resolve,max_unsupported' end graders from u""",
    "corpus_hash": "with l0 as (select doc_id n, sha256(coalesce(text, '')) sha from documents)"
    + "".join(f", l{i + 1} as (select n // {G.FAN_IN} n, sha256(string_agg(n::varchar || sha, '' order by n)) sha from l{i} group by n // {G.FAN_IN})" for i in range(G.LEVELS))
    + f" select sha256(string_agg(n::varchar || sha, '' order by n)) corpus_sha from l{G.LEVELS}",
    "content_addresses": "select sha256(text) sha256, count(*) documents, min(doc_id) first_doc from documents where text is not null group by 1 having count(*) > 1",
    "version_order": "select question_id, result_id, run_id from (select *, row_number() over (partition by question_id order by finished_at desc, result_id desc) n from (select distinct question_id, result_id, run_id, finished_at from eval_results)) where n = 1",
    "publish_gate": """with r as (select distinct run_id, question_id, passed, finished_at from eval_results), f as (select min_by(run_id, (t, run_id)) run_id from (select run_id, min(finished_at) t from r group by 1)),
      b as (select distinct question_id from r where run_id = (select run_id from f) and passed)
      select run_id, count(distinct question_id) newly_failing from r where run_id <> (select run_id from f) and not passed and question_id in (select question_id from b) group by 1""",
    "source_register": f"with {_SRC}, n as (select source_id, count(*) n from (select distinct * from chunks) group by 1) select h.source_id, publisher, title, authority, coalesce(n, 0) chunks from held h left join n using (source_id)",
    "coverage_report": f"""with {_SRC} select facet, value, count(*) n from (select 'type' facet, source_type as value from held union all select 'authority', authority::varchar from held union all select 'status', status from held
      union all select 'tag', unnest(from_json(tags, '["VARCHAR"]')) from held) group by all""",
    "freshness_days": f"with {_SRC} select quantile_cont(date_diff('day', retrieved_at::date, date '{AS_OF}'), 0.5) median_days from held where retrieved_at is not null",
    "transcript": """with r as (select distinct on (result_id) * from eval_results) select run_id, count(*) total, count(*) filter (passed) passed, count(*) filter (not passed) failed,
      count(*) filter (json_extract_string(answer, '$.status') in ('insufficient_evidence', 'out_of_scope', 'ambiguous', 'unsupported')) abstained,
      array_to_string(list_sort(list(distinct json_extract_string(answer, '$.llm.provider')) filter (json_extract_string(answer, '$.llm.provider') is not null)), ',') providers from r group by 1""",
    "source_detail": """select source_id, count(*) sections, sum(coalesce(char_end, length(text)) - char_start)::bigint chars, min_by(chunk_id, (document_id, ordinal, chunk_id)) as first, max_by(chunk_id, (document_id, ordinal, chunk_id)) as last
      from (select distinct * from chunks) c left join documents d on d.doc_id = c.document_id where c.source_id is not null group by 1""",
    "table_counts": " union all ".join(f"select '{n}' as name, count(*) n from {n}" for n in ("documents", "chunks", "sources", "questions", "eval_results", "llm_responses", "submissions")),
    "visibility": f"with {_SRC} select publisher, count(*) sources, count(*) filter (mirrored) visible, bool_and(mirrored) all_visible from held group by 1",
    "queue_pending": f"with {_RESP}, {_DONE} select request_id, question_id from req where not exists (select 1 from done where done.request_id = req.request_id and done.prompt_sha = req.prompt_sha)",
    "queue_stale": f"with {_RESP}, {_STALE} select request_id from stale",
    "queue_apply": f"""with {_RESP} select r.request_id, question_id, md5(max_by(text, (created_at, text, provider))) digest, max_by(provider, (created_at, text, provider)) provider
      from req r join resp x on x.request_id = r.request_id and x.prompt_sha = r.prompt_sha where error is null and text is not null group by all""",
    "queue_status": f"""with {_RESP}, {_DONE}, {_STALE} select case when d.request_id is not null then 'answered' when s.request_id is not null then 'stale' else 'pending' end state, count(*) n
      from req r left join done d on d.request_id = r.request_id and d.prompt_sha = r.prompt_sha left join stale s on s.request_id = r.request_id group by 1""",
}
QUERIES = {f.__name__: f for f in (
    register_problems, ingest_actions, retire_sources, cascade_counts, latest_sources, challenge_upsert, challenge_stats, challenge_graders, corpus_hash, content_addresses, version_order, publish_gate,
    source_register, coverage_report, freshness_days, transcript, source_detail, table_counts, visibility, queue_pending, queue_stale, queue_apply, queue_status,
)}
