"""Queries of the text kernel, sections, claims and extraction, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import constants as C
from tessera.functions import text as T
from tessera.operators import extract, passages
from tessera.plans import sql as D
from tessera.sources.tables import table


def _docs(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", T.normalise("text").alias("text"))


def _passages(s, d):
    return passages.passages(table(s, d, "chunks"), table(s, d, "documents"))


def tokenize_stats(s, d):
    t = _docs(s, d).select("doc_id", T.tokenize("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.length(F.array_join("t", "")).cast("long").alias("n_letters"))


def stem_terms(s, d):
    t = _docs(s, d).select(F.explode(F.array_distinct(T.tokenize("text"))).alias("token")).distinct()
    return t.select("token", T.depossess(F.col("token")).alias("plain"), T.stem(T.depossess(F.col("token"))).alias("stem"))


def content_terms(s, d):
    return _docs(s, d).select(F.explode(T.content_terms("text")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def sentence_counts(s, d):
    return _docs(s, d).select("doc_id", T.sentence_parts("text").alias("p")).select("doc_id", F.size("p").cast("long").alias("n_parts"), F.length(F.array_join("p", "")).cast("long").alias("n_chars"))


def citation_fold(s, d):
    r = table(s, d, "llm_responses").where("text is not null").select("response_id", "text").distinct()
    return r.select("response_id", F.posexplode(T.sentences(T.normalise("text"))).alias("pos", "sentence")).select("response_id", F.col("pos").alias("sentence_no"), "sentence")


def numbers_units(s, d):
    return _docs(s, d).select(F.explode(T.numbers_with_units("text")).alias("number")).groupBy("number").agg(F.count("*").alias("docs"))


def quoted_spans(s, d):
    r = table(s, d, "llm_responses").where("text is not null").select("response_id", "text").distinct()
    return r.select("response_id", F.explode(T.quoted_spans("text")).alias("span"))


def coverage_pairs(s, d):
    r = table(s, d, "submissions").where("problem is not null and expected is not null").select("submission_id", "problem", "expected").distinct()
    r = r.select("submission_id", T.content_terms("expected").alias("a"), T.content_terms("problem").alias("b"))
    return r.select("submission_id", F.round(T.coverage(F.col("a"), F.col("b")), 6).alias("coverage"), F.round(T.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


def truncate_text(s, d):
    return _docs(s, d).select("doc_id", T.truncate("text", 240).alias("head"), T.token_estimate("text").alias("tokens"))


def section_split(s, d):
    return passages.sections(table(s, d, "documents").where("text is not null")).select("doc_id", F.col("section_no").cast("int").alias("section_no"), "section", F.col("lines").cast("int").alias("lines"))


def chunk_documents(s, d):
    return passages.chunk_documents(table(s, d, "documents"))


def claims_extract(s, d):
    return passages.claims(_passages(s, d))


def claims_by_kind(s, d):
    return claims_extract(s, d).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("chunk_id").alias("chunks"))


def passage_rows(s, d):
    return _passages(s, d).select("chunk_id", "doc_id", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


def register_fields(s, d):
    return _docs(s, d).select("doc_id", F.explode(T.field_pairs("text")).alias("p")).select("p.label", "p.value").groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("value").alias("distinct_values"))


def normalise_names(s, d):
    forms = ("institute", "board", "desk", "group", "laboratory", "bulletin", "review", "gmbh", "ltd", "inc")
    return table(s, d, "sources").where("publisher is not null").select("publisher", T.normalise_name("publisher", forms).alias("name")).distinct()


def sniff_content_type(s, d):
    docs = table(s, d, "documents").where("text is not null")
    return docs.groupBy("extractor", extract.sniff(F.col("text")).alias("sniffed")).agg(F.count("*").alias("n"))


def bibliography_cut(s, d):
    return _docs(s, d).select("doc_id", F.length(extract.drop_bibliography(F.col("text"))).cast("long").alias("kept"))


def drop_repeated_lines(s, d):
    return extract.drop_repeated_lines(_docs(s, d)).select("doc_id", F.md5("text").alias("digest"))


def title_line(s, d):
    return _docs(s, d).select("doc_id", extract.first_title(F.col("text")).alias("title"))


def json_flatten(s, d):
    r = table(s, d, "eval_results").where("answer is not null").select("result_id", "answer").distinct()
    return extract.json_leaves(r, "result_id", "answer")


def collect_contacts(s, d):
    return extract.contacts(table(s, d, "documents"))


def extract_documents(s, d):
    return extract.extract(table(s, d, "documents").select(F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("content_type"), F.encode("text", "UTF-8").alias("content")))


_DOCS = "select doc_id, " + D.normalise("text") + " as text from documents where text is not null"
PASSAGES = f"""
  select chunk_id, doc_id, source_id, ordinal, section, text from (
    select c.chunk_id, d.doc_id, c.source_id, c.ordinal, c.section,
      {D.normalise("substr(d.text, c.char_start + 1, coalesce(c.char_end, length(d.text)) - c.char_start)")} as text
    from (select distinct chunk_id, document_id, source_id, ordinal, coalesce(section, '') section, char_start, char_end from chunks) c
    join documents d on c.document_id = d.doc_id where d.text is not null) where text <> ''"""

_SENTENCES = f"""
 parts as (select id, unnest({D.sentence_parts("text")}) p, generate_subscripts({D.sentence_parts("text")}, 1) i from base),
 marked as (select id, i, p, trim(regexp_extract(p, '{C.LEADING_CITATIONS}', 1)) marks, trim(regexp_replace(p, '{C.LEADING_CITATIONS}', '')) rest from parts),
 flagged as (select id, i, case when i = 1 then p else rest end body, case when i = 1 then '' else marks end marks from marked),
 numbered as (select *, sum(case when body <> '' then 1 else 0 end) over (partition by id order by i) g from flagged),
 bodies as (select id, g, body from numbered where body <> ''),
 tails as (select id, case when body <> '' then g - 1 else g end g, string_agg(marks, ' ' order by i) tail from numbered where marks <> '' group by 1, 2),
 sentences as (select b.id, b.g - 1 as sentence_no, case when tail is null then body else body || ' ' || tail end sentence from bodies b left join tails t on b.id = t.id and b.g = t.g)"""

_KIND = f"""case when regexp_matches(sentence, {D.q(C.NOISE)}) then null when regexp_matches(sentence, {D.q(C.RANGE)}) then 'range'
  when regexp_matches(sentence, {D.q(C.REQUIREMENT)}) then 'requirement' when len({D.numbers_with_units("sentence")}) > 0 then 'fact'
  when regexp_matches(sentence, {D.q(C.DEFINITION)}) then 'definition' end"""
CLAIMS = f"""base as (select chunk_id id, text from ({PASSAGES})), {_SENTENCES},
 kinds as (select id chunk_id, sentence, {_KIND} kind from (select distinct id, sentence from sentences where length(sentence) between 40 and 500)),
 claims as (select distinct 'cl_' || left(sha256(chunk_id || ':' || sentence), 20) claim_id, chunk_id, kind, sentence as text from kinds where kind is not null)"""

_RESPONSES = "select distinct response_id id, text from llm_responses where text is not null"

SQL = {
    "tokenize_stats": f"select doc_id, len(t) n_tokens, len(list_distinct(t)) n_distinct, length(array_to_string(t, '')) n_letters from (select doc_id, {D.tokenize('text')} t from ({_DOCS}))",
    "stem_terms": f"select token, plain, {D.stem('plain')} stem from (select token, {D.depossess('token')} plain from (select distinct unnest({D.tokenize('text')}) token from ({_DOCS})))",
    "content_terms": f"select term, count(*) df from (select unnest({D.content_terms('text')}) term from ({_DOCS})) group by term",
    "sentence_counts": f"select doc_id, len(p) n_parts, length(array_to_string(p, '')) n_chars from (select doc_id, {D.sentence_parts('text')} p from ({_DOCS}))",
    "citation_fold": f"with base as (select id, {D.normalise('text')} as text from ({_RESPONSES})), {_SENTENCES} select id response_id, cast(sentence_no as integer) sentence_no, sentence from sentences",
    "numbers_units": f"select number, count(*) docs from (select unnest({D.numbers_with_units('text')}) number from ({_DOCS})) group by number",
    "quoted_spans": f"select id response_id, unnest(list_distinct(list_transform(regexp_extract_all(text, {D.q(C.QUOTED)}, 1), lambda x: lower(trim(x))))) span from ({_RESPONSES})",
    "coverage_pairs": f"""select submission_id, round({D.coverage('a', 'b')}, 6) coverage,
      round(case when len(a) = 0 or len(b) = 0 then 0.0 else len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) end, 6) jaccard
      from (select submission_id, {D.content_terms('expected')} a, {D.content_terms('problem')} b
        from (select distinct submission_id, problem, expected from submissions where problem is not null and expected is not null))""",
    "truncate_text": f"select doc_id, case when length(text) <= 240 then text else regexp_replace(left(text, 239), '\\s+$', '') || '…' end head, greatest(1, length(text) // 4)::integer tokens from ({_DOCS})",
    "section_split": f"""with lines as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) i from ({_DOCS})),
      heads as (select *, regexp_matches(trim(line), {D.q(C.HEADING)}) head from lines),
      marked as (select *, sum(head::int) over w section_no, coalesce(last_value(case when head then coalesce(nullif(regexp_extract(trim(line), '^#{{1,6}}\\s+(.+)$', 1), ''), trim(line)) end ignore nulls) over w, '') as section
        from heads window w as (partition by doc_id order by i))
      select doc_id, section_no::integer section_no, section, (count(*) filter (not head))::integer lines from marked group by doc_id, section_no, section
      having coalesce(sum(length(line)) filter (not head), 0) > 0""",
    "passage_rows": f"select chunk_id, doc_id, length(text) chars, md5(text) digest from ({PASSAGES})",
    "claims_extract": f"with {CLAIMS} select claim_id, chunk_id, kind, text from claims",
    "claims_by_kind": f"with {CLAIMS} select kind, count(*) n, count(distinct chunk_id) chunks from claims group by kind",
    "register_fields": f"""select trim(label) as label, count(*) n, count(distinct trim(value)) distinct_values from (select unnest(regexp_extract_all(text, '(?m)^([^:\\n]{{2,61}}): +(\\S[^\\n]*)$', 1)) as label,
        unnest(regexp_extract_all(text, '(?m)^([^:\\n]{{2,61}}): +(\\S[^\\n]*)$', 2)) as value from ({_DOCS})) where not contains(lower(label), 'http') group by 1""",
    "normalise_names": """select distinct publisher, array_to_string(list_filter(string_split(trim(regexp_replace(lower(publisher), '[^a-z0-9]+', ' ', 'g')), ' '),
        lambda w: w <> '' and w not in ('institute','board','desk','group','laboratory','bulletin','review','gmbh','ltd','inc')), ' ') as name from sources where publisher is not null""",
    "sniff_content_type": """select extractor, case when starts_with(text, '%PDF') then 'application/pdf' when regexp_matches(lower(left(text, 1024)), '<html|<!doctype html') then 'text/html'
        when regexp_matches(text, '^\\s*[{\\[]') then 'application/json' else 'text/plain' end sniffed, count(*) n from documents where text is not null group by all""",
    "bibliography_cut": f"""with hits as (select doc_id, text, regexp_extract_all(text, {D.q(C.BIBLIOGRAPHY)}) h, regexp_split_to_array(text, {D.q(C.BIBLIOGRAPHY)}) parts from ({_DOCS})),
        cuts as (select doc_id, length(text) n, list_min(list_filter(list_transform(range(1, len(h) + 1), lambda i: list_sum(list_transform(parts[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(h[1:i-1], lambda p: length(p))), 0)),
          lambda x: x >= 0.55 * length(text))) cut, text from hits)
        select doc_id, case when cut is null then n else length(regexp_replace(left(text, cut::bigint), '\\s+$', '')) end kept from cuts""",
    "drop_repeated_lines": f"""with lines as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) i from ({_DOCS})),
        counted as (select *, count(*) over (partition by doc_id, trim(line)) n from lines)
        select doc_id, md5(coalesce(string_agg(line, chr(10) order by i) filter (not (n > 2 and length(trim(line)) < 60 and trim(line) <> '' and trim(line)[1] <> '#')), '')) digest from counted group by doc_id""",
    "title_line": f"select doc_id, left(trim(regexp_replace(trim(regexp_extract(text, '[^\\n]*\\S[^\\n]*')), '^[#\\s]+', '')), 200) title from ({_DOCS})",
    "json_flatten": """with r as (select distinct result_id, answer from eval_results where answer is not null and json_valid(answer)),
        t as (select result_id, x.key k, x.value v, x.type ty from r, json_each(answer) x)
        select result_id, k as path, case when ty = 'DOUBLE' then regexp_replace(json_extract_string(v, '$'), '\\.0+$', '') else json_extract_string(v, '$') end as value from t where ty not in ('OBJECT', 'ARRAY', 'NULL')
        union all select result_id, t.k || '.' || y.key, json_extract_string(y.value, '$') from t, json_each(t.v) y where t.ty = 'OBJECT' and y.type not in ('OBJECT', 'ARRAY', 'NULL')""",
    "collect_contacts": r"""with d as (select doc_id, uri, text from documents where text is not null),
        e as (select doc_id, uri, unnest(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}'), lambda x: lower(x)))) email from d)
        select email, count(*) pages, min(doc_id) found_on from e where not regexp_matches(email, '\.(png|jpe?g|gif|svg|webp)$') group by email""",
}
QUERIES = {f.__name__: f for f in (
    tokenize_stats, stem_terms, content_terms, sentence_counts, citation_fold, numbers_units, quoted_spans, coverage_pairs, truncate_text, section_split, chunk_documents, passage_rows,
    claims_extract, claims_by_kind, register_fields, normalise_names, sniff_content_type, bibliography_cut, drop_repeated_lines, title_line, json_flatten, collect_contacts, extract_documents,
)}
