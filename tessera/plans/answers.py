"""Queries of gates, grounding, drafting and verification, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import constants as C
from tessera.functions import text as T
from tessera.operators import answering, asking
from tessera.plans import retrieval as R
from tessera.plans import sql as D
from tessera.plans.corpus import _SENTENCES, PASSAGES
from tessera.session import materialise, once
from tessera.sources.tables import table

INSIDE = ("cell ageing and state of health", "gas detection and alarm thresholds", "hot work permits", "dust housekeeping")
OUTSIDE = ("resale price of a battery module", "water supply of a city", "job offers for welders", "solvent handling in a kitchen")


def _evidence(s, d, found=R.hybrid_evidence):
    """Evidence of every question with its text, written once for a state of the tables: every check
    reads it several times."""
    p = R._passages(s, d)
    inputs = [table(s, d, n) for n in ("chunks", "documents", "questions", "sources")]
    return once(found.__name__, inputs, lambda: found(s, d, p).join(p.select("chunk_id", "text"), "chunk_id"))


def _reader_questions(s, d):
    return table(s, d, "submissions").where("question is not null").select(F.col("question").alias("question_id"), "question").distinct()


def _answers(s, d):
    return table(s, d, "llm_responses").where("text is not null").select(F.col("response_id").alias("answer_id"), "question_id", "text").distinct()


def _claims(s, d):
    """Every sentence of the reference passages is a claim."""
    each = table(s, d, "questions").where("expected is not null").select("question_id", F.posexplode(T.sentences(T.normalise("expected"))).alias("no", "claim"))
    return each.select(F.concat_ws("#", "question_id", F.col("no").cast("string")).alias("claim_id"), "claim")


def gate_scope(s, d):
    g = answering.scope(_reader_questions(s, d), INSIDE, OUTSIDE)
    return g.select("question_id", F.round("in_score", 6).alias("in_score"), F.round("out_score", 6).alias("out_score"), "in_scope")


def gate_reproduction(s, d):
    """Questions of the suite asked for wording, against a register of pointer sources: a yearbook for
    each of forty years, which questions that name the year would have quoted."""
    year = F.col("id").cast("string")
    pointers = s.range(1985, 2025).select(F.concat(F.lit("yearbook-"), year).alias("source_id"), F.concat(F.lit("Yearbook "), year).alias("title"), (F.col("id") % 5 + 1).cast("int").alias("authority"), F.lit(False).alias("mirrored"))
    asked = table(s, d, "questions").select("question_id", F.concat(F.lit("Please quote: "), "question").alias("question"))
    return answering.reproduction(asked, R._sources(s, d).select("source_id", "title", "authority", "mirrored").unionByName(pointers))


def question_gates(s, d):
    return answering.gates(R._questions(s, d), _evidence(s, d))


def gate_responsive(s, d):
    return answering.responsive(_answers(s, d), R._questions(s, d), _evidence(s, d))


def grounding_sentences(s, d):
    return answering.ground(_answers(s, d), _evidence(s, d)).drop("eff")


def grounding_ratios(s, d):
    return answering.ratios(answering.ground(_answers(s, d), _evidence(s, d)))


def contradictions(s, d):
    return answering.contradictions(_evidence(s, d))


def extractive_scores(s, d):
    return answering.extractive_scores(R._questions(s, d), _evidence(s, d))


def extractive_answer(s, d):
    return answering.extractive_answers(extractive_scores(s, d))


def answer_confidence(s, d):
    ev = _evidence(s, d)
    a = _answers(s, d)
    g = materialise(answering.ground(a, ev), "grounded")
    return answering.confidence(g, a, ev, answering.contradictions(ev))


def verify_claims(s, d):
    return answering.verify(_claims(s, d), R._passages(s, d), R._sources(s, d))


def verify_support(s, d):
    """Which passage of which source supports a claim, and whether a sentence of it states the claim."""
    rows = answering.support(_claims(s, d), R._passages(s, d), R._sources(s, d))
    return rows.select("claim_id", "source_id", "own", "chunk_id", "support", F.col("stated").isNotNull().alias("states"))


_NUMS = D.numbers_with_units("lower(text)")
_EV = f"""{R.EVIDENCE}, ev as (select e.question_id, e.rank, e.source_id, e.authority, e.score, e.retrievers, p.text, {D.content_terms("p.text")} terms, {D.numbers_with_units("lower(p.text)")} numbers, lower(p.text) low, {D.numbers_with_units("p.text")} raw
  from evidence e join passages p using (chunk_id)), n_ev as (select question_id, count(*) n, max(score) top from ev group by 1)"""
_RARE = f"""terms_q as (select question_id, question, unnest({D.content_terms("question")}) term from questions),
  rare as (select t.question_id, t.term, ln(1.0 + greatest(1, coalesce(max(n), 0)) / (1.0 + count(ev.rank))) w, count(ev.rank) held from terms_q t left join n_ev using (question_id)
    left join ev on ev.question_id = t.question_id and list_contains(ev.terms, t.term) group by all)"""
_FRAME = D.strings(["accord", "sourc", "held"])
_RESP = "select distinct response_id id, question_id, text from llm_responses where text is not null"
_MAG = lambda x: f"regexp_replace({x}, '[a-z°%]+$', '')"
_META = f"""(regexp_matches(sentence, {D.q(C.META)}) or regexp_matches(sentence, {D.q(C.ANSWER_HEADING)}) or (len({D.numbers_with_units("bare0")}) = 0 and len(regexp_extract_all(bare0, {D.q(C.QUOTED)})) = 0
   and len(terms) >= 2 and len(list_filter(terms, lambda t: list_contains({D.strings(C.APPARATUS)}, t) or list_contains({D.strings(C.APPARATUS)}, t || 'e'))) / len(terms) >= 0.5))"""
def _ground_sql(answers: str) -> str:
    """The checks of grounding over ``answers``, a query of (id, question_id, text)."""
    return f"""with {_EV}, base as (select id, {D.normalise("text")} as text from ({answers})), {_SENTENCES},
  s0 as (select s.id, r.question_id, s.sentence_no, s.sentence, regexp_replace(s.sentence, {D.q(C.CITATION)}, ' ', 'g') bare0 from sentences s join ({answers}) r on r.id = s.id),
  s1 as (select *, {D.content_terms("bare0")} terms from s0),
  s2 as (select id, question_id, sentence_no, trim(bare0) bare, terms, len(terms) >= 3 is_claim, list_transform(regexp_extract_all(sentence, {D.q(C.CITATION)}, 1), lambda x: x::integer) cits from s1 where not {_META}),
  s3 as (select s2.*, coalesce(n, 0) n, last_value(case when is_claim and len(cits) > 0 then cits end ignore nulls) over (partition by id order by sentence_no rows between unbounded preceding and 1 preceding) carried
    from s2 left join n_ev using (question_id)),
  s4 as (select *, list_filter(cits, lambda c: c between 1 and n) own, list_filter(coalesce(carried, []), lambda c: c between 1 and n) had from s3),
  s5 as (select * exclude (own, had), case when len(own) > 0 then own else had end eff from s4),
  cited as (select s5.id, s5.sentence_no, list_distinct(flatten(list(ev.terms))) cterms, list_distinct(flatten(list(ev.numbers))) cnums, list(ev.low) lows
    from s5 join ev on ev.question_id = s5.question_id and (len(eff) = 0 or list_contains(eff, ev.rank)) group by all),
  s6 as (select s5.*, round({D.coverage("terms", "coalesce(cterms, [])")}, 6) support, coalesce(cnums, []) cnums, coalesce(lows, []) lows from s5 left join cited using (id, sentence_no)),
  s7 as (select *, case when not is_claim then null when len(eff) = 0 then case when support < {answering.MIN_SUPPORT} then 'no citation' else '' end
     when len(list_filter(list_transform(regexp_extract_all(bare, {D.q(C.QUOTED)}, 1), lambda x: lower(trim(x))), lambda x: len(list_filter(lows, lambda l: contains(l, x))) = 0)) > 0 then 'quotation'
     when len(list_filter({D.numbers_with_units("bare")}, lambda x: not list_contains(cnums, x) and not list_contains(list_transform(cnums, lambda y: {_MAG("y")}), {_MAG("x")}))) > 0 then 'figure'
     when support < {answering.MIN_SUPPORT} then 'support' else '' end reason from s6),
  grounded as (select id answer_id, sentence_no::integer sentence_no, len(cits)::integer n_citations, len(list_filter(cits, lambda c: c < 1 or c > n))::integer n_invalid, is_claim,
     case when is_claim then reason = '' end supported, case when is_claim then support end support, reason, list_distinct(eff) eff from s7),
  ratios as (select answer_id, count(*) filter (is_claim) claims, round(coalesce(avg(supported::integer), 1.0), 6) grounded_ratio,
     round(case when sum(n_citations) > 0 then 1 - sum(n_invalid) / sum(n_citations) else 1.0 end, 6) citation_validity from grounded group by 1)"""


_GROUND = _ground_sql(_RESP)
_UNIT = lambda x: f"regexp_extract({x}, '[a-z°%]+$')"
_CONFLICT = f"""pairs as (select a.question_id, a.rank rank_a, b.rank rank_b, a.raw na, b.raw nb from ev a join ev b on a.question_id = b.question_id and a.rank < b.rank and a.source_id <> b.source_id
    where {D.coverage("a.terms", "b.terms")} >= 0.5),
  conflicts as (select question_id, rank_a::integer rank_a, rank_b::integer rank_b, list_min(list_filter(list_intersect(list_transform(na, lambda x: {_UNIT("x")}), list_transform(nb, lambda x: {_UNIT("x")})),
    lambda u: u <> '' and len(list_intersect(list_filter(na, lambda x: {_UNIT("x")} = u), list_filter(nb, lambda x: {_UNIT("x")} = u))) = 0)) unit from pairs)"""
def _conf_sql(answers: str) -> str:
    """Confidence of ``answers``, after their grounding."""
    return f"""{_CONFLICT}, c as (select answer_id, unnest(eff) rank from grounded),
      c1 as (select distinct answer_id, rank from c union select r.id, ev.rank from ({answers}) r join ev using (question_id) where r.id not in (select answer_id from c)),
      per as (select c1.answer_id, avg(authority) authority, count(distinct source_id) sources, avg((length(retrievers) - length(replace(retrievers, ',', '')) + 1) / 4.0) agreement
        from c1 join ({answers}) r on r.id = c1.answer_id join ev on ev.question_id = r.question_id and ev.rank = c1.rank group by 1),
      odd as (select distinct question_id from conflicts where unit is not null),
      sc as (select r.answer_id, round(case when per.answer_id is null then 0.0 else 1.0 end * (0.35 * grounded_ratio + 0.25 * citation_validity + 0.20 * coalesce(authority / 5, 0) + 0.10 * coalesce(least(1.0, sources / 2), 0) + 0.10 * coalesce(least(1.0, agreement * 2), 0))
          * case when odd.question_id is not null then 0.75 else 1.0 end, 6) confidence_score from ratios r join ({answers}) q on q.id = r.answer_id left join per on per.answer_id = r.answer_id left join odd on odd.question_id = q.question_id)"""


_CONFIDENCE = "select answer_id, confidence_score, case when confidence_score = 0 then 'none' when confidence_score >= 0.75 then 'high' when confidence_score >= 0.55 then 'medium' else 'low' end confidence from sc"


def _resp_sql(answers: str) -> str:
    """How far ``answers`` take up their question, after the evidence."""
    return f"""{_RARE}, tot as (select question_id, sum(w) total from rare group by 1), a as (select id answer_id, question_id, {D.content_terms("text")} said from ({answers})),
      hit as (select a.answer_id, sum(w) w from a join rare on rare.question_id = a.question_id and list_contains(said, term) group by 1),
      r_of as (select a.answer_id, len(said) = 0 as idle, round(case when len(said) = 0 then 0.0 else coalesce(hit.w, 0) / total end, 6) addressed from a join tot using (question_id) left join hit using (answer_id)),
      resp as (select answer_id, addressed, idle or addressed >= {answering.MIN_QUESTION_COVERAGE} responsive from r_of)"""


_best = lambda topics: "greatest(0.0, " + ", ".join(D.coverage(D.content_terms(D.q(t)), "terms") for t in topics) + ")"
_PROSE = f"""(length(sentence) >= 40 and regexp_matches(sentence, '[.?!]$') and len(words) >= 7 and regexp_matches(sentence, '^[\\p{{Lu}}\\p{{Nd}}]') and not regexp_matches(sentence, {D.q(C.NOT_PROSE)})
   and not (len(alpha) > 0 and len(list_filter(alpha, lambda w: regexp_matches(w, '^\\p{{Lu}}'))) / len(alpha) > 0.6))"""
_VERIFY_PAD = lambda c: f"' ' || trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g')) || ' '"

_SUPPORT = f"""with passages as ({PASSAGES}), {R.SOURCES},
      base as (select question_id id, {D.normalise("expected")} as text from questions where expected is not null), {_SENTENCES}, c as (select id || '#' || sentence_no claim_id, sentence claim, {D.content_terms("sentence")} terms from sentences),
      h as (select chunk_id, unnest({D.content_terms("section || ' ' || text")}) term from passages),
      met as (select claim_id, len(terms) n, chunk_id, count(*) met from (select claim_id, terms, unnest(terms) term from c) join h using (term) group by all),
      sup as (select claim_id, chunk_id, round(met / n, 6) support from met where met / n >= case when n <= 3 then 1.0 else 0.6 end),
      r as (select s.claim_id, s.chunk_id, s.support, p.source_id, held.source_type in ('company_page') own, case when len(terms) <= 3 then len(list_filter(string_split(lower(p.text), chr(10)), lambda x: contains({_VERIFY_PAD("x")}, {_VERIFY_PAD("claim")}))) > 0
          else len(list_filter(string_split(regexp_replace(regexp_replace(p.text, '([.!?])\\s+|\\s+\\|\\s+', '\\1' || chr(10), 'g'), '\\n+', chr(10), 'g'), chr(10)), lambda x: {D.coverage("terms", D.content_terms("x"))} >= 0.6)) > 0 end states
        from sup s join passages p using (chunk_id) join held using (source_id) join c using (claim_id))"""

SQL = {
    "gate_scope": f"""select question_id, round(i, 6) in_score, round(o, 6) out_score, not (o >= 0.5 and o > i) in_scope from (select question_id, case when len(terms) > 0 then {_best(INSIDE)} else 0.0 end i, case when len(terms) > 0 then {_best(OUTSIDE)} else 0.0 end o
      from (select distinct question question_id, {D.content_terms("question")} terms from submissions where question is not null))""",
    "gate_reproduction": f"""with {R.SOURCES}, reg as (select source_id, title, authority, mirrored from held union all select 'yearbook-' || y, 'Yearbook ' || y, (y % 5 + 1)::integer, false from range(1985, 2025) t(y)),
      a as (select question_id, unnest({D.content_terms("'Please quote: ' || question")}) term from questions), h as (select source_id, authority, unnest({D.content_terms("title || ' ' || replace(source_id, '-', ' ')")}) term from reg where not mirrored)
      select question_id, min_by(source_id, (-authority, source_id)) refused_for from a join h using (term) where regexp_matches(term, '\\d') group by 1""",
    "question_gates": f"""with {_EV}, {_RARE}, q as (select question_id, {D.content_terms("question")} terms from questions),
      m as (select question_id, coalesce(sum(w) filter (held = 0) / nullif(sum(w), 0), 0.0) share, string_agg(term, ' ' order by term) filter (held = 0) missing from rare where not list_contains({_FRAME}, term) group by 1)
      select q.question_id, len(terms)::integer n_terms, len(terms) >= 3 as specific, coalesce(n, 0)::integer n_evidence, coalesce(n, 0) >= 1 and coalesce(top, 0) >= 0.01 sufficient,
        case when coalesce(n, 0) = 0 then 0.0 else round(coalesce(share, 0.0), 6) end missing_share, case when coalesce(n, 0) = 0 then '' else coalesce(missing, '') end missing
      from q left join n_ev using (question_id) left join m using (question_id)""",
    "gate_responsive": f"with {_EV}, {_resp_sql(_RESP)} select answer_id, addressed, responsive from resp",
    "grounding_sentences": _GROUND + " select * exclude (eff) from grounded",
    "grounding_ratios": _GROUND + " select * from ratios",
    "contradictions": f"with {_EV}, {_CONFLICT} select * from conflicts where unit is not null",
    "answer_confidence": f"{_GROUND}, {_conf_sql(_RESP)} {_CONFIDENCE}",
    "extractive_scores": f"""with {_EV}, {_RARE}, tot as (select question_id, sum(w) total from rare group by 1),
      base as (select question_id || '#' || rank id, trim(regexp_replace(text, '\\s*\\[\\d+\\]', '', 'g')) as text from ev), {_SENTENCES},
      s as (select string_split(id, '#')[1] question_id, string_split(id, '#')[2]::integer rank, sentence_no::integer as position, trim(sentence) sentence, regexp_split_to_array(trim(sentence), '\\s+') words,
        list_filter(regexp_split_to_array(trim(sentence), '\\s+'), lambda w: regexp_matches(w, '^\\p{{L}}')) alpha from sentences),
      p as (select *, {D.content_terms("sentence")} st from s where {_PROSE}),
      m as (select p.question_id, p.rank, p.position, p.sentence, sum(w) w from p join rare on rare.question_id = p.question_id and list_contains(st, term) group by all),
      sc as (select m.question_id, rank, position, sentence, round(w / total / (1.0 + 0.003 * greatest(0, length(sentence) - 160))
          * case when {D.contains_any("lower(question)", C.NUMERIC_CUES)} and len({D.numbers_with_units("sentence")}) > 0 then 1.6 else 1.0 end
          * case when {D.contains_any("lower(question)", C.REQUIREMENT_CUES)} and {D.contains_any("lower(sentence)", C.REQUIREMENT_WORDS)} then 1.4 else 1.0 end, 6) score
        from m join tot using (question_id) join questions q on q.question_id = m.question_id)
      select question_id, rank, position, sentence, score from sc where score >= 0.3""",
    "verify_claims": _SUPPORT + """,
      per as (select claim_id, count(distinct source_id) sources, count(distinct source_id) filter (own) own, count(distinct source_id) filter (not own and states) independent from r group by 1)
      select c.claim_id, len(terms)::integer n_terms, coalesce(sources, 0) sources, coalesce(own, 0) own, coalesce(independent, 0) independent,
        case when coalesce(independent, 0) > 0 and len(terms) > 1 then 'corroborated' when coalesce(own, 0) = 0 then 'not_found' else 'self_reported' end verdict from c left join per using (claim_id)""",
    "verify_support": _SUPPORT + " select claim_id, source_id, own, min_by(chunk_id, (-support, chunk_id)) chunk_id, max(support) support, bool_or(states) states from r group by all",
}
QUERIES = {f.__name__: f for f in (
    gate_scope, gate_reproduction, question_gates, gate_responsive, grounding_sentences, grounding_ratios, contradictions, extractive_scores, extractive_answer, answer_confidence, verify_claims, verify_support,
)}


def ask_batch(s, d):
    """All questions asked at once over all four lists; the answers are put together from the evidence."""
    return asking.ask(R._questions(s, d), _evidence(s, d, R.four_list_evidence), R._sources(s, d), INSIDE, OUTSIDE)


def ask_hybrid(s, d):
    """The same over keyword and structured evidence, which SQL can state."""
    return asking.ask(R._questions(s, d), _evidence(s, d), R._sources(s, d), INSIDE, OUTSIDE)


def prompt_hashes(s, d):
    p = asking.prompts(R._questions(s, d), _evidence(s, d), "Answer from the passages only.")
    return p.select("question_id", F.sha2("prompt", 256).alias("prompt_sha"))


QUERIES |= {f.__name__: f for f in (ask_batch, ask_hybrid, prompt_hashes)}
SQL["extractive_answer"] = f"""with es as ({SQL["extractive_scores"]}),
  l as (select question_id, list([{{'r': rank, 'p': position, 's': sentence}}] order by score desc, rank, position) xs from es group by 1),
  k as (select question_id, list_reduce(xs, lambda c, x: case when len(c) >= 5 or len(list_filter(c, lambda y: lower(y.s) = lower(x[1].s))) > 0 or (len(c) >= 2 and len(list_filter(c, lambda y: y.r = x[1].r)) >= 2) then c else list_concat(c, x) end) c from l)
  select question_id, array_to_string(list_transform(list_sort(c), lambda y: y.s || ' [' || y.r || ']'), ' ') answer from k"""
SQL["ask_hybrid"] = f"""with es as ({SQL["extractive_answer"]}), sg as ({SQL["question_gates"]}), {R.SOURCES.replace("held as", "own as")},
  scope as (select question_id, case when len(terms) > 0 then {_best(INSIDE)} else 0.0 end i, case when len(terms) > 0 then {_best(OUTSIDE)} else 0.0 end o from (select question_id, {D.content_terms("question")} terms from questions)),
  told as (select question_id, min_by(source_id, (-authority, source_id)) refused_for from (select question_id, unnest({D.content_terms("question")}) term from questions where {D.contains_any("lower(question)", C.VERBATIM_CUES)})
    join (select source_id, authority, unnest({D.content_terms("title || ' ' || replace(source_id, '-', ' ')")}) term from own where not mirrored) using (term) where regexp_matches(term, '\\d') group by 1),
  gate as (select q.question_id, case when trim(coalesce(question, '')) = '' then 'error' when o >= 0.5 and o > i then 'out_of_scope' when refused_for is not null then 'insufficient_evidence' when not specific then 'ambiguous'
    when not sufficient or missing_share >= {answering.MAX_MISSING_SUBJECT} then 'insufficient_evidence' end gate from questions q join sg using (question_id) join scope using (question_id) left join told using (question_id)),
  ans as materialized (select es.question_id id, es.question_id, answer as text from es join gate using (question_id) where gate is null),
  {_ground_sql("select * from ans").removeprefix("with ")}, {_resp_sql("select * from ans")}, {_conf_sql("select * from ans")}, conf as ({_CONFIDENCE}),
  st as (select gate.question_id, case when gate is not null then gate when ans.text is null then 'insufficient_evidence' when 1 - coalesce(grounded_ratio, 1.0) > {asking.MAX_UNSUPPORTED} then 'unsupported'
    when not coalesce(responsive, true) then 'irrelevant' else 'answered' end status, ans.text, grounded_ratio, citation_validity, confidence_score, confidence
    from gate left join ans using (question_id) left join ratios on ratios.answer_id = gate.question_id left join resp on resp.answer_id = gate.question_id left join conf on conf.answer_id = gate.question_id)
  select question_id, status, case when status = 'answered' then text end answer, grounded_ratio, citation_validity, confidence_score, confidence from st"""
SQL["prompt_hashes"] = f"""with {_EV} select q.question_id, sha256('Answer from the passages only.' || chr(10) || chr(10) || string_agg('[' || rank || '] ' || case when length(text) <= 1600 then text else regexp_replace(left(text, 1599), '\\s+$', '') || '…' end, chr(10) || chr(10) order by rank)
  || chr(10) || chr(10) || 'QUESTION: ' || question) prompt_sha from questions q join ev using (question_id) group by q.question_id, question"""
