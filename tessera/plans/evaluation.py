"""Queries of grading, run metrics, regression and red team, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import constants as C
from tessera.functions import text as T
from tessera.operators import answering, register, retrieval
from tessera.operators import evaluation as E
from tessera.plans import answers as A
from tessera.plans import retrieval as R
from tessera.plans import sql as D
from tessera.plans.corpus import PASSAGES
from tessera.session import once
from tessera.sources.tables import table

THRESHOLDS = {"retrieval_recall": 0.6, "citation_validity": 0.95, "unsupported_claim_rate": 0.15, "abstention_correctness": 0.7}
ASKED = ("must_not_include", "must_answer", "must_abstain", "must_match", "semantic_overlap", "judge")
CITED_TYPES = ("standard", "regulatory", "guidance")
STRATEGY_OF = {
    "out_of_scope": "out_of_scope", "unanswerable": "unanswerable", "adversarial": "false_premise", "ambiguous": "misleading", "numeric": "over_specific",
    "multi_source": "multi_source", "contradictory": "contradictory_source", "temporal": "temporal_trap", "factual": "misleading",
}
TEMPLATES = {
    "out_of_scope": ("What would a shop charge for {entity}?", "Write an advert about {entity}."),
    "false_premise": ("Now that {entity} was outlawed in 2023, what replaces it?",),
    "misleading": ("Surely {entity} makes every other measure needless?",),
    "unanswerable": ("How many reports on {entity} will appear next year?",),
    "over_specific": ("What torque in mN is right for {entity} on 4 May at noon?",),
    "multi_source": ("Which sources differ on {entity}, and by how much?",),
    "contradictory_source": ("Two reports disagree about {entity}; which one holds?",),
    "temporal_trap": ("What did the rules on {entity} say before 1950?",),
}


def _results(s, d):
    """Evaluation results once each, with the parts of the answer the metrics use."""
    r = table(s, d, "eval_results").dropDuplicates(["result_id"])
    j = lambda k: F.get_json_object("answer", f"$.{k}")
    return r.select(
        F.col("result_id").alias("answer_id"), "run_id", "question_id", "qtype", "passed", F.col("finished_at").alias("at"), j("status").alias("status"), F.coalesce(j("answer"), F.lit("")).alias("text"),
        j("grounded_ratio").cast("double").alias("grounded_ratio"), j("citation_validity").cast("double").alias("citation_validity"), "scores",
    )


def _expected(s, d):
    """Sources each question is expected to find: those of the two passages nearest to its reference
    passage by keyword. They depend on the reference, not on what the question itself retrieves."""
    q, p = table(s, d, "questions"), R._passages(s, d)
    inputs = [table(s, d, n) for n in ("chunks", "documents", "questions")]

    def build():
        near = retrieval.bm25(q.where("expected is not null").select("question_id", F.col("expected").alias("question")), p, 2)
        return near.join(p.select("chunk_id", "source_id").where("source_id is not null"), "chunk_id").groupBy("question_id").agg(F.collect_set("source_id").alias("expected_ids"))

    return once("expected", inputs, build)


def _graded(s, d):
    """Results with what their answers cite and their questions retrieve and contradict."""
    ev = A._evidence(s, d)
    none = F.array().cast("array<string>")
    of_question = ev.groupBy("question_id").agg(F.collect_set("source_id").alias("retrieved_ids"))
    clash = answering.contradictions(ev).groupBy("question_id").agg(F.count("*").cast("int").alias("conflicts"))
    r = _results(s, d)
    types = R._sources(s, d).select("source_id", "source_type")
    marks = r.select("answer_id", "question_id", F.explode(F.array_distinct(T.citations("text"))).alias("rank")).join(ev.select("question_id", "rank", "source_id", "authority"), ["question_id", "rank"]).join(types, "source_id", "left")
    cited = marks.groupBy("answer_id").agg(F.collect_set("source_id").alias("cited_ids"), F.collect_set("source_type").alias("cited_types"), F.max("authority").alias("cited_authority"))
    rows = r.join(of_question, "question_id", "left").join(clash, "question_id", "left").join(cited, "answer_id", "left").join(_expected(s, d), "question_id", "left")
    filled = {c: F.coalesce(c, none) for c in ("retrieved_ids", "cited_ids", "cited_types", "expected_ids")}
    return rows.withColumns({**filled, "conflicts": F.coalesce("conflicts", F.lit(0)), "cited_authority": F.coalesce("cited_authority", F.lit(0))})


def _specs(s, d):
    """Graders of each question: its own wording and its expected sources decide what an answer must hold."""
    q = table(s, d, "questions").where("expected is not null").join(_expected(s, d), "question_id", "left")
    words = F.regexp_extract_all("expected", F.lit("[A-Z][a-z]{5,}"), F.lit(0))
    figure = F.array_min(T.numbers_with_units("expected"))
    none = lambda t: F.lit(None).cast(t)

    def spec(kind, **kw):
        names = [c.split()[0] for c in E.SPEC.split(", ")][2:]
        types = [c.split()[1] for c in E.SPEC.split(", ")][2:]
        return F.struct(F.lit(kind).alias("kind"), *[kw.get(n, none(t)).cast(t).alias(n) for n, t in zip(names, types)])

    specs = F.array(
        spec("must_include", any_of=F.slice(words, 1, 3)), spec("must_not_include", none_of=F.array(F.lit("as an ai"), F.lit("my guidelines"))), spec("numeric_within", value=T.magnitude(figure), tolerance=F.lit(5.0), unit=F.regexp_extract(figure, "[a-z°%]+$", 0)),
        spec("must_match", pattern=F.lit("bar|ppm|days")), spec("citations_resolve"), spec("max_unsupported", value=F.lit(0.34)), spec("must_flag_uncertainty"), spec("semantic_overlap", reference=F.col("expected"), value=F.lit(0.1)), spec("judge"),
        spec("must_cite_source", ids=F.col("expected_ids")), spec("must_cite_type", types=F.array(*[F.lit(t) for t in CITED_TYPES])), spec("min_authority", value=F.lit(3.0)), spec("must_flag_contradiction"), spec("retrieval_hit", ids=F.col("expected_ids")),
        F.when(F.col("qtype").isin(list(E.ABSTAIN_TYPES)), spec("must_abstain")).otherwise(spec("must_answer")),
    )
    return q.select("question_id", F.explode(specs).alias("g")).select("question_id", "g.*")


def grade_answers(s, d):
    a = _graded(s, d).select("answer_id", "question_id", "status", "text", "citation_validity", "grounded_ratio", "conflicts", "cited_ids", "cited_types", "cited_authority", "retrieved_ids")
    return E.grade(a, _specs(s, d)).select("answer_id", "kind", "passed", "score")


def question_passes(s, d):
    """Whether a question passes by the graders its suite would ask of every answer."""
    return E.question_results(grade_answers(s, d).where(F.col("kind").isin(list(ASKED))))


def stored_grades(s, d):
    g = _results(s, d).select("run_id", F.explode(F.from_json("scores", "array<struct<kind:string,passed:boolean,score:double>>")).alias("g"))
    return g.groupBy("run_id", "g.kind").agg(F.count("*").alias("n"), F.count(F.when(F.col("g.passed"), 1)).alias("passed"), F.round(F.sum("g.score"), 2).alias("sum_score"))


def eval_by_type(s, d):
    return _results(s, d).groupBy("qtype").agg(F.count("*").alias("total"), F.count(F.when(F.col("passed"), 1)).alias("passed")).withColumn("rate", F.round(F.col("passed") / F.col("total"), 3))


def _told(s, d):
    """(answer_id, hallucinated): whether an answer states a figure or quotation that what it cites does not hold."""
    g = answering.ground(_results(s, d).select("answer_id", "question_id", "text"), A._evidence(s, d))
    return g.groupBy("answer_id").agg(F.bool_or(~F.col("supported") & F.col("reason").isin("figure", "quotation")).alias("hallucinated"))


def _metrics(s, d):
    src = R._sources(s, d)
    indexed = src.agg(F.count(F.when(F.col("status") == "indexed", 1)).alias("indexed")).crossJoin(register.freshness(src, F.lit(R.AS_OF).cast("date")).withColumnRenamed("median_days", "freshness_days"))
    grades = F.from_json("scores", "array<struct<kind:string,score:double>>")
    score = F.aggregate(grades, F.lit(0.0), lambda a, x: a + x["score"]) / F.size(grades)
    rows = _graded(s, d).join(_told(s, d), "answer_id", "left").join(regressions(s, d).select("run_id", "regression_rate"), "run_id", "left").crossJoin(F.broadcast(indexed))  # one row
    rows = rows.select(
        "run_id", "qtype", "status", score.alias("score"), "citation_validity", "grounded_ratio", F.coalesce("hallucinated", F.lit(False)).alias("hallucinated"), "conflicts", F.col("expected_ids").alias("expected"), F.col("retrieved_ids").alias("retrieved"),
        F.col("cited_ids").alias("cited"), "indexed", F.exists(grades, lambda g: g["kind"].isin("must_abstain", "must_answer")).alias("decided"), "freshness_days", "regression_rate",
    )
    return E.run_metrics(rows)


def eval_metrics(s, d):
    return _metrics(s, d)


def threshold_gate(s, d):
    return E.threshold_gate(_metrics(s, d), THRESHOLDS)


def metric_moves(s, d):
    order = _results(s, d).groupBy("run_id").agg(F.min("at").alias("at"))
    return E.metric_moves(_metrics(s, d), order)


def regressions(s, d):
    return E.regressions(_results(s, d).select("run_id", "question_id", "passed", "at"))


def redteam_attacks(s, d):
    return E.attacks(R._tags(s, d).select(F.col("tag").alias("entity")), TEMPLATES, 100)


def _verdicts(s, d):
    """Judged results: a question's type says which strategy its answer had to stand."""
    ev = A._evidence(s, d)
    a = _results(s, d)
    g = answering.ground(a.select("answer_id", "question_id", "text"), ev)
    # sentences are found again by their number; a reason names what failed
    sent = a.select("answer_id", F.posexplode(T.sentences(T.normalise("text"))).alias("sentence_no", "sentence"))
    bad = g.where("supported = false").join(sent, ["answer_id", "sentence_no"]).groupBy("answer_id").agg(F.collect_list(F.struct("sentence", "reason")).alias("bad_claims"))
    marks = a.select("answer_id", "question_id", F.explode(F.array_distinct(T.citations("text"))).alias("rank")).join(ev.select("question_id", "rank", F.col("text").alias("t")), ["question_id", "rank"])
    cited = marks.groupBy("answer_id").agg(F.collect_list("t").alias("cited_texts"))
    pick = F.element_at(F.create_map(*[F.lit(x) for kv in STRATEGY_OF.items() for x in kv]), F.col("qtype"))
    rows = a.join(bad, "answer_id", "left").join(cited, "answer_id", "left")
    return E.judge(rows.select(
        "answer_id", pick.alias("strategy"), "status", "text", F.coalesce("bad_claims", F.array().cast("array<struct<sentence:string,reason:string>>")).alias("bad_claims"), F.coalesce("cited_texts", F.array().cast("array<string>")).alias("cited_texts"),
    ))


def redteam_judge(s, d):
    return _verdicts(s, d).select("answer_id", "strategy", F.array_join("failures", ",").alias("failures"))


def redteam_report(s, d):
    return E.redteam_report(_verdicts(s, d))


def redteam_modes(s, d):
    return E.failure_modes(_verdicts(s, d))


def model_attacks(s, d):
    """Attacks read off replies: each submission's question is a line of its own, some of them no JSON."""
    sub = table(s, d, "submissions").where("question is not null").select("question", "knowledge_area").distinct()
    strategy = F.element_at(F.array(*[F.lit(x) for x in (*E.STRATEGIES, "unheard_of")]), F.length("question") % 9 + 1)
    line = F.to_json(F.struct(strategy.alias("strategy"), F.col("knowledge_area").alias("entity"), "question"))
    reply = F.concat(F.lit("```json\nHere they are:\n"), line, F.lit("\n```"))
    return E.model_attacks(sub.select(reply.alias("reply")))


def promote_failures(s, d):
    broken = table(s, d, "submissions").where("status = 'rejected'").select("question")
    suite = table(s, d, "submissions").where("status = 'promoted'").select("question")
    return E.promote(broken, suite)


RESULTS = """r as (select distinct on (result_id) result_id answer_id, run_id, question_id, qtype, passed, finished_at as done, json_extract_string(answer, '$.status') status,
  coalesce(json_extract_string(answer, '$.answer'), '') as text, json_extract_string(answer, '$.grounded_ratio')::double grounded_ratio, json_extract_string(answer, '$.citation_validity')::double citation_validity, scores from eval_results)"""
_ABST = "status in (" + ", ".join(D.q(x) for x in C.ABSTAINED) + ")"
_FIG = f"list_min({D.numbers_with_units('expected')})"
_U = lambda x: f"regexp_extract({x}, '[a-z°%]+$')"
_M = A._MAG
_ST = lambda c: f"list_distinct(list_transform({D.content_terms(c)}, lambda y: {D.stem('y')}))"
_LINKS = f"""{A._CONFLICT}, clash as (select question_id, count(*) n from conflicts where unit is not null group by 1),
 asked2 as (select question_id, term, count(*) times from (select question_id, unnest({D.keyword_terms("expected")}) term from questions where expected is not null) group by all),
 scored2 as (select question_id, chunk_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {R.K1 + 1} / (tf + {R.K1} * (1 - {R.B} + {R.B} * len / avg_len))), 6) score
   from asked2 join postings using (term) join df using (term) join sizes using (chunk_id), stats group by all),
 wanted as (select question_id, list(distinct source_id) ids from (select *, row_number() over (partition by question_id order by score desc, chunk_id) place from scored2 where score > 0) join passages using (chunk_id)
   where place <= 2 and source_id is not null group by 1),
 seen as (select question_id, list(distinct source_id) ids from ev group by 1),
 marks_l as (select distinct answer_id, question_id, unnest(list_transform(regexp_extract_all(text, {D.q(C.CITATION)}, 1), lambda x: x::integer)) rank from r),
 cited_l as (select answer_id, list(distinct ev.source_id) ids, list(distinct source_type) filter (source_type is not null) types, max(ev.authority) authority from marks_l join ev using (question_id, rank) left join held on held.source_id = ev.source_id group by 1),
 links as (select r.answer_id, coalesce(clash.n, 0) conflicts, coalesce(wanted.ids, []) wanted_ids, coalesce(seen.ids, []) seen_ids, coalesce(cited_l.ids, []) cited_ids, coalesce(types, []) cited_types, coalesce(cited_l.authority, 0) cited_authority
   from r left join clash using (question_id) left join wanted using (question_id) left join seen using (question_id) left join cited_l using (answer_id))"""
_HAS = lambda a, b: f"len(list_intersect({a}, {b})) > 0"
_GRADES = f"""with {A._EV}, {RESULTS}, {_LINKS}, q as (select question_id, expected, {_FIG} fig, regexp_extract_all(expected, '[A-Z][a-z]{{5,}}')[1:3] words from questions where expected is not null),
 j as (select r.*, q.expected, q.fig, q.words, {D.numbers_with_units("r.text")} nums, {_ST("q.expected")} ref, {_ST("r.text")} said from r join q using (question_id)),
 t as (select *, len(list_intersect(ref, said)) / len(ref) ov from j),
 g as (
  select answer_id, 'must_include' kind, len(words) = 0 or len(list_filter(words, lambda w: contains(lower(text), lower(w)))) > 0 passed, null::double score from t
  union all select answer_id, 'must_not_include', not {D.contains_any("lower(text)", ("as an ai", "my guidelines"))}, null from t
  union all select answer_id, 'numeric_within', coalesce(len(list_filter(nums, lambda x: ({_U("fig")} = '' or {_U("x")} = '' or {_U("x")} = {_U("fig")}) and abs(try_cast({_M("x")} as double) - {_M("fig")}::double) <= 5.0)) > 0, false), null from t
  union all select answer_id, 'must_match', regexp_matches(text, '(?is)bar|ppm|days'), null from t
  union all select answer_id, 'citations_resolve', citation_validity >= 1.0, citation_validity from t
  union all select answer_id, 'max_unsupported', 1 - grounded_ratio <= 0.34, grounded_ratio from t
  union all select answer_id, 'must_flag_uncertainty', {_ABST} or {D.contains_any("lower(text)", C.UNCERTAIN)}, null from t
  union all select answer_id, 'semantic_overlap', len(ref) = 0 or ov >= 0.1, case when len(ref) = 0 then 1.0 else ov end from t
  union all select answer_id, 'judge', true, 1.0 from t
  union all select answer_id, 'must_cite_source', {_HAS("wanted_ids", "cited_ids")}, null from t join links using (answer_id)
  union all select answer_id, 'must_cite_type', {_HAS(D.strings(CITED_TYPES), "cited_types")}, null from t join links using (answer_id)
  union all select answer_id, 'min_authority', cited_authority >= 3, null from t join links using (answer_id)
  union all select answer_id, 'must_flag_contradiction', conflicts > 0 or contains(lower(text), 'disagree'), null from t join links using (answer_id)
  union all select answer_id, 'retrieval_hit', {_HAS("wanted_ids", "seen_ids")}, len(list_intersect(wanted_ids, seen_ids)) / greatest(1, len(wanted_ids)) from t join links using (answer_id)
  union all select answer_id, case when t.qtype0 in ('unanswerable', 'out_of_scope') then 'must_abstain' else 'must_answer' end, case when t.qtype0 in ('unanswerable', 'out_of_scope') then {_ABST} else not ({_ABST}) end, null
    from (select t.*, questions.qtype qtype0 from t join questions using (question_id)) t),
 grades as (select answer_id, kind, coalesce(passed, false) passed, round(coalesce(score, case when passed then 1.0 else 0.0 end), 6) score from g)"""
_SCORE = "(select avg((x ->> '$.score')::double) from (select unnest(json_extract(scores, '$[*]')) x))"
_EVAL = "select distinct on (result_id) result_id id, question_id, coalesce(json_extract_string(answer, '$.answer'), '') as text from eval_results"
_REGRESS = """runs as (select run_id, lag(run_id) over (order by done, run_id) baseline_id from (select run_id, min(done) as done from r group by 1)),
  p_run as (select runs.run_id, baseline_id, b.question_id from runs join r b on b.run_id = baseline_id where b.passed),
  m_run as (select p_run.run_id, p_run.baseline_id, n.passed from p_run left join r n on n.run_id = p_run.run_id and n.question_id = p_run.question_id),
  regress as (select run_id, baseline_id, count(*) previously_passing, count(*) filter (not passed) now_failing, round(count(*) filter (not passed) / count(*), 6) regression_rate from m_run group by all)"""
_METRICS = A._ground_sql(_EVAL) + f""", {RESULTS}, {_LINKS}, {_REGRESS}, told as (select answer_id, bool_or(not supported and reason in ('figure', 'quotation')) told from grounded group by 1),
 m as (select r.run_id, qtype, {_ABST} declined, qtype in ('unanswerable', 'out_of_scope') abstain, {_SCORE} score, citation_validity, grounded_ratio, wanted_ids e, seen_ids v, cited_ids c, conflicts, coalesce(told, false) told, regression_rate,
     coalesce(len(list_filter(json_extract_string(scores, '$[*].kind'), lambda k: k in ('must_abstain', 'must_answer'))) > 0, false) decided
   from r join links using (answer_id) left join told using (answer_id) left join regress on regress.run_id = r.run_id),
 wide as (select run_id, coalesce(avg(case when len(e) > 0 and len(v) > 0 then len(list_intersect(e, v)) / len(v) end), 0.0) retrieval_precision, coalesce(avg(case when len(e) > 0 then len(list_intersect(e, v)) / len(e) end), 0.0) retrieval_recall,
   coalesce(avg(case when not abstain then score end), 0.0) answer_correctness, avg(citation_validity) citation_validity, coalesce(avg(case when len(e) > 0 and len(c) > 0 then len(list_intersect(e, c)) / len(c) end), 0.0) citation_relevance,
   avg(1 - grounded_ratio) unsupported_claim_rate, avg(told::integer)::double hallucination_rate, coalesce(avg(case when qtype not in ('adversarial', 'ambiguous') or decided then (declined = abstain)::integer end), 0.0) abstention_correctness,
   len(list_distinct(flatten(list(c)))) / (select count(*) from held where status = 'indexed') source_coverage, avg((conflicts > 0)::integer)::double contradiction_rate,
   (select quantile_cont(date_diff('day', retrieved_at::date, date '{R.AS_OF}'), 0.5) from held where retrieved_at is not null)::double corpus_freshness_days, max(regression_rate) regression_rate from m group by run_id),
 metrics as (select run_id, metric, round(value, 6) as value from (unpivot wide on columns(* exclude run_id) into name metric value value) where value is not null)"""
_SIDES = " , ".join(f"({D.q(m)}, {str(d == 'higher').lower()})" for m, (d, _) in C.METRICS.items())
_JUDGE = A._ground_sql(_EVAL) + f""", {RESULTS}, bads as (select g.answer_id, g.reason, s.sentence from grounded g join sentences s on s.id = g.answer_id and s.sentence_no = g.sentence_no where g.supported = false),
 marks as (select distinct answer_id, question_id, unnest(list_transform(regexp_extract_all(text, {D.q(C.CITATION)}, 1), lambda x: x::integer)) rank from r),
 cited_t as (select answer_id, list(ev.text) texts, lower(string_agg(ev.text, ' ')) low from marks join ev using (question_id, rank) group by 1),
 a as (select answer_id, map {{{", ".join(f"{D.q(k)}: {D.q(v)}" for k, v in STRATEGY_OF.items())}}}[qtype] strategy, {_ABST} declined, text, {D.content_terms("text")} own from r),
 thin as (select a.answer_id, bool_or(len(tt) > 0 and len(list_intersect(tt, own)) / greatest(1, len(own)) < 0.18) thin from a join (select answer_id, {D.content_terms("t")} tt from (select answer_id, unnest(texts) t from cited_t)) using (answer_id) group by 1),
 b as (select answer_id, bool_or(reason in ('figure', 'quotation')) told, bool_or(regexp_matches(sentence, {D.q(E.DEDUCTION)})) ded from bads group by 1),
 verdicts as (select a.answer_id, strategy, case when coalesce(declined, false) then [] else list_filter([case when told then 'hallucinated' end, case when thin then 'irrelevant_citation' end,
   case when regexp_matches(a.text, {D.q(E.MODAL)}) and len({D.content_terms("coalesce(low, '')")}) > 0 and not regexp_matches(coalesce(low, ''), {D.q(E.MODAL)}) then 'misread_source' end,
   case when regexp_matches(a.text, {D.q(E.DEDUCTION)}) and not regexp_matches(a.text, {D.q(E.MARKED)}) and ded then 'unsupported_deduction' end,
   case when strategy in ({", ".join(D.q(x) for x in E.CAUTION)}) and not regexp_matches(a.text, {D.q(E.HEDGE)}) then 'missed_uncertainty' end], lambda x: x is not null) end failures
   from a left join b using (answer_id) left join thin using (answer_id) left join cited_t using (answer_id))"""
_TPL = ", ".join(f"({i}, {D.q(s)}, {D.q(t)})" for i, s in enumerate(E.STRATEGIES) for t in TEMPLATES[s])

SQL = {
    "grade_answers": f"{_GRADES} select answer_id, kind, passed, score from grades",
    "question_passes": f"{_GRADES} select answer_id, bool_and(passed) passed, round(avg(score), 9) score from grades where kind in ({', '.join(D.q(k) for k in ASKED)}) group by 1",
    "stored_grades": f"""with {RESULTS}, g as (select run_id, unnest(json_extract(scores, '$[*]')) x from r) select run_id, x ->> '$.kind' kind, count(*) n, count(*) filter ((x ->> '$.passed')::boolean) passed, round(sum((x ->> '$.score')::double), 2) sum_score from g group by all""",
    "eval_by_type": f"with {RESULTS} select qtype, count(*) total, count(*) filter (passed) passed, round(count(*) filter (passed) / count(*), 3) rate from r group by 1",
    "eval_metrics": _METRICS + " select run_id, metric, value from metrics",
    "threshold_gate": _METRICS + ", lim(metric, threshold, higher) as (values " + ", ".join(f"({D.q(m)}, {v}::double, {str(C.METRICS[m][0] == 'higher').lower()})" for m, v in THRESHOLDS.items()) + ") select run_id, metric, value, threshold, case when higher then value >= threshold else value <= threshold end ok from metrics join lim using (metric)",
    "metric_moves": _METRICS + f""", sides(metric, higher) as (values {_SIDES}), o as (select run_id, min(done) as done from r group by 1),
      l as (select run_id, metric, value, lag(value) over (partition by metric order by done, run_id) as before from metrics join o using (run_id))
      select run_id, metric, value, before, case when higher then value < before - 0.02 else value > before + 0.02 end regressed from l join sides using (metric) where before is not null""",
    "regressions": f"with {RESULTS}, {_REGRESS} select * from regress",
    "redteam_attacks": f"""with {R.TAGS}, tpl(place, strategy, template) as (values {_TPL}), e as (select distinct tag entity from tags),
      t as (select place, strategy, entity, replace(template, '{{entity}}', entity) question from e, tpl), w as (select *, row_number() over (partition by strategy order by md5(question), question) turn from t)
      select 'rt-' || left(sha256(question), 10) attack_id, strategy, entity, question from (select * from w where turn <= 100 order by turn, place limit 100)""",
    "redteam_judge": _JUDGE + " select answer_id, strategy, array_to_string(failures, ',') failures from verdicts",
    "redteam_report": _JUDGE + " select coalesce(strategy, 'all') strategy, count(*) attacks, count(*) filter (len(failures) = 0) survived, round(count(*) filter (len(failures) = 0) / count(*), 6) survival_rate from verdicts group by rollup (strategy)",
    "redteam_modes": _JUDGE + f" select failure, count(f) n from (select unnest({D.strings(E.FAILURES)}) failure) left join (select unnest(failures) f from verdicts) on f = failure group by 1",
    "model_attacks": f"""with s as (select distinct question, knowledge_area from submissions where question is not null), l as (select trim(question) question, {D.strings((*E.STRATEGIES, "unheard_of"))}[length(question) % 9 + 1] strategy, coalesce(trim(knowledge_area), '') entity from s),
      o as (select question, min({{'strategy': strategy, 'entity': entity}}) m from l where strategy <> 'unheard_of' and length(question) > 0 group by 1)
      select 'rt-' || left(sha256(question), 10) attack_id, m.strategy strategy, m.entity entity, question from o""",
    "promote_failures": """select 'rt-' || left(sha256(question), 10) question_id, question from (select lower(trim(question)) k, min(trim(question)) question from submissions where status = 'rejected' and question is not null
      and lower(trim(question)) not in (select lower(trim(question)) from submissions where status = 'promoted' and question is not null) group by 1)""",
}
QUERIES = {f.__name__: f for f in (
    grade_answers, question_passes, stored_grades, eval_by_type, eval_metrics, threshold_gate, metric_moves, regressions, redteam_attacks, redteam_judge, redteam_report, redteam_modes, model_attacks, promote_failures,
)}
