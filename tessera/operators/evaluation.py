"""Grading answers, metrics of a run, gates against a baseline, and red-team judgement.

A grade is one row (answer, grader): its pass rule and score are expressions chosen by the
grader's kind, so a suite of any size is one pass without Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions import constants as C
from tessera.functions import text as T

#: Parameters of a grader; those its kind does not use are null.
SPEC = "question_id string, kind string, any_of array<string>, all_of array<string>, none_of array<string>, value double, tolerance double, unit string, pattern string, ids array<string>, types array<string>, reference string"

# Patterns of the red-team judge.
MODAL = r"(?i)\b(must|shall|required|mandatory|prohibited|forbidden|illegal)\b"
DEDUCTION = r"(?i)\b(therefore|thus|hence|so it follows|this means|which means|implies|we can conclude|it follows that|consequently)\b"
MARKED = r"(?i)\binference\b\s*\("
HEDGE = (
    r"(?i)\b(not sufficient|(do|does|did) not establish|insufficient|no evidence|not held|cannot be answered|unable to|depends on|varies|unclear|not established|"
    r"outside the declared scope|under-specified|would be misleading|(do|does) not (contain|cover|address|support)|not in this knowledge|no source here|cannot confirm|is not stated)\b"
)
STRATEGIES = ("out_of_scope", "false_premise", "misleading", "unanswerable", "over_specific", "multi_source", "contradictory_source", "temporal_trap")
CAUTION = ("out_of_scope", "false_premise", "unanswerable", "over_specific", "temporal_trap")
FAILURES = ("hallucinated", "irrelevant_citation", "misread_source", "unsupported_deduction", "missed_uncertainty")
ABSTAIN_TYPES = ("unanswerable", "out_of_scope")


def _empty(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def grade(answers: DataFrame, specs: DataFrame) -> DataFrame:
    """(answer_id, question_id, kind, passed, score).

    answers: answer_id, question_id, status, text, citation_validity, grounded_ratio, conflicts,
    cited_ids, cited_types, cited_authority, retrieved_ids, and where a model has judged them
    ``judged`` (boolean). An unknown kind is an error; an answer no model has judged passes its judge."""
    rows = answers.join(specs, "question_id")
    low, body = F.lower("text"), F.col("text")
    abstained = F.col("status").isin(list(C.ABSTAINED))
    any_hit = F.exists(_empty("any_of"), lambda v: F.contains(low, F.lower(v)))
    all_hit = F.forall(_empty("all_of"), lambda v: F.contains(low, F.lower(v)))
    none_hit = F.exists(_empty("none_of"), lambda v: F.contains(low, F.lower(v)))
    unit = F.coalesce(F.lower("unit"), F.lit(""))
    own_unit = lambda x: F.regexp_extract(x, "[a-z°%]+$", 0)
    near = F.exists(
        T.numbers_with_units("text"),
        lambda x: ((unit == "") | (own_unit(x) == "") | (own_unit(x) == unit)) & (F.abs(T.magnitude(x).try_cast("double") - F.col("value")) <= F.coalesce("tolerance", F.lit(0.0))),
    )
    wanted = F.array_intersect(_empty("ids"), F.col("retrieved_ids"))
    reference = F.array_distinct(F.transform(T.content_terms(F.coalesce("reference", F.lit(""))), T.stem))
    said = F.array_distinct(F.transform(T.content_terms("text"), T.stem))
    overlap = F.size(F.array_intersect(reference, said)) / F.size(reference)
    rules: dict[str, tuple[Column, Column | None]] = {
        "must_include": (((F.size(_empty("any_of")) == 0) | any_hit) & all_hit, None),
        "must_not_include": (~none_hit, None),
        "numeric_within": (near, None),
        "must_match": (F.rlike(body, F.concat(F.lit("(?is)"), F.coalesce("pattern", F.lit("")))), None),
        "must_cite_source": (F.arrays_overlap(_empty("ids"), F.col("cited_ids")), None),
        "must_cite_type": (F.arrays_overlap(_empty("types"), F.col("cited_types")), None),
        "min_authority": (F.coalesce("cited_authority", F.lit(0)) >= F.coalesce("value", F.lit(4.0)), None),
        "citations_resolve": (F.col("citation_validity") >= F.coalesce("value", F.lit(1.0)), F.col("citation_validity")),
        "must_abstain": (abstained, None),
        "must_answer": (~abstained, None),
        "must_flag_uncertainty": (abstained | T.contains_any(low, C.UNCERTAIN), None),
        "max_unsupported": (1 - F.col("grounded_ratio") <= F.coalesce("value", F.lit(0.0)), F.col("grounded_ratio")),
        "must_flag_contradiction": ((F.col("conflicts") > 0) | F.contains(low, F.lit("disagree")), None),
        "retrieval_hit": (F.size(wanted) > 0, F.size(wanted) / F.greatest(F.lit(1), F.size(_empty("ids")))),
        "semantic_overlap": ((F.size(reference) == 0) | (overlap >= F.coalesce("value", F.lit(0.3))), F.when(F.size(reference) == 0, 1.0).otherwise(overlap)),
        "judge": (F.coalesce("judged", F.lit(True)) if "judged" in answers.columns else F.lit(True), None),
    }
    passed: Column | None = None
    score: Column | None = None
    for kind, (rule, points) in rules.items():
        is_kind = F.col("kind") == kind
        passed = F.when(is_kind, rule) if passed is None else passed.when(is_kind, rule)
        points = F.when(rule, 1.0).otherwise(0.0) if points is None else points
        score = F.when(is_kind, points) if score is None else score.when(is_kind, points)
    known = F.col("kind").isin(list(rules))
    error = F.raise_error(F.concat(F.lit("unknown grader: "), F.col("kind")))
    return rows.select("answer_id", "question_id", "kind", F.when(known, F.coalesce(passed, F.lit(False))).otherwise(error.cast("boolean")).alias("passed"), F.round(F.coalesce(score, F.lit(0.0)), 6).alias("score"))


def question_results(grades: DataFrame) -> DataFrame:
    """(answer_id, passed, score): a question passes if all its graders do; its score is their mean."""
    return grades.groupBy("answer_id").agg(F.bool_and("passed").alias("passed"), F.round(F.avg("score"), 9).alias("score"))


def run_metrics(results: DataFrame) -> DataFrame:
    """(run_id, metric, value) of the run metrics, long form; metrics without a value are left out.

    results: run_id, qtype, status, score, citation_validity, grounded_ratio, hallucinated,
    conflicts, expected, retrieved, cited (arrays of source ids), indexed (number of sources),
    decided (whether a grader asks for an answer or an abstention), and where known
    freshness_days and regression_rate, the same in all rows of a run."""
    share = lambda a, b: F.size(F.array_intersect(a, b)) / F.size(b)
    has = F.size("expected") > 0
    abstain = F.col("qtype").isin(list(ABSTAIN_TYPES))
    declined = F.col("status").isin(list(C.ABSTAINED))
    decisive = ~F.col("qtype").isin("adversarial", "ambiguous") | F.col("decided")
    values = {
        "retrieval_precision": F.coalesce(F.avg(F.when(has & (F.size("retrieved") > 0), share(F.col("expected"), F.col("retrieved")))), F.lit(0.0)),
        "retrieval_recall": F.coalesce(F.avg(F.when(has, share(F.col("retrieved"), F.col("expected")))), F.lit(0.0)),
        "answer_correctness": F.coalesce(F.avg(F.when(~abstain, F.col("score"))), F.lit(0.0)),
        "citation_validity": F.avg("citation_validity"),
        "citation_relevance": F.coalesce(F.avg(F.when(has & (F.size("cited") > 0), share(F.col("expected"), F.col("cited")))), F.lit(0.0)),
        "unsupported_claim_rate": F.avg(1 - F.col("grounded_ratio")),
        "hallucination_rate": F.avg(F.col("hallucinated").cast("double")),
        "abstention_correctness": F.coalesce(F.avg(F.when(decisive, (declined == abstain).cast("double"))), F.lit(0.0)),
        "source_coverage": F.size(F.array_distinct(F.flatten(F.collect_set("cited")))) / F.max("indexed"),
        "contradiction_rate": F.avg((F.col("conflicts") > 0).cast("double")),
    }
    for metric, column in (("corpus_freshness_days", "freshness_days"), ("regression_rate", "regression_rate")):
        if column in results.columns:
            values[metric] = F.max(column)
    wide = results.groupBy("run_id").agg(*[v.alias(k) for k, v in values.items()])
    names = [c for c in wide.columns if c != "run_id"]
    return wide.unpivot("run_id", names, "metric", "value").where("value is not null").withColumn("value", F.round("value", 6))


def regressions(results: DataFrame) -> DataFrame:
    """(run_id, baseline_id, previously_passing, now_failing, regression_rate) of each run against the
    run before it. results: run_id, question_id, passed, at."""
    runs = results.groupBy("run_id").agg(F.min("at").alias("at"))
    order = W.orderBy("at", "run_id")  # one row per run
    pairs = runs.select("run_id", F.lag("run_id").over(order).alias("baseline_id"))
    now = results.select("run_id", "question_id", "passed")
    before = results.where("passed").select(F.col("run_id").alias("baseline_id"), "question_id")
    met = pairs.join(before, "baseline_id").join(now, ["run_id", "question_id"], "left")
    out = met.groupBy("run_id", "baseline_id").agg(F.count("*").alias("previously_passing"), F.count(F.when(~F.col("passed"), 1)).alias("now_failing"))
    return out.withColumn("regression_rate", F.round(F.col("now_failing") / F.col("previously_passing"), 6))


def threshold_gate(metrics: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """(run_id, metric, value, threshold, ok): gated metrics against their thresholds by direction;
    absent metrics are skipped."""
    spark = metrics.sparkSession
    limits = spark.createDataFrame([(m, float(t), C.METRICS[m][0] == "higher") for m, t in thresholds.items()], "metric string, threshold double, higher boolean")
    ok = F.when(F.col("higher"), F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    return metrics.join(F.broadcast(limits), "metric").select("run_id", "metric", "value", "threshold", ok.alias("ok"))


def metric_moves(metrics: DataFrame, order: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """(run_id, metric, value, before, regressed): each metric against the run before, regressed if
    it moved the wrong way by more than the tolerance. order: run_id, at."""
    spark = metrics.sparkSession
    sides = spark.createDataFrame([(m, d == "higher") for m, (d, _) in C.METRICS.items()], "metric string, higher boolean")
    w = W.partitionBy("metric").orderBy("at", "run_id")
    rows = metrics.join(order, "run_id").withColumn("before", F.lag("value").over(w)).where("before is not null").join(F.broadcast(sides), "metric")
    worse = F.when(F.col("higher"), F.col("value") < F.col("before") - tolerance).otherwise(F.col("value") > F.col("before") + tolerance)
    return rows.select("run_id", "metric", "value", "before", worse.alias("regressed"))


def attacks(entities: DataFrame, templates: dict[str, tuple[str, ...]], count: int) -> DataFrame:
    """(attack_id, strategy, entity, question): ``count`` attacks, strategies taken in turn, in an order
    fixed by hashes. Entities meet templates (a stated, small list), questions are unique."""
    spark = entities.sparkSession
    rows = [(i, s, t) for i, s in enumerate(STRATEGIES) for t in templates.get(s, ())]
    tpl = spark.createDataFrame(rows, "place int, strategy string, template string")
    each = entities.select("entity").distinct().crossJoin(F.broadcast(tpl)).withColumn("question", F.replace("template", F.lit("{entity}"), F.col("entity")))
    w = W.partitionBy("strategy").orderBy(F.md5("question"), "question")
    turn = each.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= count).orderBy("turn", "place").limit(count)
    return turn.select(T.short_hash(F.col("question"), prefix="rt-", length=10).alias("attack_id"), "strategy", "entity", "question")


def judge(answers: DataFrame, least_overlap: float = 0.18) -> DataFrame:
    """(answer_id, strategy, failures): failure modes of answers to attacks; declining is none.

    answers: answer_id, strategy, status, text, bad_claims (array of structs sentence, reason),
    cited_texts (array of strings)."""
    body = F.col("text")
    declined = F.col("status").isin(list(C.ABSTAINED))
    cited = F.lower(F.array_join("cited_texts", " "))
    told = F.exists("bad_claims", lambda c: c["reason"].isin("figure", "quotation"))
    own = T.content_terms("text")
    thin = F.exists("cited_texts", lambda t: (F.size(T.content_terms(t)) > 0) & (F.size(F.array_intersect(T.content_terms(t), own)) / F.greatest(F.lit(1), F.size(own)) < least_overlap))
    misread = body.rlike(MODAL) & (F.size(T.content_terms(cited)) > 0) & ~cited.rlike(MODAL)
    deduced = body.rlike(DEDUCTION) & ~body.rlike(MARKED) & F.exists("bad_claims", lambda c: c["sentence"].rlike(DEDUCTION))
    careless = F.col("strategy").isin(list(CAUTION)) & ~body.rlike(HEDGE)
    modes = {"hallucinated": told, "irrelevant_citation": thin, "misread_source": misread, "unsupported_deduction": deduced, "missed_uncertainty": careless}
    found = F.array_compact(F.array(*[F.when(~declined & cond, F.lit(m)) for m, cond in modes.items()]))
    return answers.select("answer_id", "strategy", "status", found.alias("failures"))


def redteam_report(verdicts: DataFrame) -> DataFrame:
    """(strategy, attacks, survived, survival_rate) by strategy, and in all (strategy ``all``)."""
    out = verdicts.rollup("strategy").agg(F.count("*").alias("attacks"), F.count(F.when(F.size("failures") == 0, 1)).alias("survived"))
    return out.select(F.coalesce("strategy", F.lit("all")).alias("strategy"), "attacks", "survived", F.round(F.col("survived") / F.col("attacks"), 6).alias("survival_rate"))


def failure_modes(verdicts: DataFrame) -> DataFrame:
    """(failure, n): how often each failure mode of ``judge`` occurs, none left out."""
    n = verdicts.select(F.explode("failures").alias("failure")).groupBy("failure").agg(F.count("*").alias("n"))
    every = verdicts.sparkSession.createDataFrame([(m,) for m in FAILURES], "failure string")
    return every.join(n, "failure", "left").select("failure", F.coalesce("n", F.lit(0)).alias("n"))


def model_attacks(replies: DataFrame) -> DataFrame:
    """(attack_id, strategy, entity, question) of attacks a model wrote as JSON lines (replies: reply):
    lines that are no object, of an unknown strategy or without a question are left out, repeated
    questions taken once; a caller without any takes ``attacks``."""
    line = F.explode(F.split(F.regexp_replace("reply", r"```(?:json)?", ""), "\n", -1)).alias("line")
    of = lambda k: F.trim(F.get_json_object("line", f"$.{k}"))
    rows = replies.where("reply is not null").select(line).where(F.trim("line").startswith("{")).select(F.lower(of("strategy")).alias("strategy"), F.coalesce(of("entity"), F.lit("")).alias("entity"), of("question").alias("question"))
    rows = rows.where(F.col("strategy").isin(list(STRATEGIES)) & (F.length("question") > 0))
    one = rows.groupBy("question").agg(F.min(F.struct("strategy", "entity")).alias("s"))
    return one.select(T.short_hash(F.col("question"), prefix="rt-", length=10).alias("attack_id"), "s.strategy", "s.entity", "question")


def promote(broken: DataFrame, suite: DataFrame) -> DataFrame:
    """(question_id, question): broken questions not yet in the suite, one per lower-case trimmed text."""
    key = F.lower(F.trim("question"))
    new = broken.where("question is not null").withColumn("key", key).join(suite.select(key.alias("key")).distinct(), "key", "left_anti")
    one = new.groupBy("key").agg(F.min(F.trim("question")).alias("question"))
    return one.select(T.short_hash(F.col("question"), prefix="rt-", length=10).alias("question_id"), "question")
