"""Answering a batch of questions: gates, drafting, checks and the final status, as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import answering
from tessera.session import materialise

MAX_UNSUPPORTED = 0.34


def prompts(questions: DataFrame, evidence: DataFrame, rules: str, limit: int = 1600) -> DataFrame:
    """(question_id, question, prompt): the standing rules, the numbered passages (each cut at ``limit``
    characters) and the question."""
    passage = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), T.truncate("text", limit))
    listed = evidence.select("question_id", F.struct("rank", passage.alias("p")).alias("e")).groupBy("question_id").agg(F.array_sort(F.collect_list("e")).alias("es"))
    body = F.concat_ws("\n\n", F.lit(rules), F.array_join(F.transform("es", lambda e: e["p"]), "\n\n"), F.concat(F.lit("QUESTION: "), F.col("question")))
    return questions.join(listed, "question_id").select("question_id", "question", body.alias("prompt"))


def prepare(questions: DataFrame, evidence: DataFrame, sources: DataFrame, inside: tuple[str, ...] = (), outside: tuple[str, ...] = ()) -> DataFrame:
    """(question_id, gate): the status a gate settles before any answer is drafted, null where none
    does. In order: an empty question, its scope, wording that may not be reproduced, a question
    too unspecific, evidence too thin, evidence without the question's subject."""
    g = answering.gates(questions, evidence)
    s = answering.scope(questions, inside, outside) if outside else questions.select("question_id", F.lit(True).alias("in_scope"))
    r = answering.reproduction(questions, sources)
    rows = questions.join(g, "question_id").join(s.select("question_id", "in_scope"), "question_id").join(r, "question_id", "left")
    gate = (
        F.when(F.trim(F.coalesce("question", F.lit(""))) == "", "error").when(~F.col("in_scope"), "out_of_scope").when(F.col("refused_for").isNotNull(), "insufficient_evidence")
        .when(~F.col("specific"), "ambiguous").when(~F.col("sufficient") | (F.col("missing_share") >= answering.MAX_MISSING_SUBJECT), "insufficient_evidence")
    )
    return rows.select("question_id", gate.alias("gate"))


def ask(questions: DataFrame, evidence: DataFrame, sources: DataFrame, inside: tuple[str, ...] = (), outside: tuple[str, ...] = (), drafts: DataFrame | None = None) -> DataFrame:
    """(question_id, status, answer, grounded_ratio, citation_validity, confidence_score, confidence).

    Drafts (question_id, answer) come from the caller's model, or are put together from the
    evidence. A model's draft that says the evidence does not suffice is an abstention. A draft is withheld if too many of its sentences lack support or it does not take
    up the question. Questions a gate settles are never drafted."""
    gated = materialise(prepare(questions, evidence, sources, inside, outside), "gates")
    open_ = questions.join(gated.where("gate is null").select("question_id"), "question_id", "left_semi")
    own = drafts is None
    if own:
        drafts = answering.extractive_answers(answering.extractive_scores(open_, evidence))
    drafts = materialise(drafts.join(open_.select("question_id"), "question_id", "left_semi"), "drafts")
    texts = drafts.select(F.col("question_id").alias("answer_id"), "question_id", F.col("answer").alias("text"))
    grounded = materialise(answering.ground(texts, evidence), "grounded")
    checked = (
        drafts.join(answering.ratios(grounded).withColumnRenamed("answer_id", "question_id"), "question_id", "left")
        .join(answering.responsive(texts, questions, evidence).withColumnRenamed("answer_id", "question_id"), "question_id", "left")
        .join(answering.confidence(grounded, texts, evidence, answering.contradictions(evidence)).withColumnRenamed("answer_id", "question_id"), "question_id", "left")
    )
    rows = questions.select("question_id").join(gated, "question_id").join(checked, "question_id", "left")
    status = (
        F.when(F.col("gate").isNotNull(), F.col("gate")).when(F.col("answer").isNull(), "insufficient_evidence")
        .when(F.lit(not own) & looks_abstained(F.col("answer")), "insufficient_evidence")
        .when(1 - F.coalesce("grounded_ratio", F.lit(1.0)) > MAX_UNSUPPORTED, "unsupported").when(~F.coalesce("responsive", F.lit(True)), "irrelevant").otherwise("answered")
    )
    shown = F.when(status == "answered", F.col("answer"))
    return rows.select("question_id", status.alias("status"), shown.alias("answer"), "grounded_ratio", "citation_validity", "confidence_score", "confidence")


# What a model says that abstains.
ABSTENTION = (
    "not sufficient to answer", "does not establish", "insufficient evidence", "no evidence", "cannot be answered", "evidence does not", "not enough evidence", "unable to answer",
)
_ANSWER = r"(?im)^[ \t]*ANSWER[ \t]*:?[ \t]*$"
_REASONING = r"(?im)^[ \t]*(?:REASONING|EXPLANATION)[ \t]*:?[ \t]*$"


def looks_abstained(text: Column) -> Column:
    return T.contains_any(F.lower(text), ABSTENTION)


def split_sections(text: Column) -> Column:
    """Struct (answer, reasoning) of a model's reply: what follows a line ANSWER, up to a line REASONING or
    EXPLANATION; a reply without such lines is all answer."""
    ends = F.lit(" \t\n\x0b\f\r")
    body = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), "\u00a0", " "), ends)
    body = F.element_at(F.split(body, _ANSWER, 2), -1)
    parts = F.split(body, _REASONING, 2)
    return F.struct(F.trim(parts[0], ends).alias("answer"), F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), ends).alias("reasoning"))


def limitations(answers: DataFrame, grounded: DataFrame, evidence: DataFrame, declared: tuple[str, ...] = ()) -> DataFrame:
    """(question_id, limitations): what an answered question's reader should know: the declared limits,
    a single source, sentences without support, sources without a date (evidence: published_at)."""
    cited = grounded.select(F.col("answer_id").alias("question_id"), F.explode("eff").alias("rank")).distinct().join(evidence.select("question_id", "rank", "source_id", "published_at"), ["question_id", "rank"])
    per = cited.groupBy("question_id").agg(F.countDistinct("source_id").alias("sources"), F.max(F.col("published_at").isNull()).alias("undated"))
    bad = grounded.where("supported = false").groupBy(F.col("answer_id").alias("question_id")).agg(F.count("*").alias("bad"))
    rows = answers.where("status = 'answered'").select("question_id").join(per, "question_id", "left").join(bad, "question_id", "left")
    notes = F.array_compact(F.array(
        *[F.lit(x) for x in declared], F.when(F.col("sources") == 1, "rests on a single source"), F.when(F.col("bad") > 0, F.concat(F.col("bad").cast("string"), F.lit(" sentence(s) without support"))),
        F.when(F.col("undated"), "a cited source carries no date"),
    ))
    return rows.select("question_id", notes.alias("limitations"))


def read_fields(passages: DataFrame, labels: DataFrame) -> DataFrame:
    """(question_id, rank, values): for each question's labels (question_id, label, place) the distinct
    values official records give, in the order of the labels."""
    pairs = passages.select("chunk_id", F.explode(T.field_pairs("text")).alias("p")).select("chunk_id", F.lower("p.label").alias("key"), "p.value")
    met = labels.withColumn("key", F.lower("label")).join(pairs, "key")
    one = met.groupBy("question_id", "place", "label", "value").agg(F.min("chunk_id").alias("chunk_id"))
    listed = one.groupBy("question_id", "place", "label").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "value"))).alias("vs"))
    return listed.select("question_id", F.col("place").alias("rank"), "label", F.transform("vs", lambda v: v["value"]).alias("values"))


def answer_from_fields(fields: DataFrame, most: int = 8) -> DataFrame:
    """(question_id, answer): one sentence per label, at most ``most`` values and how many more there are."""
    more = F.when(F.size("values") > most, F.concat(F.lit(" and "), (F.size("values") - most).cast("string"), F.lit(" more"))).otherwise("")
    said = F.concat(F.col("label"), F.lit(": "), F.array_join(F.slice("values", 1, most), ", "), more, F.lit("."))
    rows = fields.select("question_id", F.struct("rank", said.alias("s")).alias("e")).groupBy("question_id").agg(F.array_sort(F.collect_list("e")).alias("es"))
    return rows.select("question_id", F.array_join(F.transform("es", lambda e: e["s"]), " ").alias("answer"))
