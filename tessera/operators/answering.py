"""Checks around an answer: gates over question and evidence, grounding of each sentence,
contradictions, extractive drafting, confidence, and verdicts on outside claims.

Evidence is at most ``top_k`` passages a question; it travels as one array per question, so the
checks are column expressions over a row and nothing is compared across questions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions import constants as C
from tessera.functions import text as T
from tessera.operators.retrieval import small
from tessera.session import materialise

MIN_SUPPORT = 0.34
MIN_QUESTION_COVERAGE = 0.3
MAX_MISSING_SUBJECT = 0.5
#: Source types that speak about themselves.
SELF_TYPES = ("company_page", "self_published")
#: Source types that are about their subject whether or not a passage names it.
ABOUT_TYPES = (*SELF_TYPES, "official_record")
LABEL_WORDS = 5
#: Up to so many questions' terms, figures or weights (some kilobytes each) are sent to every task.
BROADCAST_QUESTIONS = 20_000


def bundle(evidence: DataFrame) -> DataFrame:
    """(question_id, ev): the evidence (question_id, rank, source_id, authority, text) of a question
    as an array in rank order, each item with its terms, figures and lower-case text."""
    low = F.lower("text")
    item = F.struct("rank", "source_id", "authority", T.content_terms("text").alias("terms"), T.numbers_with_units(low).alias("numbers"), low.alias("low"))
    return evidence.select("question_id", item.alias("e")).groupBy("question_id").agg(F.array_sort(F.collect_list("e")).alias("ev"))


def rarity(term: Column, ev: Column) -> Column:
    """Weight of a question term by the number of passages that hold it."""
    held = F.size(F.filter(ev, lambda e: F.array_contains(e["terms"], term)))
    return F.log(1.0 + F.greatest(F.lit(1), F.size(ev)) / (1.0 + held))


def weights(terms: Column, ev: Column) -> Column:
    """Array (t, w) of the question's terms and their weights, to be computed once a question."""
    return F.transform(terms, lambda t: F.struct(t.alias("t"), rarity(t, ev).alias("w")))


def weighted_share(of: Column, chosen: Column) -> Column:
    """Share of the weight ``of`` a question's terms that ``chosen`` (a set of terms) carries; 0 without."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x["w"])
    return F.when(total(of) > 0, total(F.filter(of, lambda x: F.array_contains(chosen, x["t"]))) / total(of)).otherwise(F.lit(0.0))


def scope(questions: DataFrame, inside: tuple[str, ...], outside: tuple[str, ...]) -> DataFrame:
    """(question_id, in_score, out_score, in_scope): out of scope if an outside topic is covered by
    half or more and better than any inside topic."""
    terms = T.content_terms("question")
    best = lambda topics: F.greatest(F.lit(0.0), *[T.coverage(T.content_terms(F.lit(t)), F.col("terms")) for t in topics])
    q = questions.select("question_id", terms.alias("terms"))
    scores = q.select("question_id", F.when(F.size("terms") > 0, best(inside)).otherwise(0.0).alias("in_score"), F.when(F.size("terms") > 0, best(outside)).otherwise(0.0).alias("out_score"))
    return scores.withColumn("in_scope", ~((F.col("out_score") >= 0.5) & (F.col("out_score") > F.col("in_score"))))


def reproduction(questions: DataFrame, sources: DataFrame) -> DataFrame:
    """(question_id, refused_for): the pointer source (not mirrored) whose title or id shares a term
    with a digit with a question that asks for wording; highest authority, then id, first."""
    asked = questions.where(T.contains_any(F.lower("question"), C.VERBATIM_CUES)).select("question_id", F.explode(T.content_terms("question")).alias("term")).where(F.col("term").rlike(r"\d"))
    names = T.content_terms(F.concat_ws(" ", "title", F.translate("source_id", "-", " ")))
    held = sources.where("not mirrored").select("source_id", "authority", F.explode(names).alias("term"))
    order = F.struct((-F.col("authority")).alias("a"), F.col("source_id"))
    return asked.join(held, "term").groupBy("question_id").agg(F.min_by("source_id", order).alias("refused_for"))


def gates(questions: DataFrame, evidence: DataFrame, min_chunks: int = 1, min_score: float = 0.01) -> DataFrame:
    """(question_id, n_terms, specific, n_evidence, sufficient, missing_share, missing): the gates
    between a question and its evidence. A question without evidence misses nothing but is not
    sufficient."""
    frame = F.array(*[F.lit(w) for w in C.QUESTION_FRAME])
    frame = F.transform(frame, T.stem)
    q = questions.select("question_id", T.content_terms("question").alias("terms")).withColumn("subject", F.array_except("terms", frame))
    tops = evidence.groupBy("question_id").agg(F.max("score").alias("top"))
    rows = q.join(bundle(evidence), "question_id", "left").join(tops, "question_id", "left").withColumn("ev", F.coalesce("ev", F.array()))
    absent = F.filter("subject", lambda t: ~F.exists(F.col("ev"), lambda e: F.array_contains(e["terms"], t)))
    rows = rows.withColumn("missing", F.when(F.size("ev") > 0, F.array_sort(absent)).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("weights", weights(F.col("subject"), F.col("ev")))
    share = F.round(weighted_share(F.col("weights"), F.col("missing")), 6)
    return rows.select(
        "question_id", F.size("terms").alias("n_terms"), (F.size("terms") >= 3).alias("specific"), F.size("ev").alias("n_evidence"),
        ((F.size("ev") >= min_chunks) & (F.coalesce("top", F.lit(0.0)) >= min_score)).alias("sufficient"), share.alias("missing_share"), F.array_join("missing", " ").alias("missing"),
    )


def responsive(answers: DataFrame, questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """(answer_id, addressed, responsive): share of the question's weight that an answer takes up."""
    q = questions.select("question_id", T.content_terms("question").alias("terms")).join(bundle(evidence), "question_id", "left")
    q = small(q.select("question_id", "terms", F.when(F.col("ev").isNotNull(), weights(F.col("terms"), F.col("ev"))).alias("weights")), BROADCAST_QUESTIONS)
    rows = answers.select("answer_id", "question_id", T.content_terms("text").alias("said")).join(q, "question_id")
    # without evidence the answer itself is the one passage that terms are weighed by
    own = F.transform("terms", lambda t: F.struct(t.alias("t"), F.log(1.0 + 1.0 / (1.0 + F.array_contains("said", t).cast("int"))).alias("w")))
    share = weighted_share(F.coalesce("weights", own), F.col("said"))
    idle = (F.size("terms") == 0) | (F.size("said") == 0)
    addressed = F.round(F.when(idle, F.lit(0.0)).otherwise(share), 6)
    return rows.select("answer_id", addressed.alias("addressed"), (idle | (addressed >= MIN_QUESTION_COVERAGE)).alias("responsive"))


def ground(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """(answer_id, sentence_no, n_citations, n_invalid, is_claim, supported, support, reason): each
    sentence of an answer against the evidence it cites.

    Sentences about the answer are left out. A sentence of fewer than three terms is no claim but
    its citations count. Uncited claims inherit the citations of the claim before them; without
    any they need the words of the evidence as a whole. Cited claims need the words, every
    figure (with its unit, or its bare value) and every quotation of what they cite."""
    own = W.partitionBy("answer_id").orderBy("sentence_no")
    s = answers.where("text is not null").select("answer_id", "question_id", F.posexplode(T.sentences(T.normalise("text"))).alias("sentence_no", "sentence"))
    s = s.select("answer_id", "question_id", "sentence_no", F.trim("sentence").alias("sentence"), T.citations("sentence").alias("cits"), F.trim(T.strip_citations("sentence")).alias("bare"))
    s = s.select("*", T.content_terms("bare").alias("terms"), T.numbers_with_units("bare").alias("numbers"), T.quoted_spans("bare").alias("quotes"))
    s = s.select("*", T.is_meta_of(F.col("sentence"), F.col("terms"), F.col("numbers"), F.col("quotes")).alias("meta"), (F.size("terms") >= 3).alias("is_claim"))
    named = F.when(~F.col("meta") & F.col("is_claim") & (F.size("cits") > 0), F.col("cits"))
    # sentences travel alone; the evidence meets them after
    s = s.withColumn("carried", F.last(named, ignorenulls=True).over(own.rowsBetween(W.unboundedPreceding, -1))).where(~F.col("meta")).drop("meta", "sentence")
    item = F.struct("rank", T.content_terms("text").alias("terms"), T.numbers_with_units(F.lower("text")).alias("numbers"))
    ev = evidence.select("question_id", item.alias("e")).groupBy("question_id").agg(F.array_sort(F.collect_list("e")).alias("ev"))
    s = s.join(small(ev, BROADCAST_QUESTIONS), "question_id", "left").withColumn("ev", F.coalesce("ev", F.array()))
    n = F.size("ev")
    valid = lambda xs: F.filter(xs, lambda c: (c >= 1) & (c <= n))
    s = s.withColumn("eff", F.when(F.size(valid(F.col("cits"))) > 0, valid(F.col("cits"))).otherwise(valid(F.coalesce("carried", F.array().cast("array<int>")))))
    s = s.withColumn("cited", F.filter("ev", lambda e: (F.size("eff") == 0) | F.array_contains("eff", e["rank"])))
    support = F.round(T.coverage(F.col("terms"), F.array_distinct(F.flatten(F.transform("cited", lambda e: e["terms"])))), 6)
    s = s.withColumn("support", support).withColumn("figures", F.array_distinct(F.flatten(F.transform("cited", lambda e: e["numbers"])))).withColumn("n_ev", n).drop("ev", "cited", "terms")
    bare_figures = F.transform("figures", T.magnitude)
    wrong = F.exists("numbers", lambda x: ~F.array_contains("figures", x) & ~F.array_contains(bare_figures, T.magnitude(x)))
    # the passages' text is fetched for the few sentences that quote
    texts = evidence.select(F.col("question_id").alias("quoted_in"), F.struct("rank", F.lower("text").alias("low")).alias("e")).groupBy("quoted_in").agg(F.collect_list("e").alias("lows"))
    s = s.withColumn("quoted_in", F.when(F.size("quotes") > 0, F.col("question_id"))).join(small(texts, BROADCAST_QUESTIONS // 10), "quoted_in", "left")
    heard = F.filter(F.coalesce("lows", F.array()), lambda e: (F.size("eff") == 0) | F.array_contains("eff", e["rank"]))
    unquoted = F.exists("quotes", lambda x: ~F.exists(heard, lambda e: F.contains(e["low"], x)))
    n = F.col("n_ev")
    low = F.col("support") < MIN_SUPPORT
    reason = (
        F.when(~F.col("is_claim"), F.lit(None).cast("string"))
        .when(F.size("eff") == 0, F.when(low, "no citation").otherwise(""))
        .when(unquoted, "quotation").when(wrong, "figure").when(low, "support").otherwise("")
    )
    s = s.withColumn("reason", reason)
    return s.select(
        "answer_id", "sentence_no", F.size("cits").alias("n_citations"), F.size(F.filter("cits", lambda c: (c < 1) | (c > n))).alias("n_invalid"), "is_claim",
        F.when(F.col("is_claim"), F.col("reason") == "").alias("supported"), F.when(F.col("is_claim"), F.col("support")).alias("support"), "reason", F.array_distinct("eff").alias("eff"),
    )


def ratios(grounded: DataFrame) -> DataFrame:
    """(answer_id, claims, grounded_ratio, citation_validity) of the sentences of ``ground``; an answer
    without claims is grounded, one without citations valid."""
    g = grounded.groupBy("answer_id").agg(
        F.count(F.when(F.col("is_claim"), 1)).alias("claims"), F.avg(F.col("supported").cast("int")).alias("g"), F.sum("n_citations").alias("c"), F.sum("n_invalid").alias("i")
    )
    return g.select("answer_id", "claims", F.round(F.coalesce("g", F.lit(1.0)), 6).alias("grounded_ratio"), F.round(F.when(F.col("c") > 0, 1 - F.col("i") / F.col("c")).otherwise(1.0), 6).alias("citation_validity"))


def contradictions(evidence: DataFrame, min_overlap: float = 0.5) -> DataFrame:
    """(question_id, rank_a, rank_b, unit): pairs of a question's passages from different sources that
    share half of the first one's terms and give disjoint figures for a unit (the least such)."""
    b = evidence.select("question_id", "rank", "source_id", T.content_terms("text").alias("terms"), T.numbers_with_units("text").alias("numbers"))
    side = lambda n: b.select("question_id", *[F.col(c).alias(f"{c}_{n}") for c in ("rank", "source_id", "terms", "numbers")])
    pairs = side("a").join(side("b"), "question_id").where("rank_a < rank_b and source_id_a != source_id_b")
    pairs = pairs.where(T.coverage(F.col("terms_a"), F.col("terms_b")) >= min_overlap)
    unit = lambda x: F.regexp_extract(x, "[a-z°%]+$", 0)
    common = F.array_intersect(F.transform("numbers_a", unit), F.transform("numbers_b", unit))
    of = lambda side_, u: F.filter(side_, lambda x: unit(x) == u)
    against = F.filter(common, lambda u: (u != "") & ~F.arrays_overlap(of("numbers_a", u), of("numbers_b", u)))
    return pairs.select("question_id", "rank_a", "rank_b", F.array_min(against).alias("unit")).where("unit is not null")


def extractive_scores(questions: DataFrame, evidence: DataFrame, min_score: float = 0.3) -> DataFrame:
    """(question_id, rank, position, sentence, score): evidence sentences fit to answer a question,
    scored by the weight of the question's terms they hold."""
    q = questions.select("question_id", F.lower("question").alias("asked"), T.content_terms("question").alias("terms")).join(bundle(evidence), "question_id")
    q = small(materialise(q.select("question_id", "asked", weights(F.col("terms"), F.col("ev")).alias("weights")), "weights"), BROADCAST_QUESTIONS)
    each = evidence.select("question_id", "rank", F.posexplode(T.sentences(T.strip_footnotes("text"))).alias("position", "sentence")).withColumn("sentence", F.trim("sentence")).where(T.is_prose("sentence"))
    rows = each.withColumn("said", T.content_terms("sentence")).join(q, "question_id")
    share = weighted_share(F.col("weights"), F.col("said"))
    damp = 1.0 / (1.0 + 0.003 * F.greatest(F.lit(0), F.length("sentence") - 160))
    figure = F.when(T.contains_any(F.col("asked"), C.NUMERIC_CUES) & (F.size(T.numbers_with_units("sentence")) > 0), 1.6).otherwise(1.0)
    duty = F.when(T.contains_any(F.col("asked"), C.REQUIREMENT_CUES) & T.contains_any(F.lower("sentence"), C.REQUIREMENT_WORDS), 1.4).otherwise(1.0)
    scored = rows.select("question_id", "rank", "position", "sentence", F.round(share * damp * figure * duty, 6).alias("score"))
    return scored.where(F.col("score") >= min_score)


def extractive_answers(scored: DataFrame, most: int = 5) -> DataFrame:
    """(question_id, answer): the best sentences with their [rank], in evidence order. The choice is
    sequential (at most two of a passage once two are chosen), so it runs over one question's
    scored sentences, a few dozen, in Python."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for rows in pdf["rows"]:
                chosen, seen, of_rank = [], set(), {}
                for r in sorted(rows, key=lambda r: (-r["score"], r["rank"], r["position"])):
                    key = r["sentence"].lower()
                    if key in seen or (of_rank.get(r["rank"], 0) >= 2 and len(chosen) >= 2):
                        continue
                    seen.add(key)
                    of_rank[r["rank"]] = of_rank.get(r["rank"], 0) + 1
                    chosen.append((r["rank"], r["position"], r["sentence"]))
                    if len(chosen) == most:
                        break
                out.append(" ".join(f"{s} [{rank}]" for rank, _, s in sorted(chosen)))
            yield pd.DataFrame({"question_id": pdf["question_id"], "answer": out})

    rows = scored.groupBy("question_id").agg(F.collect_list(F.struct("score", "rank", "position", "sentence")).alias("rows"))
    return rows.mapInPandas(run, "question_id string, answer string")


def confidence(grounded: DataFrame, answers: DataFrame, evidence: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(answer_id, confidence_score, confidence): how far an answer may be relied on, from grounding,
    citations, authority and number of the sources cited, and agreement of the retrievers; none without
    evidence."""
    cited = grounded.where("size(eff) > 0").select("answer_id", F.explode("eff").alias("rank")).distinct()
    ev = evidence.select("question_id", "rank", "source_id", "authority", F.size(F.split("retrievers", ",")).alias("n_ret"))
    keyed = answers.select("answer_id", "question_id")
    # an answer that cites nothing is judged by all its evidence
    every = keyed.join(cited.select("answer_id").distinct(), "answer_id", "left_anti").join(ev.select("question_id", "rank"), "question_id").select("answer_id", "rank")
    rows = keyed.join(cited.unionByName(every), "answer_id").join(ev, ["question_id", "rank"])
    per = rows.groupBy("answer_id").agg(F.avg("authority").alias("authority"), F.countDistinct("source_id").alias("sources"), F.avg(F.col("n_ret") / 4.0).alias("agreement"))
    odd = conflicts.select("question_id").distinct().withColumn("odd", F.lit(True))
    all_ = answers.select("answer_id", "question_id").join(ratios(grounded), "answer_id").join(per, "answer_id", "left").join(odd, "question_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    score = (
        0.35 * F.col("grounded_ratio") + 0.25 * F.col("citation_validity") + 0.20 * zero(F.col("authority") / 5)
        + 0.10 * zero(F.least(F.lit(1.0), F.col("sources") / 2)) + 0.10 * zero(F.least(F.lit(1.0), F.col("agreement") * 2))
    )
    score = F.when(F.col("authority").isNull(), 0.0).otherwise(F.round(F.when(F.col("odd"), score * 0.75).otherwise(score), 6))
    return all_.select("answer_id", score.alias("confidence_score")).withColumn("confidence", F.when(F.col("confidence_score") == 0, "none").when(F.col("confidence_score") >= 0.75, "high").when(F.col("confidence_score") >= 0.55, "medium").otherwise("low"))


def verify(claims: DataFrame, passages: DataFrame, sources: DataFrame, subject: str | None = None, denied: DataFrame | None = None) -> DataFrame:
    """(claim_id, n_terms, sources, own, independent, verdict): what the held sources say of outside
    claims (claim_id, claim). Claim and passages meet through their terms; a passage supports a claim
    if it holds all of up to three terms, or 0.6 of more. Independent support needs a sentence
    that states it; support of a subject's own pages alone is self reported, or a label if it
    stands in short lines only.

    With a ``subject``, passages of sources that are not about it by their kind count only where they
    name it, and so must a stating sentence. ``denied`` (claim_id, source_id) are the sentences a
    model has read and not confirmed; they state nothing."""
    rows = support(claims, passages, sources, subject)
    if denied is not None:
        no = denied.select("claim_id", "source_id").distinct().withColumn("no", F.lit(True))
        rows = rows.join(no, ["claim_id", "source_id"], "left").withColumn("stated", F.when(F.coalesce("no", F.lit(False)), F.lit(None)).otherwise(F.col("stated")))
    per = rows.groupBy("claim_id").agg(
        F.count("*").alias("sources"), F.count(F.when(F.col("own"), 1)).alias("own"), F.count(F.when(~F.col("own") & F.col("stated").isNotNull(), 1)).alias("independent"),
        F.sum(F.when(F.col("own"), F.col("lines")).otherwise(0)).alias("lines"), F.max(F.col("own") & F.col("long_line")).alias("long_line"),
    )
    out = claims.select("claim_id", F.size(T.content_terms("claim")).alias("n_terms")).join(per, "claim_id", "left").na.fill(0, ["sources", "own", "independent", "lines"])
    verdict = (
        F.when((F.col("independent") > 0) & (F.col("n_terms") > 1), "corroborated").when(F.col("own") == 0, "not_found")
        .when((F.col("n_terms") <= 3) & (F.col("lines") > 0) & ~F.coalesce("long_line", F.lit(False)), "label_only").otherwise("self_reported")
    )
    return out.select("claim_id", "n_terms", "sources", "own", "independent", verdict.alias("verdict"))


#: Claims counted at once; with as many passages as ``_PASSAGES`` they bound a task's matrix.
CLAIMS, _PASSAGES = 1000, 4000


def _carried(claims: DataFrame, passages: DataFrame) -> DataFrame:
    """(claim_id, chunk_id, support): passages that hold enough of a claim's terms. The claims are the
    stated set and go to the tasks in blocks; a task counts a block's terms over its passages in a
    matrix and gives the pairs that suffice, so nothing is shuffled."""
    spark = claims.sparkSession
    schema = "claim_id string, chunk_id string, support double"
    asked = [(r["claim_id"], r["terms"]) for r in claims.where("n_terms > 0").select("claim_id", "terms").toLocalIterator()]
    terms = passages.select("chunk_id", T.content_terms(F.concat_ws(" ", "section", "text")).alias("t"))
    if len(asked) > CLAIMS:
        terms = materialise(terms, "passage-terms")

    def against(part: list[tuple[str, list[str]]]) -> DataFrame:
        number: dict[str, int] = {}
        of_term: dict[int, list[int]] = {}
        for i, (_, ts) in enumerate(part):
            for t in ts:
                of_term.setdefault(number.setdefault(t, len(number)), []).append(i)
        sizes = np.array([len(ts) for _, ts in part])
        shared = spark.sparkContext.broadcast(([k for k, _ in part], number, {t: np.array(v) for t, v in of_term.items()}, sizes))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, number, of_term, sizes = shared.value
            need = np.where(sizes <= 3, 1.0, 0.6)[:, None] * sizes[:, None] - 1e-9
            for whole in batches:
                for at in range(0, len(whole), _PASSAGES):
                    pdf = whole.iloc[at : at + _PASSAGES]
                    row = np.repeat(np.arange(len(pdf)), pdf["t"].map(len).to_numpy())
                    term = np.fromiter((number.get(t, -1) for ts in pdf["t"] for t in ts), dtype=np.int64, count=len(row))
                    order = np.argsort(term, kind="stable")
                    names, begin = np.unique(term[order], return_index=True)
                    met = np.zeros((len(ids), len(pdf)), dtype=np.int32)
                    for t, i, j in zip(names.tolist(), begin, [*begin[1:], len(order)]):
                        if t >= 0:
                            met[np.ix_(of_term[t], row[order[i:j]])] += 1
                    q, c = np.nonzero(met >= need)
                    yield pd.DataFrame({"claim_id": np.array(ids, dtype=object)[q], "chunk_id": pdf["chunk_id"].to_numpy()[c], "support": met[q, c] / sizes[q]})

        return terms.mapInPandas(run, schema)

    found = spark.createDataFrame([], schema)
    for at in range(0, len(asked), CLAIMS):
        found = found.unionByName(against(asked[at : at + CLAIMS]))
    return found.withColumn("support", F.round("support", 6))


def support(claims: DataFrame, passages: DataFrame, sources: DataFrame, subject: str | None = None) -> DataFrame:
    """(claim_id, source_id, own, chunk_id, support, stated, lines, long_line, unconfirmed): each source that
    supports a claim, by its best passage (most of the claim's terms, then the least id), with the
    first sentence of its supporting passages that states the claim, the lines of its own pages that
    hold it, and whether the source's identity is unconfirmed by its tags."""
    c = claims.select("claim_id", "claim", T.content_terms("claim").alias("terms")).withColumn("n_terms", F.size("terms"))
    supporting = materialise(_carried(c, passages), "supporting")
    tags = F.coalesce("tags", F.lit("")) if "tags" in sources.columns else F.lit("")
    kind = sources.select(
        "source_id", F.col("source_type").isin(list(SELF_TYPES)).alias("own"), F.col("source_type").isin(list(ABOUT_TYPES)).alias("about"), F.contains(tags, F.lit("identity-unconfirmed")).alias("unconfirmed")
    ).dropDuplicates(["source_id"])
    # a passage is cut and its pieces' terms are taken once, however many claims it supports
    pieces = F.filter(F.transform(F.split("text", r"(?<=[.!?])\s+|\n+|\s+\|\s+", -1), lambda x: F.trim(x)), lambda x: x != "")
    cut = passages.join(supporting.select("chunk_id").distinct(), "chunk_id", "left_semi").select(
        "chunk_id", "source_id", "section", "text", F.transform(pieces, lambda x: F.struct(x.alias("p"), T.content_terms(x).alias("t"), T.padded_words(x).alias("w"))).alias("pieces")
    )
    rows = supporting.join(cut.join(kind, "source_id"), "chunk_id").join(small(materialise(c, "claims"), BROADCAST_QUESTIONS), "claim_id")
    if subject:
        rows = rows.where(F.col("about") | F.contains(F.lower("text"), F.lit(subject.lower())))
    rows = rows.withColumn("phrase", T.padded_words("claim"))
    told = lambda x: F.when(F.col("n_terms") <= 3, F.contains(x["w"], F.col("phrase"))).otherwise(T.coverage(F.col("terms"), x["t"]) >= 0.6)
    named = (lambda x: told(x) & F.contains(x["w"], T.padded_words(F.lit(subject)))) if subject else told
    # only a subject's own pages are read for labels
    lines = F.when(F.col("own"), F.filter(F.split(F.concat_ws("\n", "section", "text"), "\n", -1), lambda x: F.contains(F.lower(x), F.lower("claim")))).otherwise(F.array().cast("array<string>"))
    long_line = F.exists(lines, lambda x: F.size(F.split(F.trim(x), r"\s+", -1)) > LABEL_WORDS)
    rows = rows.select("claim_id", "source_id", "own", "unconfirmed", "chunk_id", "support", F.get(F.filter("pieces", named), F.lit(0))["p"].alias("stated"), F.size(lines).alias("lines"), long_line.alias("long_line"))
    best = F.struct((-F.col("support")).alias("s"), "chunk_id")
    return rows.groupBy("claim_id", "source_id", "own", "unconfirmed").agg(
        F.min_by("chunk_id", best).alias("chunk_id"), F.max("support").alias("support"), F.min_by("stated", F.when(F.col("stated").isNotNull(), F.col("chunk_id"))).alias("stated"), F.sum("lines").alias("lines"), F.max("long_line").alias("long_line")
    )
