"""What a store keeps beside its documents: settings, runs, versions and who may see what."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import constants as C
from tessera.operators import register


def set_meta(meta: DataFrame, values: dict[str, str]) -> DataFrame:
    """(key, value) with ``values`` put in."""
    return register.upsert(meta, meta.sparkSession.createDataFrame(list(values.items()), "key string, value string"), ["key"])


def get_meta(meta: DataFrame, key: str, default: str | None = None) -> str | None:
    row = meta.where(F.col("key") == key).first()
    return row["value"] if row else default


def replace_documents(documents: DataFrame, chunks: DataFrame, new_documents: DataFrame, new_chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks after new versions of some sources' documents: all documents of a source in
    ``new_documents`` go with their chunks, and the new ones come."""
    sources = new_documents.select("source").distinct()
    old = documents.join(sources, "source", "left_anti").unionByName(new_documents.select(*documents.columns))
    kept = chunks.join(documents.join(sources, "source", "left_semi").select(F.col("doc_id").alias("document_id")), "document_id", "left_anti")
    return old, kept.unionByName(new_chunks.select(*chunks.columns))


def persist_runs(runs: DataFrame, new: DataFrame) -> DataFrame:
    """Results (run_id, question_id, ...) with those of new runs in the place of the same run's old ones."""
    return runs.join(new.select("run_id").distinct(), "run_id", "left_anti").unionByName(new.select(*runs.columns))


def publish_reasons(version: str, report_version: str, passed: bool, moves: DataFrame, newly_failing: DataFrame, force: bool = False) -> tuple[bool, list[str]]:
    """(published, reasons) of a version: its report must be its own and pass, no gated metric may have
    regressed (moves: metric, regressed) and no question may fail newly. ``force`` publishes all the
    same, and the reasons say so."""
    reasons = [] if version == report_version else [f"the report is of {report_version}, not of {version}"]
    reasons += [] if passed else ["the evaluation did not pass"]
    gated = [m for m, (_, gate) in C.METRICS.items() if gate]
    reasons += [f"{r['metric']} regressed" for r in moves.where("regressed").where(F.col("metric").isin(gated)).orderBy("metric").collect()]  # at most one a metric
    failing = newly_failing.count()
    reasons += [f"{failing} question(s) newly failing"] if failing else []
    if reasons and force:
        return True, [*reasons, "published with force"]
    return not reasons, reasons


def history(versions: DataFrame) -> DataFrame:
    """Published versions (version, status, published_at), the newest first; ties by version."""
    return versions.where("status = 'published'").orderBy(F.desc("published_at"), F.desc("version"))


def rollback(versions: DataFrame, serving: str, to: str | None = None) -> tuple[DataFrame, str | None]:
    """(versions, now serving): the serving version is marked as rolled back and ``to``, or the latest
    other version that was once published, serves again; without one nothing changes."""
    once = versions.where(F.col("status").isin("published", "rolled_back") & (F.col("version") != serving))
    if to is None:
        row = once.orderBy(F.desc("published_at"), F.desc("version")).first()
    else:
        row = versions.where(F.col("version") == to).first()
    if row is None:
        return versions, None
    status = F.when(F.col("version") == row["version"], "published").when(F.col("version") == serving, "rolled_back").otherwise(F.col("status"))
    return versions.withColumn("status", status), row["version"]


def visible(areas: DataFrame, tenant: str | None) -> DataFrame:
    """Rows (visibility, tenant, ...) a tenant may see: public ones and its own; nobody sees the private
    rows of nobody."""
    own = F.lit(False) if tenant is None else F.coalesce(F.col("tenant") == tenant, F.lit(False))
    return areas.where((F.col("visibility") == "public") | own)


def area_report(sources: DataFrame, documents: DataFrame, chunks: DataFrame, claims: DataFrame, results: DataFrame, challenges: DataFrame, as_of: F.Column) -> DataFrame:
    """(part, name, value) of a knowledge area: its corpus, coverage, results by type and challenges."""
    number = lambda part, name, c: (F.lit(part).alias("part"), F.lit(name).alias("name"), c.cast("double").alias("value"))
    counted = [("documents", documents), ("chunks", chunks), ("claims", claims)]
    rows = [df.agg(F.count("*").alias("n")).select(*number("corpus", n, F.col("n"))) for n, df in counted]
    of = {"sources": F.lit(True), "indexed_sources": F.col("status") == "indexed", "pointer_sources": ~F.col("mirrored"), "failed_sources": F.col("status") == "failed"}
    wide = sources.agg(*[F.count(F.when(c, 1)).alias(n) for n, c in of.items()])
    rows += [wide.select(*number("corpus", n, F.col(n))) for n in of]
    rows.append(register.freshness(sources, as_of).select(*number("corpus", "freshness_days", F.col("median_days"))))
    coverage = register.coverage_report(sources).where("value is not null")
    rows.append(coverage.select(F.concat(F.lit("coverage "), "facet").alias("part"), F.col("value").alias("name"), F.col("n").cast("double").alias("value")))
    rows.append(results.groupBy("qtype").agg(F.avg(F.col("passed").cast("int")).alias("r")).select(F.lit("pass rate").alias("part"), F.col("qtype").alias("name"), F.round("r", 6).alias("value")))
    stats = register.challenge_stats(challenges).where("status is not null")
    rows.append(stats.select(F.lit("challenges").alias("part"), F.col("status").alias("name"), F.col("n").cast("double").alias("value")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def chunks_by_type(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_type, chunks): sections by their source's type; those of unregistered sources are left out."""
    kinds = sources.select("source_id", "source_type").dropDuplicates(["source_id"])
    return chunks.groupBy("source_id").agg(F.count("*").alias("n")).join(kinds, "source_id").groupBy("source_type").agg(F.sum("n").alias("chunks"))


def source_claims(claims: DataFrame, passages: DataFrame, first: int = 200) -> DataFrame:
    """(source_id, claim_id, kind): the first claims of each source by id, as its page lists them."""
    rows = claims.join(passages.select("chunk_id", "source_id").where("source_id is not null"), "chunk_id").select("source_id", "claim_id", "kind").distinct()
    return register.first_of(rows, "source_id", [F.asc("claim_id"), F.asc("kind")], first)


def pointers(sources: DataFrame) -> DataFrame:
    """(source_id, title, publisher, licence, authority) of the sources that are named and not held,
    those of most authority first."""
    return sources.where(~F.col("mirrored")).select("source_id", "title", "publisher", "licence", "authority").orderBy(F.desc("authority"), "source_id")


def served(requests: DataFrame, answers: DataFrame, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(question_id, text, provider): the queue's answer to each request (answers: request_id, text,
    provider), else that of ``ask``, which is given the requests without one and gives
    (question_id, text, provider)."""
    held = requests.select("request_id", "question_id").join(answers.select("request_id", "text", "provider"), "request_id")
    rest = ask(requests.join(answers.select("request_id"), "request_id", "left_anti"))
    return held.select("question_id", "text", F.concat(F.lit("queue:"), F.coalesce("provider", F.lit("unknown"))).alias("provider")).unionByName(rest.select("question_id", "text", "provider"))

