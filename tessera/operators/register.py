"""The source register and the store: what to ingest, upserts, cascades, versions and reports.

A store is a set of tables; a mutation is a new version of a table (anti join of what goes, union
of what comes), written beside the old one and swapped, since plain Parquet has no merge.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions import text as T

# Types a source may have.
SOURCE_TYPES = (
    "standard", "regulatory", "investigation", "academic", "industry", "dataset", "reference", "official_record", "press", "review", "community", "self_published", "other",
    "technical_report", "company_page", "research_paper", "news", "guidance",
)


def invalid(register: DataFrame) -> DataFrame:
    """(source_id, problem): rows of a register that break its rules."""
    twice = register.groupBy("source_id").count().where("count > 1").select("source_id", F.lit("registered twice").alias("problem"))
    missing = F.when(F.col("source_id").isNull() | F.col("uri").isNull() | F.col("title").isNull() | F.col("publisher").isNull() | F.col("licence").isNull(), "missing field")
    rules = F.array_compact(F.array(
        missing, F.when(~F.coalesce(F.col("source_type").isin(list(SOURCE_TYPES)), F.lit(False)), "unknown type"), F.when(~F.coalesce(F.col("authority").between(1, 5), F.lit(False)), "authority outside 1 to 5"),
    ))
    return register.select("source_id", F.explode(rules).alias("problem")).unionByName(twice).distinct()


def ingest_actions(register: DataFrame, state: DataFrame, as_of: Column, offline: bool = False) -> DataFrame:
    """(source_id, action) of each registered source: pointer, fresh, offline, unchanged or index.

    register: source_id, mirrored, refresh_days, sha256 (of the fetched content, null if the
    fetch failed), chars; state: source_id, retrieved_at, sha256."""
    known = state.select("source_id", "retrieved_at", F.col("sha256").alias("old"))
    rows = register.join(known, "source_id", "left")
    fresh = F.col("retrieved_at").isNotNull() & (F.datediff(as_of, F.col("retrieved_at").cast("date")) < F.col("refresh_days"))
    action = (
        F.when(~F.col("mirrored"), "pointer").when(fresh, "fresh").when(F.lit(offline), "offline").when(F.col("sha256").isNull(), "failed")
        .when(F.col("sha256") == F.col("old"), "unchanged").when(F.col("chars") < 200, "failed").otherwise("index")
    )
    return rows.select("source_id", action.alias("action"))


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: Column | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` put in by key; of several new rows of a key the last by ``order``
    stays (any, where there is no order). One shuffle on the key for each side, no sort of the whole."""
    if order is not None:
        one = new.groupBy(*key).agg(F.max_by(F.struct(*new.columns), order).alias("r")).select("r.*")
    else:
        one = new.dropDuplicates(key)
    return old.join(one.select(*key), key, "left_anti").unionByName(one.select(*old.columns))


def insert_or_ignore(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The first row of each key by ``order``."""
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def cascade(gone: DataFrame, documents: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks without those of the sources ``gone`` (source_id), and without orphans."""
    docs = documents.join(gone.select(F.col("source_id").alias("source")).distinct(), "source", "left_anti")
    kept = chunks.join(docs.select(F.col("doc_id").alias("document_id")), "document_id", "left_semi")
    return docs, kept


def corpus_hash(documents: DataFrame) -> DataFrame:
    """(corpus_sha): one hash over the ordered ids and content hashes of a corpus. Hashes are combined
    in a tree of ``FAN_IN`` ids a node (a node's number is that of its children divided by it), so
    that a task holds a node's children and no more; ``LEVELS`` of it reach any 64-bit number of
    consecutive ids below a thousand to that power."""
    level = documents.select(F.col("doc_id").alias("n"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    for _ in range(LEVELS):
        node = F.floor(F.col("n") / FAN_IN)
        listed = F.transform(F.array_sort(F.collect_list(F.struct("n", "sha"))), lambda r: F.concat(r["n"].cast("string"), r["sha"]))
        level = level.groupBy(node.alias("n")).agg(F.sha2(F.array_join(listed, ""), 256).alias("sha"))
    # one node is left, or as many as there are ids beyond the tree's reach, over a thousand to that power
    top = F.transform(F.array_sort(F.collect_list(F.struct("n", "sha"))), lambda r: F.concat(r["n"].cast("string"), r["sha"]))
    return level.agg(F.sha2(F.array_join(top, ""), 256).alias("corpus_sha"))


#: Children of a node, and levels, of the tree of ``corpus_hash``.
FAN_IN, LEVELS = 1000, 4


@dataclass(frozen=True)
class Version:
    name: str
    manifest: str
    corpus: str
    index: str


def index_hash(*parts: str) -> str:
    return hashlib.sha256("\x1f".join(parts).encode()).hexdigest()


def cut_version(history: list[Version], manifest: str, corpus: str, index: str) -> Version:
    """The version of a state: an existing one if its three hashes are known, else the next; a changed
    manifest or index raises the minor number, a changed corpus the patch."""
    for v in history:
        if (v.manifest, v.corpus, v.index) == (manifest, corpus, index):
            return v
    if not history:
        return Version("v0.1.0", manifest, corpus, index)
    last = history[-1]
    major, minor, patch = map(int, last.name[1:].split("."))
    name = f"v{major}.{minor + 1}.0" if (last.manifest, last.index) != (manifest, index) else f"v{major}.{minor}.{patch + 1}"
    return Version(name, manifest, corpus, index)


def newly_failing(baseline: DataFrame, current: DataFrame, keep: tuple[str, ...] = ("question_id",)) -> DataFrame:
    """Questions that passed in the baseline and fail now, with the columns ``keep`` of ``current``; a
    publish needs none."""
    return current.where("not passed").join(baseline.where("passed").select("question_id"), "question_id", "left_semi").select(*keep).distinct()


def source_register(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """(source_id, publisher, title, authority, chunks): every source with its number of sections."""
    n = chunks.groupBy("source_id").agg(F.count("*").alias("n"))
    return sources.join(n, "source_id", "left").select("source_id", "publisher", "title", "authority", F.coalesce("n", F.lit(0)).alias("chunks"))


def coverage_report(sources: DataFrame) -> DataFrame:
    """(facet, value, n): sources by type, authority, status and tag."""
    facet = lambda name, c: sources.select(F.lit(name).alias("facet"), c.cast("string").alias("value"))
    tags = facet("tag", F.lit("")).limit(0).unionByName(sources.select(F.lit("tag").alias("facet"), F.explode(F.from_json("tags", "array<string>")).alias("value")))
    rows = facet("type", F.col("source_type")).unionByName(facet("authority", F.col("authority"))).unionByName(facet("status", F.col("status"))).unionByName(tags)
    return rows.groupBy("facet", "value").agg(F.count("*").alias("n"))


def freshness(sources: DataFrame, as_of: Column) -> DataFrame:
    """(median_days): median age of the retrieval of sources that have one."""
    return sources.where("retrieved_at is not null").agg(F.percentile(F.datediff(as_of, F.col("retrieved_at").cast("date")), F.lit(0.5)).alias("median_days"))


def transcript(results: DataFrame) -> DataFrame:
    """(run_id, total, passed, failed, abstained, providers) of each run."""
    status, provider = F.get_json_object("answer", "$.status"), F.get_json_object("answer", "$.llm.provider")
    counted = ("insufficient_evidence", "out_of_scope", "ambiguous", "unsupported")
    return results.groupBy("run_id").agg(
        F.count("*").alias("total"), F.count(F.when(F.col("passed"), 1)).alias("passed"), F.count(F.when(~F.col("passed"), 1)).alias("failed"),
        F.count(F.when(status.isin(list(counted)), 1)).alias("abstained"), F.array_join(F.array_sort(F.collect_set(provider)), ",").alias("providers"),
    )


def challenge_stats(challenges: DataFrame) -> DataFrame:
    """(status, n) with the total in the row ``total``."""
    out = challenges.rollup("status").agg(F.count("*").alias("n"), F.grouping("status").alias("all"))
    return out.select(F.when(F.col("all") == 1, "total").otherwise(F.col("status")).alias("status"), "n")


def parse_issue(body: Column) -> Column:
    """Map of ``### Heading`` sections of an issue form to their text; the first of a heading counts,
    the blank placeholder is empty."""
    clean = F.regexp_replace(body, r"\r\n?", "\n")
    parts = F.slice(F.split(F.concat(F.lit("\n"), clean), r"\n###[ \t]+", -1), 2, 10_000)
    pair = lambda p: F.struct(F.lower(F.trim(F.regexp_extract(p, r"^[^\n]*", 0))).alias("k"), F.trim(F.regexp_replace(F.regexp_replace(p, r"^[^\n]*\n?", ""), r"^\s+|\s+$", "")).alias("v"))
    pairs = F.transform(parts, pair)
    first = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, 1, i), lambda o: o["k"] == p["k"]))
    return F.map_from_entries(F.transform(first, lambda p: F.struct(p["k"], F.when(p["v"] == "_No response_", "").otherwise(p["v"]))))


def grader_choice(expected: Column, problem: Column) -> Column:
    """Kind of grader a challenge is turned into, from what its author says was wrong."""
    text = F.lower(F.concat_ws(" ", expected, problem))
    decline = ("should not answer", "should decline", "no evidence", "not knowable", "unanswerable", "out of scope")
    return (
        F.when(F.coalesce(F.length(expected), F.lit(0)) > 0, F.when(T.contains_any(text, decline), "must_abstain").otherwise("must_include"))
        .when(T.contains_any(text, ("hallucinat", "made up", "fabricat", "invented")), "max_unsupported")
        .when(T.contains_any(text, ("wrong source", "citation", "cited")), "citations_resolve")
        .otherwise("citations_resolve,max_unsupported")
    )


def counts(**tables: DataFrame) -> DataFrame:
    """(name, n): rows of each table."""
    out: DataFrame | None = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def latest(versions: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key by a total order."""
    return versions.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def first_of(rows: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key by a total order; a task sends on no more than that a key."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("__n") <= n).drop("__n")
