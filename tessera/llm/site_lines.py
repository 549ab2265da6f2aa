"""Lines that one publisher repeats over its documents (problem 1).

Every line is reduced to a form without case, digits and punctuation and hashed to 64 bits
inside the JVM. A document contributes each of its hashes once; counting them per publisher
is a partial aggregation, so a publisher with a third of all rows costs no more in one task
than any other. The frequent hashes of a publisher number at most ``1 / share`` times its
mean number of lines per document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import materialise

#: Above this many frequent (publisher, hash) rows of 24 bytes the join back is a salted shuffle.
BROADCAST_ROWS = 500_000
SALTS = 32


@dataclass(frozen=True)
class Rules:
    """``min_docs`` documents and ``min_share`` of the publisher's documents make a line frequent."""

    min_docs: int = 5
    min_share: float = 0.1


def line_forms(text: Column) -> Column:
    """Array with one form per line of ``text`` (split at \\n): lower case, each run of digits
    read as ``0``, anything else but letters one space, trimmed. The passes run over the whole
    text before it is split, so no string is made per line and pass."""
    t = F.regexp_replace(F.lower(text), r"\p{Nd}+", "0")
    t = F.regexp_replace(t, r"[^\p{L}0\n]+", " ")
    return F.transform(F.split(t, "\n", -1), lambda x: F.trim(x))


def _hashes(text: Column) -> Column:
    """Array of one hash per line; null where the line cannot count (no letter, or a heading)."""
    forms = line_forms(text)
    heading = F.transform(F.split(text, "\n", -1), lambda x: F.ltrim(x).startswith("#") | x.rlike(r"^[\s\p{Z}]+#"))
    return F.zip_with(forms, heading, lambda f, h: F.when(~h & f.rlike(r"[^ 0]"), F.xxhash64(f)))


def _publishers(sources: DataFrame) -> DataFrame:
    """One publisher per source: that of the latest registration (ties: the least name)."""
    return (
        sources.select(F.col("source_id").alias("__source"), F.col("publisher").alias("__publisher"), F.col("retrieved_at").alias("__at"))
        .where("__source is not null and __publisher is not null")
        .groupBy("__source")
        .agg(F.min_by("__publisher", F.struct(F.coalesce(-F.unix_timestamp("__at"), F.lit(0)), "__publisher")).alias("__publisher"))
    )


def repeated_lines(documents: DataFrame, sources: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(doc_id, line_no) of every occurrence of a line frequent within its publisher.

    documents: doc_id, text, source; sources: source_id, publisher, retrieved_at. Other columns
    are not read, whatever their names. Null and empty texts have no lines but count among the
    publisher's documents; documents whose source is null or unregistered are left out; equal
    rows (the same doc_id twice) count once per row of ``documents``, and give their lines once;
    empty tables give no rows.
    """
    docs = documents.select(F.col("doc_id").alias("__doc"), F.col("text").alias("__text"), F.col("source").alias("__source"))
    lines = materialise(
        docs.join(_publishers(sources), "__source").select("__doc", "__publisher", _hashes(F.col("__text")).alias("__lines")),
        "site-lines",
    )
    total = lines.groupBy("__publisher").agg(F.count("*").alias("__docs"))
    frequent = (
        lines.select("__publisher", F.explode(F.array_distinct(F.array_compact("__lines"))).alias("__line"))
        .groupBy("__publisher", "__line")
        .agg(F.count("*").alias("__n"))
        .where(F.col("__n") >= rules.min_docs)
        .join(total, "__publisher")
        .where(F.col("__n") >= F.col("__docs") * F.lit(rules.min_share))
        .select("__publisher", "__line")
    )
    frequent = materialise(frequent, "site-frequent")
    each = lines.select("__doc", "__publisher", F.posexplode("__lines").alias("__pos", "__line")).where("__line is not null")
    if frequent.count() <= BROADCAST_ROWS:
        hits = each.join(F.broadcast(frequent), ["__publisher", "__line"], "left_semi")
    else:  # a line of every document of the largest publisher is one key: spread it
        salted = frequent.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        each = each.withColumn("__salt", F.pmod(F.hash("__doc"), F.lit(SALTS)))
        hits = each.join(salted, ["__publisher", "__line", "__salt"], "left_semi")
    return hits.select(F.col("__doc").alias("doc_id"), (F.col("__pos") + 1).cast("int").alias("line_no")).distinct()


def without_lines(documents: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, text): each document's text without the given (doc_id, line_no) rows.

    Keeps every row of ``documents``; a null text stays null, a text all of whose lines go
    becomes empty.
    """
    gone = lines.groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_set("line_no").alias("__gone"))
    docs = documents.select(F.col("doc_id").alias("__doc"), F.col("text").alias("__text"))
    kept = F.filter(F.split("__text", "\n", -1), lambda x, i: ~F.array_contains("__gone", i + 1))
    return docs.join(gone, "__doc", "left").select(
        F.col("__doc").alias("doc_id"),
        F.when(F.col("__gone").isNull(), F.col("__text")).otherwise(F.array_join(kept, "\n")).alias("text"),
    )
