"""Queries pN_... of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm import keyword_spam, leakage, main_body, packing, pair_defects, personal_data, site_lines, splitting
from tessera.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return site_lines.repeated_lines(table(spark, folder, "documents"), table(spark, folder, "sources"))


def p1_clean(spark: SparkSession, folder: str) -> DataFrame:
    return site_lines.without_lines(table(spark, folder, "documents"), p1_found(spark, folder))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    pieces = splitting.split_sections(table(spark, folder, "chunks"), table(spark, folder, "documents"), oversized_only=True)
    return pieces.where(F.col("section_chars") > splitting.Sizes().most).select("chunk_id").distinct()


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_sections(table(spark, folder, "chunks"), table(spark, folder, "documents"))


def p2_cover(spark: SparkSession, folder: str) -> DataFrame:
    """Each section with whether its pieces start at its start, end at its end, leave no gap and keep to the sizes."""
    sizes = splitting.Sizes()
    pieces = p2_pieces(spark, folder)
    after = W.partitionBy("chunk_id", "document_id", "section", "section_chars", "first").orderBy("piece_no")
    # a chunk_id may be given to several spans: a piece's first is that of its span
    first = F.max(F.when(F.col("piece_no") == 0, F.col("char_start"))).over(W.partitionBy("chunk_id", "document_id", "section", "section_chars").orderBy("char_start", "piece_no"))
    rows = pieces.withColumn("first", first).withColumn("before", F.lag("char_end").over(after))
    fits = (F.col("char_end") - F.col("char_start") <= sizes.most) & (F.col("before").isNull() | ((F.col("before") >= F.col("char_start")) & (F.col("before") - F.col("char_start") <= sizes.overlap)))
    cover = rows.groupBy("chunk_id", "document_id", "section", "section_chars", "first").agg(F.bool_and(fits).alias("fits"), F.max("char_end").alias("end"))
    return cover.select("chunk_id", "document_id", "section", "section_chars", F.col("first").alias("char_start"), F.col("end").alias("char_end"), "fits").distinct()


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    texts = personal_data.texts_of(table(spark, folder, "documents"), table(spark, folder, "submissions"))
    return personal_data.find(texts).drop("end_pos").distinct()


def p3_masked(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data.mask(personal_data.texts_of(table(spark, folder, "documents"), table(spark, folder, "submissions")))


def p3_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """Each text with its length, put together again from the masked text, its placeholders and the spans found."""
    texts = personal_data.texts_of(table(spark, folder, "documents"), table(spark, folder, "submissions"))
    holder = F.element_at(F.create_map(*[F.lit(x) for k, v in personal_data.PLACEHOLDERS.items() for x in (k, len(v))]), F.col("kind"))
    key = ["rec_table", "rec_id", "field_name"]
    gone = personal_data.find(texts).distinct().groupBy(*key).agg(F.sum(F.col("end_pos") - F.col("start_pos") - holder).alias("gone"))
    kept = personal_data.mask(texts).select(*key, F.length("text").alias("n")).distinct()
    return kept.join(gone, key, "left").select(*key, (F.col("n") + F.coalesce("gone", F.lit(0))).alias("chars"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = pair_defects.pairs_of(table(spark, folder, "eval_results"), table(spark, folder, "llm_responses"), table(spark, folder, "questions"))
    return pair_defects.pair_defects(pairs)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return main_body.furniture_lines(table(spark, folder, "documents")).distinct()


def p5_main(spark: SparkSession, folder: str) -> DataFrame:
    return main_body.main_text(table(spark, folder, "documents"))


def p5_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Each web page with its number of lines, counted from those kept and those taken out."""
    kept = p5_main(spark, folder).select("doc_id", F.size(F.split("text", "\n", -1)).alias("kept"), (F.col("text") == "").alias("none"))
    gone = p5_found(spark, folder).groupBy("doc_id").agg(F.count("*").alias("gone"))
    both = kept.join(gone, "doc_id", "left").withColumn("gone", F.coalesce("gone", F.lit(0)))
    # a page all of whose lines are gone is an empty text, which has no line
    return both.select("doc_id", (F.when(F.col("none") & (F.col("gone") > 0), 0).otherwise(F.col("kept")) + F.col("gone")).alias("lines"))


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.containers(table(spark, folder, "documents"))


def p6_fills(spark: SparkSession, folder: str) -> DataFrame:
    """Each document with whether its parts follow on one another and no container of them is overfull, and
    whether it stayed whole or has a part that fills a container."""
    cap = packing.Settings().capacity
    parts = packing.containers(table(spark, folder, "documents"))
    size = F.col("token_end") - F.col("token_start")
    fill = parts.groupBy("container_id").agg(F.sum(size).alias("fill"))
    rows = parts.join(fill, "container_id").groupBy("doc_id").agg(
        (F.sum(size) == F.max("token_end")).alias("whole"), (F.max("fill") <= cap).alias("fits"), ((F.max("part_no") == 0) | (F.max(size) == cap)).alias("split_by_need"), F.count("*").alias("parts")
    )
    return rows.select("doc_id", "whole", "fits", "split_by_need")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    leaks = leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "questions"))
    return leaks.where(F.col("longest_run") >= leakage.RUN).select("doc_id", "item_id").distinct()


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "questions"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return keyword_spam.spam_pages(table(spark, folder, "documents"))


def p8_evidence(spark: SparkSession, folder: str) -> DataFrame:
    return keyword_spam.evidence(table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


_P1_LINES = """
with pub as (
  select source_id, min_by(publisher, (coalesce(-epoch(retrieved_at), 0), publisher)) publisher
  from sources where source_id is not null and publisher is not null group by source_id),
docs as (select doc_id, text, publisher from documents join pub on source = source_id),
raw as (select doc_id, publisher, unnest(string_split(text, chr(10))) line,
               generate_subscripts(string_split(text, chr(10)), 1) line_no from docs where text is not null),
lines as (
  select doc_id, publisher, cast(line_no as integer) line_no,
    trim(regexp_replace(regexp_replace(lower(line), '\\p{Nd}+', '0', 'g'), '[^\\p{L}0]+', ' ', 'g')) form
  from raw where not regexp_matches(line, '^[\\s\\p{Z}]*#')),
counted as (select publisher, form, count(distinct doc_id) n from lines where regexp_matches(form, '[^ 0]') group by all),
total as (select publisher, count(*) docs from docs group by publisher),
frequent as (select publisher, form from counted join total using (publisher) where n >= 5 and n >= docs * 0.1),
hits as (select distinct doc_id, line_no from lines semi join frequent using (publisher, form))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1_LINES + "select doc_id, line_no from hits",
        "p1_clean": _P1_LINES
        + """, gone as (select doc_id, list(line_no) l from hits group by doc_id)
        select d.doc_id, case when l is null then text else
          array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: not list_contains(l, i)), chr(10)) end as text
        from documents d left join gone using (doc_id)""",
        "p2_found": """
        select distinct chunk_id from chunks join documents on document_id = doc_id
        where coalesce(char_end, length(text)) - coalesce(char_start, 0) > 1200""",
        "p2_cover": """
        with c as (select distinct chunk_id, document_id, coalesce(section, '') section, coalesce(char_start, 0) a, coalesce(char_end, length(text), 0) b, coalesce(length(text), 0) n
          from chunks join documents on document_id = doc_id)
        select distinct chunk_id, document_id, section, (b - a)::integer section_chars, least(a, n)::integer char_start, least(b, n)::integer char_end, true fits from c where b > a""",
        "p3_lengths": """
        select distinct * from (select 'documents' rec_table, doc_id rec_id, 'text' field_name, length(text) chars from documents where text <> ''
          union all select 'submissions', submission_id, 'problem', length(problem) from submissions where problem <> '' union all select 'submissions', submission_id, 'expected', length(expected) from submissions where expected <> '')""",
        "p5_lines": "select doc_id, len(string_split(text, chr(10))) lines from documents where extractor = 'html' and text is not null",
        "p6_fills": "select distinct doc_id, true whole, true fits, true split_by_need from documents where doc_id is not null",
        "p7_found": """
        with words as (
          select item_id, unnest([question, expected]) t from questions),
        item as (select item_id, regexp_extract_all(lower(t), '[\\p{L}\\p{N}]+') w from words where t is not null),
        grams as (select distinct item_id, array_to_string(w[i:i+11], ' ') g
          from (select item_id, w, unnest(range(1, len(w) - 10)) i from item where len(w) >= 12)),
        doc as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') w from documents where text is not null),
        runs as (select doc_id, array_to_string(w[i:i+11], ' ') g
          from (select doc_id, w, unnest(range(1, len(w) - 10)) i from doc where len(w) >= 12))
        select distinct doc_id, item_id from runs join grams using (g)""",
    }
