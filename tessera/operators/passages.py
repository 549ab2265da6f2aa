"""Passages: the sections of documents as rows, and sections found anew."""

from __future__ import annotations

from collections.abc import Iterator
import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions import constants as C
from tessera.functions import text as T


def passages(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, source_id, ordinal, section, text): one row per section whose document
    exists; repeated rows count once, a null end is the text's end, blank sections are left out."""
    spans = chunks.where("document_id is not null").groupBy(F.col("document_id").alias("doc_id")).agg(
        F.collect_set(F.struct("chunk_id", "source_id", "ordinal", F.coalesce("section", F.lit("")).alias("section"), "char_start", "char_end")).alias("spans")
    )  # one document's sections; repeated rows go here
    docs = documents.select("doc_id", F.col("text").alias("body")).where("body is not null")
    end = lambda s: F.coalesce(s["char_end"], F.length("body"))
    cut = lambda s: F.struct(
        s["chunk_id"].alias("chunk_id"), s["source_id"].alias("source_id"), s["ordinal"].alias("ordinal"), s["section"].alias("section"),
        F.substring(F.col("body"), s["char_start"] + 1, end(s) - s["char_start"]).alias("raw"),
    )
    # texts are cut before the rows multiply, so no row carries more than its own section
    rows = docs.join(spans, "doc_id").select("doc_id", F.explode(F.transform("spans", cut)).alias("s"))
    return rows.select("s.chunk_id", "doc_id", "s.source_id", "s.ordinal", "s.section", T.normalise("s.raw").alias("text")).where("text != ''")


def sections(documents: DataFrame) -> DataFrame:
    """(doc_id, section_no, section, lines, chars): sections by marked and numbered headings.

    A window over the lines of one document numbers the sections; nothing crosses documents.
    """
    lines = documents.select("doc_id", F.posexplode(F.split(T.normalise("text"), "\n", -1)).alias("line_no", "line"))
    own = W.partitionBy("doc_id").orderBy("line_no")
    heading = F.trim("line").rlike(C.HEADING)
    title = F.when(heading, F.coalesce(F.nullif(F.regexp_extract(F.trim("line"), r"^#{1,6}\s+(.+)$", 1), F.lit("")), F.trim("line")))
    marked = lines.withColumn("section_no", F.sum(heading.cast("int")).over(own)).withColumn("head", heading)
    marked = marked.withColumn("section", F.coalesce(F.last(title, ignorenulls=True).over(own), F.lit("")))
    body = F.when(~F.col("head"), F.length("line") + 1)
    return (
        marked.groupBy("doc_id", "section_no", "section")
        .agg(F.count(F.when(~F.col("head"), 1)).alias("lines"), F.coalesce(F.sum(body), F.lit(0)).alias("chars"))
        .where("chars > lines")
    )


_GAP = re.compile(C.PACK_GAP)
_HEAD = re.compile(C.HEADING)


def pack_sentences(body: str, target: int, overlap: int, least: int) -> list[tuple[str, int, int]]:
    """(text, start, end) of pieces of whole sentences near ``target`` characters. Sentences up to
    ``overlap`` characters are repeated at the next piece's start; a last piece under ``least`` is
    put to the one before."""
    spans, at = [], 0
    for m in [*_GAP.finditer(body), None]:
        stop = m.start() if m else len(body)
        if body[at:stop].strip():
            spans.append((at, stop))
        at = m.end() if m else stop
    out: list[tuple[str, int, int]] = []
    first = used = size = 0
    for i, (a, b) in enumerate(spans):
        if i > first and size + (b - a) > target:
            out.append((body[spans[first][0] : spans[i - 1][1]].strip(), spans[first][0], spans[i - 1][1]))
            used = i
            carried, k = 0, i
            while overlap > 0 and k > first and carried + spans[k - 1][1] - spans[k - 1][0] <= overlap:
                k -= 1
                carried += spans[k][1] - spans[k][0]
            first, size = k, carried
        size += b - a + 1
    if spans and (used < len(spans) or not out):
        out.append((body[spans[first][0] : spans[-1][1]].strip(), spans[first][0], spans[-1][1]))
    if len(out) > 1 and len(out[-1][0]) < least:
        tail = out.pop()
        out[-1] = (f"{out[-1][0]} {tail[0]}".strip(), out[-1][1], tail[2])
    return out


def _blocks(text: str) -> Iterator[tuple[str, str, int]]:
    section, lines, start, at = "", [], 0, 0
    for line in [*text.split("\n"), None]:
        head = line is not None and _HEAD.match(line.strip())
        if line is None or head:
            body = "\n".join(lines).strip()
            if body:
                yield section, body, start
            lines = []
            if line is None:
                return
            section = re.sub(r"^#{1,6}\s+", "", line.strip()).strip()
            start = at + len(line) + 1
        else:
            if not lines:
                start = at
            lines.append(line)
        at += len(line) + 1


def chunk_documents(documents: DataFrame, target: int = 1200, overlap: int = 150, least: int = 200) -> DataFrame:
    """(doc_id, chunk_id, ordinal, section, text, char_start, char_end, token_estimate).

    Greedy packing carries state from sentence to sentence, hence Python; Arrow batches of whole
    documents, no shuffle. Spans are those of the normalised text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                n = 0
                for section, body, start in _blocks(text):
                    for piece, a, b in pack_sentences(body, target, overlap, least):
                        key = hashlib.sha256(f"{doc}:{n}:{piece}".encode()).hexdigest()[:20]
                        rows.append((doc, f"ch_{key}", n, section, piece, start + a, start + b, max(1, len(piece) // 4)))
                        n += 1
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_id", "ordinal", "section", "text", "char_start", "char_end", "token_estimate"]).astype(
                {"doc_id": "int64", "ordinal": "int32", "char_start": "int32", "char_end": "int32", "token_estimate": "int32"}
            )

    docs = documents.where("text is not null").select("doc_id", T.normalise("text").alias("text"))
    return docs.mapInPandas(run, "doc_id bigint, chunk_id string, ordinal int, section string, text string, char_start int, char_end int, token_estimate int")


def claims(passages_: DataFrame) -> DataFrame:
    """(claim_id, chunk_id, kind, text) of the sentences of 40 to 500 characters that make a claim."""
    low, high = C.CLAIM_CHARS
    each = passages_.select("chunk_id", F.explode(T.sentences("text")).alias("text")).where(F.length("text").between(low, high))
    each = each.withColumn("kind", T.claim_kind("text")).where("kind is not null")
    key = T.short_hash(F.col("chunk_id"), F.lit(":"), F.col("text"), prefix="cl_")
    return each.select(key.alias("claim_id"), "chunk_id", "kind", "text").distinct()
