"""Splitting oversized sections at natural boundaries (problem 2).

Content-defined chunking. A polynomial hash rolls over windows of ``window`` characters; the
window with the least hash of a stretch, away from its ends by the minimum size, is its landmark,
and the cut is the natural boundary nearest to it: a paragraph end if one is in reach, else a line
end, a sentence end, a word end, and only then the landmark itself. Either side of a cut is cut
again until it is small enough. A landmark depends on the characters around it and not on its
offset, and stays the least of every smaller stretch around it, so an edit moves the cuts beside
it only.

Spans travel without their text, one row per document that has an oversized one; only the texts
of these documents are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialise


#: Up to so many document ids (of 8 bytes) are sent to every task.
BROADCAST_IDS = 2_000_000


@dataclass(frozen=True)
class Sizes:
    """Characters: pieces of at most ``most``; cuts at least ``least`` apart, from the section's
    ends too; consecutive pieces overlap by up to ``overlap``, and an overlap comes out of the
    size; a boundary is taken from up to ``reach`` characters around the landmark. ``most`` less
    ``overlap`` must be twice ``least`` or more."""

    most: int = 1200
    least: int = 400
    overlap: int = 150
    window: int = 32
    reach: int = 120


_BASE = np.uint64(1099511628211)
_BREAKS = (
    re.compile(r"\n[ \t\r]*\n\s*"),
    re.compile(r"\n"),
    re.compile(r"[.!?;:…。！？][\"'”’»)\]]*\s+"),
    re.compile(r"\s+"),
)


def landmarks(text: str, window: int) -> np.ndarray:
    """uint64 hash of the ``window`` characters ending at each offset (mixed, so that the least
    value is a fair landmark). The first ``window - 1`` offsets have the hash of a shorter run.
    ``window`` is a power of two: a window of 2m is two of m, so it takes log2 passes."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        h, base, m = codes + np.uint64(1), _BASE, 1
        while m < window:
            shifted = np.zeros_like(h)
            shifted[m:] = h[:-m] if m < len(h) else h[:0]
            h = shifted * base + h
            base = base * base
            m *= 2
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def _boundaries(text: str) -> list[np.ndarray]:
    return [np.fromiter((m.end() for m in r.finditer(text)), dtype=np.int64) for r in _BREAKS]


def _nearest(ends: np.ndarray, at: int, low: int, high: int) -> int:
    i, best = int(np.searchsorted(ends, at)), -1
    for j in (i - 1, i):
        if 0 <= j < len(ends) and low <= ends[j] <= high and (best < 0 or abs(ends[j] - at) < abs(best - at)):
            best = int(ends[j])
    return best


def split_span(text: str, sizes: Sizes = Sizes()) -> list[tuple[int, int]]:
    """Spans [start, end) that cover ``text``, each of at most ``sizes.most`` characters, each
    starting at most ``sizes.overlap`` before the end of the one before. Empty text: no span."""
    n = len(text)
    if n == 0:
        return []
    if n <= sizes.most:
        return [(0, n)]
    marks, ends = landmarks(text, sizes.window), _boundaries(text)
    cuts, todo = [0, n], [(0, n)]
    while todo:
        a, b = todo.pop()
        # the section's first piece has nothing before it to repeat
        if b - a <= sizes.most - (sizes.overlap if a else 0):
            continue
        low, high = a + sizes.least, b - sizes.least
        at = low + int(np.argmin(marks[low - 1 : high]))
        near, far = max(low, at - sizes.reach), min(high, at + sizes.reach)
        cut = next((c for e in ends if (c := _nearest(e, at, near, far)) >= 0), -1)
        if cut < 0:  # nothing natural near the landmark: the nearest word end, if any
            cut = _nearest(ends[3], at, low, high)
        if cut < 0:
            cut = at
        cuts.append(cut)
        todo += [(a, cut), (cut, b)]
    cuts.sort()
    out, start = [], 0
    for cut in cuts[1:]:
        out.append((start, cut))
        floor = cut - sizes.overlap
        start = next((c for e in ends[1:] if (i := int(np.searchsorted(e, floor))) < len(e) and (c := int(e[i])) < cut), cut)
    return out


def _splitter(sizes: Sizes):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text, spans in zip(pdf["__doc"], pdf["__text"], pdf["__spans"]):
                text = text or ""
                for s in spans:
                    # what a span claims beyond its text is nothing; one of nothing else is an empty piece
                    a, b = min(s["a"], len(text)), min(s["b"], len(text))
                    for k, (x, y) in enumerate(split_span(text[a:b], sizes) or [(0, 0)]):
                        rows.append((s["id"], doc, s["section"], k, a + x, a + y, s["b"] - s["a"]))
            yield pd.DataFrame(rows, columns=["chunk_id", "document_id", "section", "piece_no", "char_start", "char_end", "section_chars"]).astype(
                {"document_id": "int64", "piece_no": "int32", "char_start": "int32", "char_end": "int32", "section_chars": "int32"}
            )

    return run


PIECES = "chunk_id string, document_id bigint, section string, piece_no int, char_start int, char_end int, section_chars int"


def split_sections(chunks: DataFrame, documents: DataFrame, sizes: Sizes = Sizes(), oversized_only: bool = False) -> DataFrame:
    """Pieces (chunk_id, document_id, section, piece_no, char_start, char_end, section_chars) of every
    section, or of the sections that claim more than ``sizes.most`` characters alone.

    chunks: chunk_id, document_id, section, char_start, char_end; documents: doc_id, text; other
    columns are not read. A null char_end is the text's length, a null char_start 0, a null
    section empty; rows of documents that do not exist give nothing, nor do empty spans, nor
    chunks of a null chunk_id's document beyond what they state (the id stays null). Equal rows
    are cut once; a chunk_id is cut once for each distinct span given to it. Offsets are those of
    documents.text; a span reaching past its text is clipped to it, and one that lies past it
    altogether gives one empty piece at the text's end; ``section_chars`` is what the span claims.
    """
    spans = chunks.select(
        F.col("document_id").alias("__doc"), F.col("chunk_id").alias("id"), F.coalesce("section", F.lit("")).alias("section"),
        F.coalesce("char_start", F.lit(0)).alias("a"), F.col("char_end").alias("b"),
    ).where(F.col("__doc").isNotNull() & (F.col("b").isNull() | (F.col("b") > F.col("a"))))
    # exact duplicates go here; a group holds the sections of one document that may be oversized
    large = spans.where(F.col("b").isNull() | (F.col("b") - F.col("a") > sizes.most))
    large = large.groupBy("__doc").agg(F.collect_set(F.struct("id", "section", "a", F.coalesce("b", F.lit(-1)).alias("b"))).alias("__spans"))
    large = materialise(large, "split-spans")
    docs = documents.select(F.col("doc_id").alias("__doc"), F.col("text").alias("__text"))
    asked = docs
    if large.count() <= BROADCAST_IDS:
        asked = docs.join(F.broadcast(large.select("__doc")), "__doc", "left_semi")
    length = F.coalesce(F.length("__text"), F.lit(0))
    closed = F.transform("__spans", lambda s: s.withField("b", F.when(s["b"] < 0, length).otherwise(s["b"])))
    cut = asked.join(large, "__doc").withColumn("__spans", F.filter(closed, lambda s: s["b"] - s["a"] > sizes.most))
    cut = cut.where(F.size("__spans") > 0).select("__doc", "__text", "__spans").mapInPandas(_splitter(sizes), PIECES)
    if oversized_only:
        return cut
    # the others need the length of their text alone
    lengths = docs.select("__doc", length.alias("__n"))
    end = F.coalesce(F.col("b"), F.col("__n"))
    fits = spans.distinct().where(F.col("b").isNull() | (F.col("b") - F.col("a") <= sizes.most)).join(lengths, "__doc")
    fits = fits.where((end > F.col("a")) & (end - F.col("a") <= sizes.most))
    whole = fits.select(
        F.col("id").alias("chunk_id"), F.col("__doc").alias("document_id"), "section", F.lit(0).alias("piece_no"), F.least("a", "__n").cast("int").alias("char_start"),
        F.least(end, "__n").cast("int").alias("char_end"), (end - F.col("a")).cast("int").alias("section_chars"),
    )
    return whole.unionByName(cut)
