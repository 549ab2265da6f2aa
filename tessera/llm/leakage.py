"""Held-out items inside training documents (problem 7).

Seed and extend. A seed is four words: in a row, or two and two with one or two words between
them. Items give all their seeds and a document all of its own, so a replaced, inserted, dropped
or swapped word leaves seeds on both sides of it (two for two in a row, one gap for the other),
and whether a copy is found does not depend on other copies. A pair of document and field is
aligned if its seeds cover enough of the field for the alignment to count: Smith-Waterman on words
scores edited or paraphrased copies, and the longest run of common words is taken beside it.

The items are the stated query set: they are broadcast in blocks of bounded size, one scan of the
documents per block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = 12
_GAP = re.compile(r"[\W_]+")


@dataclass(frozen=True)
class Settings:
    """``run`` consecutive words are an exact leak; an alignment counts as an edited copy from
    ``min_share`` of the item's best score and ``min_score`` on, and is made where seeds cover
    ``min_cover`` of the field's words; ``block_chars`` bounds what one block of items brings to
    a task."""

    run: int = RUN
    min_cover: float = 0.3
    match: int = 2
    mismatch: int = -1
    gap: int = -1
    min_share: float = 0.4
    min_score: int = 24
    block_chars: int = 16_000_000


def words(text: str | None) -> list[str]:
    """Runs of letters or digits, without case."""
    return _GAP.sub(" ", (text or "").lower()).split()


def smith_waterman(a: np.ndarray, b: np.ndarray, s: Settings) -> int:
    """Best local alignment score of two sequences of word numbers (linear gap cost)."""
    if not len(a) or not len(b):
        return 0
    best, prev, ramp = 0, np.zeros(len(b) + 1, dtype=np.int64), np.arange(len(b) + 1) * s.gap
    for x in a:
        row = np.zeros_like(prev)
        np.maximum(prev[:-1] + np.where(b == x, s.match, s.mismatch), prev[1:] + s.gap, out=row[1:])
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row - ramp) + ramp  # gaps along the row
        best, prev = max(best, int(row.max())), row
    return best


def smith_waterman_pairs(pairs: list[tuple[np.ndarray, np.ndarray]], s: Settings) -> list[int]:
    """``smith_waterman`` of each pair (numbers from 0 on; -1 in the second for words that match
    nothing), all at once by anti-diagonals: a step takes one cell of every row of every pair."""
    if not pairs:
        return []
    long, n = max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs)
    if not long or not n:
        return [0] * len(pairs)
    kind = np.int16 if s.match * long < 30_000 else np.int32
    own = np.full((long, len(pairs)), -2, dtype=np.int32)
    back = np.full((n + 2 * long, len(pairs)), -1, dtype=np.int32)
    for k, (a, b) in enumerate(pairs):
        own[: len(a), k] = a
        back[n + long - len(b) : n + long, k] = b[::-1]
    before, last, row = (np.zeros((long + 1, len(pairs)), dtype=kind) for _ in range(3))
    best, cell, side, same = np.zeros(own.shape, kind), np.zeros(own.shape, kind), np.zeros(own.shape, kind), np.zeros(own.shape, bool)
    for d in range(n + long - 1):
        at = n + long - 1 - d
        np.equal(own, back[at : at + long], out=same)
        np.multiply(same, kind(s.match - s.mismatch), out=cell)
        cell += before[:-1]
        cell += kind(s.mismatch)
        np.maximum(last[1:], last[:-1], out=side)
        side += kind(s.gap)
        np.maximum(cell, side, out=cell)
        np.maximum(cell, 0, out=row[1:])
        np.maximum(best, row[1:], out=best)
        before, last, row = last, row, before
    return best.max(axis=0).tolist()


#: Cells of a step of ``smith_waterman_pairs``, which bound its memory; a step of few cells costs
#: as much as one of many.
_STEP = 1 << 16


def align(pairs: list[tuple[np.ndarray, np.ndarray]], s: Settings) -> list[int]:
    """Scores of many pairs, those of like size together."""
    out = [0] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda k: (len(pairs[k][0]) + len(pairs[k][1]), k))
    while order:
        part, size = [], 0
        while order and (not part or max(size, len(pairs[order[-1]][0])) * (len(part) + 1) <= _STEP):
            size = max(size, len(pairs[order[-1]][0]))
            part.append(order.pop())
        for k, score in zip(part, smith_waterman_pairs([pairs[k] for k in part], s)):
            out[k] = score
    return out


#: Places of a seed's four words.
_FORMS = ((0, 1, 2, 3), (0, 1, 3, 4), (0, 1, 4, 5))
#: Words of documents taken together.
_TOGETHER = 200_000


def _seeds(ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, tuple[int, ...]]]:
    """(places, keys, form): the seeds of a sequence of word numbers, none across a -1."""
    for form in _FORMS:
        n = len(ids) - form[-1]
        if n <= 0:
            continue
        cols = [ids[f : f + n] for f in form]
        at = np.flatnonzero(np.minimum.reduce(cols) >= 0)
        key = np.zeros(len(at), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for c in cols:  # exact below 65,536 words, and checked by the words in any case
                key = key * np.uint64(0x10001) + c[at].astype(np.uint64)
                key ^= key >> np.uint64(33)
                key *= np.uint64(0xFF51AFD7ED558CCD)
        yield at, key, form


class Block:
    """A block of items' fields, made ready to look up seeds in."""

    def __init__(self, items: list[tuple[int, list[tuple[str, list[str]]]]]) -> None:
        self.fields = [(item, name) for item, fs in items for name, _ in fs]
        self.number: dict[str, int] = {}
        self.words = [np.array([self.number.setdefault(x, len(self.number)) for x in w], dtype=np.int64) for _, fs in items for _, w in fs]
        self.length = np.array([len(w) for w in self.words], dtype=np.int64)
        keys, field, place, form = [], [], [], []
        for k, w in enumerate(self.words):
            for at, key, f in _seeds(w):
                keys.append(key)
                field.append(np.full(len(at), k))
                place.append(at)
                form.append(np.full(len(at), _FORMS.index(f)))
        join = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        key = join(keys, np.uint64)
        order = np.argsort(key, kind="stable")
        self.keys, self.field, self.place, self.form = key[order], join(field, np.int64)[order], join(place, np.int64)[order], join(form, np.int64)[order]
        self.flat = join(self.words, np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)])[:-1] if self.words else np.zeros(0, np.int64)

    def hits(self, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Per form of the document's seeds: (place, its form, field, place and form in the field)."""
        out = []
        for n, (at, key, form) in enumerate(_seeds(ids)):
            low = np.searchsorted(self.keys, key, "left")
            many = np.searchsorted(self.keys, key, "right") - low
            found = many > 0
            at, low, many = at[found], low[found], many[found]
            if not len(at):
                continue
            first = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many)
            j, at = first + np.arange(many.sum()), np.repeat(at, many)
            field, place, own = self.field[j], self.place[j], self.form[j]
            base, forms = self.start[field] + place, np.array(_FORMS)
            true = np.logical_and.reduce([ids[at + form[x]] == self.flat[base + forms[own, x]] for x in range(4)])
            out.append((at[true], np.full(true.sum(), _FORMS.index(form)), field[true], place[true], own[true]))
        return out


def _related(block: Block, docs: list[np.ndarray], s: Settings) -> list[tuple[int, int, int, int, int]]:
    """(document, field, longest run, first and last word hit) of the pairs worth an alignment."""
    ends = np.cumsum([len(d) + 1 for d in docs])
    ids = np.concatenate([x for d in docs for x in (d, np.array([-1]))])
    hits = block.hits(ids)
    if not hits:
        return []
    at, form, field, place, own = (np.concatenate(x) for x in zip(*hits))
    doc = np.searchsorted(ends, at, "right")
    pair = doc * len(block.fields) + field
    most = int(block.length.max()) + 8
    # the field's words that seeds cover
    forms = np.array(_FORMS)
    covered = np.unique((pair[:, None] * most + place[:, None] + forms[own]).ravel())
    known, cover = np.unique(covered // most, return_counts=True)
    # runs: seeds of four in a row on both sides, one after another
    plain = (form == 0) & (own == 0)
    longest = np.zeros(len(known), dtype=np.int64)
    if plain.any():
        p, a, i = pair[plain], at[plain], place[plain]
        shift = a - i + most
        order = np.lexsort((a, shift, p))
        p, a, shift = p[order], a[order], shift[order]
        new = np.concatenate([[True], (p[1:] != p[:-1]) | (shift[1:] != shift[:-1]) | (a[1:] != a[:-1] + 1)])
        starts = np.flatnonzero(new)
        length = np.diff(np.concatenate([starts, [len(p)]])) + 3
        np.maximum.at(longest, np.searchsorted(known, p[starts]), length)
    k = known % len(block.fields)
    wanted = (longest >= s.run) | (cover >= s.min_cover * block.length[k])
    order = np.argsort(pair, kind="stable")
    low = np.minimum.reduceat(at[order], np.searchsorted(pair[order], known))
    high = np.maximum.reduceat(at[order], np.searchsorted(pair[order], known))
    start = ends - np.array([len(d) + 1 for d in docs])
    d = known // len(block.fields)
    return [(int(d[x]), int(k[x]), int(longest[x]), int(low[x] - start[d[x]]), int(high[x] - start[d[x]])) for x in np.flatnonzero(wanted)]


def _leaks_of(block: Block, docs: list[tuple[int, np.ndarray]], s: Settings) -> list[tuple]:
    out, pairs, known = [], [], []
    for d, k, longest, low, high in _related(block, [w for _, w in docs], s):
        n = int(block.length[k])
        reach = (s.match + 1) * n  # no alignment that counts spans more beside its seeds
        known.append((docs[d][0], k, longest, n))
        pairs.append((block.words[k], docs[d][1][max(0, low - reach) : high + reach]))
    for (doc, k, longest, n), score in zip(known, align(pairs, s)):
        best = s.match * n
        if longest >= s.run or (score >= s.min_score and score >= s.min_share * best):
            out.append((doc, *block.fields[k], longest, score, score / max(1, best)))
    return out


def _finder(shared, s: Settings):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = Block(shared.value)
        get = block.number.get
        for pdf in batches:
            out, held, size = [], [], 0
            for doc, text in zip(pdf["__doc"], pdf["__text"]):
                ids = np.array([get(w, -1) for w in words(text)], dtype=np.int64)
                held.append((doc, ids))
                size += len(ids)
                if size >= _TOGETHER:
                    out += _leaks_of(block, held, s)
                    held, size = [], 0
            if held:
                out += _leaks_of(block, held, s)
            frame = pd.DataFrame(out, columns=["doc_id", "item_id", "field", "longest_run", "score", "share"])
            yield frame.astype({"doc_id": "int64", "item_id": "int64", "longest_run": "int32", "score": "int32", "share": "float64"})

    return run


LEAKS = "doc_id bigint, item_id bigint, field string, longest_run int, score int, share double"


def _blocks(items: DataFrame, limit: int) -> Iterator[list[tuple[int, list[tuple[str, list[str]]]]]]:
    block, size = [], 0
    for r in items.toLocalIterator():
        fields = [(f, w) for f in ("question", "expected") if (w := words(r[f]))]
        block.append((r["item_id"], fields))
        size += sum(len(x) + 1 for _, w in fields for x in w)
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaks(documents: DataFrame, items: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, item_id, field, longest_run, score, share): documents that hold wording of an item.

    documents: doc_id, text; items: item_id, question, expected; other columns are not read.
    ``longest_run`` is the number of consecutive words shared (0 below four), ``score`` the
    Smith-Waterman score, ``share`` that of the field's best possible. A row is given for a run of
    ``run`` words or an alignment from ``min_score`` and ``min_share`` on. Fields of fewer than four
    words have no seed and give nothing, as do null and empty texts and fields, and null ids;
    repeated rows give their result once.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("bigint").alias("__doc"), F.col("text").alias("__text")).where("__doc is not null and __text is not null")
    wanted = items.select(F.col("item_id").cast("bigint").alias("item_id"), "question", "expected").where("item_id is not null")
    parts = [docs.mapInPandas(_finder(spark.sparkContext.broadcast(block), s), LEAKS) for block in _blocks(wanted, s.block_chars)]
    if not parts:
        return spark.createDataFrame([], LEAKS)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()
