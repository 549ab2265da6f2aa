"""Filling containers of fixed capacity (problem 6).

Sizes are counted in tokens of a public tokenizer, once per document. A document above the
capacity gives whole containers of its own and a rest. The rests and all other documents go to
groups of bounded size (by a hash, so no key can make one large); in each group best fit by
falling size makes a first packing, and swap-based local search improves it: moving one
document, exchanging one for one or two for one between underfull bins, each step raising the
sum of squared fills until bins empty. What is still in bins below ``full`` is grouped anew and
packed once more across the old groups.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialise


@dataclass(frozen=True)
class Settings:
    """``capacity`` tokens; ``group`` documents are packed in one task; ``vocabulary`` is the path
    of a byte-level BPE ranks file that every executor can read (None: that of the installed
    public tokenizers) and ``pattern`` its splitting pattern; bins below ``full`` are packed a second
    time."""

    capacity: int = 2048
    group: int = 20_000
    full: float = 0.98
    vocabulary: str | None = None
    pattern: str | None = None


def _encoder(s: Settings):
    import tiktoken

    path, pattern = s.vocabulary, s.pattern
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, row, tokens): tokens of each row's text, 0 for null and empty ones, and a number of
    the row, which tells equal rows apart."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(s).encode_ordinary
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["__doc"], "tokens": [len(encode(t)) if t else 0 for t in pdf["__text"]]})

    rows = documents.select(F.col("doc_id").cast("bigint").alias("__doc"), F.col("text").alias("__text")).where("__doc is not null")
    return rows.mapInPandas(run, "doc_id bigint, tokens int").select("doc_id", F.monotonically_increasing_id().alias("row"), "tokens")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: best fit by falling size. Ties go to the lower number."""
    bins: list[list[int]] = []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    present: list[int] = []  # free spaces that some bin has, sorted
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        size = sizes[i]
        at = bisect_left(present, size)
        if at < len(present):
            free = present[at]
            b = by_free[free].pop()
            if not by_free[free]:
                present.pop(at)
        else:
            b, free = len(bins), capacity
            bins.append([])
        bins[b].append(i)
        left = free - size
        if not by_free[left]:
            present.insert(bisect_left(present, left), left)
        by_free[left].append(b)
    return bins


def local_search(sizes: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Bins improved by moves and exchanges until none is left. Each step takes documents out of
    the emptier of two underfull bins into the fuller one, so the sum of squared fills rises and
    the search ends; it also ends once the bins are as few as the sizes allow."""
    fill = [sum(sizes[i] for i in b) for b in bins]
    least = -(-sum(fill) // capacity)
    open_ = sorted((b for b in range(len(bins)) if fill[b] < capacity), key=lambda b: fill[b])
    left, changed = len(bins), True
    while changed and left > least:
        changed = False
        for a in list(open_):
            if not bins[a]:
                continue
            by_fill = sorted((b for b in open_ if bins[b] and b != a and fill[b] < capacity), key=lambda b: fill[b])
            fills = [fill[b] for b in by_fill]
            # one document moves to the fullest bin that takes it
            for i in sorted(bins[a], key=lambda k: -sizes[k]):
                k = bisect_right(fills, capacity - sizes[i]) - 1
                if k >= 0 and fills[k] + sizes[i] > fill[a]:
                    b = by_fill.pop(k)
                    fills.pop(k)
                    bins[a].remove(i)
                    bins[b].append(i)
                    fill[a] -= sizes[i]
                    fill[b] += sizes[i]
                    k = bisect_left(fills, fill[b])
                    by_fill.insert(k, b)
                    fills.insert(k, fill[b])
                    changed = True
            if not bins[a]:
                continue
            for b in reversed(by_fill):
                room = capacity - fill[b]
                if fill[b] < fill[a] or room == 0:
                    continue
                best = _exchange(sizes, bins[a], bins[b], room)
                if best:
                    out, back = best
                    for i in out:
                        bins[a].remove(i)
                        bins[b].append(i)
                    bins[b].remove(back)
                    bins[a].append(back)
                    gain = sum(sizes[i] for i in out) - sizes[back]
                    fill[a] -= gain
                    fill[b] += gain
                    changed = True
        left -= sum(not bins[b] for b in open_)
        open_ = [b for b in sorted(open_, key=lambda b: fill[b]) if bins[b] and fill[b] < capacity]
    return [b for b in bins if b]


def _exchange(sizes: list[int], a: list[int], b: list[int], room: int) -> tuple[tuple[int, ...], int] | None:
    """Of one or two documents of ``a`` for one of ``b`` the exchange that fills ``room`` best."""
    theirs = sorted((sizes[j], j) for j in b)
    keys = [x for x, _ in theirs]
    best, choice = 0, None
    for i in a:
        at = bisect_left(keys, sizes[i] - room)  # the least that must come back
        if at < len(keys) and 0 < sizes[i] - keys[at] <= room and sizes[i] - keys[at] > best:
            best, choice = sizes[i] - keys[at], ((i,), theirs[at][1])
    own = sorted(a, key=lambda i: sizes[i])
    for n, (back, j) in enumerate(theirs):
        if best == room:
            break
        if n and keys[n - 1] == back:
            continue
        low, high = 0, len(own) - 1  # the greatest pair that still fits, by pointers from both ends
        while low < high:
            gain = sizes[own[low]] + sizes[own[high]] - back
            if gain > room:
                high -= 1
                continue
            if gain > best:
                best, choice = gain, ((own[low], own[high]), j)
            low += 1
    return choice


def pack(sizes: list[int], s: Settings = Settings()) -> list[int]:
    """Bin number of each item; items of size 0 go with the first bin."""
    some = [i for i, x in enumerate(sizes) if x > 0]
    bins = local_search([sizes[i] for i in some], best_fit([sizes[i] for i in some], s.capacity), s.capacity)
    out = [0] * len(sizes)
    for b, items in enumerate(bins):
        for i in items:
            out[some[i]] = b
    return out


def _packer(s: Settings, stage: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "part_no", "row"], kind="stable").reset_index(drop=True)
        sizes = (pdf["token_end"] - pdf["token_start"]).tolist()
        bins = pack(sizes, s)
        fill: dict[int, int] = {}
        for b, x in zip(bins, sizes):
            fill[b] = fill.get(b, 0) + x
        group = pdf["group"].iloc[0] if len(pdf) else 0
        return pdf.assign(container_id=[f"{stage}-{group}-{b}" for b in bins], fill=[fill[b] for b in bins])

    return run


_ITEMS = "doc_id bigint, row bigint, part_no int, token_start int, token_end int, group bigint"


def _grouped(items: DataFrame, s: Settings, stage: int) -> DataFrame:
    groups = max(1, -(-items.count() // s.group))
    keyed = items.withColumn("group", F.pmod(F.xxhash64("row", F.lit(stage)), F.lit(groups)))
    # a stated number of partitions: groups are few bytes and much work, and must not be put together
    return keyed.repartition(groups, "group").groupBy("group").applyInPandas(_packer(s, stage), f"{_ITEMS}, container_id string, fill int").drop("group")


def containers(documents: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, part_no, token_start, token_end, container_id): the container of each document.

    documents: doc_id, text; other columns are not read. Only a document above ``capacity`` has
    several parts, all but its last one whole containers. Null and empty texts are parts of no
    tokens in some container; every row with a doc_id is packed, equal rows each by themselves; an empty table
    gives no rows. Rows without doc_id are left out, as nothing could name them in the result. Equal
    sizes are packed in the order of doc_id. Token counts are written once, so that a task that is
    run again gives the same containers.
    """
    counts = materialise(token_counts(documents, s), "pack-tokens")
    cap = s.capacity
    whole = F.floor((F.greatest("tokens", F.lit(1)) - 1) / cap).cast("int")
    parts = counts.select("doc_id", "row", "tokens", F.explode(F.sequence(F.lit(0), whole)).alias("part_no")).select(
        "doc_id", "row", "part_no", (F.col("part_no") * cap).alias("token_start"), F.least("tokens", (F.col("part_no") + 1) * cap).cast("int").alias("token_end")
    )
    full = (F.col("token_end") - F.col("token_start")) == cap
    own = parts.where(full).withColumn("container_id", F.concat_ws("-", F.lit("own"), "row", "part_no"))
    first = materialise(_grouped(parts.where(~full), s, 1), "pack-first")
    done = first.where(F.col("fill") >= cap * s.full).drop("fill")
    again = _grouped(first.where(F.col("fill") < cap * s.full).drop("fill", "container_id"), s, 2).drop("fill")
    return own.unionByName(done).unionByName(again).drop("row")
