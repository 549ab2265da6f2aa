"""Keyword-stuffed and link-list pages (problem 8).

A page is cut into strings (sentences, hard-wrapped lines rejoined, runs of pieces without
function words). Two conditions make it spam, and neither does alone:

- list density: more than half of its words, page furniture aside, stand in strings that look like
  lists of keywords, links or tags rather than sentences or records;
- replication: most of these strings' phrases are replicated elsewhere, that is on several hosts.

Phrases are what stands between marks of punctuation, up to five words; longer stretches are
exploded into shingles of five words. Either is taken without order and repetition, since stuffed
pages shuffle the same few keywords. Distinct hosts are counted per phrase over the whole crawl.

Strings of prose give no phrases, so the shuffle carries the suspicious text alone. A phrase that
a third of the pages share is one key after the map-side aggregation per host; the join back
broadcasts the replicated phrases while they are few and is salted beyond.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import main_body
from tessera.session import materialise

BROADCAST_ROWS = 1_000_000
SALTS = 32


@dataclass(frozen=True)
class Limits:
    """``share`` of the words in strings of evidence ``listed`` or more is the list density asked
    for; ``replicated`` of the weight of their phrases, of up to ``words`` words, must stand on
    ``hosts`` hosts or more."""

    share: float = 0.5
    listed: float = 0.4
    replicated: float = 0.5
    hosts: int = 3
    words: int = 5


# Function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(
    """a an the and or but of to in on at by for from with without into over under above after before between through during until while when where
    which who whose that this these those there it its he she they we you i his her their our your as if because although not no is are was were be
    been being has have had do does did can could may might must shall should will would than then so also only each every all any some such both
    der die das den dem des ein eine einer eines einem einen und oder aber von vom zu zum zur im am an auf aus bei mit nach vor über unter durch für
    gegen ohne um bis dass ob wenn als wie weil doch nicht kein keine ist sind war waren wird wurde wurden werden worden hat haben hatte muss müssen
    soll kann es er sie wir ihr sich sein seine ihre dieser diese dieses jeder alle seit später
    le la les un une des du de au aux et ou mais dans sur sous par pour avec sans entre vers chez que qui dont où ce cette ces il elle ils elles on
    nous vous se sa son ses leur leurs ne pas plus est sont était a ont avait été être peut doit soit tous toute toutes avant après près en
    el los las una unos unas del al y o pero que quien cuyo donde este esta estos estas ese esa lo su sus se no es son era fue ha han había sido ser
    puede debe con sin por para entre sobre desde hasta antes después cada todo toda todos aunque cuando luego tras""".split()
)
# Those of them that also tie keywords together: articles, prepositions, and, or.
GLUE = frozenset(
    """a an the and or of to in on at by for from with without into over under near der die das den dem des ein eine einer eines einem einen und oder von vom
    zu zum zur im am an auf aus bei mit für le la les un une des du de au aux et ou dans sur pour avec sans en el los las una del al y o con sin por para""".split()
)
_FIGURE = re.compile(r"\d[\d.,]*\s*(?:%|°C|K|ppm|bar|kPa|mΩ|V|s|min|days?|h|m|mm|cm|Minuten|Tage|jours|minutes|minutos|días)(?![\w-])")
_WORDLIKE = re.compile(r"[^\W_]")
_LINK = re.compile(r"https?://|www\.|\]\(")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[^\W\d_])")
_BREAK = re.compile(r"\s*(?:[#|>]|[-*•–—»]\s|\d+[.)]\s|\[\d+\])")
_HEADING = re.compile(r"#{1,6}\s|\d+(?:\.\d+)+\s")
_STRIP = ".,;:!?()[]\"'“”«»|*-–—•#>…"
_TARGET = re.compile(r"\b(?:https?://|www\.)[^\s/()]+")
_MARKS = re.compile(r"[,;|.!?:()\[\]#»*•\"“”\n/]|\s[-–—]\s")
_LETTERS = re.compile(r"[^\W\d_]+")


def _words(piece: str) -> list[str]:
    """The words of a piece, lower case, without the punctuation around them."""
    return [w for t in piece.lower().split() if (w := t.strip(_STRIP)) and (w[0].isalnum() or _WORDLIKE.search(w))]


def _has_function_words(low: list[str]) -> bool:
    return sum(map(FUNCTION_WORDS.__contains__, low)) * 12 > len(low)


def strings(lines: list[str]) -> list[tuple[str, list[str]]]:
    """Pieces of a text to be judged, with their words: its lines, each split at sentence ends;
    hard-wrapped lines (full, and going on in the next) are joined first. Neighbouring pieces
    without function words are put together, since keyword strings may be dressed up with full
    stops; headings stand alone."""
    out: list[tuple[str, list[str]]] = []
    held, width = "", 0
    run: list[str] = []
    run_words: list[str] = []

    def close() -> None:
        nonlocal run, run_words
        if run:
            out.append((" ".join(run), run_words))
            run, run_words = [], []

    def add(line: str) -> None:
        if _HEADING.match(line):
            close()
            out.append((line, _words(line)))
            return
        for piece in _SENTENCE.split(line) if ". " in line or "! " in line or "? " in line or not line.isascii() else (line,):
            low = _words(piece)
            if _has_function_words(low):
                close()
                out.append((piece, low))
            else:
                run.append(piece)
                run_words.extend(low)

    for raw in lines:
        line = raw.strip()
        if held and line and 60 <= width <= 100 and held[-1] not in ".!?:" and not _BREAK.match(line) and width + len(line.split(None, 1)[0]) >= 78:
            held += " " + line
        else:
            if held:
                add(held)
            held = line
        width = len(line)
    if held:
        add(held)
    close()
    return out


def _returning(low: list[str], span: int = 12) -> float:
    """Share of the words, function words aside, that stood among the ``span`` before them."""
    last: dict[str, int] = {}
    n = met = 0
    for x in low:
        if x not in FUNCTION_WORDS:
            met += n - last.get(x, -span - 1) <= span
            last[x] = n
            n += 1
    return met / max(1, n)


def list_evidence(string: str, low: list[str]) -> float:
    """How much a piece with the words ``low`` looks like a string of keywords, links or tags rather
    than a sentence or a record, from 0 to 1. Words of a clause (verbs, pronouns, subordination)
    speak against it; articles and prepositions do so the less, the more the other words are
    repeated; figures with units speak for a record."""
    n = len(low)
    if not n or _HEADING.match(string):
        return 0.0
    links = len(_LINK.findall(string)) if "](" in string or "://" in string or "www." in string else 0
    tags = sum(t.lstrip("»*•- ")[:1] == "#" and len(t) > 2 for t in string.split()) if "#" in string else 0
    if tags >= max(2, 0.5 * n):
        return 1.0
    if n < 4 and not links:
        return 0.0
    plain = sum(map(FUNCTION_WORDS.__contains__, low))
    glue = sum(map(GLUE.__contains__, low)) if plain else 0
    clause = (plain - glue) / n
    short = 0.3 if n < 8 else 0.0
    if not links and clause > 0.225 - short / 4:
        return 0.0  # what repetition could add does not outweigh it
    again = 1 - len(set(low)) / n
    score = 0.8 - 4.0 * clause + 0.5 * again + 1.5 * links / n - short
    if glue and score > 0:
        # words that return at once are at most those that return at all
        back = (n - len(set(low))) / max(1, n - plain) if n >= 12 else 0.0
        tied = 1.0 if 1.5 - 2.4 * back >= 1.0 else min(1.0, max(0.0, 1.5 - 2.4 * _returning(low)))
        score -= 4.0 * glue / n * tied
    if score > 0:
        score -= 6.0 * len(_FIGURE.findall(string)) / n
    return min(1.0, max(0.0, score))


def phrases(string: str, words: int) -> dict[str, int]:
    """Phrases of a string and the words each brings: stretches between marks, up to ``words``
    words, longer ones as shingles of ``words`` words. A phrase is its distinct words in order of
    the alphabet; figures, and hosts of links, are left out. A hashtag is a phrase."""
    out: dict[str, int] = {}
    low = string.lower()
    if "://" in low or "www." in low:
        low = _TARGET.sub(" , ", low)
    for part in _MARKS.split(low):
        w = _LETTERS.findall(part)
        for i in range(max(1, len(w) - words + 1) if w else 0):
            key = " ".join(sorted(set(w[i : i + words])))
            out[key] = out.get(key, 0) + (min(len(w), words) if i == 0 else 1)
    return out


def _stuffed(text: str) -> bool:
    """Whether a text says the same words over and over, without function words."""
    low = _words(text)
    return len(low) >= 12 and len(set(low)) < 0.6 * len(low) and not _has_function_words(low)


def without_furniture(lines: list[str], gone: set[int]) -> list[str]:
    """Lines with page furniture (numbers ``gone``) blanked. A block of furniture lines that has links
    or hashtags written out, or a block or line that says the same words over and over, is no
    site's menu: it stays."""
    kept, block = [], []

    def close() -> None:
        whole = " ".join(block)
        links = sum(len(_LINK.findall(x)) for x in block) + sum(t.lstrip("»")[:1] == "#" and len(t) > 2 for t in whole.split())
        stays = links >= 3 or _stuffed(whole)
        kept.extend(x if stays or _stuffed(x) else "" for x in block)
        block.clear()

    for k, x in enumerate(lines, 1):
        if k in gone or (block and not x.strip()):
            block.append(x)
        else:
            close()
            kept.append(x)
    close()
    return kept


_FORMS = "__doc bigint, __host string, __words int, __listed int, __phrases array<struct<w:int,p:string>>"


def _form(limits: Limits):
    model = main_body.fit()

    def listed(lines: list[str]) -> tuple[int, list[tuple[int, str]]]:
        total, found = 0, []
        for s, low in strings(lines):
            total += len(low)
            if list_evidence(s, low) >= limits.listed:
                found.append((len(low), s))
        return total, found

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready, known = (main_body._Weights(model[0]), model[1]), {}
        for pdf in batches:
            out = []
            for doc, host, title, text, page in zip(pdf["__doc"], pdf["__host"], pdf["__title"], pdf["__text"], pdf["__page"]):
                lines = text.split("\n")
                if page:
                    lines = without_furniture(lines, set(main_body.label_page(text, title, ready, known)))
                total, found = listed(lines)
                if not found:
                    continue
                weights: dict[str, int] = {}
                for _, s in found:
                    for p, w in phrases(s, limits.words).items():
                        weights[p] = weights.get(p, 0) + w
                out.append((doc, host, total, sum(n for n, _ in found), [{"w": w, "p": p} for p, w in weights.items()]))
            yield pd.DataFrame(out, columns=["__doc", "__host", "__words", "__listed", "__phrases"])

    return run


def _host() -> F.Column:
    """The uri's host without letter case and www.; the source where there is no uri."""
    host = F.regexp_extract(F.lower("uri"), r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?(?:www\.)?([^/:?#]+)", 1)
    return F.coalesce(F.nullif(host, F.lit("")), F.col("source"))


def evidence(documents: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(doc_id, words, list_words, phrase_words, replicated_words) of each page with list-like
    strings: its words, furniture aside; those in such strings; the weight of these strings'
    phrases, and of those among them that stand on ``hosts`` hosts or more.

    documents: doc_id, title, text, uri, source, extractor; other columns are not read. Pages of
    extractor ``html`` have furniture, which is left out of all four figures. Null, empty and blank
    texts, and pages without any list-like string, give no row. A page without uri and source has
    no host and replicates nothing, but its phrases are looked up like any other's. Equal rows are
    taken once.
    """
    docs = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("doc_id").cast("bigint").alias("__doc"), _host().alias("__host"), F.col("title").alias("__title"), F.col("text").alias("__text"),
        F.coalesce(F.col("extractor") == "html", F.lit(False)).alias("__page"),
    )
    forms = materialise(docs.mapInPandas(_form(limits), _FORMS), "spam-forms")
    each = forms.select("__doc", "__host", F.explode("__phrases").alias("__p")).select("__doc", "__host", F.xxhash64("__p.p").alias("__phrase"), F.col("__p.w").alias("__w"))
    spread = (
        each.where("__host is not null").select("__phrase", "__host").groupBy("__phrase", "__host").agg(F.lit(1).alias("one"))
        .groupBy("__phrase").agg(F.count("*").alias("__hosts")).where(F.col("__hosts") >= limits.hosts).select("__phrase")
    )
    spread = materialise(spread, "spam-phrases")
    if spread.count() <= BROADCAST_ROWS:
        held = each.join(F.broadcast(spread), "__phrase", "left_semi")
    else:
        salted = spread.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        held = each.withColumn("__salt", F.pmod(F.hash("__doc"), F.lit(SALTS))).join(salted, ["__phrase", "__salt"], "left_semi")
    # a page given twice has its phrases twice: its weight is that of one row
    rows = forms.select("__doc", "__words", "__listed", F.aggregate("__phrases.w", F.lit(0), lambda x, y: x + y).alias("__all")).groupBy("__doc").agg(
        F.max("__words").alias("__words"), F.max("__listed").alias("__listed"), F.max("__all").alias("__all"), F.count("*").alias("__times")
    )
    counted = held.groupBy("__doc").agg(F.sum("__w").alias("__held"))
    return rows.join(counted, "__doc", "left").select(
        F.col("__doc").alias("doc_id"), F.col("__words").alias("words"), F.col("__listed").alias("list_words"), F.col("__all").cast("int").alias("phrase_words"),
        F.coalesce(F.col("__held") / F.col("__times"), F.lit(0)).cast("int").alias("replicated_words"),
    )


def spam_pages(documents: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(doc_id) of the pages with more than ``share`` of their words in list-like strings, at least
    ``replicated`` of whose phrases are on several hosts. On a crawl of few hosts nothing is
    replicated, and nothing is found."""
    found = evidence(documents, limits).where(F.col("list_words") > F.col("words") * F.lit(limits.share))
    return found.where((F.col("replicated_words") >= F.col("phrase_words") * F.lit(limits.replicated)) & (F.col("phrase_words") > 0)).select("doc_id")
