"""Text rules as column functions. Everything stays in the JVM; no Python per row.

Arguments are string columns (or names); null gives null unless stated. Tokens, stems and
terms are ASCII by definition of the token pattern.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import constants as C


def _array(words: Iterable[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _trimmed(x: Column) -> Column:
    return F.trim(x)  # with one argument: transform would pass the index as the characters to trim


def normalise(c: Column | str) -> Column:
    """No-break blanks to blanks, line ends to \\n, runs of blanks to one, three or more line ends
    to two, trimmed. (Compatibility forms of letters are left to the reader of raw files.)"""
    t = F.trim(F.replace(_col(c), F.lit("\u00a0"), F.lit(" ")), F.lit(" \t\n\x0b\f\r"))
    inner = F.regexp_replace(t, r"\r\n?", "\n")
    inner = F.regexp_replace(inner, r"[ \t]{2,}|\t", " ")  # a lone blank need not be replaced by itself
    inner = F.regexp_replace(inner, r"\n{3,}", "\n\n")
    # most texts need none of it, which plain searches tell sooner than patterns
    odd = t.contains("\r") | t.contains("\t") | t.contains("  ") | t.contains("\n\n\n")
    return F.when(odd, inner).otherwise(t)


def tokenize(c: Column | str) -> Column:
    """Lower-case word tokens; hyphenated terms stay whole."""
    return F.transform(F.regexp_extract_all(_col(c), F.lit(C.WORD), F.lit(0)), F.lower)


def depossess(t: Column) -> Column:
    """A token without its possessive tail or trailing apostrophes."""
    n = F.length(t)
    return (
        F.when((n > 3) & t.endswith("'s"), F.left(t, n - 2))
        .when((n > 3) & t.endswith("s'"), F.left(t, n - 1))
        .otherwise(F.regexp_replace(t, "['’]+$", ""))
    )


def stem(t: Column) -> Column:
    """The form that inflections of a token agree on: an ordered list of suffix rules."""
    n = F.length(t)
    plural = t.endswith("s") & ~t.endswith("ss") & ~t.endswith("us") & ~t.endswith("is")
    cut = (
        F.when((n > 4) & t.endswith("sses"), F.left(t, n - 2))
        .when((n > 5) & t.endswith("ing"), F.regexp_replace(t, r"(?<=.)(.)\1ing$|ing$", "$1"))
        .when((n > 4) & t.endswith("ed"), F.left(t, n - 2))
        .when((n > 3) & plural, F.left(t, n - 1))
        .otherwise(t)
    )
    out = F.when((n > 4) & t.endswith("ies"), F.concat(F.left(t, n - 3), F.lit("y"))).otherwise(F.regexp_replace(cut, r"^(.{3,})e$", "$1"))
    return F.when(t.rlike("^[a-z]"), out).otherwise(t)


def plain_terms(c: Column | str) -> Column:
    """Distinct tokens without possessive tails, stop words and words of one or two letters."""
    tokens = F.transform(F.array_distinct(tokenize(c)), depossess)
    return F.filter(F.array_except(tokens, _array(C.STOPWORDS)), lambda t: F.length(t) > 2)


def content_terms(c: Column | str) -> Column:
    """The set of stemmed terms that carry a text's meaning."""
    return F.array_distinct(F.transform(plain_terms(c), stem))


def keyword_terms(c: Column | str) -> Column:
    """Tokens of the keyword index, with repetitions: not stop words, longer than one letter."""
    stop = _array(C.STOPWORDS)
    return F.filter(tokenize(c), lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def coverage(needle: Column, hay: Column) -> Column:
    """Share of ``needle`` (a set) found in ``hay``; an empty needle is covered."""
    return F.when(F.size(needle) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(needle, hay)) / F.size(needle))


def token_estimate(c: Column | str) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(_col(c)) / 4)).cast("int")


def truncate(c: Column | str, limit: int, suffix: str = "…") -> Column:
    c = _col(c)
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.regexp_replace(F.left(c, F.lit(max(0, limit - len(suffix)))), r"\s+$", ""), F.lit(suffix)))


def sentence_parts(c: Column | str) -> Column:
    """Pieces of each line, cut after . ! ? where a capital, bracket or quote follows."""
    lines = F.filter(F.transform(F.split(_col(c), "\n", -1), _trimmed), lambda x: x != "")
    return F.filter(F.flatten(F.transform(lines, lambda x: F.transform(F.split(x, C.SENTENCE_GAP, -1), _trimmed))), lambda x: x != "")


def fold_citations(parts: Column) -> Column:
    """Pieces with leading [n] marks moved to the end of the piece they belong to."""
    last = lambda acc: F.element_at(acc, -1)
    before = lambda acc: F.slice(acc, 1, F.size(acc) - 1)

    def add(acc: Column, p: Column) -> Column:
        marks = F.trim(F.regexp_extract(p, C.LEADING_CITATIONS, 1))
        rest = F.trim(F.regexp_replace(p, C.LEADING_CITATIONS, ""))
        joined = F.concat(before(acc), F.array(F.concat_ws(" ", last(acc), marks)))
        folded = F.when(rest == "", joined).otherwise(F.concat(joined, F.array(rest)))
        return F.when((marks != "") & (F.size(acc) > 0), folded).otherwise(F.concat(acc, F.array(p)))

    return F.aggregate(parts, F.array().cast("array<string>"), add)


def sentences(c: Column | str) -> Column:
    """Sentences with their citation marks attached."""
    parts = sentence_parts(c)
    return F.when(F.exists(parts, lambda p: p.rlike(C.LEADING_CITATIONS)), fold_citations(parts)).otherwise(parts)


def canonical_unit(raw: Column) -> Column:
    """Canonical form of a unit's spelling; empty if it is none."""
    units = F.create_map(*[F.lit(x) for kv in C.UNIT_OF.items() for x in kv])
    clean = F.replace(F.regexp_replace(F.trim(F.lower(raw)), r"\s+", " "), F.lit("° "), F.lit("°"))
    first = F.regexp_extract(clean, r"^[^ -]*", 0)
    return F.coalesce(F.try_element_at(units, clean), F.try_element_at(units, first), F.lit(""))


def numbers_with_units(c: Column | str) -> Column:
    """Set of figures with their canonical unit, whole values without a fraction."""
    c = _col(c)
    figures = F.regexp_extract_all(c, F.lit(C.NUMBER), F.lit(1))
    units = F.regexp_extract_all(c, F.lit(C.NUMBER), F.lit(2))

    def show(f: Column, u: Column) -> Column:
        v = F.regexp_replace(f, ",", "").cast("double")
        return F.concat(F.when((v == F.floor(v)) & (v < 9e18), v.cast("bigint").cast("string")).when(v == F.floor(v), v.cast("decimal(38,0)").cast("string")).otherwise(v.cast("string")), canonical_unit(u))

    return F.array_distinct(F.zip_with(figures, units, show))


def magnitude(number: Column) -> Column:
    """A figure of ``numbers_with_units`` without its unit."""
    return F.regexp_replace(number, "[a-z°%]+$", "")


def quoted_spans(c: Column | str) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(_col(c), F.lit(C.QUOTED), F.lit(1)), lambda q: F.lower(F.trim(q))))


def citations(c: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(_col(c), F.lit(C.CITATION), F.lit(1)), lambda x: x.cast("int"))


def strip_citations(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), C.CITATION, " ")


def strip_footnotes(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(c), r"\s*\[\d+\]", ""))


def is_meta(c: Column | str) -> Column:
    """Whether a sentence speaks of the answer or its sources rather than of the matter."""
    c = F.trim(_col(c))
    bare = strip_citations(c)
    return is_meta_of(c, content_terms(bare), numbers_with_units(bare), quoted_spans(bare))


def is_meta_of(c: Column, terms: Column, numbers: Column, quotes: Column) -> Column:
    """``is_meta`` of a trimmed sentence whose terms, figures and quotations are at hand."""
    words = _array(C.APPARATUS)
    share = F.size(F.filter(terms, lambda t: F.array_contains(words, t) | F.array_contains(words, F.concat(t, F.lit("e"))))) / F.size(terms)
    plain = (F.size(numbers) == 0) & (F.size(quotes) == 0)
    return c.rlike(C.META) | c.rlike(C.ANSWER_HEADING) | (plain & (F.size(terms) >= 2) & (share >= 0.5))


def is_prose(c: Column | str) -> Column:
    """Whether a sentence has the shape of a statement rather than of a heading or reference."""
    c = F.trim(_col(c))
    words = F.split(c, r"\s+", -1)
    alpha = F.filter(words, lambda w: w.rlike(r"^\p{L}"))
    capital = F.size(F.filter(alpha, lambda w: w.rlike(r"^\p{Lu}")))
    title_case = (F.size(alpha) > 0) & (capital / F.size(alpha) > 0.6)
    return (F.length(c) >= 40) & c.rlike(r"[.?!]$") & (F.size(words) >= 7) & c.rlike(r"^[\p{Lu}\p{Nd}]") & ~c.rlike(C.NOT_PROSE) & ~title_case


def claim_kind(c: Column | str) -> Column:
    """Kind of claim a sentence makes, or null: range, requirement, fact, definition."""
    c = F.trim(_col(c))
    return (
        F.when(c.rlike(C.NOISE), F.lit(None).cast("string"))
        .when(c.rlike(C.RANGE), "range")
        .when(c.rlike(C.REQUIREMENT), "requirement")
        .when(F.size(numbers_with_units(c)) > 0, "fact")
        .when(c.rlike(C.DEFINITION), "definition")
    )


def field_pairs(c: Column | str) -> Column:
    """``Label: value`` lines as structs (label, value); a label has 2 to 61 characters and no link."""
    pattern = F.lit(r"(?m)^([^:\n]{2,61}): +(\S[^\n]*)$")
    labels, values = F.regexp_extract_all(_col(c), pattern, F.lit(1)), F.regexp_extract_all(_col(c), pattern, F.lit(2))
    pairs = F.zip_with(labels, values, lambda a, b: F.struct(F.trim(a).alias("label"), F.trim(b).alias("value")))
    return F.filter(pairs, lambda p: ~F.lower(p["label"]).contains("http"))


def strip_html(c: Column | str) -> Column:
    """Tags to blanks, blanks collapsed. Entities of the basic set are read."""
    t = F.regexp_replace(_col(c), r"<[^>]+>", " ")
    for entity, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(mark))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def partial_date(c: Column | str) -> Column:
    """Date of a full date, a month or a year; null for anything else."""
    c = _col(c)
    return (
        F.when(c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(c, "yyyy-M-d"))
        .when(c.rlike(r"^\d{4}-\d{1,2}$"), F.try_to_date(F.concat(c, F.lit("-1")), "yyyy-M-d"))
        .when(c.rlike(r"^\d{4}$"), F.try_to_date(F.concat(c, F.lit("-1-1")), "yyyy-M-d"))
    )


def recency(c: Column | str, as_of: Column, half_life_days: int = C.HALF_LIFE_DAYS) -> Column:
    """1 for undated sources, else decaying from 1 towards 0.5 with age."""
    age = F.greatest(F.lit(0), F.datediff(as_of, partial_date(c)))
    return F.coalesce(0.5 + 0.5 * F.exp(-F.log(F.lit(2.0)) * age / half_life_days), F.lit(1.0))


def normalise_name(c: Column | str, legal_forms: tuple[str, ...]) -> Column:
    """A name in lower case without punctuation and without the words of its legal form."""
    words = F.split(F.trim(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", " ")), " ", -1)
    forms = _array(legal_forms)
    return F.array_join(F.filter(words, lambda w: (w != "") & ~F.array_contains(forms, w)), " ")


def padded_words(c: Column | str) -> Column:
    """Lower-case letters and digits only, blanks between and around: for phrase tests."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", " ")), F.lit(" "))


def short_hash(*parts: Column, prefix: str, length: int = 20) -> Column:
    return F.concat(F.lit(prefix), F.left(F.sha2(F.concat(*parts), 256), F.lit(length)))


def contains_any(c: Column, words: Iterable[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def transform_terms(*columns: str) -> Column:
    """Stemmed terms of several columns together, with repetitions."""
    tokens = F.transform(tokenize(F.concat_ws("\n", *columns)), depossess)
    stop = _array(C.STOPWORDS)
    return F.transform(F.filter(tokens, lambda t: (F.length(t) > 2) & ~F.array_contains(stop, t)), stem)
