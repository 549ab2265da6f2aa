"""Pieces of SQL that state the text rules for the checking engine.

Written from the rules, not from the column functions: where the checking engine lacks
look-around or back-references another formulation is used.
"""

from __future__ import annotations

from tessera.functions import constants as C


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strings(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def normalise(c: str) -> str:
    return (
        f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate({c}, chr(160), ' '), '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'),"
        f" '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"
    )


def tokenize(c: str) -> str:
    return f"list_transform(regexp_extract_all({c}, {q(C.WORD)}), lambda t: lower(t))"


def depossess(t: str) -> str:
    return (
        f"case when length({t}) > 3 and suffix({t}, '''s') then left({t}, length({t}) - 2) when length({t}) > 3 and suffix({t}, 's''') then left({t}, length({t}) - 1)"
        f" else rtrim({t}, '''’') end"
    )


def stem(t: str) -> str:
    stripped = f"left({t}, length({t}) - 3)"
    ing = f"case when length({t}) > 5 and substr({t}, length({t}) - 3, 1) = substr({t}, length({t}) - 4, 1) then left({t}, length({t}) - 4) else {stripped} end"
    cut = (
        f"case when length({t}) > 4 and suffix({t}, 'sses') then left({t}, length({t}) - 2) when length({t}) > 5 and suffix({t}, 'ing') then {ing}"
        f" when length({t}) > 4 and suffix({t}, 'ed') then left({t}, length({t}) - 2)"
        f" when length({t}) > 3 and suffix({t}, 's') and right({t}, 2) not in ('ss', 'us', 'is') then left({t}, length({t}) - 1) else {t} end"
    )
    return (
        f"case when not regexp_matches({t}, '^[a-z]') then {t} when length({t}) > 4 and suffix({t}, 'ies') then left({t}, length({t}) - 3) || 'y'"
        f" else regexp_replace({cut}, '^(.{{3,}})e$', '\\1') end"
    )


def plain_terms(c: str) -> str:
    return (
        f"list_filter(list_distinct(list_transform({tokenize(c)}, lambda t: {depossess('t')})), lambda t: length(t) > 2 and not list_contains({strings(C.STOPWORDS)}, t))"
    )


def content_terms(c: str) -> str:
    return f"list_distinct(list_transform({plain_terms(c)}, lambda t: {stem('t')}))"


def transform_terms(c: str) -> str:
    return f"list_transform(list_filter(list_transform({tokenize(c)}, lambda t: {depossess('t')}), lambda t: length(t) > 2 and not list_contains({strings(C.STOPWORDS)}, t)), lambda t: {stem('t')})"


def keyword_terms(c: str) -> str:
    return f"list_filter({tokenize(c)}, lambda t: length(t) > 1 and not list_contains({strings(C.STOPWORDS)}, t))"


def coverage(a: str, b: str) -> str:
    return f"case when len({a}) = 0 then 1.0 else len(list_intersect({a}, {b})) / len({a}) end"


def sentence_parts(c: str) -> str:
    mark = "chr(30)"
    lines = f"list_filter(list_transform(string_split({c}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
    cut = f"string_split(regexp_replace(x, '([.!?])\\s+([A-Z\\[\"''(])', '\\1' || {mark} || '\\2', 'g'), {mark})"
    return f"list_filter(list_transform(flatten(list_transform({lines}, lambda x: {cut})), lambda y: trim(y)), lambda y: y <> '')"


def unit(u: str) -> str:
    table = "map {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in C.UNIT_OF.items()) + "}"
    clean = f"replace(regexp_replace(trim(lower({u})), '\\s+', ' ', 'g'), '° ', '°')"
    return f"coalesce({table}[{clean}], {table}[regexp_extract({clean}, '^[^ -]*')], '')"


def numbers_with_units(c: str) -> str:
    """The figures of a text: their starts are marked first, since there is no look-behind."""
    marked = f"regexp_replace({c}, '(^|[^\\p{{L}}\\p{{N}}_.])(\\d)', '\\1§\\2', 'g')"
    pattern = r"§(\d+(?:[.,]§?\d+)?)\s*(°\s?[CF]|µ?[A-Za-z]+(?:[- ][A-Za-z]+)?)?"
    value = "cast(replace(replace(zz.f, ',', ''), '§', '') as double)"
    shown = f"case when {value} = floor({value}) then cast(cast({value} as decimal(38,0)) as varchar) else cast({value} as varchar) end"
    pairs = f"list_transform(list_zip(regexp_extract_all({marked}, {q(pattern)}, 1), regexp_extract_all({marked}, {q(pattern)}, 2)), lambda p: {{'f': p[1], 'u': p[2]}})"
    return f"list_distinct(list_transform({pairs}, lambda zz: {shown} || {unit('zz.u')}))"


def partial_date(c: str) -> str:
    return (
        f"case when regexp_matches({c}, '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}$') then cast(try_strptime({c}, '%Y-%m-%d') as date)"
        f" when regexp_matches({c}, '^\\d{{4}}-\\d{{1,2}}$') then cast(try_strptime({c} || '-1', '%Y-%m-%d') as date)"
        f" when regexp_matches({c}, '^\\d{{4}}$') then cast(try_strptime({c} || '-1-1', '%Y-%m-%d') as date) end"
    )


def recency(c: str, as_of: str) -> str:
    return f"coalesce(0.5 + 0.5 * exp(-ln(2.0) * greatest(0, date_diff('day', {partial_date(c)}, {as_of})) / {C.HALF_LIFE_DAYS}), 1.0)"


def contains_any(c: str, words) -> str:
    return "(" + " or ".join(f"contains({c}, {q(w)})" for w in words) + ")"
