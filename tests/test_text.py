"""Text rules against their statement in plain Python, on cases and on generated texts."""

import math
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import constants as C
from tessera.functions import text as T


def one(spark, column, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


@pytest.mark.parametrize("token, want", [
    ("gas", "gas"), ("gases", "gas"), ("vents", "vent"), ("venting", "vent"), ("charge", "charg"), ("charging", "charg"), ("batteries", "battery"), ("running", "run"), ("string", "str"),
    ("adding", "ad"), ("classes", "class"), ("bus", "bus"), ("basis", "basis"), ("fire", "fir"), ("80", "80"), ("used", "used"), ("bed", "bed"), ("ties", "tie"),
])
def test_stem(spark, token, want):
    assert one(spark, T.stem(F.col("t")), token) == [want]


def test_tokens_and_terms(spark):
    assert one(spark, T.tokenize("t"), "Li-ion cells' 1,5 and UL9540A 12.5 état") == [["li-ion", "cells'", "1,5", "and", "ul9540a", "12.5", "tat"]]
    assert sorted(one(spark, T.content_terms("t"), "What's the cell's venting? The vents of cells")[0]) == ["cell", "vent"]
    assert one(spark, T.content_terms("t"), "", "of 80 UL") == [[], []]


def test_sentences_fold_citations(spark):
    text = "It exceeds 80 C. [1] Venting follows. [2] [3]\n\nNext line (A). \"Quoted.\" small. not split"
    assert one(spark, T.sentences("t"), text)[0] == ["It exceeds 80 C. [1]", "Venting follows. [2] [3]", "Next line (A).", '"Quoted." small. not split']
    assert one(spark, T.sentences("t"), "[1] First stays.", "") == [["[1] First stays."], []]


@pytest.mark.parametrize("text, want", [
    ("100 Wh", {"100wh"}), ("100 watt hours", {"100wh"}), ("80 °C", {"80°c"}), ("80.0 degrees Celsius", {"80°c"}), ("5 grams of", {"5g"}), ("1,234,567", {"1234", "567"}), ("1,5", {"15"}),
    ("50%", {"50"}), ("50 percent", {"50%"}), ("v2.1", set()), ("10 fatalities", {"10"}), ("3.50 bar", {"3.5bar"}), ("0.5 m and 0.5 m", {"0.5m"}),
])
def test_numbers(spark, text, want):
    assert set(one(spark, T.numbers_with_units("t"), text)[0]) == want


def python_numbers(text):
    out = set()
    for m in re.finditer(r"(?<![\w.])(\d+(?:[.,]\d+)?)\s*(°\s?[CF]|µ?[A-Za-z]+(?:[- ][A-Za-z]+)?)?", text):
        v = float(m[1].replace(",", ""))
        unit = re.sub(r"\s+", " ", (m[2] or "").strip().lower()).replace("° ", "°")
        unit = C.UNIT_OF.get(unit, C.UNIT_OF.get(re.split("[ -]", unit)[0], ""))
        out.add((str(int(v)) if v.is_integer() else str(v)) + unit)
    return out


@given(st.lists(st.text(alphabet="0123456789., °CFbarkWhm-xyz\n", max_size=15), min_size=1, max_size=20))
@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_numbers_generated(spark, texts):
    for t, got in zip(texts, one(spark, T.numbers_with_units("t"), *texts)):
        assert set(got) == python_numbers(t), t


def test_meta_and_prose(spark):
    meta = ["There is no evidence for this.", "REASONING", "Stated directly in the cited passage.", "The source states the limit is 100 Wh.", "The valve was closed by hand."]
    assert one(spark, T.is_meta("t"), *meta) == [True, True, True, False, False]
    prose = ["The valve was closed by hand before the alarm was raised.", "Too short.", "How The Valve Was Closed By Hand In The North Hall Yesterday.", "see vol. 3 of the journal of fire research for all of it.", "The valve was closed by hand before the alarm"]
    assert one(spark, T.is_prose("t"), *prose) == [True, False, False, False, False]


def test_claims(spark):
    kinds = ["See also the annex for 3 bar", "between 10 to 20 bar it holds", "Operators must isolate the tank", "It weighs 3 kg", "Venting is defined as release", "Nothing here"]
    assert one(spark, T.claim_kind("t"), *kinds) == [None, "range", "requirement", "fact", "definition", None]


def test_small_functions(spark):
    assert one(spark, T.truncate("t", 10), "short", "exactly 10", "a longer text") == ["short", "exactly 10", "a longer…"]
    assert one(spark, T.token_estimate("t"), "", "x" * 9) == [1, 2]
    assert one(spark, T.normalise("t"), " a  b\r\nc\n\n\n\nd ") == ["a b\nc\n\nd"]
    assert [str(x) if x else None for x in one(spark, T.partial_date("t"), "2024-02-30", "2024-02-03", "2024-02", "2024", "undated", None)] == [None, "2024-02-03", "2024-02-01", "2024-01-01", None, None]
    assert one(spark, T.strip_html("t"), "<p>a &amp; <b>b</b></p>") == ["a & b"]
    assert one(spark, T.normalise_name("t", ("ltd",)), "The ACME Works, Ltd.") == ["the acme works"]
    got = one(spark, T.recency("t", F.lit("2024-01-01").cast("date"), 365), "2023-01-01", None, "2030")
    assert math.isclose(got[0], 0.75) and got[1:] == [1.0, 1.0]
    assert [tuple(p) for p in one(spark, T.field_pairs("t"), "Name: ACME\nhttp://x: y\nA: b\nLegal form: ltd: x")[0]] == [("Name", "ACME"), ("Legal form", "ltd: x")]


def test_coverage_and_jaccard(spark):
    df = spark.sql("select array('a','b') x, array('b','c','d') y, cast(array() as array<string>) z")
    row = df.select(T.coverage(F.col("x"), F.col("y")), T.coverage(F.col("z"), F.col("y")), T.jaccard(F.col("x"), F.col("y")), T.jaccard(F.col("z"), F.col("y"))).first()
    assert tuple(row) == (0.5, 1.0, 0.25, 0.0)
