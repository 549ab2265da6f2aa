import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import splitting as S

CH = "chunk_id string, document_id bigint, section string, char_start int, char_end int, text string"


def text_of(seed, n=6000):
    r = random.Random(seed)
    out = []
    while sum(map(len, out)) < n:
        out.append(" ".join("abcdefgh"[r.randrange(8)] * r.randint(1, 9) for _ in range(r.randint(3, 20))).capitalize() + r.choice([". ", ".\n", ".\n\n"]))
    return "".join(out)


def check(text, sizes=S.Sizes()):
    spans = S.split_span(text, sizes)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert a < c <= b < d and b - c <= sizes.overlap
    assert all(0 < b - a <= sizes.most for a, b in spans)
    return spans


def test_covers_with_bounded_pieces_and_overlaps():
    for seed in range(20):
        text = text_of(seed)
        spans = check(text)
        assert all(text[b - 1].isspace() for _, b in spans[:-1])  # cuts at natural ends


@given(st.text(alphabet="ab .\n!é😀", min_size=1, max_size=5000))
@settings(max_examples=60, deadline=None)
def test_any_text(text):
    check(text)


def test_no_boundary_at_all():
    check("x" * 10_000)


def test_short_and_empty():
    assert S.split_span("") == []
    assert S.split_span("x" * 1200) == [(0, 1200)]
    assert len(S.split_span("x" * 1201)) == 2


def test_an_edit_moves_only_neighbouring_cuts():
    r, strict = random.Random(1), 0
    for seed in range(60):
        text = text_of(seed, 20_000)
        at = text.index(". ", r.randrange(1000, 18_000)) + 2
        edited = text[:at] + "An inserted sentence of some words. " + text[at:]
        shift = len(edited) - len(text)
        cuts = [b for _, b in S.split_span(text)[:-1]]
        again = {b for _, b in S.split_span(edited)[:-1]}
        before = [c for c in cuts if c <= at]
        after = [c for c in cuts if c > at]
        # of the cuts on either side of the edit, the nearest two may move
        strict += set(before[:-2]) <= again and {c + shift for c in after[2:]} <= again
    assert strict >= 57, strict


def test_operator_cases(spark):
    docs = spark.createDataFrame([(1, "a " * 2000, "h"), (2, None, ""), (3, "", ""), (5, "short", "")], "doc_id bigint, text string, section string")
    rows = [("c1", 1, "S", 0, None, ""), ("c1", 1, "S", 0, None, ""), ("c2", 1, None, 100, 1300, ""), ("c3", 1, "T", 100, 1301, ""), ("c4", 2, "", 0, None, ""), ("c5", 3, "", 0, None, ""), ("c6", 9, "", 0, 5000, ""), ("c7", 5, "", 2, 2, "")]
    chunks = spark.createDataFrame(rows, CH)
    got = S.split_sections(chunks, docs).collect()
    ids = {r.chunk_id for r in got}
    assert ids == {"c1", "c2", "c3"}
    assert sum(r.chunk_id == "c2" for r in got) == 1
    assert max(r.char_end for r in got if r.chunk_id == "c1") == 4000
    assert len({(r.chunk_id, r.piece_no) for r in got}) == len(got)
    assert {r.section for r in got if r.chunk_id == "c2"} == {""}
    over = S.split_sections(chunks, docs, oversized_only=True).collect()
    assert {r.chunk_id for r in over} == {"c1", "c3"}
    past = spark.createDataFrame([("p1", 5, "", 2, 1_999_999_999, ""), ("p2", 5, "", 50, 1_999_999_999, ""), ("p3", 5, "", 3, 90, "")], CH)
    rows = sorted((r.chunk_id, r.piece_no, r.char_start, r.char_end, r.section_chars) for r in S.split_sections(past, docs).collect())
    assert rows == [("p1", 0, 2, 5, 1_999_999_997), ("p2", 0, 5, 5, 1_999_999_949), ("p3", 0, 3, 5, 87)]
    assert S.split_sections(chunks.limit(0), docs).count() == 0
    assert S.split_sections(chunks, docs.limit(0)).count() == 0


def test_pieces_match_sections_cut_one_by_one(spark, monkeypatch):
    texts = {i: text_of(i, 500 * i) for i in range(1, 12)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    spans = [(f"c{i}-{k}", i, f"s{k}", 700 * k, None if k % 3 == 0 else 700 * k + 1500, "") for i in texts for k in range(4)]
    want = set()
    for c, d, section, a, b, _ in spans:
        n = len(texts[d])
        b = n if b is None else b
        if b > a:
            for k, (x, y) in enumerate(S.split_span(texts[d][a:b]) or [(0, 0)]):
                want.add((c, d, section, k, min(a, n) + x, min(a, n) + y, b - a))
    chunks = spark.createDataFrame(spans, CH)
    assert set(map(tuple, S.split_sections(chunks, docs).collect())) == want
    monkeypatch.setattr(S, "BROADCAST_IDS", 0)
    assert set(map(tuple, S.split_sections(chunks, docs).collect())) == want


def test_offsets_are_characters(spark):
    docs = spark.createDataFrame([(1, "😀é " * 1000)], "doc_id bigint, text string")
    chunks = spark.createDataFrame([("c", 1, "", 0, None, "")], CH)
    got = S.split_sections(chunks, docs).collect()
    assert max(r.char_end for r in got) == 3000 and max(r.char_end - r.char_start for r in got) <= 1200
