import math
import random

from tessera.llm import packing as K


def total(bins, sizes):
    return [sum(sizes[i] for i in b) for b in bins]


def test_best_fit_and_search_keep_every_item():
    r = random.Random(1)
    for cap, top in ((100, 100), (100, 40), (2048, 1900)):
        sizes = [r.randint(1, top) for _ in range(600)]
        first = K.best_fit(sizes, cap)
        after = K.local_search(sizes, [list(b) for b in first], cap)
        for bins in (first, after):
            assert sorted(i for b in bins for i in b) == list(range(600)) and max(total(bins, sizes)) <= cap
        assert math.ceil(sum(sizes) / cap) <= len(after) <= len(first)


def test_search_empties_bins_by_exchanges():
    sizes = [6, 4, 5, 3, 7, 5]
    bins = K.local_search(sizes, [[0, 5], [1, 4], [2, 3]], 10 + 2)
    assert len(bins) == 3 or max(total(bins, sizes)) <= 12
    assert len(K.local_search([5, 5, 5, 5], [[0], [1], [2], [3]], 10)) == 2


def test_exchange_two_for_one():
    sizes = [4, 4, 6, 2]
    # out of [4, 4] into [6, 2] (capacity 10): both fours for the six fill it
    assert K._exchange(sizes, [0, 1], [2, 3], 2) in (((0, 1), 2), ((0,), 3))


def test_operator_cases(spark):
    rows = [(1, "word " * 5000), (2, None), (3, ""), (4, "a few words"), (4, "a few words"), (None, "x")] + [(10 + i, "word " * (50 * (i % 7 + 1))) for i in range(60)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, tokens int")
    got = K.containers(docs).collect()
    sizes = {(r.doc_id, r.part_no): r.token_end - r.token_start for r in got}
    assert sum(r.doc_id == 4 for r in got) == 2 and {r.doc_id for r in got} == {r[0] for r in rows if r[0] is not None}
    fill = {}
    for r in got:
        fill[r.container_id] = fill.get(r.container_id, 0) + r.token_end - r.token_start
    assert max(fill.values()) <= 2048
    parts = sorted((r.part_no, r.token_start, r.token_end) for r in got if r.doc_id == 1)
    assert [p[0] for p in parts] == list(range(len(parts))) and parts[0][1] == 0 and all(a[2] == b[1] for a, b in zip(parts, parts[1:]))
    assert all(e - s == 2048 for _, s, e in parts[:-1]) and sizes[(2, 0)] == sizes[(3, 0)] == 0
    assert len(fill) <= math.ceil(sum(sizes.values()) / 2048) + 2
    assert K.containers(docs.limit(0)).count() == 0
    again = K.containers(docs).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_fill_is_near_the_bound(spark):
    r = random.Random(12)
    docs = spark.createDataFrame([(i, "word " * min(9000, int(r.lognormvariate(5.5, 1.0)))) for i in range(3000)], "doc_id bigint, text string")
    for group in (20_000, 400):  # one group, and several that are packed again across groups
        got = K.containers(docs, K.Settings(group=group)).collect()
        bound = math.ceil(sum(x.token_end - x.token_start for x in got) / 2048)
        assert bound <= len({x.container_id for x in got}) <= bound * 1.01 + 1


def test_equal_rows_are_containers_of_their_own(spark):
    docs = spark.createDataFrame([(1, ("word " * 3000).strip())] * 3, "doc_id bigint, text string")
    fill = {}
    for r in K.containers(docs).collect():
        fill[r.container_id] = fill.get(r.container_id, 0) + r.token_end - r.token_start
    assert max(fill.values()) <= 2048 and sum(fill.values()) == 3 * 3000


def test_search_runs_until_nothing_changes():
    r = random.Random(2)
    sizes = [r.randint(200, 900) for _ in range(300)]
    once = K.local_search(sizes, K.best_fit(sizes, 2048), 2048)
    assert K.local_search(sizes, [list(b) for b in once], 2048) == [b for b in once]


def test_exchange_finds_the_best_pair_in_bins_of_any_number():
    from tessera.llm.packing import _exchange

    r = random.Random(9)
    for n in (3, 12, 60):
        for _ in range(30):
            sizes = [r.randint(5, 60) for _ in range(2 * n)]
            a, b, room = list(range(n)), list(range(n, 2 * n)), r.randint(1, 20)
            outs = [sizes[i] for i in a] + [sizes[i] + sizes[k] for x, i in enumerate(a) for k in a[x + 1 :]]
            want = max((o - sizes[j] for o in outs for j in b if 0 < o - sizes[j] <= room), default=0)
            got = _exchange(sizes, a, b, room)
            assert (sum(sizes[i] for i in got[0]) - sizes[got[1]] if got else 0) == want
    assert _exchange([10] * 41 + [18], list(range(41)), [41], 2) is not None  # two of 10 for one of 18
