import random

import numpy as np

from tessera.llm import leakage as L

DOC = "doc_id bigint, text string, item_id bigint"
ITEM = "item_id bigint, question string, expected string, doc_id int"


def run(spark, docs, items, s=L.Settings()):
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], DOC)
    q = spark.createDataFrame([(i, a, b, 0) for i, a, b in items], ITEM)
    return L.leaks(d, q, s).collect()


def exact(rows):
    return sorted({(r.doc_id, r.item_id) for r in rows if r.longest_run >= L.RUN})


def brute(docs, items):
    out = set()
    for d, t in docs:
        w = L.words(t)
        runs = {tuple(w[i : i + 12]) for i in range(len(w) - 11)}
        for i, a, b in items:
            for f in (a, b):
                v = L.words(f)
                if any(tuple(v[k : k + 12]) in runs for k in range(len(v) - 11)):
                    out.add((d, i))
    return sorted(out)


def test_matches_brute_force(spark):
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(r.choices(vocab, k=20)), " ".join(r.choices(vocab, k=30))) for i in range(30)]
    docs = []
    for d in range(120):
        w = r.choices(vocab, k=80)
        if d % 2:
            src = r.choice(items)[1 + d % 4 // 2].split()
            n = r.randint(9, 15)
            at = r.randrange(max(1, len(src) - n))
            w[20:20] = src[at : at + n]
        docs.append((d, (", " if d % 3 else "\n").join(w).upper() if d % 5 == 0 else " ".join(w)))
    got = exact(run(spark, docs, items))
    assert got == brute(docs, items) and got


def test_blocks_change_nothing(spark):
    items = [(i, " ".join(f"q{i}x{k}" for k in range(14)), None) for i in range(9)]
    docs = [(i, "before " + items[i][1] + " after") for i in range(9)]
    assert exact(run(spark, docs, items)) == exact(run(spark, docs, items, L.Settings(block_chars=100))) == [(i, i) for i in range(9)]


def test_edited_copies_are_scored(spark):
    words = [f"t{k}" for k in range(40)]
    copy = [w if k % 7 else "changed" for k, w in enumerate(words)]
    rows = run(spark, [(1, " ".join(copy)), (2, "nothing of the kind")], [(5, None, " ".join(words))])
    assert [(r.doc_id, r.item_id) for r in rows] == [(1, 5)] and rows[0].longest_run < 12 and rows[0].share > 0.5


def test_smith_waterman():
    s = L.Settings()
    a = np.array([1, 2, 3, 4])
    assert L.smith_waterman(a, a, s) == 8
    assert L.smith_waterman(a, np.array([1, 2, 9, 3, 4]), s) == 7
    assert L.smith_waterman(a, np.array([7, 8]), s) == 0
    assert L.smith_waterman(a, np.array([], dtype=int), s) == 0


def test_nulls_empty_ties_and_repeats(spark):
    long_ = " ".join(f"z{k}" for k in range(12))
    docs = [(1, long_), (1, long_), (2, None), (3, ""), (4, long_ + " " + long_)]
    items = [(1, long_, long_), (1, long_, long_), (2, None, None), (3, "", "a b c")]
    assert exact(run(spark, docs, items)) == [(1, 1), (4, 1)]
    assert run(spark, [], items) == [] and run(spark, docs, []) == []


def test_eleven_words_do_not_count(spark):
    assert exact(run(spark, [(1, " ".join(f"z{k}" for k in range(11)))], [(1, " ".join(f"z{k}" for k in range(30)), None)])) == []


def test_very_long_text(spark):
    item = " ".join(f"k{k}" for k in range(12))
    assert exact(run(spark, [(1, "filler words " * 60_000 + item)], [(1, item, None)])) == [(1, 1)]


def test_edited_copies_do_not_depend_on_other_copies(spark):
    own = [f"t{k}" for k in range(60)]
    edited = " ".join("changed" if k % 10 == 5 else w for k, w in enumerate(own))
    other = " ".join("altered" if k % 9 == 4 else w for k, w in enumerate(own))
    docs = [(0, " ".join(own)), (1, edited)] + [(k, other) for k in range(2, 42)]
    got = {r.doc_id: r for r in run(spark, docs, [(7, None, " ".join(own))])}
    assert sorted(got) == list(range(42))
    assert got[0].longest_run == 60 and got[1].longest_run == 9 and got[2].longest_run == 8 and got[41].score == got[2].score
    without = {r.doc_id: r for r in run(spark, docs[1:2], [(7, None, " ".join(own))])}
    assert without[1] == got[1]


def test_many_alignments_at_once_score_as_one_by_one():
    r, s = np.random.default_rng(5), L.Settings()
    for _ in range(20):
        pairs = [(r.integers(0, 6, r.integers(0, 25)), r.integers(-1, 6, r.integers(0, 40))) for _ in range(12)]
        want = [L.smith_waterman(a, b, s) for a, b in pairs]
        assert L.smith_waterman_pairs(pairs, s) == want and L.align(pairs, s) == want
    assert L.align([], s) == []


def edit(words, kind, every, r):
    """A copy of ``words`` changed at every ``every``-th word."""
    out, i = [], 0
    while i < len(words):
        hit = i % every == every - 1
        if hit and kind == "replace":
            out.append(f"new{r.randrange(1000)}")
        elif hit and kind == "insert":
            out += [words[i], f"new{r.randrange(1000)}"]
        elif hit and kind == "swap" and i + 1 < len(words):
            out += [words[i + 1], words[i]]
            i += 1
        elif not (hit and kind == "drop"):
            out.append(words[i])
        i += 1
    return out


def test_recall_of_edited_copies(spark):
    r = random.Random(8)
    vocab = [f"w{i}" for i in range(900)]
    items = [(i, None, " ".join(r.choices(vocab, k=r.randint(24, 70)))) for i in range(60)]
    docs, true = [], {}
    for kind in ("replace", "insert", "swap", "drop"):
        for every in (3, 4, 5, 6, 8) if kind != "swap" else (5, 6, 8):
            for i, _, text in items:
                d = len(docs)
                true[d] = (kind, every, i)
                docs.append((d, " ".join(r.choices(vocab, k=60) + edit(text.split(), kind, every, r) + r.choices(vocab, k=60))))
    found = {(x.doc_id, x.item_id) for x in run(spark, docs, items)}
    recall = {}
    for d, (kind, every, i) in true.items():
        recall.setdefault((kind, every), []).append((d, i) in found)
    assert all(sum(v) >= 0.9 * len(v) for v in recall.values()), {k: sum(v) / len(v) for k, v in recall.items()}
    assert len(found - {(d, i) for d, (_, _, i) in true.items()}) <= 0.02 * len(found)


def test_scores_match_brute_force_where_seeds_cover(spark):
    r, s = random.Random(6), L.Settings(min_score=10, min_share=0.2, min_cover=0.0)
    vocab = [f"w{i}" for i in range(12)]
    items = [(i, None, " ".join(r.choices(vocab, k=20))) for i in range(6)]
    docs = [(d, " ".join(r.choices(vocab, k=50))) for d in range(30)]
    number = {w: k for k, w in enumerate(vocab)}
    code = lambda t: np.array([number[w] for w in t.split()])
    want = {(d, i): L.smith_waterman(code(b), code(t), s) for d, t in docs for i, _, b in items}
    got = {(x.doc_id, x.item_id): x.score for x in run(spark, docs, items, s)}
    assert got and all(want[k] == v for k, v in got.items())
    seeded = {(d, i) for d, t in docs for i, _, b in items if any(b.split()[k : k + 4] == t.split()[j : j + 4] for k in range(17) for j in range(47))}
    assert all(k in got for k in seeded if want[k] >= 10)
