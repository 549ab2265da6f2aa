from tessera.llm import crf
from tessera.llm import pair_defects as P

Q = "How many cycles did the Torvald panel allow before the seal at level 9 had to be replaced?"
CASES = [
    (None, "empty"), ("", "empty"), (" \n", "empty"), ("ANSWER\n\nREASONING\n", "empty"), ("[1] [2].", "empty"), ("n/a", "empty"), ("...", "empty"), ("<p></p>", "empty"),
    ("I'm afraid I can't help with this.", "refusal"), ("Thank you for the question. I must decline to discuss it.", "refusal"), ("I AM NOT ABLE TO COMMENT ON THIS.", "refusal"),
    (Q, "copied"), (Q.lower().rstrip("?"), "copied"), (Q + "\n" + Q, "copied"), ("Question: " + Q, "copied"),
    ("Nach 12 Minuten erreichte die Pumpe in der Halle eine Temperatur von 90 °C. Der Druck stieg auf 3 bar, bevor das Ventil nachgab.", "other_language"),
    ("The panel allowed 12 cycles before the seal was", "truncated"), ("Pressure rose to 3 bar. The valve did not op", "truncated"), ("The valve was replaced in May and the", "truncated"),
    ("12", None), ("Yes.", None), ("In 2019", None), ("80 bar", None), (Q + " The panel allowed 12 cycles. [2]", None), ("The sources held do not state this value.", None), ("Outside the scope: no source deals with it.", None),
    ("The panel allowed 12 cycles.\n- tank\n- gas sensor", None), ('The panel allowed 12 cycles. One source says: "Der Druck stieg auf 3 bar, bevor die Pumpe nachgab."', None),
    ("We cannot rule out a second fault, and crews were unable to help before noon.", None), ("The panel allowed 12 cycles [3].", None),
]


def pairs(spark, rows):
    return spark.createDataFrame([("t", i, q, a, "x") for i, q, a in rows], "rec_table string, rec_id bigint, question string, answer string, defect string")


def test_defects(spark):
    rows = [(i, Q, a) for i, (a, _) in enumerate(CASES)]
    got = {r.rec_id: r.defect for r in P.pair_defects(pairs(spark, rows + rows + [(None, Q, "")])).collect()}
    wrong = [(a, want, got.get(i)) for i, (a, want) in enumerate(CASES) if got.get(i) != want]
    assert not wrong


# wording that stands in no list of the module
UNSEEN_REFUSALS = [
    "I'm going to sit this one out.", "You won't get that from me, I'm afraid.", "That isn't a conversation I can have with you.", "I do apologise, yet I am prevented from describing this.",
    "That is one I am going to skip.", "I have opted out of exchanges like this one.", "I can't in good conscience help you there.", "My instructions forbid me to reply to this.",
    "I respectfully decline.", "Answering this would go against my principles, so I won't.", "I'm unable to weigh in on that one, sorry.", "Mir steht es nicht zu, mich damit zu befassen.",
    "Je ne souhaite pas m'exprimer sur ce point avec vous.", "Prefiero no entrar en ese tema con usted, lo siento.",
]
UNSEEN_OTHERS = [
    "None of the reports I was given mentions a seal at that level.", "We could not find the log, so the passages leave this open.", "I would put the limit at 40 cycles, going by the second report.",
    "The board declined to comment and the owner refused entry to the crew.", "My estimate is 12 cycles, although the log cannot be checked any more.", "Crews were not allowed to enter before the gas had gone.",
    "That lies outside the scope of this collection, which holds reports on fires only.", "We do not know why the valve was shut, but nobody had asked for it.",
]


def test_unseen_refusals_and_unseen_answers(spark):
    asked = {"Mir st": "Wie viele Zyklen ließ die Kommission zu, bevor die Dichtung ersetzt werden musste?", "Je ne ": "Combien de cycles la commission a-t-elle admis avant que le joint soit remplacé ?",
             "Prefie": "¿Cuántos ciclos admitió la comisión antes de que la junta fuera sustituida?"}
    rows = [(i, asked.get(a[:6], Q), a) for i, a in enumerate(UNSEEN_REFUSALS + UNSEEN_OTHERS)]
    got = {r.rec_id: r.defect for r in P.pair_defects(pairs(spark, rows)).collect()}
    missed = [a for i, a in enumerate(UNSEEN_REFUSALS) if got.get(i) != "refusal"]
    wrong = [a for i, a in enumerate(UNSEEN_OTHERS, len(UNSEEN_REFUSALS)) if i in got]
    assert len(missed) <= len(UNSEEN_REFUSALS) // 5 and not wrong, (missed, wrong)


def test_null_question_long_and_empty_tables(spark):
    long_ = "The valve was closed. " * 20_000
    got = P.pair_defects(pairs(spark, [(1, None, "Der Druck stieg auf 3 bar, bevor die Pumpe nachgab."), (2, Q, long_), (3, "", Q)])).collect()
    assert got == []
    assert P.pair_defects(pairs(spark, [])).count() == 0


def test_held_out_accuracy():
    model = crf.fit(P.made_up(800), P.TAGS)
    test = P.made_up(400, seed=99)
    said = crf.decode(model, [[f for f, _ in s] for s in test])
    right = sum(a == b for s, t in zip(test, said) for (_, a), b in zip(s, t))
    assert right / sum(map(len, test)) > 0.97


def test_viterbi_is_exact():
    import itertools

    import numpy as np

    r = np.random.default_rng(2)
    m = crf.Model(("a", "b", "c"), {f"f{i}": i for i in range(5)}, r.normal(size=(5, 3)), r.normal(size=(3, 3)), r.normal(size=3))
    seq = [["f0", "f3"], ["f1"], [], ["f4", "unknown"]]
    e = [sum((m.emit[m.index[f]] for f in fs if f in m.index), np.zeros(3)) for fs in seq]
    score = lambda p: m.start[p[0]] + sum(e[i][p[i]] for i in range(4)) + sum(m.move[a, b] for a, b in zip(p, p[1:]))
    best = max(itertools.product(range(3), repeat=4), key=score)
    assert crf.decode(m, [seq, []]) == [[m.labels[i] for i in best], []]


def test_pairs_of(spark):
    ev = spark.createDataFrame([(1, Q, '{"answer": null}'), (2, Q, "{}"), (3, Q, "no json"), (4, Q, '{"answer": "caf\\u00e9 12"}')], "result_id bigint, question string, answer string")
    ll = spark.createDataFrame([(1, "q1", None), (2, "unknown", "x y z.")], "response_id bigint, question_id string, text string")
    qs = spark.createDataFrame([("q1", Q), ("q1", Q)], "question_id string, question string")
    got = {(r.rec_table, r.rec_id): r.answer for r in P.pairs_of(ev, ll, qs).collect()}
    assert got == {("eval_results", 1): None, ("eval_results", 2): None, ("eval_results", 3): None, ("eval_results", 4): "café 12", ("llm_responses", 1): None, ("llm_responses", 2): "x y z."}
