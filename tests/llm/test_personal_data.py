import itertools
import random

import pytest

from tessera.llm import personal_data as P
from tessera.llm import semi_crf
from tessera.llm.semi_crf import Segment


@pytest.fixture(scope="module")
def model():
    return P.fit()


@pytest.mark.parametrize("text, want", [
    ("Questions go to Petra Holmqvist, p.holm@mail.example, until May.", [("name", "Petra Holmqvist"), ("email", "p.holm@mail.example")]),
    ("Write to jo.berg (at) works (dot) invalid for the log.", [("email", "jo.berg (at) works (dot) invalid")]),
    ("Call +44 20 7946 0018 or 07700 900123 today.", [("phone", "+44 20 7946 0018"), ("phone", "07700 900123")]),
    ("Insurance claim under passport no. XP1234567 was refused.", [("id_number", "XP1234567")]),
    ("The owner lives at 14 Miller Street, Elmsford HM2 4QX, and left.", [("address", "14 Miller Street, Elmsford HM2 4QX")]),
    ("Statement of Oskar B. Lindgren: the door was warm.", [("name", "Oskar B. Lindgren")]),
    ("Witness Lindgren, Oskar left the hall.", [("name", "Lindgren, Oskar")]),
    ("Reported by: Ines\nLindgren; home address 3 Mill Lane, Norwick; tel. 01632 960100", [("name", "Ines\nLindgren"), ("address", "3 Mill Lane, Norwick"), ("phone", "01632 960100")]),
    ("Batch 1234-5678-9012 came from the Marlow Street depot, unit 38. The Halvarn rig is here.", []),
    ("Report no. 2010-648-4044 lists cell serial QK 85 15 30 B. Firmware 2.1.7 logs under cell@rack20.", []),
    ("On 2 October 2017 the tank at Lowmarch Plant was taken out of service.", []),
])
def test_entities(model, text, want):
    found = P.entities(text, P.Finder(), model)
    assert [(s.kind, text[s.start : s.end]) for s in found] == want


def test_held_out(model):
    f = P.Finder()
    hit = wrong = missed = 0
    for text, true in P.made_up(300, 4242):
        got = {(s.start, s.end, s.kind) for s in P.entities(text, f, model)}
        hit, wrong, missed = hit + len(got & true), wrong + len(got - true), missed + len(true - got)
    assert hit / (hit + wrong) > 0.96 and hit / (hit + missed) > 0.94


# names and sentences that stand in no list and no pattern of the module
UNLISTED = "Tobias Keller|Brigitte Vogel|Nathaniel Price|Rajesh Iyer|Wiremu Paki|Siobhan Doyle|Kwame Mensah|Lidia Ferrante|Mateusz Zielinski|Agneta Sund|Gavin O'Leary|Pernille Holm-Dahl".split("|")
SENTENCES = [
    "The photographs in this section were taken by {} shortly before dawn.", "Later {} admitted that nobody had looked at the gauge.", "Among the drawings {} kept a list of spare keys.",
    "In an interview {} described the sound as a sharp crack.", "{} then switched the ventilation off and waited for the crew.", "Two hours later the insurer telephoned {} about the claim.",
    "A neighbour, {}, took the dog away.", "Neither the owner nor {} could remember the date.", "Our thanks go to {} for reading the draft.", "{} keeps bees behind the workshop.",
    "Nobody had warned {} about the fumes.", "The minutes say that {} left early because of the noise.",
]
NO_NAMES = [
    "The fire at Sandford Hollow was seen from the road.", "Readings from the Keldholm Brinex rig are listed below.", "Water Supply is treated in the next part; water supply and drains are old.",
    "They shipped the tank from Elmstead Cross to Port Mallow by rail.", "Die Pumpe von Waldheim und das Ventil von Osterburg fielen aus.", "The Ridgeway Institute reviewed the rule and the Ashgrove Council did not.",
    "In Lower Brackwell the alarm was late.", "A Quorell Tenby valve was fitted and later removed.", "Monday Morning readings were low, and the monday shift saw it.", "Durch Korrosion fiel die Leitung in der Halle aus.",
]


def test_names_and_contexts_that_no_list_holds(model):
    finder = P.Finder()
    assert not any(n.split()[0].lower() in P.GIVEN for n in UNLISTED)
    hit = 0
    for s in SENTENCES:
        for n in UNLISTED:
            a = s.index("{}")
            hit += [(a, a + len(n))] == [(x.start, x.end) for x in P.entities(s.format(n), finder, model)]
    wrong = [(s, [s[x.start : x.end] for x in found]) for s in NO_NAMES if (found := P.entities(s, finder, model))]
    assert hit >= 0.9 * len(SENTENCES) * len(UNLISTED) and len(wrong) <= 1, (hit, wrong)


def test_decoding_is_exact():
    r = random.Random(5)
    for _ in range(40):
        segs = [Segment(a := r.randrange(60), a + r.randint(1, 12), r.choice("xy"), (f"f{r.randrange(6)}",)) for _ in range(7)]
        m = semi_crf.Model({**{f"f{i}": r.uniform(-1, 2) for i in range(6)}, "x>y": 0.7, "y>x": -0.6, "x>x": -0.2})

        def total(chosen):
            chosen = sorted(chosen)
            if any(a.end > b.start for a, b in zip(chosen, chosen[1:])):
                return -1e9
            return sum(map(m.score, chosen)) + sum(m.weights.get(semi_crf._pair(a, b), 0.0) for a, b in zip(chosen, chosen[1:]))

        best = max(total(c) for k in range(len(segs) + 1) for c in itertools.combinations(segs, k))
        assert abs(total(semi_crf.decode(m, segs)) - best) < 1e-9


def test_operator_cases(spark):
    rows = [("d", 1, "text", "Email: jo@mail.example"), ("d", 1, "text", "Email: jo@mail.example"), ("d", 2, "text", None), ("d", 3, "text", ""), ("d", None, "text", "jo@mail.example"), ("d", 4, "text", "é😀 jo@mail.example"), ("d", 5, "text", "12 34 " * 30_000)]
    t = spark.createDataFrame([(*r, "k") for r in rows], "rec_table string, rec_id bigint, field_name string, text string, kind string")
    got = [(r.rec_id, r.kind, r.start_pos) for r in P.find(t).where("rec_id < 5").collect()]
    assert sorted(got) == [(1, "email", 7), (1, "email", 7), (4, "email", 3)]
    masked = {r.rec_id: r.text for r in P.mask(t.where("rec_id < 5")).collect()}
    assert masked == {1: "Email: [EMAIL]", 4: "é😀 [EMAIL]"}
    assert P.find(t.limit(0)).count() == 0


def test_texts_of(spark):
    d = spark.createDataFrame([(1, "x")], "doc_id bigint, text string")
    s = spark.createDataFrame([(7, "p", None), (7, "p", None)], "submission_id bigint, problem string, expected string")
    got = sorted((r.rec_table, r.rec_id, r.field_name, r.text or "") for r in P.texts_of(d, s).collect())
    assert got == [("documents", 1, "text", "x"), ("submissions", 7, "expected", ""), ("submissions", 7, "problem", "p")]
