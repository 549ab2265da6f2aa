"""Bodies and what they publish are no persons, whether or not a list holds their nouns."""

import pytest

from tessera.llm import personal_data as P

LISTED = ["Pellworth Incident Register", "Dorrel Loss Ledger", "Ostrel Hazard Herald", "Kreuzfeld Zeitung"]
UNLISTED = ["Umberley Zarnic Tolvar", "Skerrin Bravane", "Kreuz Mulvane Obren"]
FRAMES = [
    "The material published by {} is provided for general information and does not replace advice.", "Figures may not add up because of rounding; {} accepts no liability for use of these data.",
    "All rights reserved. {} cannot be held liable for loss.", "Die Angaben dienen der Information; {} haftet nicht für Fehler.", "Los datos son orientativos y {} no asume ninguna responsabilidad.",
]
PEOPLE = ["Tobias Keller", "Nathaniel Price", "Siobhan Doyle", "Maria Jose Vega"]
SENTENCES = ["The letter published by {} is long.", "{} said that the register was shut.", "I think that {} is right about the valve.", "The parcel was signed for by {} on Monday."]


@pytest.fixture(scope="module")
def found():
    model, finder = P.fit(), P.Finder()
    return lambda text: [text[x.start : x.end] for x in P.entities(text, finder, model) if x.kind == "name"]


@pytest.mark.parametrize("body", LISTED + UNLISTED)
def test_a_body_is_no_person(found, body):
    assert [x for f in FRAMES for x in found(f.format(body))] == []
    assert found(FRAMES[0].format(body.replace(" ", "\u00a0"))) == []


@pytest.mark.parametrize("name", PEOPLE)
def test_persons_beside_the_same_words_stay(found, name):
    assert [found(s.format(name)) for s in SENTENCES] == [[name]] * len(SENTENCES)


def test_both_in_one_sentence(found):
    assert found("Pellworth Incident Register accepts no liability for what Petra Holmqvist wrote.") == ["Petra Holmqvist"]
