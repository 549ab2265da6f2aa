"""Defective question-answer pairs (problem 4).

The answer is cut into clauses; a conditional random field tags each of them as answer, refusal,
echo of the question, foreign (in another language than the question) or unfinished. The words
each tag covers are then weighed to at most one defect a pair. The field is fitted when the
operator starts, on sequences put together from the labelled sentences below; their number is a
parameter and the only bound. Nothing is shuffled but exact duplicates.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import crf


@dataclass(frozen=True)
class Shares:
    """Share of an answer's words that a tag must cover; ``sequences`` made-up answers fit the field."""

    refusal: float = 0.4
    echo: float = 0.95
    foreign: float = 0.5
    sequences: int = 3000


TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")

# Frequent function words that tell the four languages apart.
LANGUAGES = {
    "en": "the of and to in was is that for with on by from at this which were are be has have not before after it an as no did how why or",
    "de": "der die das und von zu den im ist nicht mit dem des ein eine einen einer auf für wurde wurden war sich nach bei aus dass als durch vor hat hatte diesen muss oder werden kann",
    "fr": "le la les des et du une est que dans par pour pas sur avec qui ont avant après été cette ne au aux n'a d'une l'enquête être soit tous doit sont ce",
    "es": "el los las del que en por con una se fue para no antes después muestra cada como al su han era debe está tras lo pide y durante hasta un es",
}
#: Function words with what they say for each language: a word of several counts for each in part. Counts
#: are twelfths, 16 bits a language, so that a text's words are summed at once.
_KNOWS: dict[str, int] = {}
for _w in {w for ws in LANGUAGES.values() for w in ws.split()}:
    _in = [i for i, ws in enumerate(LANGUAGES.values()) if _w in ws.split()]
    _KNOWS[_w] = sum((12 // len(_in)) << (16 * i) for i in _in)

# Labelled sentences, by language.
REFUSALS = {
    "en": """I'm sorry, but I can't help with that request.
I cannot assist with this question.
I am unable to answer questions of this kind.
As an AI language model, I am not able to comment on this.
I won't be able to provide that information.
Unfortunately I must decline to respond to this.
It would not be appropriate for me to discuss this.
My policy prevents me from talking about that matter.
Sorry, this request goes against my guidelines.
I have to refuse to deal with this topic.
That is not something I can go into; let us talk about something else.
I'd rather not answer this.
I can not comply with this instruction.
This is a matter on which I may not give advice.
I do not feel comfortable answering that.
We are not allowed to comment on such matters.
We will not give details of this, as it is against our instructions.
Regrettably, I am not permitted to respond to that, because it may be harmful.
I can't take part in a talk about weapons; ask an expert instead.
Sorry.
I apologise.""",
    "de": """Es tut mir leid, dabei kann ich nicht helfen.
Diese Anfrage muss ich leider ablehnen.
Als Sprachmodell darf ich dazu nichts sagen.
Dazu kann ich leider keine Auskunft geben.
Ich kann diese Frage nicht beantworten.
Meine Richtlinien erlauben mir das nicht.""",
    "fr": """Désolé, je ne peux pas répondre à cette demande.
Je dois malheureusement refuser de traiter ce sujet.
En tant que modèle de langue, je ne suis pas en mesure d'en parler.
Je ne peux pas vous aider sur cette question.
Mes règles ne me permettent pas de répondre.""",
    "es": """Lo siento, no puedo ayudar con esa petición.
Debo negarme a contestar a esto.
Como modelo de lenguaje, no puedo hablar de ese tema.
No me es posible responder a esta pregunta.
Mis normas no me permiten responder.""",
}
# Parts that refusals are put together from: how they begin, that one will not or
# cannot, what it is that one does not do, what about, and why.
REFUSAL_PARTS = {
    "en": (
        ["", "", "", "Sorry, ", "I'm sorry, but ", "My apologies: ", "Unfortunately, ", "I'm afraid ", "I regret that ", "Thank you for asking, but ", "Thanks for asking, but ", "Good question, but ", "No: ", "Let me be clear: ", "With respect, ", "As an assistant, "],
        ["I can't", "I cannot", "I won't", "I will not", "I'm not able to", "I am unable to", "I'm not going to", "I would rather not", "I'd prefer not to", "I must decline to", "I have to refuse to", "I have no intention to", "I'm not in a position to", "I am not allowed to",
         "I have been asked not to", "I have been told not to", "it is not for me to", "it is not my place to", "I choose not to", "I will have to decline to", "we do not", "we cannot", "I do not", "I don't wish to", "I must avoid to", "I am declining to", "I refuse to", "I am going to refuse to", "I'm choosing not to"],
        ["help with", "assist with", "answer", "respond to", "discuss", "talk about", "comment on", "speak about", "explain", "go into", "get into", "deal with", "engage with", "give details on", "give out", "provide", "share", "take up", "describe", "advise on", "be drawn on", "reply to", "address", "offer an opinion on", "continue with", "support", "look into", "take part in"],
        ["this", "that", "this topic", "that subject", "this question", "such questions", "requests of this kind", "this request", "such information", "this matter", "anything of this sort", "this conversation", "your request", "what you ask", "these things", "it", "questions of that sort", "matters like these"],
        ["", "", "", " with you", " here", " at all", ", as it could be misused", " because of my guidelines", " under my rules", ", since it may cause harm", "; that is my policy", ", whatever the reason", " in this conversation"],
    ),
    "de": (
        ["", "", "Leider ", "Es tut mir leid, aber ", "Bedaure: "],
        ["kann ich", "darf ich", "möchte ich", "will ich", "werde ich"],
        ["dazu nichts sagen", "diese Frage nicht beantworten", "dabei nicht helfen", "darüber nicht sprechen", "darauf nicht eingehen", "dazu keine Auskunft geben", "diesem Wunsch nicht nachkommen", "hierzu keine Angaben machen", "mich dazu nicht äußern"],
        [""],
        ["", "", ", weil es Schaden stiften könnte", ", da meine Regeln es verbieten", " und bitte um Verständnis"],
    ),
    "fr": (
        ["", "", "Désolé, ", "Je regrette, ", "Malheureusement, "],
        ["je ne peux pas", "je ne veux pas", "je ne suis pas autorisé à", "je ne suis pas en mesure de", "je préfère ne pas", "je dois refuser de", "il ne m'est pas permis de"],
        ["répondre à", "parler de", "commenter", "discuter de", "vous aider sur", "expliquer", "donner des détails sur", "traiter"],
        ["cela", "ce sujet", "cette question", "votre demande", "ce genre de choses"],
        ["", "", ", car mes règles l'interdisent", " avec vous", " pour des raisons de sécurité"],
    ),
    "es": (
        ["", "", "Lo siento, ", "Lamentablemente, ", "Me temo que "],
        ["no puedo", "no quiero", "no voy a", "no estoy autorizado a", "prefiero no", "debo negarme a", "no se me permite", "no me corresponde"],
        ["responder a", "hablar de", "comentar", "ayudar con", "explicar", "dar detalles sobre", "tratar", "opinar sobre"],
        ["eso", "este tema", "esta pregunta", "su petición", "ese asunto"],
        ["", "", ", porque mis normas lo prohíben", " con usted", " por motivos de seguridad"],
    ),
}
# Refusals that name no act.
SHORT_REFUSALS = {
    "en": """This falls outside of what I may talk about.
That is beyond what I can share with you.
This is something I stay away from.
That's a subject I would prefer to leave alone.
I will pass on this.
No comment from me.
I am out of this conversation.
You had better ask somebody else; this is not for me.
My rules put this off limits for me.
Not something I do.
I'll have to leave it there.
I'd like to keep out of this one.
Don't ask me that.""",
    "de": "Das ist nichts für mich.\nFragen Sie bitte jemand anderen; ich halte mich da heraus.\nKein Kommentar von mir.\nDavon lasse ich die Finger.",
    "fr": "Ce n'est pas à moi de le dire.\nDemandez à quelqu'un d'autre ; je m'abstiens.\nSans commentaire de ma part.\nJe préfère m'en tenir là.",
    "es": "No me toca a mí decirlo.\nPregunte a otra persona; yo me abstengo.\nSin comentarios por mi parte.\nPrefiero dejarlo aquí.",
}
AFTER_REFUSAL = {
    "en": ["Please consult a qualified professional.", "Is there anything else I can do?", "Let us talk about something else instead.", "I hope you understand.", "Try a different question.", "Ask me something else."],
    "de": ["Bitte wenden Sie sich an eine Fachperson.", "Kann ich sonst etwas tun?"],
    "fr": ["Veuillez consulter un spécialiste.", "Puis-je faire autre chose ?"],
    "es": ["Consulte a un profesional.", "¿Puedo hacer algo más?"],
}
COURTESY = {
    "en": ["Thank you for the question.", "Thanks for asking.", "Good question."],
    "de": ["Danke für die Frage.", "Vielen Dank für Ihre Anfrage."],
    "fr": ["Merci pour la question.", "Merci de votre demande."],
    "es": ["Gracias por la pregunta.", "Gracias por su consulta."],
}
ABSTENTIONS = {
    "en": """The sources held do not state this value, so no answer is given.
Outside the scope of this knowledge area: no source here deals with it.
None of the passages retrieved covers the gasket; the evidence is insufficient.
This cannot be answered from the evidence held: the passages speak of the pump only.
The documents do not say.
I cannot answer this from the sources, since the evidence does not cover it.
There is not enough evidence in the passages to answer.
I found nothing on this in the documents, so I can give no figure.
The question is out of scope; I only hold reports on fires.
I have no source that supports an answer.
I cannot tell from the passages whether the valve was open.
We have no evidence on that point.
My sources are silent about the gasket.
I am unable to confirm it, as no passage mentions the pump.
The material I was given does not cover this.
I'm afraid the evidence retrieved does not settle this.
Sorry, the documents held do not mention it.""",
    "de": """Die vorliegenden Quellen nennen diesen Wert nicht.
Dazu enthalten die Quellen keine Angabe.
Das liegt außerhalb des Themas dieser Sammlung.""",
    "fr": """Les sources disponibles n'indiquent pas cette valeur.
Les documents ne permettent pas de répondre.
Cela sort du domaine couvert par les sources.""",
    "es": """Las fuentes disponibles no indican este valor.
Los documentos no permiten responder.
Queda fuera del ámbito de las fuentes.""",
}
ANSWERS = {
    "en": """Pressure in the gasket rose to 22 bar before the panel opened.
We cannot rule out a second fault, and crews were unable to help before the smoke had cleared.
The operator refused to comment, and the guidelines were not followed.
I measured 12 ppm near the door, which is not able to ignite.
The sorry state of the filter was the probable cause, although a leak could not be excluded.
Operators must isolate the tank before work on the line starts in the yard.
A limit of 40 °C is used for the rack; above it the nozzle loses strength.
The share of failures linked to loose parts fell from 31 % to 26 % over 4 years.
On 21 May 2014 the cell at the works was taken out of service.
No one in the hall was hurt, but the fuse holder and 4 units beside it were lost.
The valve shall be inspected every 30 days, and records shall be kept for 5 years.
Home units with a collector showed a wave in 8 of 50 trials.
The policy of the owner prevents any change to the vent.
My reading of the log is that the pump failed first; I would put it at 12 s.
I saw that the hatch could not be opened, so we did not go in.
We do not know who closed the valve, but we measured 20 ppm.
The crew would not talk about the leak with the owner.
I can answer that: the seal was replaced after 40 cycles.
You should not open the rack before 30 minutes have passed.
I do not agree with the report, which gives 22 bar.
They declined to share the data and would not respond to the board.
You cannot ask for a refund after 12 days.""",
    "de": """Nach 17 Minuten erreichte die Pumpe in der Trocknung eine Temperatur von 172 °C.
Die Prüfung ergab, dass das Ventil seit 90 Tagen nicht gewartet worden war.
Der Druck stieg auf 16 bar, bevor der Filter und später das Modul nachgab.
Als wahrscheinliche Ursache gilt Feuchtigkeit, doch ein Fehler ist nicht auszuschließen.
Vor dem Öffnen muss der Behälter mindestens 34 Minuten lang spannungsfrei sein.
Der Bericht empfiehlt, dass die Dichtung alle 20 Tage durch geschultes Personal geprüft wird.""",
    "fr": """Après 8 minutes, le module a atteint 135 °C dans la cour.
L'enquête montre que le joint n'avait pas été contrôlé depuis 98 jours.
Le rapport demande que la cellule soit vérifiée tous les 285 jours par une équipe formée.
La cause probable est la surcharge, mais un capteur défaillant ne peut pas être exclu.
On a mesuré 120 ppm de monoxyde de carbone dans la cour.
La pression est montée à 9 bar avant que la pompe ne cède.""",
    "es": """Tras 18 minutos, el módulo alcanzó 103 °C en el patio.
La investigación muestra que la válvula llevaba 53 días sin revisión.
El informe pide que la junta se revise cada 56 días por personal formado.
La causa probable es un tornillo flojo, aunque no se puede descartar la sobrecarga.
Antes de abrir, el silo debe quedar sin tensión durante 30 minutos.
En el patio se midieron 590 ppm de monóxido de carbono poco después.""",
}
QUESTIONS = {
    "en": ["How many cycles did the panel allow before the seal at level 7 had to be replaced by staff?", "Did the rule require crews to wait 200 minutes before flooding the pit, or was it not applied?", "Which pressure did inspectors record at the bulkhead in 2004, and why did the clause not apply there?"],
    "de": ["Wie viele Zyklen ließ die Kommission zu, bevor die Dichtung auf Ebene 7 ersetzt werden musste?", "Welchen Druck zeigte das Ventil in Halle 3, und warum wurde es nicht geprüft?"],
    "fr": ["Combien de cycles la commission a-t-elle admis avant que le joint du niveau 7 soit remplacé ?", "Quelle pression a été relevée dans la cour, et pourquoi la règle n'a-t-elle pas été suivie ?"],
    "es": ["¿Cuántos ciclos admitió la comisión antes de que la junta del nivel 7 fuera sustituida?", "¿Qué presión se midió en el patio y por qué no se aplicó la norma?"],
}
# What an answer may consist of without saying anything.
PLACEHOLDERS = frozenset("n/a na null none nil nan undefined tbd todo answer reasoning explanation antwort réponse respuesta keine aucune ninguna placeholder unknown".split())

# Words that open a complete short answer.
_SHORT = frozenset("yes no none ja nein keine oui non aucun aucune sí si ninguno ninguna approximately about both neither".split())

# Words of the one who answers, of the one addressed, and of regret.
_SELF = frozenset("i we me my our i'm i'd i'll i've we're ich wir mir mich meine meiner meinem meinen je j'ai moi nous mes ma yo mis mí".split())
_YOU = frozenset("you your yours sie ihnen ihre ihrer ihrem ihren vous votre vos usted su le".split())
_SORRY = frozenset("sorry afraid apologise apologize apologies apology unfortunately regret regrettably respectfully leider leid bedaure désolé malheureusement regrette siento lamentablemente temo".split())
_DENY = re.compile(
    r"\b(?:cannot|can ?not|can't|won't|will not|would not|wouldn't|not (?:be )?(?:able|allowed|permitted|appropriate|going|for me|my)|unable|declin\w+|refus\w+|rather not|prefer (?:not|to)|may not|do not|don't|"
    r"prevents?|against|no intention|not (?:in a position|something|to)|avoid|pass on|stay away|keep out|leave (?:it|that|this)|outside of what|beyond what|off limits|no comment|forbid\w*|forbidden|prohibit\w*|liberty|irresponsible|"
    r"nicht|nichts|kein\w*|ablehnen|verweiger\w*|ne \w+ pas|n'\w+ pas|ne pas|refuser|m'abstiens|interdit|untersagt|verboten|prohibido|prohíben|abstengo|no (?:puedo|quiero|voy|estoy|se me|me)|negarme|prefiero no|sin comentarios)\b"
)
# What one does with a question or a request.
_DEAL = re.compile(
    r"\b(?:help|assist|answer\w*|respond|reply|discuss\w*|talk|comment|speak|explain\w*|engage|provide|share|advise|opinion|address|conversation|topic|subject|request\w*|ask|information|"
    r"sagen|beantworten|helfen|sprechen|eingehen|auskunft|äußern|nachkommen|frage|anfrage|répondre|parler|commenter|discuter|aider|expliquer|demande|sujet|responder|hablar|comentar|ayudar|explicar|opinar|petición|tema)\b"
)
_SOURCE = re.compile(
    r"\b(?:sources?|passages?|documents?|evidence|reports?|corpus|material|retrieved|scope|knowledge|data|found|text|quellen?|dokumente?|belege?|themas?|unterlagen|preuves?|domaine|fuentes?|documentos?|pruebas?|ámbito)\b"
)

_CITE = re.compile(r"\[\s*\d+(?:\s*[,;–-]\s*\d+)*\s*\]")
_TAG = re.compile(r"<[^<>]{0,80}>")
_HEAD = re.compile(r"(?im)^[ \t#*]*(?:answer|reasoning|explanation|antwort|begründung|réponse|raisonnement|respuesta|razonamiento)[ \t*]*(?::[ \t*]*|$)")
_CUT = re.compile(r"(?<=[.!?])[\"'”’»)]*\s+|\s*\n\s*")
_ITEM = re.compile(r"(?:[-*•–]|\(?\d{1,2}[.)])\s+")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_QUOTE = re.compile(r"[\"“„«][^\"”“»]*[\"”“»]?")
_INVISIBLE = re.compile("[​‌‍⁠﻿­]")


def clauses(answer: str) -> list[str]:
    """Clauses of an answer without citations, mark-up and headings; none if nothing is said."""
    t = answer if answer.isascii() else _INVISIBLE.sub("", answer)
    if "[" in t:
        t = _CITE.sub("", t)
    if "<" in t:
        t = _TAG.sub(" ", t)
    t = _HEAD.sub("\n", t)
    parts = [p for p in (x.strip() for x in _CUT.split(t)) if _WORD.search(p)]
    if parts and all(w in PLACEHOLDERS for p in parts for w in re.split(r"[\s:.()]+", p.lower()) if w):
        return []
    return parts


def words(part: str) -> list[str]:
    return _WORD.findall(part.lower().replace("’", "'"))


def language(low: list[str]) -> dict[str, float]:
    """How many of a text's (lower-case) words speak for each language."""
    out: dict[str, float] = {}
    for at in range(0, len(low), 5000):  # so that no count overflows its bits
        total = sum(map(_KNOWS.get, low[at : at + 5000], repeat(0)))
        for i, k in enumerate(LANGUAGES):
            if n := (total >> (16 * i)) & 0xFFFF:
                out[k] = out.get(k, 0.0) + n / 12
    return out


def _best(scores: dict[str, float]) -> tuple[str, float]:
    """The leading language and its lead over the next."""
    if not scores:
        return "", 0.0
    top = sorted(scores.items(), key=lambda x: -x[1])
    return top[0][0], top[0][1] - (top[1][1] if len(top) > 1 else 0.0)


def features(parts: list[str], lows: list[list[str]], question: frozenset[str], asked: tuple[str, float]) -> list[list[str]]:
    """Features of each clause: its words, how it ends, overlap with the question's words, language.
    ``lows`` holds the clauses' words, ``asked`` the question's language and its lead."""
    lang, sure = asked
    out, last = [], len(parts) - 1
    for i, (p, low) in enumerate(zip(parts, lows)):
        lower = p.lower().replace("’", "'")
        n = len(low)
        said = set(low)
        fs = list(said)
        own = not _SELF.isdisjoint(said) or ("m'" in lower and any(w.startswith("m'") for w in low))
        if _DENY.search(lower):
            deal = _DEAL.search(lower)
            fs.append("#deny:self" if own else "#deny")
            if deal:
                fs.append("#deny:self:deal" if own else "#deny:deal")
            if _SOURCE.search(lower):
                fs.append("#deny:source")
            if not _YOU.isdisjoint(said):
                fs.append("#deny:you")
        if not _SORRY.isdisjoint(said):
            fs.append("#sorry")
        figure = any(map(str.isdigit, low))
        fs.append("#figure" if figure else "#plain")
        if own and not figure and not _SOURCE.search(lower):
            fs.append("#self:plain" if _YOU.isdisjoint(said) else "#self:plain:you")
            if n <= 14 and not sum(map(question.__contains__, low)) > 0.3 * n:
                fs.append("#self:aside")
        fs.append("#item" if _ITEM.match(p) else "#line")
        if i == last:
            end = p.rstrip("\"'”’»)*_ ")[-1:]
            closed = end in (".", "!", "?", "…") and not p.endswith("..")
            short = n == 1 or n <= 3 and (any(c.isdigit() for c in p) or low[0] in _SHORT)
            fs.append("#closed" if closed else "#last item" if fs[-1] == "#item" and n <= 8 else "#short" if last == 0 and short else "#open")
            if not closed and (p[-1] in ",;:-–(" or low[-1] in _KNOWS):
                fs.append("#hanging")
        if n >= 4 and question:
            share = sum(map(question.__contains__, low)) / n
            fs.append("#echo all" if share >= 0.9 else "#echo most" if share >= 0.7 else "#echo part" if share >= 0.4 else "#echo no")
        own = low
        if '"' in p or "«" in p or "“" in p or "„" in p:  # what is quoted may be in any language
            bare = _QUOTE.sub(" ", p)
            own = words(bare) if len(bare) > 0.3 * len(p) else []
        best, lead = _best(language(own))
        if sure >= 1 and best and best != lang and lead >= 1:
            fs.append("#foreign" if lead >= 2 else "#foreign?")
        elif best == lang:
            fs.append("#native")
        out.append(fs)
    return out


def refusal(r: random.Random, lang: str) -> str:
    """A refusal: one of the sentences above, or one put together from their parts."""
    kind = r.random()
    if kind < 0.25:
        return r.choice(REFUSALS[lang].split("\n"))
    if kind < 0.45:
        return r.choice(SHORT_REFUSALS[lang].split("\n"))
    begin, cannot, act, about, why = (r.choice(x) for x in REFUSAL_PARTS[lang])
    out = f"{begin}{cannot} {act} {about}".strip() + why
    return out[0].upper() + out[1:] + "."


def made_up(count: int, seed: int = 7) -> list[list[tuple[list[str], str]]]:
    """``count`` labelled answers put together from the sentences above."""
    r, out = random.Random(seed), []
    langs = ["en", "en", "en", "de", "fr", "es"]
    pick = lambda table, lang: r.choice(table[lang] if isinstance(table[lang], list) else table[lang].split("\n"))
    for _ in range(count):
        lang = r.choice(langs)
        other = r.choice([x for x in LANGUAGES if x != lang])
        q = pick(QUESTIONS, lang)
        body = [(pick(ANSWERS, lang), "answer") for _ in range(r.randint(1, 4))]
        kind = r.choice(["answer", "answer", "list", "short", "abstain", "refusal", "refusal", "echo", "echo-answer", "foreign", "quote", "cut", "cut"])
        if kind == "list":
            body += [(f"- {x}", "answer") for x in r.sample(["gas sensor", "roof hatch", "tray liner", "pump", "cell of the rack", "Ventil", "joint"], 3)]
        elif kind == "short":
            body = [(r.choice(["7", "80 bar", "Yes.", "No", "In 2019", "12 °C", "Ja", "Non", "about 40 %"]), "answer")]
        elif kind == "abstain":
            body = [(pick(ABSTENTIONS, lang), "answer")]
        elif kind == "refusal":
            s = refusal(r, lang)
            body = [(s.upper() if r.random() < 0.1 else s, "refusal")]
            if lang == "en" and len(s.split()) < 3:
                body.append((refusal(r, lang), "refusal"))
            if r.random() < 0.4:
                body.append((pick(AFTER_REFUSAL, lang), "refusal"))
            if r.random() < 0.3:
                body.insert(0, (pick(COURTESY, lang), "answer"))
        elif kind == "echo":
            w = q.split()
            if r.random() < 0.5:
                del w[r.randrange(len(w))]
            s = " ".join(w)
            s = r.choice([s, s.lower().rstrip("?"), s.upper().rstrip("?"), s])
            body = [(s, "echo")] * r.choice([1, 1, 2])
        elif kind == "echo-answer":
            body.insert(0, (q, "echo"))
        elif kind == "foreign":
            body = [(pick(ANSWERS, other), "foreign") for _ in body]
        elif kind == "quote":
            body.insert(r.randrange(len(body) + 1), (f'One source says: "{pick(ANSWERS, other)}"' if lang == "en" else f'« {pick(ANSWERS, lang)} »', "answer"))
        elif kind == "cut":
            w = body[-1][0].split()
            keep = " ".join(w[: r.randint(2, max(2, len(w) - 2))])
            keep = r.choice([keep, keep, keep[:-2] if len(keep) > 8 else keep, keep + r.choice([" and the", " with a,", " und die", " de la", " y el"])])
            body[-1] = (keep, "unfinished")
        if kind in ("answer", "list", "cut") and r.random() < 0.1:
            body.insert(0, (pick(COURTESY, lang), "answer"))
        parts, asked = [p for p, _ in body], words(q)
        out.append(list(zip(features(parts, list(map(words, parts)), frozenset(asked), _best(language(asked))), [t for _, t in body])))
    return out


@lru_cache(maxsize=4)
def fit(s: Shares = Shares()) -> crf.Model:
    """The field for ``s``, fitted once a process."""
    return crf.fit(made_up(s.sequences), TAGS)


def defect(counts: list[int], tags: list[str], s: Shares = Shares()) -> str | None:
    """The pair's defect from the numbers of words its tags cover."""
    if not counts:
        return "empty"
    cover = dict.fromkeys(TAGS, 0)
    for n, t in zip(counts, tags):
        cover[t] += n
    total = sum(cover.values())
    if cover["refusal"] >= s.refusal * total:
        return "refusal"
    if cover["echo"] >= s.echo * total:
        return "copied"
    if cover["foreign"] >= s.foreign * total:
        return "other_language"
    return "truncated" if tags[-1] == "unfinished" else None


def _tagger(model: crf.Model, s: Shares):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked: dict[str, tuple[frozenset[str], tuple[str, float]]] = {}
        for pdf in batches:
            if len(asked) > 20_000:  # only a memo
                asked.clear()
            cut, todo = [], []
            for q, a in zip(pdf["__question"], pdf["__answer"]):
                q = q or ""
                if q not in asked:
                    asked[q] = frozenset(words(q)), _best(language(words(q)))
                parts = clauses(a) if a else []
                lows = [words(p) for p in parts]
                cut.append([len(x) for x in lows])
                todo.append(features(parts, lows, *asked[q]))
            tags = crf.decode(model, todo)
            for i, q in enumerate(pdf["__question"]):
                if not (q and asked[q][0]):  # nothing asked: nothing to copy, no language to miss
                    tags[i] = ["answer" if t in ("echo", "foreign") else t for t in tags[i]]
            found = [defect(p, t, s) for p, t in zip(cut, tags)]
            yield pd.DataFrame({"rec_table": pdf["__table"], "rec_id": pdf["__id"].astype("int64"), "defect": pd.Series(found, dtype="object")}).dropna(subset=["defect"])

    return run


DEFECTS = "rec_table string, rec_id bigint, defect string"


def pair_defects(pairs: DataFrame, s: Shares = Shares()) -> DataFrame:
    """(rec_table, rec_id, defect) of the defective rows of ``pairs``.

    pairs: rec_table, rec_id, question, answer; other columns are not read. A null, empty, blank
    or placeholder answer is ``empty``; with a null or empty question nothing is copied or in
    another language. Rows without rec_id are left out; equal rows give their defect once.
    """
    rows = pairs.where("rec_id is not null").select(
        F.col("rec_table").alias("__table"), F.col("rec_id").cast("bigint").alias("__id"), F.col("question").alias("__question"), F.col("answer").alias("__answer")
    )
    return rows.mapInPandas(_tagger(fit(s), s), DEFECTS).distinct()


def json_answer(answer: Column) -> Column:
    """Key ``answer`` of a JSON object; null where it is null, absent or the text no JSON."""
    return F.get_json_object(answer, "$.answer")


def pairs_of(eval_results: DataFrame, llm_responses: DataFrame, questions: DataFrame) -> DataFrame:
    """Both tables' pairs in one form. Exact duplicates are left to ``pair_defects``; a response to
    an unknown question keeps a null question."""
    asked = questions.select(F.col("question_id").alias("__qid"), F.col("question").alias("__q")).dropDuplicates(["__qid"])
    a = eval_results.select(F.lit("eval_results").alias("rec_table"), F.col("result_id").alias("rec_id"), "question", json_answer(F.col("answer")).alias("answer"))
    b = llm_responses.select("response_id", "question_id", "text").join(asked, F.col("question_id") == F.col("__qid"), "left")
    b = b.select(F.lit("llm_responses").alias("rec_table"), F.col("response_id").alias("rec_id"), F.col("__q").alias("question"), F.col("text").alias("answer"))
    return a.unionByName(b)
