"""Personal information inside free text (problem 3).

Triggers (an automaton of given names, titles, cues and street words, and one pass each for digit
groups and for runs of capitalised words) point at the few places of a text that can hold personal
data. There every candidate span is proposed, several where the boundaries are open, with features of the whole span and of
what stands beside it; a semi-Markov conditional random field chooses boundaries and types
jointly. The field is fitted when the operator starts, on texts filled in from the patterns
below; their number is a parameter and its only bound. Per text, without shuffle.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import semi_crf
from tessera.llm.keyword_spam import FUNCTION_WORDS, GLUE
from tessera.llm.semi_crf import Segment


@dataclass(frozen=True)
class Settings:
    """Number of made-up texts the field is fitted on, and their seed."""

    texts: int = 5000
    seed: int = 11


KINDS = ("email", "phone", "id_number", "address", "name")
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}

# Given names of several languages, lower case.
GIVEN = frozenset(
    """adam agnes alan alex alice amir ana andrea anna anouk antoine aylin bastien beatriz ben bram callum camille carla carlos carmen chloe
    claire clara corin daniel dario david diego edda elena elif emeka emil emma erik eva fatima fenna fiona franz gabriel george giulia greta
    hana hannah hans halvard helen hugo ilse ines ingrid ioana isabel iskander ivan jack james jan jana jane javier jens joao john jona jonas jorge jose juan
    julia jurgen kamal karin karl katja kenji klaus lars laura lea leila leo liam liesl linda lowri luca lucas lucia luis maja manuel marco maria
    marie marisol mark marta martin mary matteo max maya michael miguel mirel mohammed nadia nadja nina noah noor nora oliver olga omar oskar paloma paul
    pedro peter petra pierre priya rachel raul rhys richard robert rosa ruben ruth samuel sara sarah saskia sean sigrid simon sofia sophie stefan
    susan tariq tavi teodor thomas tom ursula vera victor wen yara yusra yuki zofia zoe""".split()
)
# Forms of address and roles a name may follow.
TITLES = frozenset(
    "dr prof professor mr mrs ms miss herr frau m mme mlle monsieur madame sr sra señor señora don doña witness zeuge zeugin témoin testigo ing sir".split()
)
# Words whose company makes a capitalised pair a place, body, method or device.
NOT_PEOPLE = frozenset(
    """street road lane close avenue ave rd st yard works depot mill park store plant terminal quay vale row bay hall harbour north south east west upper lower
    institute board review desk bulletin laboratory lab group agency office department university college company ltd inc gmbh bureau instituto boletín revue
    instruments instrument systems services council committee commission panel team brigade foundation society association press library centre center redaktion rédaction redacción thanks thank regards hello dear danke merci gracias
    method test rig bench protocol rule clause valve sensor pump scale model report standard energy safety battery process fire insurance standards research
    telefon telephone téléphone teléfono phone tel mobile mobil email e-mail
    january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday
    the and of in on at by for from with to a an this that these is was were are not but or as it when because home contact about news training events
    der die das und von im am zu mit bei nach vor le la les des du de et el los las del y en untersuchung enquête investigación""".split()
)
# Nouns that name a body or what it publishes; those that are surnames too are left out.
BODIES = frozenset(
    """register registry archive archives record records ledger digest gazette journal observer monitor watch magazine newsletter newspaper herald tribune chronicle
    observatory academy school trust authority administration association federation union alliance consortium coalition network forum congress conference
    commission committee council court tribunal ministry directorate inspectorate inspection secretariat division section unit branch registrar
    corporation corp incorporated llc plc holding holdings partners enterprises industries technologies technology solutions consulting services service agency
    museum hospital clinic airport station observatory facility facilities project programme program initiative campaign survey database portal catalogue
    incident incidents accident hazard hazards risk loss quality health certification compliance prevention investigation technical national international regional
    verein gesellschaft amt behörde kammer ministerium zeitung zeitschrift zentrum register archiv stiftung prüfstelle fachblatt anstalt
    société compagnie agence ministère association fondation observatoire registre gazette cahiers laboratoire conseil comité
    sociedad compañía agencia ministerio asociación fundación observatorio registro gaceta cuadernos laboratorio consejo comité empresa""".split()
)
# Cues of an identity number.
ID_CUES = (
    "passport", "identity card", "id card", "id number", "id no", "identification number", "tax id", "social security", "ssn", "ni number", "national insurance",
    "insurance number", "driving licence", "driver's license", "driver licence", "driving license", "licence number", "personal number", "personnummer", "national id",
    "ausweis", "reisepass", "steuer-id", "steuernummer", "steueridentifikationsnummer", "sozialversicherung", "führerschein", "personalnummer", "passeport",
    "carte d'identité", "sécurité sociale", "numéro fiscal", "permis de conduire", "pasaporte", "dni", "nie", "seguridad social", "permiso de conducir", "identidad", "número fiscal",
)
# Words of a street's name.
_EN_STREET = "Street|St|Road|Rd|Close|Lane|Ln|Avenue|Ave|Drive|Way|Court|Place|Terrace|Crescent|Gardens|Grove|Hill|Square|Boulevard|Mews|Walk"
_FR_STREET = "rue|avenue|boulevard|place|chemin|allée|impasse|quai|route|cours"
_ES_STREET = r"Calle|C/|Avenida|Avda\.?|Plaza|Paseo|Camino|Carrera|Ronda|Travesía"
_DE_STREET = "weg|straße|strasse|str\\.|allee|gasse|platz|damm|ufer|steig|pfad|ring"

_S = r"\s{1,3}"
_CAP = r"[A-ZÀ-ÖØ-Þ][\w’'-]*"
_WORD = r"[A-ZÀ-ÖØ-Þ](?:[^\W\d_]|[’'-])+(?!\w)"
_TOWN = rf"{_WORD}(?:[ \xa0]{_WORD}|\r?\n{_WORD}(?=[.,;)]|{_S}(?:[a-z]|[A-Z]{{1,2}}\d))){{0,2}}"
_FLAT = r"(?:Flat|Apt\.?|Apartment|Unit|Suite)"
_ADDRESSES = (
    re.compile(
        rf"(?:{_FLAT}{_S}\d+[A-Za-z]?,{_S})?\b\d{{1,5}}[A-Za-z]?,?{_S}(?:{_CAP}{_S}){{1,3}}(?:{_EN_STREET})\b\.?(?:,{_S}{_FLAT}{_S}\d+[A-Za-z]?)?"
        rf"(?:,{_S}(?!{_FLAT}){_TOWN})?(?:,?{_S}(?:[A-Z]{{1,2}}\d[\dA-Z]?(?:{_S})?\d[A-Z]{{2}}|[A-Z]{{2}}{_S}\d{{5}}(?:-\d{{4}})?)\b)?"
    ),
    re.compile(
        rf"\b\d{{1,4}}(?:{_S}(?:bis|ter))?,?{_S}(?:{_FR_STREET}){_S}(?:(?:de{_S}la|de|du|des|la|le|les){_S}|(?:l|d)['’])*{_CAP}(?:(?:{_S}|-)(?:{_CAP}|de|du|des|la)){{0,3}}(?:,?{_S}\d{{5}}{_S}{_TOWN})?"
    ),
    re.compile(rf"\b(?:{_ES_STREET}){_S}(?:(?:de|del|la|las|los|el){_S}){{0,3}}{_CAP}(?:{_S}(?:(?:de|del|la){_S})?{_CAP}){{0,2}},?{_S}(?:n\.?º\s?)?\d{{1,4}}(?:,{_S}\d{{1,2}}\.?º(?:{_S}[A-Z]\b)?)?(?:,{_S}\d{{5}}{_S}{_TOWN})?"),
    re.compile(rf"\b[A-ZÄÖÜ][\wäöüß-]*(?:{_DE_STREET}){_S}\d{{1,4}}(?:{_S})?[a-z]?\b(?:,{_S}\d{{5}}{_S}{_TOWN})?"),
    re.compile(rf"\b(?:Am|An der|An den|Im|Auf der|Zum|Zur){_S}{_CAP}{_S}\d{{1,4}}[a-z]?,{_S}\d{{5}}{_S}{_TOWN}"),
)

_AT = re.compile(r"([\w+'’-]+(?:\.[\w+'’-]+)*)(\s{0,2}(?:@|\(at\)|\[at\]|\sat\s)\s{0,2})([\w-]+(?:(?:\.|\s{0,2}(?:\(dot\)|\[dot\]|\sdot\s)\s{0,2})[\w-]+)+)", re.I)
_MARKED = re.compile(r"@|\((?:at|dot)\)|\[(?:at|dot)\]|\sdot\s", re.I)
_DIGITS = re.compile(r"(?<![\w.,/-])(?=[+(\d](?:\D{0,4}\d){6})(?:\+\d{1,3}|\(\d{1,5}\)|\d{2,5})(?:[ \xa0.\-/\n]{0,2}\(?\d{1,6}\)?){1,7}(?![\w/])")
_EXT = re.compile(r"\s{0,2}(?:ext\.?|extension|x|poste|Durchwahl)\s{0,2}\d{1,5}\b", re.I)
_CODE = re.compile(r"[A-Z]{0,5}[ -]?\d[\dA-Z]*(?:[ -][\dA-Z]{1,8}){0,6}\b")
_TO_CODE = re.compile(r"[\s\w.:=#°º()-]{0,26}?(?<![\w-])(?=[A-Z0-9])")
_NEXT_CODE = re.compile(r"[A-Z0-9]\w*[\s\w.:=#°º()-]{0,20}?(?<![\w-])(?=[A-Z0-9])")
_NAME_TOKEN = r"[A-Za-zÀ-ÖØ-öø-ÿ][\w’'-]*\w"
_PARTICLE = r"(?:(?:van|von|de|der|den|del|la|le|da|di|du|ter|al|bin)\s{1,2}){0,2}"
_AFTER_GIVEN = re.compile(rf"(?:{_S}[A-Za-z]\.){{0,2}}{_S}{_PARTICLE}({_NAME_TOKEN})")
_BEFORE_GIVEN = re.compile(rf"({_NAME_TOKEN}),{_S}$")
_WORD_BEFORE = re.compile(rf"({_NAME_TOKEN}){_S}$")
_AFTER_REVERSED = re.compile(rf"{_S}[A-Za-z]\.(?!\w)")
_INITIAL = re.compile(rf"(?<![\w.'’°-])[A-Z]\.{_S}(?:[A-Z]\.{_S})?{_PARTICLE}{_CAP}")
_REVERSED_INITIAL = re.compile(rf"(?<![\w.'’°-]){_CAP},{_S}[A-Z]\.(?!\w)(?!\s*[A-Z]\.\s*[A-Z])")
_INITIAL_LETTER = re.compile(r"(?<!\w)[A-Z]\.")
_SURNAME_BEFORE = re.compile(rf"(?<![\w.'’°-]){_CAP},{_S}$")
_PAIR = re.compile(rf"{_CAP}(?:{_S}[A-Z]\.)?{_S}{_CAP}|{_CAP},{_S}{_CAP}(?:{_S}[A-Z]\.)?")
# Runs of two or three capitalised words in a line, which are names where their surroundings say so.
_TITLED = r"[A-ZÀ-ÖØ-Þ](?:['’][A-ZÀ-ÖØ-Þ])?[^\W\d_A-Z]+(?:[A-Z][^\W\d_A-Z]+)?(?:-[A-ZÀ-ÖØ-Þ][^\W\d_A-Z]+)?"
_CAPITALS = re.compile(rf"(?<![\w.'’#@&/-]){_TITLED}(?:[ \xa0](?:[A-Z]\. )?(?:(?:van|von|de|der|den|del|la|di|du|ter|bin|al) ){{0,2}}{_TITLED})+(?!\w|-\w)")
_LOWER = re.compile(r"(?<![\w-])[^\W\d_A-ZÀ-Þ][^\W\d_A-Z]+")
_ENGLISH = re.compile(r"\b(?:the|of|and|was|were|that|is|in|to|by|with|for|on)\b")
_GERMAN = re.compile(r"\b(?:der|die|das|und|ist|nicht|mit|von|den|dem|ein|eine|für|auf|wurde|bei|zu|im|sich)\b")
# Verbs of what people do, of which one beside a name speaks for a person.
PERSON_VERBS = frozenset(
    """said says told tells wrote writes signed saw met spoke called asked explained reported noticed argued recalled added replied thought believed knew heard felt
    brought carried opened closed left arrived returned walked ran drove lives lived works worked took gave found phoned emailed apologised complained claimed denied
    agreed insisted warned noted who whose was is had has did sagte schrieb sah traf erklärte berichtete meinte bemerkte unterschrieb verließ rief fragte hat hatte
    a dit écrit vu signé expliqué déclaré affirme avait quitté appelé dijo escribió vio firmó explicó declaró salió llamó había""".split()
)
# Words that open a sentence before a name.
OPENERS = frozenset(
    """yesterday today tonight later meanwhile perhaps maybe afterwards soon earlier recently eventually finally sadly luckily sometimes often once twice again still now here
    yet however therefore indeed instead otherwise besides first second next last gestern heute später dann danach inzwischen vielleicht schließlich zuerst hier jetzt hier demain
    aujourd'hui ensuite puis enfin peut-être ici ayer hoy luego entonces finalmente quizá aquí ahora tampoco también""".split()
)
# Words after which a person is named, and words after which a place is.
PERSON_BEFORE = frozenset("by with met told asked thanked called thank ask contact colleague supervisor foreman driver manager engineer technician operator owner tenant neighbour inspector durch kollege leiter par collègue por colega and".split())
PLACE_BEFORE = frozenset("at in near into towards outside around between bei aus in nach à en dans vers desde hasta".split())
#: What bodies do and persons seldom: disclaim, reserve, publish.
_BODY_AFTER = re.compile(
    r"\s+(?:accepts?\s+no|(?:takes?|assumes?|bears?)\s+no|(?:is|are)\s+(?:provided|published|issued|supplied|edited|not\s+(?:liable|responsible))|disclaims?|reserves?|publishes|holds?\s+the\s+(?:copyright|rights)|cannot\s+be\s+held"
    r"|übernimmt\s+keine|haftet\s+nicht|behält\s+sich|(?:wird|werden)\s+(?:bereitgestellt|veröffentlicht|herausgegeben)|décline|n[’']accepte|n[’']assume|se\s+réserve|(?:est|sont)\s+(?:fournie?s?|publiée?s?)"
    r"|no\s+(?:acepta|asume|se\s+hace)|declina|se\s+reserva|se\s+(?:ofrece|publica|facilita)n?)\b", re.I
)
_BODY_BEFORE = re.compile(r"(?:published\s+by|issued\s+by|copyright(?:\s+by)?|©(?:\s+\d{4})?|rights\s+of|(?:bereitgestellt|veröffentlicht|herausgegeben)\s+von|publiée?s?\s+par|fournie?s?\s+par|publicad[oa]s?\s+por|ofrecid[oa]s?\s+por)\s+$", re.I)
_PLACE_END = re.compile(r"(?:wick|ford|ton|ham|bury|ville|field|mere|stadt|burg|dorf|haven|port|worth|mouth|dale|shire|stelle|blatt|institut|werk|verband)$")

_TRIM = ".,;:!?()[]\"“”«»*=—–-"


def _around(text: str, a: int, b: int) -> tuple[str, str, str]:
    """The last two words before a span and the first after it, lower case, with their punctuation."""
    left = text[max(0, a - 40) : a].lower().split()
    right = text[b : b + 24].lower().split(None, 1)
    return (left[-2] if len(left) > 1 else "", left[-1] if left else "", right[0] if right else "")


class Finder:
    """Proposes candidate segments of a text."""

    def __init__(self) -> None:
        import ahocorasick

        auto = ahocorasick.Automaton()
        for g in GIVEN:
            auto.add_word(g, ("given", g))
        for t in TITLES:
            auto.add_word(f" {t} ", ("title", t))
            auto.add_word(f" {t}. ", ("title", t))
        for c in ("(signed) ", "statement of ", "spoke to ", "reported by: ", "permit holder: ", "contact: ", "contact : ", "contacto: ", "according to ", "thanks, ", "name: ", " fitter, ", " neighbour ", "rückfragen an "):
            auto.add_word(c, ("title", c))
        for c in ID_CUES:
            auto.add_word(c, ("id", c))
        for s in (" street", " road", " rd", " close", " lane", " ln", " avenue", " ave", " drive", " way", " court", " place", " terrace", " crescent", " gardens", " grove", " hill", " square", " boulevard", " mews", " walk", " st", " st."):
            for end in (",", ".", " ", ";", ")"):
                auto.add_word(s + end, ("street", 0))
        for s in _FR_STREET.split("|"):
            auto.add_word(f" {s} ", ("street", 1))
        for s in ("calle ", "c/ ", "avenida ", "avda. ", "avda ", "plaza ", "paseo ", "camino ", "carrera ", "ronda ", "travesía "):
            auto.add_word(s, ("street", 2))
        for s in _DE_STREET.replace("\\", "").split("|"):
            auto.add_word(f"{s} ", ("street", 3))
        for s in (" am ", " an der ", " im ", " auf der ", " zum ", " zur "):
            auto.add_word(s, ("street", 4))
        auto.make_automaton()
        self._auto = auto

    def segments(self, text: str) -> list[Segment]:
        out: dict[tuple[int, int, str], Segment] = {}
        low = text.lower()
        if len(low) != len(text):  # a letter that grows in lower case would shift all offsets
            low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
        flat = low
        for blank in _BLANKS:
            flat = flat.replace(blank, " ")
        if "@" in flat or "(at)" in flat or "[at]" in flat or " dot " in flat:
            self._emails(text, out)
        self._numbers(text, out)
        for i in _INITIAL_LETTER.finditer(text):
            if m := _INITIAL.match(text, i.start()):
                self._name(text, m.start(), m.end(), "initial", out)
            if (m := _SURNAME_BEFORE.search(text, max(0, i.start() - 40), i.start())) and (m := _REVERSED_INITIAL.match(text, m.start())):
                self._name(text, m.start(), m.end(), "reversed initial", out)
        tried: set[tuple[int, int]] = set()
        for last, (what, value) in self._auto.iter(f" {flat} "):
            end = last  # one blank is put before the text, so this is the offset after the match
            if what == "given":
                a = end - len(value)
                if (a == 0 or not (flat[a - 1].isalnum() or flat[a - 1] in "'’-@._+")) and not flat[end : end + 1].isalnum() and flat[end : end + 1] not in ("'", "’", "@", "_", "+"):
                    self._given(text, a, end, out)
            elif what == "title":
                self._titled(text, end, out)
            elif what == "id":
                self._identity(text, flat, end, value, out)
            else:
                self._address(text, end, value, tried, out)
        self._runs(text, low, out)
        return list(out.values())

    def _add(self, out: dict, a: int, b: int, kind: str, features: list[str]) -> None:
        if (a, b, kind) not in out:
            out[a, b, kind] = Segment(a, b, kind, tuple(features))

    def _emails(self, text: str, out: dict) -> None:
        done = 0
        for mark in _MARKED.finditer(text):
            if mark.start() < done:
                continue
            # an address is sought around the mark alone, from the start of a word
            a = max(done, mark.start() - 80)
            m = next((x for x in _AT.finditer(text, a, mark.end() + 140) if x.end() > mark.start()), None)
            if m is None or m.start() > mark.start():
                continue
            done = m.end()
            sign = m[2].strip().lower()
            if sign == "at" and not re.search(r"\sdot\s", m[3], re.I):
                continue
            fs = ["email", f"email sign {sign}", "email end " + ("known" if m[3].split(".")[-1].isalpha() else "other")]
            if len(re.split(r"[.\s]+|\(dot\)|\[dot\]", m[3])[-1]) < 2 or m[3].replace(".", "").isdigit():
                fs.append("email bad end")
            self._add(out, m.start(), m.end(), "email", fs)

    def _numbers(self, text: str, out: dict) -> None:
        for m in _DIGITS.finditer(text):
            whole = m.group()
            spans = {(m.start(), m.end())}
            for piece in re.finditer(r"[^\n]+", whole):  # where a line may end the number
                spans.add((m.start() + piece.start(), m.start() + piece.end()))
            for a, b in spans:
                part = text[a:b].rstrip(" .-/\xa0\n")
                b = a + len(part)
                n = sum(c.isdigit() for c in part)
                if not 7 <= n <= 15:
                    continue
                shape = re.sub(r"\d+", lambda x: str(len(x.group())), part)
                before2, before, after = _around(text, a, b)
                base = [
                    f"starts {part[0] if part[0] in '+(' else '0' if part[0] == '0' else 'digit'}", f"digits {n}", f"shape {shape}", f"before {before}", f"before {before2} {before}",
                    f"after {after}", "in lines" if "\n" in part else "one line", "blocks " + "".join(sorted(set(re.sub(r"[\d\n]", "", part)))),
                ]
                if re.match(r"(?:19|20)\d\d[-./]\d\d?[-./]\d\d|\d\d?[-./]\d\d?[-./](?:19|20)\d\d", part):
                    base.append("date")
                if a and text[a - 1] in "-#":
                    base.append("glued")
                for kind in ("phone", "id_number"):
                    if kind == "id_number" and len(shape) > 14:
                        continue
                    self._add(out, a, b, kind, [kind, *(f"{kind} {x}" for x in base)])
                if ext := _EXT.match(text, b):
                    self._add(out, a, ext.end(), "phone", ["phone", "phone extension", *(f"phone {x}" for x in base)])

    def _identity(self, text: str, flat: str, end: int, cue: str, out: dict) -> None:
        if flat[end - len(cue) - 1 : end - len(cue)].isalnum():
            return
        m = _TO_CODE.match(text, end)
        at, tries = end, 0
        while m and tries < 4:
            at = m.end()
            code = _CODE.match(text, at)
            if code and sum(c.isdigit() for c in code.group()) >= 5:
                part = code.group()
                # a code ends before a capital word that follows it
                for p in {part, re.sub(r"[ -][A-Z]+$", "", part), re.sub(r"( [A-Z])$", r"\1", part)}:
                    b = at + len(p)
                    if sum(c.isdigit() for c in p) < 5 or not p or text[b : b + 1].isalnum():
                        continue
                    shape = re.sub(r"[A-Z]+", lambda x: "A" * min(2, len(x.group())), re.sub(r"\d+", lambda x: str(len(x.group())), p))
                    self._add(out, at, b, "id_number", ["id_number", "id_number cue", f"id_number cue {cue}", f"id_number shape {shape}", f"id_number gap {min(4, (at - end) // 6)}", f"id_number after {_around(text, at, b)[2]}"])
                    old = out.get((at, b, "id_number"))
                    if old and "id_number cue" not in old.features:
                        out[at, b, "id_number"] = Segment(at, b, "id_number", (*old.features, "id_number cue", f"id_number cue {cue}", f"id_number shape {shape}"))
                return
            tries += 1
            nxt = _NEXT_CODE.match(text, at)
            if not nxt or nxt.end() - end > 34:
                return
            m = nxt

    def _address(self, text: str, end: int, which: int, tried: set, out: dict) -> None:
        a, b = max(0, end - 90), min(len(text), end + 90)
        for m in _ADDRESSES[which].finditer(text, a, b):
            span = m.span()
            if span in tried or not span[0] <= end <= span[1] + 2 or (span[0] and text[span[0] - 1].isalnum()):
                continue
            tried.add(span)
            part = m.group()
            before2, before, after = _around(text, *span)
            fs = [
                "address", f"address form {which}", f"address before {before}", f"address before {before2} {before}", f"address after {after}",
                f"address parts {min(3, part.count(','))}", "address code" if re.search(r"\d{5}|[A-Z]\d+ ?\d[A-Z]{2}", part) else "address no code",
                "address flat" if re.search(_FLAT, part) else "address no flat",
            ]
            self._add(out, *span, "address", fs)

    def _titled(self, text: str, end: int, out: dict) -> None:
        while end < len(text) and text[end].isspace():
            end += 1
        m = _PAIR.match(text, end)
        if m:
            self._name(text, m.start(), m.end(), "pair", out)

    def _given(self, text: str, a: int, b: int, out: dict) -> None:
        g = text[a:b]
        m = _AFTER_GIVEN.match(text, b)
        if m and _same_case(g, m[1]):
            self._name(text, a, m.end(), "given", out)
        m = _BEFORE_GIVEN.search(text, max(0, a - 40), a)
        if m and _same_case(g, m[1]):
            x = _AFTER_REVERSED.match(text, b)
            self._name(text, m.start(), x.end() if x else b, "reversed given", out)
        m = _WORD_BEFORE.search(text, max(0, a - 32), a)
        if m and g[0].isupper() and _same_case(g, m[1]):
            self._name(text, m.start(), b, "surname given", out)

    def _runs(self, text: str, low: str, out: dict) -> None:
        """Capitalised runs inside sentences that nothing else has proposed."""
        taken = [(s.start, s.end) for s in out.values() if s.kind in ("name", "address")]
        whole: frozenset[str] | None = None
        for m in _CAPITALS.finditer(text):
            a, b = m.span()
            if text[b - 2 : b] in ("'s", "’s"):
                b -= 2
            opened, start = "", a == 0 or text[a - 1] == "\n" or text[a - 2 : a - 1] in (".", "!", "?", ":", "-", "*", "•")
            while start and (first := low[a:b].split(None, 1)) and len(first) > 1 and (first[0] in _COMMON or first[0] in OPENERS):
                # the word that opens the sentence
                a, start, opened = b - len(first[1]), False, "adverb" if first[0] in OPENERS else "article" if first[0] in GLUE else "other"
            words = [w for w in low[a:b].split() if w not in _PARTICLES and w[1:] != "."]
            if not 2 <= len(words) <= 3 or not _COMMON.isdisjoint(words) or any(x <= a and b <= y for x, y in taken):
                continue
            begin, end = text.rfind("\n", 0, a) + 1, text.find("\n", b)
            line = text[begin : end if end >= 0 else len(text)]
            if line.lstrip()[:1] == "#" or len(_LOWER.findall(line)) < 2:
                continue
            if whole is None:
                whole = frozenset(_LOWER.findall(text))
            follows = low[b : b + 24].split(None, 1)
            nxt = follows[0].strip(_TRIM) if follows else ""
            before = low[max(0, a - 24) : a].split()
            prev = before[-1] if before else ""
            article = prev in ("the", "a", "an", "this", "das", "der", "die", "dem", "den", "le", "la", "el", "los")
            if nxt not in PERSON_VERBS and (start or article or len(_ENGLISH.findall(line)) < 2) and not _OF.isdisjoint(text[a:b].split()):
                continue  # a thing of a place
            fs = ["plain start" if start else "plain middle"]
            if nxt in PERSON_VERBS:
                fs.append("plain verb after" if text[b : b + 1] == " " else "plain verb after mark")
            if not start and prev in PERSON_BEFORE:
                fs.append("plain person before")
            if not start and prev in PLACE_BEFORE:
                fs.append("plain place before")
            if _PLACE_END.search(words[-1]):
                fs.append("plain place end")
            if len(_GERMAN.findall(line)) >= 2:
                fs.append("plain german")
            if not whole.isdisjoint(words):
                fs.append("plain lower elsewhere")
            if nxt in NOT_PEOPLE_AFTER:
                fs.append("plain thing after")
            if text[b : b + 1] == "…" or text[b : b + 3] == "...":
                fs.append("plain cut")
            if opened:
                fs.append(f"plain opened {opened}")
            if article:
                fs.append("plain article before")
            if _BODY_AFTER.match(text, b):
                fs.append("plain body after")
            if _BODY_BEFORE.search(text, max(0, a - 40), a):
                fs.append("plain body before")
            if len(words) == 3:
                fs.append("plain three words")
            self._name(text, a, b, "plain", out, tuple(fs))
            if start and len(words) == 3:  # the first word may be capital for opening the sentence
                self._name(text, a + len(text[a:b].split()[0]) + 1, b, "plain", out, (*fs, "plain without first"))

    def _name(self, text: str, a: int, b: int, how: str, out: dict, more: tuple[str, ...] = ()) -> None:
        if (a, b, "name") in out:
            old = out[a, b, "name"]
            if f"name how {how}" not in old.features:
                out[a, b, "name"] = Segment(a, b, "name", (*old.features, f"name how {how}"))
            return
        part = text[a:b]
        if "\n\n" in part or part.count("\n") > 1:
            return
        tokens = [t.strip(",") for t in part.split()]
        low = [t.lower().strip(".") for t in tokens]
        before2, before, after = _around(text, a, b)
        plain = before.strip(_TRIM)
        case = "upper" if part.isupper() else "lower" if part.islower() else "title"
        fs = [
            "name", f"name how {how}", *more, f"name case {case}", f"name before {before}", f"name before {before2} {before}", f"name after {after}",
            f"name tokens {len(tokens)}", "name in lines" if "\n" in part else "name one line",
        ]
        if before.isdigit():
            fs.append("name after number")
        if before[:1] == "#":
            fs.append("name in heading")
            if "\n" in part:
                return
        if any(w in GIVEN for w in low):
            fs.append(f"name known given {case}")
        if plain in TITLES and (before[-1:].isalpha() or before[-1:] == "."):
            fs.append("name title")
        if before[-1:] in (":", ")"):
            fs.append(f"name after mark {before[-1]}")
        wrong = sum(w in NOT_PEOPLE for w in low)
        if wrong:
            fs.append("name wrong word")
        nxt = text[b : b + 20].split(None, 1)
        if case == "title" and nxt and b < len(text) and text[b] in " \n" and nxt[0][:1].isupper():
            fs.append("name next capital" + (" wrong" if nxt[0].strip(_TRIM).lower() in NOT_PEOPLE else ""))
        if case != "lower" and plain and before[-1:].isalnum() and text[max(0, a - 1)] in " \n" and before != plain.lower():
            fs.append("name odd before")
        prev = text[max(0, a - 24) : a].split()
        if not any(x.startswith("plain opened") for x in more) and prev and prev[-1][:1].isupper() and prev[-1][-1:].isalnum() and plain not in TITLES and len(prev[-1]) > 1:
            fs.append("name previous capital")
        if case == "upper":
            near = re.sub(r"[^A-Za-z]", "", text[max(0, a - 14) : a] + text[b : b + 14])
            fs.append("name in upper line" if near and near.isupper() else "name upper alone")
        if text[b : b + 1] in ("@", "_") or text[max(0, a - 1)] in "@_":
            fs.append("name at sign")
        self._add(out, a, b, "name", fs)


_OF = frozenset("von de del du di".split())
_PARTICLES = frozenset("van von de der den del la di du ter bin al".split())
#: What no word of a name is: function words and the words of NOT_PEOPLE and BODIES.
_COMMON = (FUNCTION_WORDS | NOT_PEOPLE | BODIES) - _PARTICLES
#: Things that bear a name.
NOT_PEOPLE_AFTER = frozenset("rig method test bench protocol rule clause valve sensor pump scale model report standard instruments paste clamps liners collars foam panel line cell works plant yard depot".split())

_BLANKS = "\n\r\t\x0b\x0c\xa0\u2002\u2003\u2009\u202f"


def _same_case(a: str, b: str) -> bool:
    return (a.islower() and b[0].islower()) or (a[0].isupper() and b[0].isupper())


# Patterns of the texts the field is fitted on. {n} name, {e} e-mail, {p} phone,
# {i} an identity number with its cue, {a} address, {t} town, {w} word, {d} small number, {b} a body on no list.
PATTERNS = """
I met {n} on {d} May.|I spoke to {n} about the leak.|According to Dr {n} the vent was blocked.|According to {n} the vent was taped over.
Ms {n} signed the form.|Mr {n} signed it.|Witness {n} left the hall at once.|Prof. {n} wrote the note.
Questions go to {n}, {e}, until the end of the week.|Contact: {n}, phone {p}.|Contacto: {n}, teléfono {p}.|Contact : {n}, téléphone {p}.|Rückfragen an {n}, Telefon {p}.
The fitter, {n}, can be reached on {p}.|The night guard, {n}, saw it.|{n} told the panel that the door was open.|{n}, a driver from {t}, moved the pallet.
The alarm was reset by {n} and again by {n}.|(signed) {n}|Statement of {n}: the door was warm.|Reported by: {n}; home address {a}; tel. {p}|Reported by: {n}; home address {a}; mobile {p}
Permit holder: {n} ({i})|Permit holder: {n}|thanks, {n} / {p}|thanks, {n} / {p} {n} told us.|cc {e}; {e}|Email: {e}|Email: {e} should quote the later edition|Tel {p}|Tel {p} The figure is wrong.
My neighbour {n} saw smoke; their number is {p}.|Frau {n} unterschrieb die Freigabe.|Zeuge {n} verließ die Halle.|Mme {n} a signé le permis.|Le témoin {n} a quitté le hall.
La señora {n} firmó el permiso.|El testigo {n} salió de la nave.|Herr {n} prüfte die Pumpe.|M. {n} a vu la fumée.
Bitte an {e} schreiben.|Merci d'écrire à {e} au plus vite.|Escriban a {e} cuanto antes.|Send the figures to {e} please.|Call {p} or write to {e} for the log.|write to {e} please
The form lists {p} and {p} as emergency contacts.|Insurance claim under {i} was refused.|The injured worker gave {i} to the first-aid post.|{i}|{i} The unit is missing.
The owner lives at {a}, and the unit was charging.|Delivery went to {a} by mistake.|Parcel collected from {a} at 12:{d}.|Samples were sent to {a} for {n} to examine.
Der Besitzer wohnt in {a}.|Le propriétaire habite au {a}.|El dueño vive en {a}.|Address: {a}|Letters go to {a}.
{w} {n}|{w}. {n}, {p}|{n}\\n{a}\\n{p}|Best regards, {n}
""".strip().replace("\n", "|").split("|")  # fmt: skip
# The same for names that no list holds ({q}), with nothing beside them that announces a name.
PLAIN = """
{q} said that the alarm came late.|{q} wrote to the office twice.|We met {q} at the gate.|The key was handed over by {q} on Monday.|{q} was the first to see the smoke.|The call was taken by {q}, who closed the line.
After lunch {q} opened the hatch again.|Please thank {q} for the photographs.|{q} had worked in the hall for years.|I asked {q} whether the door was locked.|The log names {q} as the last user.|{q} lives above the shop.
It was {q} who rang the bell.|The driver, {q}, left before noon.|Nobody but {q} knew the code.|{q}'s van stood in the way.|The letter to {q} came back.|{q} and {q} carried the tank outside.|A statement from {q} is still missing.
{q} sagte, dass die Tür offen war.|Der Brief ging an {q} und kam nicht zurück.|{q} a écrit deux lettres au bureau.|La clé a été remise par {q} hier soir.|{q} dijo que la puerta estaba abierta.|La llave la tenía {q} desde ayer.
They gave {q} the spare parts.|My colleague {q} brought the meter.|Last week {q} told us about the leak.|In the end {q} signed for it.|Tonight {q} rang twice.|Soon {q} {v}ed it.|Finally {q} {v} the {v} and {v}.|Because {q} {v}, the {v} was late.|While {q} {v}ed, nobody {v} it.|Perhaps {q} knew.|When {q} paid, the others waited.|A call from {q} came at noon.|Flowers to {q} went out.|{q} {v}ed that the {v} was late.|The {v} from {q} {v} again.|In {v} {q} {v}ed it twice.|{q} {v}s the {v} every day.|They {v} {q} on Friday.|Then a {v} of {q} was {v}ed.|All {v} with {q}, as the {v} said.|{q} noticed a smell of gas in the corridor.
I think that {q} is right about it.|They agree that {q} {v}ed first.|The page says that {q} was late, and {q} is sure of it.|The letter published by {q} was long.|A {v} and {q} were in the yard.|The note issued by {q} is old.|The date was wrong; {q} {v}ed it.|Wir denken, dass {q} es weiß, und {q} war da.|Les totaux et {q} sont là.
""".strip().replace("\n", "|").split("|")  # fmt: skip
# Capitalised runs that are places, bodies and things, and headings run into text.
NAMELESS = """
The fire at {t} {z} was seen from the road.|Samples from {t} {z} were lost.|A unit near {t} {z} was shut.|The {z} {x} rig ran for days.|The {z} {x} was blamed for the fault.|They compared {z} {x} paste with the old one.
Where {z} meets {x}, the drawings differ.|Durch {z} fiel die Pumpe aus.|Der Rundbrief von {z} {x}blatt ist bestellt und wurde versandt.|Die Angaben von {z} {x}stelle sind nicht geprüft.|- On 12 May the vent of the tank at {t} {z}…
The {z} {x} and the {x} {z} were both tested.|In {z} {x} the rule was not applied.|{z} {x} valves were fitted later and {z} {x} seals too.|Hot {z} work was stopped, as hot work is not allowed.|Gas Detection is covered below; gas detection and {z}.
Der Druck fiel, bevor das {z} von {t} und später die {x} von {t} nachgab.|Untersuchung: die {z} von {x} und das {x} von {t}|El {z} de {t} y la {x} de {t} fallaron.
They moved the rack from {t} {z} to {z} {t} by train.|Vom Standort {z} {x} wurde die Anlage zu der Halle gebracht.|Der Versuch {z} {x} wurde mit der Pumpe und dem Ventil wiederholt.|The line to {z} {x} is closed for the winter.
The text published by {b} is provided as it stands.|Totals are rounded and {b} accepts no claim for them.|Rights reserved; {b} takes no responsibility for the tables.|The leaflet was issued by {b} and is not advice.|By using this page you agree that {b} disclaims all warranties.|This is a free notice published by {b} for the trade.
Der Text wird von {b} bereitgestellt und ist ohne Gewähr.|Die Zahlen sind gerundet, und {b} übernimmt keine Haftung.|Le texte publié par {b} est fourni à titre indicatif.|Les totaux sont arrondis et {b} décline toute responsabilité.|El texto publicado por {b} se ofrece sin garantía.|Los totales son redondos y {b} no asume ninguna responsabilidad.
""".strip().replace("\n", "|").split("|")  # fmt: skip
HARMLESS = """
Firmware {d}.{d}.{d} logs under cell@rack{d} in bay {d}, North Yard.|The flow meter counted {d} {f} {f} litres at {d} {d} N, {d} {d} W.|Batch {g}-{g}-{g} came from the Marlow Street depot, unit {d}.
Report no. 20{d}-{f}-{g} lists cell serial QK {d} {d} {d} B.|{t} Instruments supplied part {f}.{f}.{g} for the {s} method.|The recorder stamped 20{d}-12-{d} 23:{d}:17 at channel {f}.
The {s} rig and the {s} Instruments bench differ by {d} % for the cell.|Related failures of the pump were measured at {t} and at {t} in 20{d}.|On {d} May 20{d} the cell at {t} {y} was taken out of service.
Reprinted under licence {g}{d}/20{d}. The views are those of the authors and not of {s} {y} Board.|To cite this item use the permanent reference {g}{d} of the {s} Energy Desk collection.|Last reviewed {d}/12/20{d} \\| Document class {g}{d}
By the {s} Safety Board editorial desk, 20{d}-11-{d}|Subscribers to the {t} alarm network lost signal.|Downloaded from the {s} Fire Research Group archive on 20{d}-11-{d}|© 20{d} {s} Energy Desk. All rights reserved.
{t} Row|{t} {y}\\n{s} Vale\\nHome|Never miss a finding: join {g} readers of our list.|Read more: Pump and valve at {t} {y}|Book now: cells workshop, {t}, {d} June|The line was closed by {t} Plant.
Abrufdatum {d}.11.20{d}, Archivnummer {g}{d}|Consulté le {d}/11/20{d}, dossier {g}{d}|Vor dem Öffnen muss der Behälter von {t} mindestens {d} Minuten spannungsfrei sein.|The {s} panel held that the {s} line, built in 19{d}, lost its {s} seal after {f} cycles.
Serial numbers {g}-{f}-{g} and {g} {g} {f} were logged.|Order {g}{g}{g} of the {y} shipped.|SKU {g}{d} \\| price \\| charger|Pressure rose to {d}.{d} bar at {d}:{d}.|{s}. Mirel {y}|ACCORDING TO THE SOURCES HELD, HOW MANY CYCLES DID THE PANEL ALLOW|the code 20{d} {f} {g} of the batch|See http://{w}{d}.example/{g}
## Limits\nLea también: una nota de {t}|### Scope {t}\nRosa Blätter lagen am Tor|at {d} {d} N, {d} {d} W. Related failures were noted.|cell serial QK {d} {d} B. Subscribers lost signal.|serial {d} {d} B. {t} had none.
It reached {d} °C. Durch den Spalt trat Gas aus.|a rise of {d} K. Pressure fell at {d} V. Gas was found.|on 0{d}/12/20{d}\n{d}.{d} Scope of the test|See {d}.{d}.20{d}\n{d} {w}|am 0{d}/11/20{d} {d}.{d} Ursachen
Kosten von {g} {f} Euro wurden genannt.|By the {s} desk, 0{h}/0{h}/20{d}\\n\\n{h}.{h} {z} of the cell|Redaktion {s}, 0{h}/0{h}/20{d}\\n{h}.{h} Ursachen {t}|Zone {d} of the {y}, close to {t} Lane|No one was hurt at {t} {y}.|It was {s} {y} that supplied the {s} test.|Times are local. Mirel valves were used.|Noor and the crew saw wen they came.
""".strip().replace("\n", "|").replace("\\|", "¦").split("|")  # fmt: skip
_SURNAMES = "Ashdown Belmar Corvane Dunleavy Eskelin Farrow Grunwald Hollis Ibarren Jansky Kestell Lorimer Marchetti Novak Ortega Pellerin Quirke Rossow Sandvik Thorne Ulbricht Varga Wexler Yilmaz Zeller O'Hara Lund-Berg D'Amico".split()
_GIVEN_OTHERS = "Aurelio Brynja Casimir Delphine Evander Florin Gwenda Hedvig".split()
_TOWNS = ["Norwick", "Elmsford", "Castle Row", "Brackley", "Port Vale", "Osterfeld", "Vernoux", "Almeda", "Sandy Quay"]


def _name(r: random.Random) -> str:
    g = r.choice(sorted(GIVEN)).capitalize() if r.random() < 0.85 else r.choice(_GIVEN_OTHERS)
    s = r.choice(_SURNAMES)
    if r.random() < 0.1:
        s += "-" + r.choice(_SURNAMES)
    kind = r.random()
    if kind < 0.5:
        out = f"{g} {s}"
    elif kind < 0.64:
        out = f"{g} {r.choice('ABCDEFGHJKLMNPRSTWY')}. {s}"
    elif kind < 0.77:
        out = f"{r.choice('ABCDEFGHJKLMNPRSTWY')}. {s}"
    elif kind < 0.9:
        out = f"{s}, {g}"
    else:
        out = f"{s}, {r.choice('ABCDEFGHJKLMNPRSTWY')}."
    case = r.random()
    if kind < 0.64 or 0.77 <= kind < 0.9:
        if case < 0.1:
            return out.lower()
        if case < 0.18:
            return out.upper()
    return out


def _coined(r: random.Random) -> str:
    """A capitalised word of syllables that no list holds."""
    return "".join(r.choice("b br d f g gr h j k kl l m n p r s st t tr v w z".split()) + r.choice("a e i o u ei au ia".split()) for _ in range(r.choice([1, 2, 2]))).capitalize() + r.choice(["n", "l", "r", "s", "th", "sh", "ne", "la", "k", ""])


def _unlisted(r: random.Random) -> str:
    """A name whose given name is on no list."""
    given = r.choice(_GIVEN_OTHERS) if r.random() < 0.2 else _coined(r)
    surname = r.choice(_SURNAMES) if r.random() < 0.4 else _coined(r)
    return f"{given} {r.choice(['', '', '', '', r.choice('ABCDEFGHJKLMNPRSTWY') + '. ', 'van ', 'de ', _coined(r) + ' '])}{surname}"


def _digits(r: random.Random, shape: str) -> str:
    return "".join(str(r.randrange(10)) if c == "9" else r.choice("ABCDEFGHJKLMPRSTXY") if c == "A" else c for c in shape)


def _email(r: random.Random) -> str:
    who = r.choice(["{g}.{s}", "{g}-{s}", "{g}+site9", "{s}_99", "g{s}"]).format(g=r.choice(sorted(GIVEN)), s=r.choice(_SURNAMES).lower())
    out = _digits(r, who) + "@" + r.choice(["mail.example", "post.example.org", "works.invalid", "plant-ops.example", "inbox.test"])
    style = r.random()
    if style < 0.15:
        out = out.replace("@", " [at] ")
    elif style < 0.3:
        out = out.replace("@", " (at) ").replace(".e", " (dot) e").replace(".i", " (dot) i").replace(".o", " (dot) o").replace(".t", " (dot) t")
    return out.upper() if r.random() < 0.1 else out


def _address(r: random.Random) -> str:
    town, n = r.choice(_TOWNS), str(r.randint(1, 400))
    return r.choice([
        f"{n} Miller Close, {town}", f"{n}b Harbour Rd., {town}", f"Flat {r.randint(1, 40)}, {n} Old Mill Lane, {town}", f"{n}9 Cooper's Ave, Apt {r.randint(1, 60)}, {town}, ZZ 00{r.randint(100, 999)}",
        f"{n} Bridge Street, {town} HM{r.randint(1, 9)} 4QX", f"{n}, rue des Lilas-Bleus, 00{r.randint(100, 999)} {town}", f"Calle del Prado {n}, {r.randint(1, 6)}.º B, 00{r.randint(100, 999)} {town}",
        f"Birkenweg {n}, 00{r.randint(100, 999)} {town}", f"Hafenstraße {n}, 00{r.randint(100, 999)} {town}",
    ])


def _identity(r: random.Random) -> tuple[str, str]:
    cue, shape = r.choice([
        ("passport", "A99999999"), ("passport no.", "AA9999999"), ("identity card", "99999999A"), ("social security number", "999-99-9999"), ("SSN", "999-99-9999"), ("SSN", "999 99 9999"), ("social security number", "999 99 9999"), ("NI number", "AA999999A"),
        ("national insurance no.", "AA 99 99 99 A"), ("tax identification number", "99 999 999 999"), ("driving licence", "AAAA999999AA99"), ("personal number", "19999999-9999"), ("tax ID", "99 999 999 999"),
    ])
    return cue, _digits(r, shape)


def made_up(count: int, seed: int) -> list[tuple[str, set[tuple[int, int, str]]]]:
    """``count`` texts with their true entities."""
    r, out = random.Random(seed), []
    for _ in range(count):
        text, true = "", set()
        for _ in range(r.randint(1, 3)):
            kind = r.random()
            pattern = r.choice(PATTERNS if kind < 0.47 else PLAIN if kind < 0.6 else HARMLESS if kind < 0.89 else NAMELESS).replace("\\n", "\n").replace("¦", "|")
            if text:
                text += r.choice([" ", "\n", "\n\n", ". "])
            for part in re.split(r"(\{\w\})", pattern):
                kind = {"{n}": "name", "{q}": "name", "{e}": "email", "{p}": "phone", "{a}": "address"}.get(part)
                if kind:
                    value = _unlisted(r) if part == "{q}" else {"name": _name, "email": _email, "address": _address}[kind](r) if kind != "phone" else _digits(r, r.choice([
                        "+44 20 7946 0999", "(020) 7946 0999", "07700 900999", "01632 960999", "+1-202-555-0199", "202 555 0199 ext. 99", "(312) 555-0199", "415.555.0199", "+33 1 99 00 99 99", "01 99 00 99 99", "030 23125 999", "+49 (0)30 23125-999", "+442079460999", "030/99999999",
                    ]))
                    true.add((len(text), len(text) + len(value), kind))
                elif part == "{i}":
                    cue, value = _identity(r)
                    cue += r.choice([" ", ": ", " = "])
                    if r.random() < 0.4:
                        cue = cue[0].upper() + cue[1:]
                    text += cue
                    true.add((len(text), len(text) + len(value), "id_number"))
                else:
                    value = {
                        "{t}": r.choice(_TOWNS), "{w}": r.choice(["leak", "smoke", "pump", "Hello", "Note"]), "{d}": str(r.randint(10, 28)), "{h}": str(r.randint(1, 9)), "{f}": str(r.randint(100, 999)), "{g}": str(r.randint(1000, 9999)),
                        "{s}": r.choice(_SURNAMES + ["Halberg", "Orrin", "Dorrick"]), "{v}": _coined(r).lower(), "{z}": _coined(r), "{x}": _coined(r), "{b}": " ".join(_coined(r) for _ in range(r.choice([2, 3, 3]))), "{y}": r.choice(["Yard", "Works", "Depot", "Mill", "Park", "Store", "Plant", "Terminal"]),
                    }.get(part, part)
                text += value
        if r.random() < 0.15:
            k = text.find(" ", r.randrange(len(text)))
            if k > 0:  # a line break instead of a blank changes no offset
                text = text[:k] + "\n" + text[k + 1 :]
        out.append((text, true))
    return out


@lru_cache(maxsize=4)
def fit(s: Settings = Settings()) -> semi_crf.Model:
    """The field for ``s``, fitted once a process."""
    finder = Finder()
    return semi_crf.fit([(finder.segments(t), true) for t, true in made_up(s.texts, s.seed)])


def entities(text: str, finder: Finder, model: semi_crf.Model) -> list[Segment]:
    """Personal data of one text, in order."""
    return semi_crf.decode(model, finder.segments(text)) if text else []


def masked(text: str, found: list[Segment]) -> str:
    out, at = [], 0
    for s in found:
        out += [text[at : s.start], PLACEHOLDERS[s.kind]]
        at = s.end
    return "".join(out) + text[at:]


FOUND = "rec_table string, rec_id bigint, field_name string, kind string, start_pos int, end_pos int"


def _rows(texts: DataFrame) -> DataFrame:
    return texts.where("rec_id is not null and text is not null and text != ''").select(
        F.col("rec_table").alias("__table"), F.col("rec_id").cast("bigint").alias("__id"), F.col("field_name").alias("__field"), F.col("text").alias("__text")
    )


def find(texts: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(rec_table, rec_id, field_name, kind, start_pos, end_pos): every occurrence of personal data.

    texts: rec_table, rec_id, field_name, text; other columns are not read. Offsets count
    characters from 0. Null and empty texts and null ids give nothing; equal rows give their
    occurrences once each row.
    """
    model = fit(s)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder()
        for pdf in batches:
            rows = [
                (t, i, f, x.kind, x.start, x.end)
                for t, i, f, text in zip(pdf["__table"], pdf["__id"], pdf["__field"], pdf["__text"])
                for x in entities(text, finder, model)
            ]
            frame = pd.DataFrame(rows, columns=["rec_table", "rec_id", "field_name", "kind", "start_pos", "end_pos"])
            yield frame.astype({"rec_id": "int64", "start_pos": "int32", "end_pos": "int32"})

    return _rows(texts).mapInPandas(run, FOUND)


def mask(texts: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(rec_table, rec_id, field_name, text): the texts with typed placeholders for what ``find``
    finds; null and empty texts are left out."""
    model = fit(s)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder()
        for pdf in batches:
            texts = [masked(t, entities(t, finder, model)) for t in pdf["__text"]]
            yield pd.DataFrame({"rec_table": pdf["__table"], "rec_id": pdf["__id"].astype("int64"), "field_name": pdf["__field"], "text": texts})

    return _rows(texts).mapInPandas(run, "rec_table string, rec_id bigint, field_name string, text string")


def texts_of(documents: DataFrame, submissions: DataFrame) -> DataFrame:
    """documents.text, submissions.problem and submissions.expected in one form; exact duplicates of
    a submission are taken once."""
    d = documents.select(F.lit("documents").alias("rec_table"), F.col("doc_id").alias("rec_id"), F.lit("text").alias("field_name"), "text")
    s = submissions.select("submission_id", "problem", "expected").distinct()
    fields = F.explode(F.create_map(F.lit("problem"), F.col("problem"), F.lit("expected"), F.col("expected"))).alias("field_name", "text")
    return d.unionByName(s.select(F.lit("submissions").alias("rec_table"), F.col("submission_id").alias("rec_id"), fields))
