"""Main body of web pages (problem 5): minimum-cut labelling of lines.

Each non-blank line is a node. A logistic model of its words and form gives its terminal
capacities, how costly it is to call the line body or furniture; adjacent lines, and lines of
the same markup close by (what is left of DOM siblings in extracted text), are joined by
smoothness edges. The minimum cut of that graph is the labelling. Lines whose own evidence
outweighs all their edges are settled before (this is exact), so that the maximum flow runs
over the doubtful lines alone.

The model is fitted when the operator starts, on the labelled lines below (a few hundred, its
only bound). It is stateless per page: one pass, no shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Smoothness:
    """Edge capacities: neighbours, neighbours across blank lines, same markup (added), same
    markup with one line between, a caption and the line below it (added)."""

    next_line: float = 0.35
    across_blank: float = 0.2
    same_markup: float = 0.9
    sibling: float = 0.4
    caption: float = 1.3


# Labelled lines the model is fitted on. `_` stands for a name.
FURNITURE = """
Home
Contact
About us
FAQ
Log in
Search
News
Careers
Partners
Members
Library
Press room
Events calendar
Publications
Webinars
Training
Topics
Shop
Sitemap
Menu
Open menu
Close menu
Skip to main content
Skip to navigation
Enter search term
In this section
Back to top
Toggle navigation
English | Deutsch | Français
Home | News | About us | Contact | Careers
Home · Library · Guidance · Training
Log in › Members › Webinars
Training Contact Home Publications
Privacy | Terms of use | Accessibility | Sitemap | Imprint
Press room » Home / Gas detection for the pouch cell
About us > Members / How a leak affects storage: lessons from _
Home / Reports / Investigation: the sensor at _ and the valve at _
You are reading an archived page
You may also like
Related reading
Related articles
Most read this week
Popular now
From the archive
More from this section
Recommended for you
0 comments
0 comments · Leave a reply
Be the first to comment
We use cookies to make this site work and to understand how it is used. Accept all / Manage settings
This website sets optional cookies. Choose "Reject" to keep only those that are strictly necessary.
Your privacy matters to us. By continuing to browse you agree to our use of similar technologies.
Before you continue: may we measure your visit? Yes, allow | No, thanks
_ and its 0 partners store and read information on your device. You can change your mind at any time.
Cookie preferences
Accept all cookies
Sign up for the _ weekly digest and receive new findings every Friday.
Follow _ for alerts, summaries and early notice of consultations
Subscribe to our newsletter
Never miss a finding on cell ageing: join 0 readers of our mailing list.
Enjoying this piece? Members read every report from _ in full.
Our free guide explains vent sizing for the weld tab in plain words; leave your details to get it.
Download our free guide today
Book now: hot work workshop, _, 0 May
Register now for the webinar on gas alarms, places are limited
Sponsored: See what _ members think about water supply
Advertisement - continues below
Advertisement
Listen to this article (0 min) or save it to your folder
Read more: How a rupture affects storage: lessons from _
Read also: How a leak affects training: lessons from _
Watch: How a fault affects charging: lessons from _ (video, 0 min)
Support our work: members of _ make this archive possible.
Donate now
Share this report with a colleague: Mail - Post - Link
Share this page: email, print, copy link
Did you find this useful? Rate it from 0 to 0 and tell the _ team why.
Rate this article
Last reviewed 0-0-0 | Document class 0
Last updated 0 May 0
Published 0/0/0 by _
By the _ editorial desk, 0-0-0
By _ staff writer, 0 March 0
Downloaded from the _ archive on 0-0-0
Reprinted under licence 0/0. The views expressed are those of the authors and not of _.
The material published by _ is provided for general information and does not amount to legal or engineering advice.
Figures may not add up because of rounding; _ accepts no liability for use of these data.
To cite this item use the permanent reference 0 of the _ collection.
_ is an independent body funded by its members and by licence fees.
© 0 _. All rights reserved. No part of this page may be reproduced without written permission.
Tags: sensor placement, state of health
Filed under: storage
How an overcharge affects explosion isolation: lessons from _
- How an overcharge affects explosion isolation: lessons from _
0. How hydrogen build-up affects dust housekeeping: lessons from _
- Vent sizing for the weld tab
- Spray dryer and water supply at _ Store
0. Tray liner and alarm thresholds at _ Depot
Roof hatch and sensor placement at _ Yard
Sensor placement for the dust collector - A rise of 0 K per minute was confirmed near the…
How a leak affects storage: lessons from _ - Pressure in the gasket rose to 0 bar before …
Startseite
Über uns
Anmelden
Kontakt
Karriere
Aktuelles
Suche
Schulungen
Leitfäden
Berichte
Presse
Menü öffnen
Zum Inhalt springen
Startseite | Kontakt | Karriere | Berichte
Anmelden > Über uns > Untersuchung: das Modul von _ und das Silo von _ (_)
Datenschutz | Impressum | Nutzungsbedingungen | Barrierefreiheit
Mehr zum Thema
Meistgelesen
Das könnte Sie auch interessieren
0 Kommentare
Diese Seite verwendet Cookies. Alle akzeptieren / Einstellungen
Wir schätzen Ihre Privatsphäre und speichern nur notwendige Daten auf Ihrem Gerät.
Jetzt den Rundbrief von _ bestellen
Lesen Sie auch: Untersuchung: das Ventil von _ und die Pumpe von _ (_)
Anzeige - _ Park stellt aus: Untersuchung: der Sensor von _ und der Behälter von _ (_)
Anzeige
Diesen Beitrag teilen: Mail - Verweis - Druck
Redaktion _, 0-0-0
Abrufdatum 0-0-0, Archivnummer 0
Die Angaben von _ erfolgen ohne Gewähr und ersetzen keine Beratung.
© 0 _. Alle Rechte vorbehalten.
© 0 _. All rights reserved.
- Untersuchung: der Behälter von _ und der Schrank von _ (_)
0. Untersuchung: der Filter von _ und das Ventil von _ (_)
Accueil
Qui sommes-nous
Connexion
Carrières
Recherche
Actualités
Formations
Rapports
Guides
Ouvrir le menu
Aller au contenu
Accueil | Contact | Presse | Formations
Confidentialité | Mentions légales | Accessibilité | Plan du site
Qui sommes-nous > Recherche » Enquête : le capteur de _ et le filtre (_)
À lire aussi
Les plus lus
Sur le même sujet
0 commentaires
Ce site utilise des cookies. Tout accepter / Paramétrer
Nous respectons votre vie privée : gérez vos choix à tout moment.
Abonnez-vous à la lettre de _
Lire aussi : Enquête : le module de _ et le séchoir de _ (_)
Publicité - _ expose : Enquête : la cellule de _ et la barre de _ (_)
Partager cet article : courriel - lien - imprimer
La rédaction de _, le 0-0-0
Consulté le 0-0-0, dossier 0
Les informations publiées par _ n'ont qu'une valeur indicative.
© 0 _. Tous droits réservés.
- Enquête : le silo de _ et la barre de _ (_)
0. Enquête : la pompe de _ et le joint de _ (_)
Inicio
Quiénes somos
Acceder
Empleo
Contacto
Buscar
Noticias
Formación
Guías
Informes
Abrir menú
Saltar al contenido
Inicio | Contacto | Empleo | Informes
Privacidad | Aviso legal | Accesibilidad | Mapa del sitio
Buscar » Formación / Investigación: el sensor de _ y el silo de _ (_)
Te puede interesar
Lo más leído
0 comentarios
Este sitio utiliza cookies. Aceptar todo / Configurar
Nos importa tu privacidad: puedes cambiar tus preferencias cuando quieras.
Suscríbete al boletín de _
Lea también: Investigación: el sensor de _ y el depósito de _ (_)
Publicidad - _ expone: Investigación: la junta de _ y la barra de _ (_)
Comparte este artículo: correo - enlace - imprimir
Redacción de _, 0-0-0
Consultado el 0-0-0, expediente 0
La información de _ tiene carácter orientativo y no sustituye al asesoramiento.
© 0 _. Todos los derechos reservados.
- Investigación: la junta de _ y la barra de _ (_)
0. Investigación: el módulo y el módulo de _ (_)
""".strip().split("\n")

BODY = """
# How a leak affects storage: lessons from _
# Spray dryer and water supply at _ Store
# Untersuchung: das Silo von _ und die Zelle von _ (_)
# Enquête : le silo de _ et le module de _ (_)
# Investigación: el sensor de _ y la junta de _ (_)
## Background
### Limits
## Ablauf
## Recommandations
## Secuencia
Pressure in the gasket rose to 0 bar before the panel opened.
Consent to keep cookies of pressed powder beside the gasket was withdrawn after 0 small fires.
Subscribers to the _ alarm network lost signal for 0 minutes while the annex was without power.
Related failures of the sensor were measured at _ and at _ in 0.
The share of failures linked to a failed sensor fell from 0 % to 0 % over 0 years.
Home storage units with a dust collector showed a pressure wave in 0 of 0 trials.
Contact resistance at the weld tab reached 0 mΩ, which points to static discharge.
The supplier found that guidance on cell ageing had not been read by 0 of the 0 staff.
Members of the brigade followed the smoke to the library of the works and closed the menu of alarms.
A limit of 0 °C is used for the rack; above it the nozzle loses strength.
The valve shall be inspected every 0 days, and records shall be kept for 0 years.
Operators must isolate the tank before work on training of staff starts in the yard.
No one in the hall was hurt, but the fuse holder and 0 units beside it were lost.
On 0 May 0 the cell at _ Yard was taken out of service.
Whether a blocked path or static discharge came first remains open, as the log has a gap of 0 min.
Gas samples from the room held 0 ppm carbon monoxide and 0 % hydrogen by volume.
Tests on 0 samples of the joint gave a median delay of 0 s, with brief scatter.
Because of loose fasteners, the laboratory replaced the line and raised the alarm setting to 0 ppm.
The privacy screen beside the cells was charred over 0 cm and its rights of use were reserved for trials.
Information on the device was read from the recorder after 0 hours.
Members reported that the newsletter rack had caught fire at 0:0 and signed the log.
Readers of the gauge share one table; each column lists the limit and the measured value.
All temperatures are given in degrees Celsius unless stated otherwise.
Numbers in brackets refer to the list of exhibits.
Note: readings below 0 ppm were not recorded.
Figure 0: view of the burnt rack from the north door.
Reading 0: the dryer was normal at 0 °C in the line.
Reading taken at the isolation valve in the control room.
The file also notes: 0 cycles and gives no further detail.
Firmware 0.0.0 logs under cell@rack0 in bay 0, North Yard.
Call 0 0 0 or write to jo@post.example for the full log.
Questions go to _, jo@post.example, until the end of the month.
The owner lives at 0 Alder Ave, Apt 0, _, and the unit was charging in the hallway.
Report no. 0-0-0 lists cell serial QK 0 0 B.
_ Instruments supplied part 0.0.0 for the _ method.
thanks, _ / 0 0 0
Reported by: _; home address 0 Alder Ave, Apt 0, _, 0; tel. 0 0 0
_ signed the hot work permit.
(signed) _
Permit holder: _
Statement of _: the door was already warm.
[0] How a fire affects state of health: lessons from _. A limit of 0 °C is used for the pump, and the paper gives the tests behind it.
- The blanket shall be inspected every 0 days, and records shall be kept for 0 years.
- Check the vent in the chamber for contamination, then sign the sheet.
- Pressure relief panel, sensor placement: 0 days
- Gas sensor, solvent handling: 0 °C
• Isolation valve, cell ageing: 0 bar
* Fuse holder, storage spacing: 0 °C
* Close the valve, wait 0 minutes and call the control room.
0. Open the panel and read the gauge before the pump starts.
0. Isolation of the rack, 0 V, 0 min
| pressure relief panel | emergency response | value |
| --- | --- | --- |
| vent membrane | the plant room, _ | 0 °C, 0 bar |
| rack enclosure | the cage | 0 °C |
Valve: opens the line when the pressure is above the limit.
Busbar: a bar of metal that joins the cells of a module.
0:0 alarm raised, pump off, 0 °C
SKU 0 | price | charger | _
buy charger, price charger, cheap charger, online charger
#cheapcharger #pricecharger #topcharger
Nach 0 Minuten erreichte die Pumpe von _ in der Trocknung eine Temperatur von 0 °C.
Die Prüfung ergab, dass das Ventil von _ seit 0 Tagen nicht gewartet worden war.
Als wahrscheinliche Ursache gilt Feuchtigkeit, doch Metallspäne ist nicht auszuschließen.
Der Bericht empfiehlt, dass die Dichtung alle 0 Tage durch geschultes Personal geprüft wird.
Vor dem Öffnen muss das Modul mindestens 0 Minuten lang spannungsfrei sein.
- Durch Feuchtigkeit fiel der Behälter von _ im Jahr 0 insgesamt 0 Mal aus.
Der Druck stieg auf 0 bar, bevor der Filter von _ nachgab.
Bitte an jo@post.example schreiben.
Après 0 minutes, le capteur de _ a atteint 0 °C dans le local technique.
L'enquête montre que la pompe n'avait pas été contrôlé depuis 0 jours.
La cause probable est la surcharge, mais des copeaux de métal ne peut pas être exclue.
Le rapport demande que le silo soit vérifié tous les 0 jours par une équipe formée.
- On a mesuré 0 ppm de monoxyde de carbone dans la cour.
Merci d'écrire à jo@post.example au plus vite.
Tras 0 minutos, la barra de _ alcanzó 0 °C en la nave norte.
La investigación muestra que la válvula de _ llevaba 0 días sin revisión.
La causa probable es un sensor averiado, aunque no se puede descartar la falta de mantenimiento.
El informe pide que la junta se revise cada 0 días por personal formado.
- Debido a la humedad, el silo de _ falló 0 veces durante el año 0.
Antes de abrir, el armario debe quedar sin tensión durante 0 minutos.
Escriban a jo@post.example cuanto antes.
""".strip().split("\n")

# Subjects that lines of either kind are about; they must carry no evidence.
_SUBJECTS = """sensor placement|water supply|dust housekeeping|cell ageing|vent sizing|solvent handling|charge control|storage
gas detection|alarm thresholds|hot work permits|training|recycling feed|emergency response|state of health|damaged cells
the roof hatch|the spray dryer|the gas sensor|the pouch cell|the weld tab|the tank|the library|a rupture|an overcharge""".replace("\n", "|").split("|")
_TEASERS = (
    "How _ affects _: lessons from _", "- How _ affects _: lessons from _", "- _ for _", "0. _ and _ at _ Depot", "- _ and _ at _ Works", "Never miss _ on _: join 0 readers of our mailing list.",
    "Listen to this article (0 min) or save it to your _ folder", "Enjoying this piece? Members read every _ report in full.", "Watch: _ for _ (video, 0 min)", "Read more: _ and _ at _ Plant",
    "Our guide explains _ for _ in plain words; leave your details to get it.", "_ for _ - A limit of 0 K is used for _ and the…", "To cite this item use the permanent reference 0 of the _ collection.",
    "Reprinted under licence 0/0. The views expressed are those of the authors and not of _.", "Sponsored: See what _ members think about _", "Book now: _ workshop, _, 0 June",
)
_NOTES = (
    "- _, _: 0 days", "* _, _: 0 s", "• _, _: 0 °C", "0. _, _: 0 bar", "- _ _ 0 %", "[0] How _ affects _: lessons from _. The supplier found that _ failed, and the paper lists _.",
    "[0] _ and _ at _ Works. A limit of 0 °C is used for _.", "[0] _ for _. The operator reported _ and no one was hurt.", "I spoke to _ about _ on 0 May.", "_ (licence number: 0-0-0)", "_: _ at _, 0 m from _.",
    "The _ panel held that _, built in 0, lost its seal after 0 cycles, while inspectors from _ measured 0 kPa behind _ and blamed _.",
    "- Whether _ or _ came first remains open, as the log has a gap of 0 min.", "Crews under the _ rule waited 0 minutes, then flooded _ with foam made by _.", "| --- | --- |",
)


def _filled(patterns: tuple[str, ...], each: int = 6) -> list[str]:
    """Each pattern ``each`` times, its places filled with the subjects in turn."""
    out, k = [], 0
    for p in patterns:
        for _ in range(each):
            parts = p.split("_")
            line = parts[0]
            for x in parts[1:]:
                line += _SUBJECTS[k % len(_SUBJECTS)] + x
                k += 1
            out.append(line)
    return out


_WORD = re.compile(r"[^\W\d_]+|\d+")
_BULLET = re.compile(r"[-*•–—·‣▪»>]+\s+|\(?\d{1,3}[.)]\s+|\[\d+\]\s+|\*{2,}\s*")
_END = re.compile(r"[.!?][\"'”’»)\]*\s»]*$")
_FIGURE = re.compile(r"\d\s*(?:%|°C|K\b|ppm|bar|kPa|mΩ|V\b|s\b|min\b|days?\b|h\b|m\b|mm\b|cm\b)")
_RULE = re.compile(r"\s[|·›/»>]\s")
_WRAP = re.compile(r"^(?:[*»>–—\s]+)|(?:[*»\s]+)$")


class _Weights(dict):
    def __missing__(self, key):
        return 0.0


def _tokens(line: str) -> list[str]:
    return ["0" if w[0].isdigit() else w for w in _WORD.findall(line.lower())]


def _shape(line: str, words: int) -> tuple[float, ...]:
    """Features of a line's form; the line is without surrounding blanks."""
    table = line[0] == "|" and line[-1] == "|"
    parts = _RULE.split(line) if not table else []
    menu = len(parts) >= 3 and max(len(p.split()) for p in parts) <= 4
    end, bullet = bool(_END.search(line)), bool(_BULLET.match(line))
    return (
        1.0, line[0] == "#", table, menu, end, bullet, bullet and end, not end and not bullet and words <= 3,
        not end and 4 <= words <= 16, words > 18, bool(_FIGURE.search(line)), line[-1] == "…" or line.endswith("..."),
        len(parts) == 2, line[0] == "©" or "©" in line[:8], ":" in line[-14:] and any(c.isdigit() for c in line[-10:]), "@" in line,
        line[0] == "[" and end, len(line) >= 40 and "://" not in line and len(line.split()) == 1,
    )


_SHAPES = 18


def _evidence(line: str) -> tuple[dict, int, tuple[float, ...]]:
    toks = _tokens(line)
    n = len(toks)
    return {**dict.fromkeys(toks, 1.0), **dict.fromkeys(zip(toks, toks[1:]), 1.0)}, n, _shape(line, n)


def fit(furniture: list[str] = FURNITURE, body: list[str] = BODY, decay: float = 3e-4, steps: int = 500) -> tuple[dict, list[float]]:
    """Weights of words and word pairs, and of the forms: logistic regression by accelerated
    gradient descent, deterministic. The fitting lines are its bound."""
    lines = [(x.replace("_", "Norwell"), 1.0) for x in furniture] + [(x.replace("_", "Norwell"), 0.0) for x in body]
    lines += [(hashlib.sha512(bytes([k])).hexdigest(), 0.0) for k in range(6)]  # data printed among paragraphs
    lines += [(x, 1.0) for x in _filled(_TEASERS)] + [(x, 0.0) for x in _filled(_NOTES)]
    rows = [(_evidence(x), t) for x, t in lines]
    vocab: dict = {}
    for (f, _, _), _ in rows:
        for k in f:
            vocab.setdefault(k, len(vocab))
    x = np.zeros((len(rows), len(vocab) + _SHAPES))
    y = np.array([t for _, t in rows])
    for i, ((f, n, s), _) in enumerate(rows):
        for k in f:
            x[i, vocab[k]] = 2.0 / np.sqrt(max(1, n))
        x[i, len(vocab) :] = s
    w, m, rate = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 4.0 / np.linalg.norm(x, 2) ** 2 * len(rows)
    for t in range(steps):
        look = w + t / (t + 3) * (w - m)
        p = 1 / (1 + np.exp(-x @ look))
        m, w = w, look - rate * (x.T @ (p - y) / len(rows) + decay * look)
    return {k: float(w[j]) * 2.0 for k, j in vocab.items()}, [float(v) for v in w[len(vocab) :]]


def log_odds(line: str, model: tuple[dict, list[float]]) -> float:
    """Log odds that a line (without surrounding blanks) is furniture."""
    words, forms = model
    toks = _tokens(line)
    n = len(toks)
    if not n:
        return 0.0
    get = words.__getitem__
    score = sum(map(get, set(toks))) + sum(map(get, set(zip(toks, toks[1:]))))
    return score / n**0.5 + sum(f * s for f, s in zip(forms, _shape(line, n)) if s)


def minimum_cut(unary: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: source side) of least energy: max(0, u) for a False node of evidence u > 0,
    max(0, -u) for a True node of u < 0, and an edge's capacity where its ends differ."""
    n = len(unary)
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    load, own = [0.0] * n, list(unary)
    for i, j, c in edges:
        near[i].append((j, c))
        near[j].append((i, c))
        load[i] += c
        load[j] += c
    label: list[bool | None] = [None] * n
    todo = deque(i for i in range(n) if abs(own[i]) >= load[i])
    while todo:  # settled: evidence no smaller than all edges to unsettled lines together
        i = todo.popleft()
        if label[i] is not None:
            continue
        label[i] = own[i] > 0
        for j, c in near[i]:
            if label[j] is None:
                own[j] += c if label[i] else -c
                load[j] -= c
                if abs(own[j]) >= load[j]:
                    todo.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if not rest:
        return label
    # maximum flow (shortest augmenting paths) over the unsettled lines
    at = {i: k for k, i in enumerate(rest)}
    source, sink = len(rest), len(rest) + 1
    cap: list[dict[int, float]] = [{} for _ in range(len(rest) + 2)]

    def add(a: int, b: int, c: float, back: float) -> None:
        cap[a][b] = cap[a].get(b, 0.0) + c
        cap[b][a] = cap[b].get(a, 0.0) + back

    for i in rest:
        if own[i] > 0:
            add(source, at[i], own[i], 0.0)
        elif own[i] < 0:
            add(at[i], sink, -own[i], 0.0)
        for j, c in near[i]:
            if j > i and label[j] is None:
                add(at[i], at[j], c, c)
    while True:
        parent = {source: source}
        queue = deque([source])
        while queue and sink not in parent:
            a = queue.popleft()
            for b, c in cap[a].items():
                if c > 1e-9 and b not in parent:
                    parent[b] = a
                    queue.append(b)
        if sink not in parent:
            break
        path, b = [], sink
        while b != source:
            path.append((parent[b], b))
            b = parent[b]
        flow = min(cap[a][b] for a, b in path)
        for a, b in path:
            cap[a][b] -= flow
            cap[b][a] += flow
    for i in rest:
        label[i] = at[i] in parent
    return label


def _markup(line: str) -> str:
    if line[0] == "#":
        return "#"
    if line[0] == "|":
        return "|"
    m = _BULLET.match(line)
    if m:
        return "0" if m.group()[0].isdigit() or m.group()[0] in "([" else m.group()[0]
    if _END.search(line):
        return "."
    return "," if len(line.split()) > 3 else "w"


def _plain(s: str) -> str:
    return " ".join(_tokens(s))


def label_page(text: str, title: str | None, model: tuple[dict, list[float]], known: dict[str, float], s: Smoothness = Smoothness()) -> list[int]:
    """Numbers (from 1) of the non-blank lines of ``text`` that are not main body."""
    lines = [(k, x) for k, raw in enumerate(text.split("\n"), 1) if (x := raw.strip())]
    if not lines:
        return []
    if len(known) > 50_000:  # only a memo of computed scores
        known.clear()
    heading, unary, kind = _plain(title or ""), [], []
    for _, x in lines:
        u = known.get(x)
        if u is None:
            core = _WRAP.sub("", x) if x[0] in "*»>–—" else x
            u = log_odds(core or x, model) if core == x or not core else max(log_odds(x, model), log_odds(core, model))
            known[x] = u
        if x[0] == "#":  # a marked heading is the article's unless its words say otherwise
            u = -6.0 if heading and _plain(x) == heading else min(u, -2.0) if u < 2 else u
        unary.append(u)
        kind.append(_markup(x))
    edges = []
    for i in range(1, len(lines)):
        c = s.next_line if lines[i][0] == lines[i - 1][0] + 1 else s.across_blank
        if kind[i] == kind[i - 1] and kind[i] not in "#.":
            c += s.same_markup
        elif kind[i - 1] in "w," and kind[i] in "-*•0,–" and unary[i - 1] > 1.5:  # a caption and its list
            c += s.caption
        edges.append((i - 1, i, c))
        if i > 1 and kind[i] == kind[i - 2] and kind[i] not in "#.":
            edges.append((i - 2, i, s.sibling))
    return [k for (k, _), out in zip(lines, minimum_cut(unary, edges)) if out]


def _labeller(model: tuple[dict, list[float]], s: Smoothness):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready, known = (_Weights(model[0]), model[1]), {}
        for pdf in batches:
            docs, numbers = [], []
            for doc, title, text in zip(pdf["__doc"], pdf["__title"], pdf["__text"]):
                found = label_page(text, title, ready, known, s)
                numbers += found
                docs += [doc] * len(found)
            yield pd.DataFrame({"doc_id": pd.Series(docs, dtype="int64"), "line_no": pd.Series(numbers, dtype="int32")})

    return run


def furniture_lines(documents: DataFrame, s: Smoothness = Smoothness(), extractor: str = "html") -> DataFrame:
    """(doc_id, line_no) of the non-blank lines of web pages that are not main body.

    documents: doc_id, title, text, extractor; other columns are not read. Rows of another or no
    extractor, and null, empty and blank texts, give nothing; a null title is no evidence. Equal
    rows give their lines once for each row; a page is read whole, however long.
    """
    pages = documents.where((F.col("extractor") == extractor) & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    pages = pages.select(F.col("doc_id").cast("bigint").alias("__doc"), F.col("title").alias("__title"), F.col("text").alias("__text"))
    return pages.mapInPandas(_labeller(fit(), s), "doc_id bigint, line_no int")


def main_text(documents: DataFrame, s: Smoothness = Smoothness(), extractor: str = "html") -> DataFrame:
    """(doc_id, text): each web page without its furniture; blank lines stay. Same cases as
    ``furniture_lines``; pages of null text are left out."""
    model = fit()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready, known = (_Weights(model[0]), model[1]), {}
        for pdf in batches:
            out = []
            for title, text in zip(pdf["__title"], pdf["__text"]):
                gone = set(label_page(text, title, ready, known, s))
                out.append("\n".join(x for k, x in enumerate(text.split("\n"), 1) if k not in gone))
            yield pd.DataFrame({"doc_id": pdf["__doc"].astype("int64"), "text": out})

    pages = documents.where((F.col("extractor") == extractor) & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    pages = pages.select(F.col("doc_id").cast("bigint").alias("__doc"), F.col("title").alias("__title"), F.col("text").alias("__text"))
    return pages.mapInPandas(run, "doc_id bigint, text string")
