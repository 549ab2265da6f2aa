import itertools
import random

from tessera.llm import main_body as M

PAGE = """Home | News | About us | Contact | Careers
We use cookies to make this site work. Accept all / Manage settings
# Pump failure at the north yard
By the Norwell editorial desk, 2020-01-02
Pressure in the pump rose to 22 bar before the panel opened. No one was hurt, but the cell was lost.
Read more: How a leak affects storage: lessons from Norwell
## Findings
The share of failures linked to cookies of pressed powder fell from 31 % to 26 % over 4 years.
- Gas sensor, solvent handling: 40 days
- Roof hatch, cell ageing: 12 °C
You may also like
- How an overcharge affects training: lessons from Norwell
- Vent sizing for the weld tab
3 comments
Privacy | Terms of use | Accessibility | Sitemap"""


def energy(u, edges, x):
    return sum(max(0, -a) if t else max(0, a) for a, t in zip(u, x)) + sum(c for i, j, c in edges if x[i] != x[j])


def test_minimum_cut_is_least_energy():
    r = random.Random(1)
    for _ in range(60):
        n = r.randint(1, 9)
        u = [r.uniform(-2, 2) for _ in range(n)]
        edges = [(i, j, r.uniform(0, 2)) for i, j in itertools.combinations(range(n), 2) if r.random() < 0.4]
        best = min(energy(u, edges, x) for x in itertools.product([False, True], repeat=n))
        assert abs(energy(u, edges, M.minimum_cut(u, edges)) - best) < 1e-6
    assert M.minimum_cut([], []) == []


def rows(spark, data):
    return spark.createDataFrame([(*r, 1) for r in data], "doc_id bigint, title string, text string, extractor string, line_no int")


def test_page(spark):
    got = sorted(r.line_no for r in M.furniture_lines(rows(spark, [(1, "Pump failure at the north yard", PAGE, "html")])).collect())
    assert got == [1, 2, 4, 6, 11, 12, 13, 14, 15]
    text = M.main_text(rows(spark, [(1, None, PAGE, "html")])).first().text
    assert text.startswith("# Pump failure") and "cookies of pressed powder" in text and "comments" not in text


def test_cases(spark):
    data = [(1, None, None, "html"), (2, None, "", "html"), (3, None, " \n\t\n", "html"), (4, None, PAGE, "pdf"), (5, None, PAGE, None), (None, None, PAGE, "html")]
    assert M.furniture_lines(rows(spark, data)).count() == 0
    assert M.furniture_lines(rows(spark, [])).count() == 0
    twice = M.furniture_lines(rows(spark, [(1, None, PAGE, "html")] * 2)).collect()
    assert len(twice) == 18
    long_ = "Pressure in the pump rose to 22 bar before the panel opened. " * 5000
    assert M.furniture_lines(rows(spark, [(1, None, long_ + "\n" + "x" * 100_000 + ".", "html")])).count() <= 1


def test_held_out_lines():
    model = M.fit()
    w = (M._Weights(model[0]), model[1])
    furniture = ["Sign up for our weekly newsletter", "Share this page", "Terms of use | Privacy | Contact", "© 2021 Example Ltd. All rights reserved.", "12 comments", "Accept all cookies", "Kontakt | Impressum | Datenschutz"]
    body = ["The crew measured 40 bar at the outlet of the tank.", "The fitter closed the valve and left the hall before the alarm.", "| pump | north hall | 3 bar |", "- Valve, pump house: 12 bar"]
    assert all(M.log_odds(x, w) > 0 for x in furniture) and all(M.log_odds(x, w) < 0 for x in body)
