from pyspark.sql import functions as F

from tessera.operators import asking, collect
from tessera.sources import sinks

A = '<a href="{0}">{1}</a>'


def test_crawl(spark):
    site = {
        "https://acme.example": A.format("https://acme.example/about/", "About us") + A.format("https://acme.example/a/b/c", "Deep") + A.format("https://other.example/x", "Other"),
        "https://acme.example/about": A.format("https://shop.acme.example/legal", "Legal notice") + A.format("https://acme.example", "Home"),
    }
    pages = spark.createDataFrame(list(site.items()), "url string, html string")
    start = spark.createDataFrame([("acme.example", "https://acme.example/")], "site string, url string")
    got = {(r.url, r.step) for r in collect.crawl(start, pages, ("about", "legal"), 1, steps=2).collect()}
    assert got == {("https://acme.example", 0), ("https://acme.example/about", 1), ("https://shop.acme.example/legal", 2)}


def test_feed_and_json(spark):
    long_ = "Acme made a pump. " * 20
    xml = "<rss>" + "".join(f"<item><title>T{i} {'Acme' if i else 'None'}</title><link>http://x/{i}</link><pubDate>Mon, 5 Feb 2024 10:00:00 +0000</pubDate><description><![CDATA[{long_ if i else 'short'}]]></description></item>" for i in range(4)) + "</rss>"
    got = collect.feed_items(spark.createDataFrame([("f", xml)], "feed string, xml string"), "acme", take=2).collect()
    assert [r.link for r in got] == ["http://x/1", "http://x/2"] and str(got[0].published.date()) == "2024-02-05"
    raw = spark.createDataFrame([("s", '{"data": {"items": [{"body": "%s", "h": ""}, {"text": "acme"}]}}' % long_)], "source string, json string")
    rows = collect.json_items(raw, "data.items", {"title": ("h", "t"), "text": ("text", "body")}, "ACME").collect()
    assert len(rows) == 1 and rows[0].title is None and rows[0].text == long_


def test_names_and_register(spark):
    t = spark.createDataFrame([("a", 1, "We sell pumps. Acme Works Ltd is registered in Norwick."), ("a", 2, "Call us. Acme Works Ltd, company number 12345, trading as Acme.")], "site string, page_no int, text string")
    names = collect.declared_names(t).collect()
    assert [(r.name, r.sentence.startswith("Acme Works Ltd is")) for r in names] == [("Acme Works Ltd", True)]
    wanted = spark.createDataFrame([("a", "ACME works limited", True), ("a", "Acme", False)], "site string, name string, declared boolean")
    cand = spark.createDataFrame([("Acme Works Ltd.", "k1", "", "12345"), ("Acme Inc", "k2", "ZZ1", "9"), ("Other", "k3", "", "1")], "name string, key string, postcode string, number string")
    got = {(r.key, r.corroborated) for r in collect.register_matches(wanted, cand, t).collect()}
    assert got == {("k1", True), ("k2", False)}
    assert {r.key for r in collect.register_matches(wanted, cand, t, rejected=("k1",)).collect()} == {"k2"}


def test_fields(spark):
    p = spark.createDataFrame([("c1", "Name: ACME\nSeat: Norwick"), ("c2", "name: ACME\nSeat: Elm")], "chunk_id string, text string")
    labels = spark.createDataFrame([("q", "Seat", 1), ("q", "Name", 2)], "question_id string, label string, place int")
    assert asking.answer_from_fields(asking.read_fields(p, labels), most=1).first().answer == "Seat: Norwick and 1 more. Name: ACME."


def test_ask(spark):
    ev = spark.createDataFrame([("q1", 1, "s", 5, "keyword", 0.5, "k", "Widget cells vent at 80 °C when the relief valve is shut by hand.")], "question_id string, rank int, source_id string, authority int, retrievers string, score double, chunk_id string, text string")
    q = spark.createDataFrame([("q1", "At what heat do widget cells vent?"), ("q2", " "), ("q3", "vent?"), ("q4", "Where do zeppelins land at night?")], "question_id string, question string")
    src = spark.createDataFrame([("s", "T", 5, True)], "source_id string, title string, authority int, mirrored boolean")
    got = {r.question_id: r for r in asking.ask(q, ev, src).collect()}
    assert {k: r.status for k, r in got.items()} == {"q1": "answered", "q2": "error", "q3": "ambiguous", "q4": "insufficient_evidence"}
    assert got["q1"].answer.endswith("[1]") and got["q1"].confidence in ("high", "medium") and got["q4"].answer is None
    mine = spark.createDataFrame([("q1", "Widget cells vent at 300 °C when the valve is shut [1].")], "question_id string, answer string")
    assert asking.ask(q.where("question_id = 'q1'"), ev, src, drafts=mine).first().status == "unsupported"


def test_sinks(spark, tmp_path):
    raw = spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"a"),), (bytearray(b"b"),)], "content binary")
    folder = str(tmp_path / "cache")
    sinks.cache_raw(raw, folder)
    sinks.cache_raw(raw.union(spark.createDataFrame([(bytearray(b"c"),)], "content binary")), folder)
    assert spark.read.parquet(folder).count() == 3
    sinks.replace_table(raw, str(tmp_path / "t"), "v1")
    sinks.replace_table(raw.limit(1), str(tmp_path / "t"), "v2")
    assert sinks.current_table(spark, str(tmp_path / "t")).count() == 1
    (tmp_path / "s.json").write_text('{"suite": "x", "questions": [{"id": "1", "question": "Q", "graders": [{"kind": "judge"}]}]}')
    assert sinks.read_suites(spark, [str(tmp_path / "s.json"), str(tmp_path / "none.json")]).first().suite == "x"
    p = spark.createDataFrame([("s1", 0, "c", "", "t")], "source_id string, ordinal int, chunk_id string, section string, text string")
    sinks.export_corpus(p, spark.createDataFrame([("s1",), ("s2",)], "source_id string"), str(tmp_path / "corpus"))
    assert spark.read.json(str(tmp_path / "corpus" / "sources")).count() == 2
    assert [r.source_id for r in spark.read.json(str(tmp_path / "corpus" / "passages")).collect()] == ["s1"]


def test_links_are_resolved(spark):
    html = """<a href="/a/">A</a> <a class=x href='b?x=1#t'>B <b>b</b></a> <a href="../c/./d">C</a> <a href=//y.example/e>E</a> <a href="mailto:x@y">M</a> <a href="#t">T</a> <a href="https://z.example">Z</a> <a href="f?a=1&amp;b=2">F</a>"""
    got = {(r.target, r.label) for r in collect.links(spark.createDataFrame([("https://x.example/p/q.html", html)], "url string, html string")).collect()}
    assert got == {("https://x.example/a", "A"), ("https://x.example/p/b?x=1", "B b"), ("https://x.example/c/d", "C"), ("https://y.example/e", "E"), ("https://z.example", "Z"), ("https://x.example/p/f?a=1&b=2", "F")}


def test_contact_facts_and_probes(spark):
    rows = [("s", 1, "u1", "Call us: 020 7946 0018 today, and ask for the person on duty there. Batch 123 456 7890 is late. Write to A@x.example or b@x.example/logo.png", '<a href="tel:+44-1">c</a>'), ("s", 2, "u2", "+44 20 7946 0999 and tel 020 7946 0018; a@x.example pic@x.png", None), ("t", 1, "u3", None, None)]
    pages = spark.createDataFrame(rows, "site string, page_no int, url string, text string, html string")
    got = {(r.kind, r.value, r.found_on) for r in collect.contact_facts(pages).collect()}
    assert got == {("email", "a@x.example", "u1"), ("email", "b@x.example", "u1"), ("phone", "020 7946 0018", "u1"), ("phone", "+44 20 7946 0999", "u2"), ("phone", "+44-1", "u1")}
    assert collect.contact_facts(pages, most=1).count() == 2
    probes = [("s", "/robots.txt", "u/robots.txt", "User-agent: *\nSitemap: https://s/map.xml\n"), ("s", "/sitemap.xml", "u/sitemap.xml", None), ("s", "/llms.txt", "u/llms.txt", "<!doctype html><html>"), ("t", "/sitemap.xml", "v", None)]
    got = {(r.site, r.probe): (r.present, r.uri) for r in collect.probe_facts(spark.createDataFrame(probes, "site string, probe string, uri string, body string")).collect()}
    assert got == {("s", "/robots.txt"): (True, "u/robots.txt"), ("s", "/sitemap.xml"): (True, "https://s/map.xml"), ("s", "/llms.txt"): (False, None), ("t", "/sitemap.xml"): (False, None)}


def test_records_are_rendered(spark):
    js = '{"hits": [{"name": "Acme", "address": {"street": "Mill Lane", "tags": ["x", {"k": "y"}], "secret": "z"}}], "n": 0}'
    df = spark.createDataFrame([(js, "Name :  Acme   Ltd\nNo: 12", "<li>now: <b>Jo</b> in 2001</li><li>gone: Ed in 1999</li>")], "j string, t string, m string")
    keep = [{"label": "Name", "path": "hits.0.name"}, {"label": "Address", "path": "hits.0.address", "skip": ["secret"]}, {"label": "None", "path": "hits.4.name"}, {"label": "N", "path": "n"}]
    assert df.select(collect.render_json(F.col("j"), keep).alias("x")).first().x == "Name: Acme\nAddress: Mill Lane, x, y\nN: 0"
    rec = {"label": "Officer", "split": "<li>", "keep_if": "now|gone", "drop_if": "gone", "value": r"<b>(.*?)</b> in (\d+)", "groups": 2, "none": "nobody"}
    page = collect.render_page(F.col("t"), F.col("m"), [{"label": "Name", "pattern": r"Name :(.*?)\n"}, {"label": "Tax", "pattern": r"Tax: (\d+)"}], rec)
    assert df.select(page.alias("x")).first().x == "Name: Acme Ltd\nOfficer: Jo, 2001"
    gone = collect.render_page(F.col("t"), F.col("m"), [], {**rec, "keep_if": "never"})
    assert df.select(gone.alias("x")).first().x == "Officer: nobody"
    assert collect.fill("https://x/{q_q}?n={n}", {"q": "a b&c", "n": "1"}) == "https://x/a%20b%26c?n=1"
    try:
        collect.fill("{nobody}", {})
        raise AssertionError
    except ValueError:
        pass


def test_feeds_are_unwrapped_and_releases_told_apart(spark):
    item = "<item><title>Acme {n}</title><link>https://agg.example/r?u=https%3A%2F%2F{h}%2Fa</link><description>{d}</description></item>"
    xml = "<rss>" + item.format(n=1, h="news.example", d="Acme sold pumps. " * 20) + item.format(n=2, h="wire.example", d="Acme sold more pumps. " * 20) + item.format(n=3, h="news.example", d="(PRESS RELEASE) Acme pumps. " * 20) + "</rss>"
    rows = collect.feed_items(spark.createDataFrame([("f", xml)], "feed string, xml string"), "acme", unwrap="u", wires=("wire.example",), markers=("press release",)).collect()
    assert [(r.link, r.source_type) for r in rows] == [("https://news.example/a", "press"), ("https://wire.example/a", "self_published"), ("https://news.example/a", "self_published")]


def test_collectors_run_registers_last(spark):
    cols = "uri string, title string, text string, publisher string, published_at string, source_type string"
    order = []

    def site(c, params, own):
        order.append((c["id"], own is None))
        return spark.createDataFrame([("u", "T", f"About {params['name']}", "p", None, "self_published")], cols)

    def reg(c, params, own):
        order.append((c["id"], own.count()))
        return spark.createDataFrame([("r", "R", own.first().text, "p", None, "official_record")], cols)

    got = collect.run_collectors([{"id": "reg", "kind": "register"}, {"id": "web", "kind": "site"}], {"site": site, "register": reg}, {"name": "Acme"}).collect()
    assert order == [("web", True), ("reg", 1)] and {(r.collector, r.text) for r in got} == {("web", "About Acme"), ("reg", "About Acme")}
    try:
        collect.run_collectors([{"id": "x", "kind": "what"}], {"site": site}, {})
        raise AssertionError
    except ValueError:
        pass
