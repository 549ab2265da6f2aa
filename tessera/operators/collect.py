"""Finding sources: crawling a site best page first, reading feeds and JSON item lists, names a site
declares, and matching a register's candidates. Pages come as a table (url, html), so that any
fetcher, or a folder of files, can stand behind it."""

from __future__ import annotations

import json
import re
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions import text as T
from tessera.session import materialise

# Words of legal forms, and cues of a sentence that declares a registered name.
LEGAL_FORMS = ("ltd", "limited", "inc", "llc", "gmbh", "ag", "plc", "sa", "sarl", "bv", "oy", "ab", "co", "corp", "company")
DECLARES = r"(?i)\b(registered (?:in|as|office|company)|trading as|company number|incorporated)\b"
NAME = r"\b((?:[A-Z][\w&'’-]+\s+){0,4}(?:Ltd|Limited|Inc|LLC|GmbH|AG|PLC|plc|SA|BV|Oy|AB)\b\.?)"


def host(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:www\.)?([^/:?#]+)", 1)


def same_site(url: Column, site: Column) -> Column:
    """Whether a url's host is the site or below it."""
    return (host(url) == site) | host(url).endswith(F.concat(F.lit("."), site))


def resolve(base: Column, href: Column) -> Column:
    """The absolute form of a link on the page ``base``, without fragment and closing slash; null for what
    leads to no page (mail, telephone, scripts, a place on the page itself)."""
    site = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)?", 1)
    there = F.trim(F.regexp_replace(href, "#.*$", ""))
    folder = F.regexp_replace(path, "[^/]*$", "")
    whole = F.when(there.startswith("//"), F.concat(F.regexp_extract(base, "^([^:]+:)", 1), there)).when(there.startswith("/"), F.concat(site, there)).when(there.startswith("?"), F.concat(site, path, there)).otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), there))
    full = F.when(there.rlike(r"^(?i)https?://"), there).otherwise(whole)
    host_, rest, query = F.regexp_extract(full, r"^([^:]+://[^/?]+)", 1), F.regexp_extract(full, r"^[^:]+://[^/?]+([^?]*)", 1), F.regexp_extract(full, r"(\?.*)$", 1)
    step = lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1))).when((p == ".") | (p == ""), acc).otherwise(F.concat(acc, F.array(p)))
    parts = F.aggregate(F.split(rest, "/"), F.array().cast("array<string>"), step)
    tidy = F.concat(host_, F.when(F.size(parts) > 0, F.concat(F.lit("/"), F.array_join(parts, "/"))).otherwise(""), query)
    return F.when((there != "") & ~there.rlike(r"^(?i)(?!https?:)[a-z][a-z0-9+.-]*:"), tidy)


def links(pages: DataFrame) -> DataFrame:
    """(url, target, label): links of pages, relative ones resolved, in any kind of quotes."""
    pattern = F.lit(r"""(?is)<a\s[^>]*?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))[^>]*>(.*?)</a>""")
    group = lambda n: F.regexp_extract_all("html", pattern, F.lit(n))
    each = F.arrays_zip(group(1).alias("a"), group(2).alias("b"), group(3).alias("c"), group(4).alias("l"))
    rows = pages.select("url", F.explode(each).alias("p"))
    href = F.replace(F.concat("p.a", "p.b", "p.c"), F.lit("&amp;"), F.lit("&"))
    return rows.select("url", resolve(F.col("url"), href).alias("target"), T.strip_html(F.col("p.l")).alias("label")).where("target is not null").distinct()


# What a telephone number looks like, and what must stand before one that has no plus.
PHONE = r"(?<![\w/.-])(?:\+\d{1,3}[\s.-]?)?(?:\(\d{2,4}\)[\s.-]?)?\d{2,4}[\s.-]\d{3,4}[\s.-]\d{3,4}(?![\w/.-])"
PHONE_CUE = r"\b(?:phone|tel|telephone|call|ring|fax|helpline|hotline|contact us)\b|☎|📞"
TEL_LINK = r"""(?i)href=["']tel:([^"']+)["']"""


def contact_facts(pages: DataFrame, most: int = 10) -> DataFrame:
    """(site, kind, value, found_on): e-mail addresses and telephone numbers of each site, the first
    ``most`` of a kind in page order, each with the page it is first found on.

    pages: site, page_no, url, text, html (may be null). A run of digits is a number only with a plus
    or where a word for telephones stands in the 40 characters before; tel: links count as they are."""
    text = F.coalesce("text", F.lit(""))
    mails = F.transform(F.regexp_extract_all(text, F.lit(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"), F.lit(0)), F.lower)
    mails = F.filter(mails, lambda m: ~m.rlike(r"\.(png|jpe?g|gif|svg|webp)$"))
    # every match is taken with what stands before it, so that its cue can be seen
    shown = F.regexp_extract_all(text, F.lit(rf"(?s)(.*?)({PHONE})"), F.lit(1))
    found = F.regexp_extract_all(text, F.lit(rf"(?s)(.*?)({PHONE})"), F.lit(2))
    digits = lambda v: F.regexp_replace(v, r"\D", "")
    ok = lambda before, v: F.length(digits(v)).between(9, 15) & ~digits(v).rlike(r"^(19|20)\d{6,}$") & (v.startswith("+") | F.lower(F.right(before, F.lit(40))).rlike(PHONE_CUE))
    at = lambda xs, i: F.coalesce(F.get(xs, i), F.lit(""))
    behind = F.transform(shown, lambda b, i: F.concat(at(found, i - 3), at(shown, i - 2), at(found, i - 2), at(shown, i - 1), at(found, i - 1), b))
    phones = F.filter(F.zip_with(behind, found, lambda b, v: F.when(ok(b, F.trim(v)), F.trim(v))), lambda v: v.isNotNull())
    dialled = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(TEL_LINK), F.lit(1))
    item = lambda kind, late, xs: F.transform(xs, lambda v, i: F.struct(F.lit(kind).alias("kind"), F.lit(late).alias("late"), i.alias("at"), v.alias("value")))
    each = pages.select("site", "page_no", "url", F.explode(F.concat(item("email", 0, mails), item("phone", 0, phones), item("phone", 1, dialled))).alias("x"))
    first = each.groupBy("site", F.col("x.kind").alias("kind"), F.col("x.value").alias("value")).agg(F.min(F.struct("x.late", "page_no", "x.at", "url")).alias("f"))
    own = W.partitionBy("site", "kind").orderBy("f", "value")
    return first.withColumn("n", F.row_number().over(own)).where(F.col("n") <= most).select("site", "kind", "value", F.col("f.url").alias("found_on"))


def probe_facts(answers: DataFrame) -> DataFrame:
    """(site, probe, present, detail, uri): files a site is asked for (site, probe, uri, body; body null
    where it was not served). An HTML page in the place of a file is none; a sitemap is also where the
    site's robots.txt says it is."""
    masked = F.contains(F.lower(F.left("body", F.lit(500))), F.lit("<html")) & ~F.col("probe").rlike(r"(\.html|/)$")
    rows = answers.withColumn("ok", F.col("body").isNotNull() & ~F.coalesce(masked, F.lit(False)))
    told = F.regexp_extract_all("body", F.lit(r"(?im)^[ \t]*sitemap:[ \t]*(\S+)"), F.lit(1))
    maps = rows.where(F.col("ok") & F.col("probe").endswith("robots.txt")).groupBy("site").agg(F.max(told).alias("maps"))
    rows = rows.join(maps, "site", "left").withColumn("declared", ~F.col("ok") & F.col("probe").endswith("sitemap.xml") & (F.coalesce(F.size("maps"), F.lit(0)) > 0))
    detail = (
        F.when(F.col("declared"), F.concat(F.lit("declared in robots.txt ("), F.size("maps").cast("string"), F.lit(" listed)"))).when(F.col("ok"), F.concat(F.size(F.split(F.regexp_replace("body", r"\n$", ""), "\n", -1)).cast("string"), F.lit(" lines")))
        .when(F.col("body").isNull(), "not served").otherwise("served an HTML page, not the file")
    )
    return rows.select("site", "probe", (F.col("ok") | F.col("declared")).alias("present"), detail.alias("detail"), F.when(F.col("declared"), F.get("maps", F.lit(0))).when(F.col("ok"), F.col("uri")).alias("uri"))


def dig(column: Column, path: str) -> Column:
    """What a dotted path (``hits.0.name``) leads to in a JSON text, as text; null where it leads nowhere."""
    return F.get_json_object(column, "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split(".") if p))


def _flattened(values: pd.Series, skips: pd.Series) -> pd.Series:
    def flat(x, skip: frozenset) -> str:
        if isinstance(x, dict):
            return ", ".join(s for k, v in x.items() if k not in skip and (s := flat(v, skip)))
        if isinstance(x, list):
            return ", ".join(s for v in x if (s := flat(v, frozenset())))
        return "" if x is None else str(x).strip()

    def one(text: str | None, skip: str) -> str:
        if text is None:
            return ""
        try:
            return flat(json.loads(text), frozenset(skip.split("\x1f")))
        except ValueError:
            return text.strip()  # a scalar that was a string comes without its quotes

    return pd.Series([one(v, s) for v, s in zip(values, skips)], dtype=object)


def flat(column: Column, skip: tuple[str, ...] = ()) -> Column:
    """The values of a JSON text of any depth, joined by commas, without those under the keys ``skip``."""
    return F.pandas_udf(_flattened, "string")(column, F.lit("\x1f".join(skip)))


def fill(template: str, params: dict[str, str]) -> str:
    """``{name}`` of a template by its parameter and ``{name_q}`` by its quoted form for a url; a parameter
    that is not given is an error."""
    values = {**params, **{f"{k}_q": quote(str(v)) for k, v in params.items()}}

    def one(m: re.Match) -> str:
        if m[1] not in values:
            raise ValueError(f"template {template!r} needs the parameter {m[1]!r}")
        return str(values[m[1]])

    return re.sub(r"\{(\w+)\}", one, template)


def render_json(column: Column, keep: list[dict]) -> Column:
    """``Label: value`` lines of a JSON record: of each entry (label, path, skip) what its path holds."""
    lines = [F.when(F.length(v) > 0, F.concat(F.lit(f"{k['label']}: "), v)) for k in keep for v in [flat(dig(column, k["path"]), tuple(k.get("skip", ())))]]
    return F.array_join(F.array_compact(F.array(*lines)), "\n")


def render_page(text: Column, markup: Column, fields: list[dict], records: dict | None = None) -> Column:
    """``Label: value`` lines of a register's page: single values (label, pattern with one group) from its
    text, and of repeated blocks of its markup (label, split, keep_if, drop_if, value, groups, none) those
    that are kept, each reduced to the groups of ``value``."""
    plain = F.regexp_replace(text, r"[ \t]+", " ")
    tidy = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    lines = [F.when(F.rlike(plain, F.lit("(?s)" + f["pattern"])), F.concat(F.lit(f"{f['label']}: "), tidy(F.regexp_extract(plain, "(?s)" + f["pattern"], 1)))) for f in fields]
    out = F.array_compact(F.array(*lines)) if lines else F.array().cast("array<string>")
    if records:
        r = records
        kept = F.filter(F.split(markup, r["split"], -1), lambda b: b.rlike(r["keep_if"]) & (~b.rlike(r["drop_if"]) if r.get("drop_if") else F.lit(True)) & b.rlike("(?s)" + r["value"]))
        groups = lambda b: F.filter(F.array(*[T.strip_html(F.regexp_extract(b, "(?s)" + r["value"], n)) for n in range(1, r.get("groups", 1) + 1)]), lambda g: g != "")
        blocks = F.transform(kept, lambda b: F.concat(F.lit(f"{r['label']}: "), F.array_join(groups(b), ", ")))
        none = F.array(F.lit(f"{r['label']}: {r['none']}")) if r.get("none") else F.array().cast("array<string>")
        out = F.concat(out, F.when(F.size(blocks) > 0, blocks).otherwise(none))
    return F.array_join(out, "\n")


DOCUMENTS = ("collector", "uri", "title", "text", "publisher", "published_at", "source_type")


def run_collectors(collectors: list[dict], read: dict, params: dict[str, str]) -> DataFrame:
    """(collector, uri, title, text, publisher, published_at, source_type) of all collectors, in their order.

    A collector is (id, kind, source_type, ...); ``read`` gives for each kind the function that collects
    it: (collector, params, None) -> documents. Those of kind ``register`` run last and are given what
    the site's own pages say (documents of source_type ``self_published``), which corroborates them.
    An unknown kind is an error before anything is read."""
    for c in collectors:
        if c.get("kind") not in read:
            raise ValueError(f"collector {c.get('id')!r} has the unknown kind {c.get('kind')!r}")
    out: DataFrame | None = None
    for last in (False, True):
        own = materialise(out.where("source_type = 'self_published'"), "own-pages") if last and out is not None and any(c["kind"] == "register" for c in collectors) else None
        for c in collectors:
            if (c["kind"] == "register") == last:
                docs = read[c["kind"]](c, params, own).select(F.lit(c["id"]).alias("collector"), *[x for x in DOCUMENTS[1:]])
                out = docs if out is None else out.unionByName(docs)
    if out is None:
        raise ValueError("no collectors")
    return out




def crawl(start: DataFrame, pages: DataFrame, preferred: tuple[str, ...], budget: int, steps: int = 5) -> DataFrame:
    """(site, url, priority, step): pages reached from each site's start (site, url), the best ``budget``
    of each step and site: priority is the path's depth less three for each preferred word in url
    or label, least first. A step is a join of the frontier with the links; what was seen is taken out."""
    edges = materialise(links(pages), "links")
    depth = lambda u: F.size(F.filter(F.split(F.regexp_replace(u, r"^[a-z]+://[^/]+", ""), "/"), lambda p: p != ""))
    hits = lambda u, label: sum((F.contains(F.lower(F.concat_ws(" ", u, label)), F.lit(w)).cast("int") for w in preferred), F.lit(0))
    seen = start.select("site", F.regexp_replace("url", "/$", "").alias("url"), F.lit(0).alias("priority"), F.lit(0).alias("step"))
    frontier = seen
    for step in range(1, steps + 1):
        nxt = frontier.select("site", "url").join(edges, "url").where(same_site(F.col("target"), F.col("site")))
        nxt = nxt.select("site", F.col("target").alias("url"), (depth(F.col("target")) - 3 * hits(F.col("target"), F.col("label"))).alias("priority")).groupBy("site", "url").agg(F.min("priority").alias("priority"))
        nxt = nxt.join(seen.select("site", "url"), ["site", "url"], "left_anti")
        best = nxt.groupBy("site").agg(F.slice(F.array_sort(F.collect_list(F.struct("priority", "url"))), 1, budget).alias("b")).select("site", F.explode("b").alias("b"))
        frontier = materialise(best.select("site", "b.url", "b.priority", F.lit(step).alias("step")), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def feed_items(feeds: DataFrame, mention: str, least: int = 200, take: int = 20, unwrap: str | None = None, wires: tuple[str, ...] = (), markers: tuple[str, ...] = ()) -> DataFrame:
    """(feed, link, title, published, text, source_type): items of RSS documents (feed, xml) that mention a
    name and have ``least`` characters of text, the first ``take`` of each feed in order. ``unwrap`` is the
    parameter that holds the real address; an item of a wire's host, or with one of the ``markers`` of a
    release, is the subject's own word (self_published), any other press."""
    items = feeds.select("feed", F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?is)<item\b[^>]*>(.*?)</item>"), F.lit(1))).alias("pos", "x"))
    tag = lambda n: T.strip_html(F.regexp_replace(F.regexp_extract("x", rf"(?is)<{n}\b[^>]*>(.*?)</{n}>", 1), r"(?s)^\s*<!\[CDATA\[|\]\]>\s*$", ""))
    rows = items.select("feed", "pos", tag("link").alias("link"), tag("title").alias("title"), F.try_to_timestamp(F.regexp_replace(tag("pubDate"), r"^\w+,\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z")).alias("published"), tag("description").alias("text"))
    if unwrap:  # the address an aggregator's link holds
        inner = F.url_decode(F.regexp_extract("link", rf"[?&]{unwrap}=([^&#]*)", 1))
        rows = rows.withColumn("link", F.coalesce(F.nullif(inner, F.lit("")), F.col("link")))
    said = F.concat_ws("\n", "link", "title", "text")
    own = host(F.col("link")).isin(list(wires)) | (said.rlike("(?i)" + "|".join(f"(?:{m})" for m in markers)) if markers else F.lit(False))
    rows = rows.withColumn("source_type", F.when(own, "self_published").otherwise("press"))
    rows = rows.where(F.contains(F.lower(F.concat_ws(" ", "title", "text")), F.lit(mention.lower())) & (F.length("text") >= least))
    first = W.partitionBy("feed").orderBy("pos")
    kept = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= take)
    return kept.select("feed", "link", "title", "published", "text", "source_type")


def json_items(raw: DataFrame, path: str, fields: dict[str, tuple[str, ...]], mention: str, least: int = 120, take: int = 20) -> DataFrame:
    """(source, <fields>): items of JSON lists (source, json) at a dotted path; each field is the first
    of its paths with text. Items need the mention and a ``text`` of ``least`` characters."""
    items = raw.select("source", F.posexplode(F.from_json(F.get_json_object("json", f"$.{path}"), "array<string>")).alias("pos", "item"))
    out = items.select("source", "pos", *[F.coalesce(*[F.nullif(F.get_json_object("item", f"$.{p}"), F.lit("")) for p in ps]).alias(n) for n, ps in fields.items()])
    told = F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(mention.lower()))
    rows = out.where(told & (F.length("text") >= least))
    kept = rows.groupBy("source").agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", *fields))), 1, take).alias("i"))
    return kept.select("source", F.explode("i").alias("i")).select("source", *[F.col(f"i.{n}") for n in fields])


def declared_names(texts: DataFrame, most: int = 4) -> DataFrame:
    """(site, name, sentence): names of companies a site's sentences declare, the first sentence of
    each, at most ``most`` a site in order of first mention. texts: site, page_no, text."""
    s = texts.select("site", "page_no", F.posexplode(T.sentences(T.normalise("text"))).alias("pos", "sentence")).where(F.col("sentence").rlike(DECLARES))
    each = s.select("site", "page_no", "pos", "sentence", F.explode(F.regexp_extract_all("sentence", F.lit(NAME), F.lit(1))).alias("name"))
    first = each.groupBy("site", "name").agg(F.min(F.struct("page_no", "pos", "sentence")).alias("f"))
    kept = first.groupBy("site").agg(F.slice(F.array_sort(F.collect_list(F.struct("f", "name"))), 1, most).alias("k"))
    return kept.select("site", F.explode("k").alias("k")).select("site", "k.name", F.col("k.f.sentence").alias("sentence"))


def register_matches(wanted: DataFrame, candidates: DataFrame, facts: DataFrame, cap: int = 3, rejected: tuple[str, ...] = (), confirmed: tuple[str, ...] = ()) -> DataFrame:
    """(site, key, name, corroborated): register candidates (name, key, postcode, number) whose
    normalised name is one of a site's names (site, name, declared), declared names first, at most
    ``cap`` a site. A match is corroborated if the site's text (facts: site, text) shows the
    candidate's number or postcode, or if it was confirmed by hand; rejected keys are dropped."""
    norm = lambda c: T.normalise_name(c, LEGAL_FORMS)
    w = wanted.select("site", "declared", norm("name").alias("n")).where("n != ''")
    c = candidates.where(~F.col("key").isin(list(rejected))).select("key", "name", "postcode", "number", norm("name").alias("n"))
    met = w.join(c, "n").groupBy("site", "key", "name", "postcode", "number").agg(F.max("declared").alias("declared"))
    shown = lambda v: F.coalesce((F.length(v) > 0) & F.contains("said", T.padded_words(v)), F.lit(False))
    # page by page: a site's text is never put together
    seen = met.join(facts.select("site", T.padded_words("text").alias("said")), "site", "left").withColumn("ok", shown(F.col("number")) | shown(F.col("postcode")))
    rows = seen.groupBy("site", "key", "name", "declared").agg(F.bool_or("ok").alias("ok"))
    rows = rows.select("site", "key", "name", "declared", (F.col("key").isin(list(confirmed)) | F.coalesce("ok", F.lit(False))).alias("corroborated"))
    kept = rows.groupBy("site").agg(F.slice(F.array_sort(F.collect_list(F.struct((~F.col("declared")).alias("d"), "key", "name", "corroborated"))), 1, cap).alias("k"))
    return kept.select("site", F.explode("k").alias("k")).select("site", "k.key", "k.name", "k.corroborated")
