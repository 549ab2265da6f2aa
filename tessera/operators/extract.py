"""From bytes to text: type sniffing, extraction, and the line rules applied after it."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import constants as C
from tessera.functions import text as T

# Elements whose content is no text of the page, and those that end a line.
_SKIP = frozenset("script style noscript svg nav footer form iframe".split())
_BLOCK = frozenset("p div section article li ul ol table tr td th br hr h1 h2 h3 h4 h5 h6 blockquote pre header main aside dl dt dd figure figcaption".split())


def sniff(text: Column) -> Column:
    """Content type by the first characters of a text."""
    return (
        F.when(text.startswith("%PDF"), "application/pdf")
        .when(F.lower(F.left(text, F.lit(1024))).rlike("<html|<!doctype html"), "text/html")
        .when(text.rlike(r"^\s*[{\[]"), "application/json")
        .otherwise("text/plain")
    )


def drop_bibliography(text: Column) -> Column:
    """The text up to the first bibliography heading that stands after 0.55 of it."""
    # the heading is searched from the position on, at a line's start
    n = F.length(text)
    heads = F.regexp_extract_all(text, F.lit(C.BIBLIOGRAPHY), F.lit(0))
    parts = F.split(text, C.BIBLIOGRAPHY, -1)
    ends = F.transform(
        F.sequence(F.lit(1), F.size(heads)),
        lambda i: F.length(F.array_join(F.slice(parts, F.lit(1), i), "")) + F.length(F.array_join(F.slice(heads, F.lit(1), i - 1), "")),
    )
    cut = F.array_min(F.filter(ends, lambda e: e >= 0.55 * n))
    return F.when((F.size(heads) > 0) & cut.isNotNull(), F.regexp_replace(F.left(text, cut), r"\s+$", "")).otherwise(text)


def drop_repeated_lines(df: DataFrame, column: str = "text") -> DataFrame:
    """``df`` with ``column`` without its lines under 60 characters that stand more than twice,
    headings excepted. The sorted short lines are a column of their own, so that each is looked at
    once: a line whose third next in order is equal stands more than twice."""
    short = F.filter(F.transform(F.split(column, "\n", -1), lambda x: F.trim(x)), lambda x: (F.length(x) < 60) & (x != "") & ~x.startswith("#"))
    rows = df.withColumn("__short", F.array_sort(short))
    often = F.transform("__short", lambda x, i: F.when(F.try_element_at(F.col("__short"), i + 3) == x, x))
    rows = rows.withColumn("__often", F.array_distinct(F.array_compact(often)))
    kept = F.array_join(F.filter(F.split(column, "\n", -1), lambda x: ~F.array_contains("__often", F.trim(x))), "\n")
    return rows.withColumn(column, F.when(F.size("__often") > 0, kept).otherwise(F.col(column))).drop("__short", "__often")


def first_title(text: Column) -> Column:
    """The first line that is not blank, without heading marks, 200 characters at most."""
    line = F.trim(F.regexp_extract(text, r"[^\n]*\S[^\n]*", 0))
    return F.left(F.trim(F.regexp_replace(line, r"^[#\s]+", "")), F.lit(200))


def json_leaves(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, path, value) of the scalar leaves of a JSON object, two levels deep (path ``a.b``).
    Text that is no JSON object gives nothing; nulls are no leaves."""
    kind = lambda c: F.schema_of_variant(c)
    top = df.select(key, F.explode(F.from_json(F.col(column), "map<string,variant>")).alias("path", "v"))
    below = top.where(kind("v").startswith("OBJECT")).select(key, F.col("path").alias("a"), F.explode(F.from_json(F.to_json("v"), "map<string,variant>")).alias("b", "v"))
    below = below.select(key, F.concat_ws(".", "a", "b").alias("path"), "v")
    leaf = ~kind("v").rlike("^(OBJECT|ARRAY|VOID)")
    return top.unionByName(below).where("v is not null").where(leaf).select(key, "path", F.try_variant_get("v", "$", "string").alias("value"))


def contacts(documents: DataFrame) -> DataFrame:
    """(email, pages, found_on): addresses published on pages, image names excepted."""
    address = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
    each = documents.where(F.contains("text", F.lit("@"))).select("doc_id", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(address), F.lit(0)), F.lower))).alias("email"))
    return each.where(~F.col("email").rlike(r"\.(png|jpe?g|gif|svg|webp)$")).groupBy("email").agg(F.count("*").alias("pages"), F.min("doc_id").alias("found_on"))


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.title = ""
        self._skip: list[str] = []
        self._in_title = False

    def handle_starttag(self, tag, attrs):
        if self._skip:
            if tag == self._skip[-1]:
                self._skip.append(tag)
        elif tag in _SKIP:
            self._skip.append(tag)
        elif tag == "title":
            self._in_title = True
        elif tag in _BLOCK:
            self.out.append("\n" + ("#" * int(tag[1]) + " " if re.fullmatch("h[1-6]", tag) else ""))

    def handle_endtag(self, tag):
        if self._skip:
            if tag == self._skip[-1]:
                self._skip.pop()
        elif tag == "title":
            self._in_title = False
        elif tag in _BLOCK:
            self.out.append("\n")

    def handle_data(self, data):
        if self._in_title:
            self.title += data
        elif not self._skip:
            self.out.append(re.sub(r"\s+", " ", data))


def html_text(raw: str) -> tuple[str, str]:
    """(title, text) of a page: scripts, navigation, footers and forms dropped, headings marked."""
    page = _Page()
    page.feed(raw)
    page.close()
    lines = [x.strip() for x in "".join(page.out).split("\n")]
    return page.title.strip(), "\n".join(x for x in lines if x and x.strip("#").strip())


def json_text(raw: str) -> str:
    """``a.b[0]: value`` lines of any JSON document; text that is none stays as it is."""
    lines: list[str] = []

    def walk(x, path: str) -> None:
        if isinstance(x, dict):
            for k, v in x.items():
                walk(v, f"{path}.{k}" if path else str(k))
        elif isinstance(x, list):
            for i, v in enumerate(x):
                walk(v, f"{path}[{i}]")
        else:
            lines.append(f"{path}: {x}" if path else str(x))

    try:
        walk(json.loads(raw), "")
    except ValueError:
        return raw
    return "\n".join(lines)


def extract(raw: DataFrame) -> DataFrame:
    """(id, content_type, title, text, sha256) of raw contents (id, content_type, content: binary).

    The declared type decides, else the first bytes do. HTML and JSON are parsed in Python, in
    Arrow batches; the line rules run after in the JVM. Null contents give no row; PDF needs an
    optional reader and gives empty text without one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            titles, texts = [], []
            for kind, body in zip(pdf["content_type"], pdf["body"]):
                title, text = "", body
                if kind == "text/html":
                    title, text = html_text(body)
                elif kind == "application/json":
                    text = json_text(body)
                elif kind == "application/pdf":
                    text = ""
                # compatibility forms of letters; most texts are plain and need no look
                titles.append(title if title.isascii() else unicodedata.normalize("NFKC", title))
                texts.append(text if text.isascii() else unicodedata.normalize("NFKC", text))
            yield pd.DataFrame({"id": pdf["id"], "content_type": pdf["content_type"], "title": titles, "text": texts, "sha256": pdf["sha256"]})

    body = F.decode("content", "UTF-8")
    typed = raw.where("content is not null").select("id", F.coalesce(F.col("content_type"), sniff(body)).alias("content_type"), body.alias("body"), F.sha2("content", 256).alias("sha256"))
    parsed = typed.mapInPandas(run, "id bigint, content_type string, title string, text string, sha256 string")
    clean = parsed.withColumn("text", T.normalise("text"))
    page = drop_repeated_lines(clean.withColumn("page", F.when(F.col("content_type") == "text/html", F.col("text"))), "page")
    titled = page.withColumn("text", F.coalesce(drop_bibliography(F.col("page")), F.col("text"))).drop("page")
    return titled.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), first_title(F.col("text"))))
