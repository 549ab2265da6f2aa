"""Bytes of registered sources: written in the register, in files, or brought by the caller's fetcher."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Content types by suffix; any other file is plain text.
TYPES = {"pdf": "application/pdf", "html": "text/html", "htm": "text/html", "md": "text/markdown", "txt": "text/plain", "json": "application/json"}
FETCHED = "source_id string, content binary, content_type string, final_uri string, error string"


def content_type(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    known = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, suffix), F.lit("text/plain"))


def kind(uri: Column, content: Column) -> Column:
    """How a source is fetched: inline, http, file, or not at all."""
    scheme = F.lower(F.regexp_extract(uri, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return F.when(content.isNotNull() | (scheme == "inline"), "inline").when(scheme.isin("http", "https"), "http").when(scheme.isin("file", ""), "file").otherwise("unsupported")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content, content_type) of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    path = F.regexp_replace("path", r"^[a-z]+:/{0,2}(?=/)", "")
    return files.select(path.alias("path"), "content", content_type(F.col("path")).alias("content_type"))


def fetch(sources: DataFrame, files: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    """(source_id, content, content_type, final_uri, error) of every source (source_id, uri, content).

    ``files`` is ``read_files`` of where file sources lie; ``pages`` (uri, content, content_type,
    final_uri) is what the caller's fetcher brought for http sources, as nothing here opens a
    connection. What cannot be had is a row with an error."""
    rows = sources.select("source_id", F.coalesce("uri", F.lit("")).alias("uri"), "content").withColumn("kind", kind(F.col("uri"), F.col("content")))
    none = lambda t: F.lit(None).cast(t)
    inline = rows.where("kind = 'inline'").select(
        "source_id", F.encode("content", "UTF-8").alias("body"), F.lit("text/markdown").alias("content_type"), F.lit("inline:").alias("final_uri"),
        F.when(F.col("content").isNull(), F.concat(F.lit("inline source "), "uri", F.lit(" has no content"))).alias("error"),
    )
    path = F.regexp_replace("uri", r"^[Ff][Ii][Ll][Ee]:(?://)?", "")
    wanted = rows.where("kind = 'file'").select("source_id", path.alias("path"))
    if files is None:
        found = wanted.select("source_id", none("binary").alias("body"), none("string").alias("content_type"), F.col("path").alias("final_uri"))
    else:
        found = wanted.join(files, "path", "left").select("source_id", F.col("content").alias("body"), "content_type", F.col("path").alias("final_uri"))
    local = found.withColumn("error", F.when(F.col("body").isNull(), F.concat(F.lit("local file not found: "), "final_uri")))
    asked = rows.where("kind = 'http'").select("source_id", "uri")
    if pages is None:
        brought = asked.select("source_id", none("binary").alias("body"), none("string").alias("content_type"), F.col("uri").alias("final_uri"))
    else:
        brought = asked.join(pages.dropDuplicates(["uri"]), "uri", "left").select("source_id", F.col("content").alias("body"), "content_type", F.coalesce("final_uri", "uri").alias("final_uri"))
    web = brought.withColumn("error", F.when(F.col("body").isNull(), F.concat(F.lit("not fetched: "), "final_uri")))
    other = rows.where("kind = 'unsupported'").select("source_id", none("binary").alias("body"), none("string").alias("content_type"), F.col("uri").alias("final_uri"), F.concat(F.lit("unsupported scheme: "), "uri").alias("error"))
    out = inline.unionByName(local).unionByName(web).unionByName(other)
    return out.select("source_id", F.col("body").alias("content"), "content_type", "final_uri", "error")
