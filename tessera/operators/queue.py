"""The split between preparing prompts and calling a model: requests meet responses by the hash of
their prompt, so a changed prompt makes a response stale and an equal one is never asked twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T


def requests(prompts: DataFrame, area: str) -> DataFrame:
    """(request_id, question_id, prompt, prompt_sha) of prepared prompts (question_id, question, prompt)."""
    key = T.short_hash(F.lit(f"{area}:"), F.col("question"), prefix="req_")
    return prompts.select(key.alias("request_id"), "question_id", "prompt", F.sha2("prompt", 256).alias("prompt_sha"))


def pending(requests_: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests without a good response to the same prompt."""
    done = responses.where("error is null and text is not null").select("request_id", "prompt_sha").distinct()
    return requests_.join(done, ["request_id", "prompt_sha"], "left_anti")


def stale(requests_: DataFrame, responses: DataFrame) -> DataFrame:
    """(request_id): requests that only have responses to another prompt."""
    now = requests_.select("request_id", "prompt_sha")
    return responses.join(now.select("request_id"), "request_id", "left_semi").join(now, ["request_id", "prompt_sha"], "left_anti").select("request_id").distinct()


def apply(requests_: DataFrame, responses: DataFrame) -> DataFrame:
    """(request_id, question_id, text, provider): the latest good response to each current prompt."""
    good = responses.where("error is null and text is not null")
    met = requests_.select("request_id", "question_id", "prompt_sha").join(good, ["request_id", "prompt_sha"])
    order = F.struct("created_at", "text", "provider")
    return met.groupBy("request_id", "question_id").agg(F.max_by(F.struct("text", "provider"), order).alias("r")).select("request_id", "question_id", "r.text", "r.provider")


def status(requests_: DataFrame, responses: DataFrame) -> DataFrame:
    """(state, n): requests by state, answered, stale or pending."""
    answered = apply(requests_, responses).select("request_id").withColumn("a", F.lit(True))
    old = stale(requests_, responses).withColumn("s", F.lit(True))
    rows = requests_.select("request_id").join(answered, "request_id", "left").join(old, "request_id", "left")
    return rows.groupBy(F.when(F.col("a"), "answered").when(F.col("s"), "stale").otherwise("pending").alias("state")).agg(F.count("*").alias("n"))
