"""A worker over a folder of requests: reads new request files, asks the model for those without a
response to the same prompt, writes responses. Restarts resume from the checkpoint, and the prompt
hash makes a repeated batch write nothing twice."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUEST = "request_id string, question_id string, prompt string, prompt_sha string"
RESPONSE = "request_id string, prompt_sha string, text string, provider string, error string, created_at timestamp"


def answer_batch(batch: DataFrame, complete: Callable[[str], str], provider: str) -> DataFrame:
    """Responses to a batch of requests; a failing call becomes an error, not a failed job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, errors = [], []
            for prompt in pdf["prompt"]:
                try:
                    texts.append(complete(prompt))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - whatever the provider raises
                    texts.append(None)
                    errors.append(str(e))
            yield pd.DataFrame({"request_id": pdf["request_id"], "prompt_sha": pdf["prompt_sha"], "text": pd.Series(texts, dtype="object"), "provider": provider, "error": pd.Series(errors, dtype="object")})

    schema = "request_id string, prompt_sha string, text string, provider string, error string"
    return batch.mapInPandas(run, schema).withColumn("created_at", F.current_timestamp())


def run_worker(spark: SparkSession, requests: str, responses: str, checkpoint: str, complete: Callable[[str], str], provider: str = "local") -> None:
    """Work off what lies in ``requests`` (JSON files) and stop: trigger available-now."""

    def step(batch: DataFrame, _: int) -> None:
        done = spark.read.schema(RESPONSE).json(responses).where("error is null and text is not null").select("request_id", "prompt_sha")
        todo = batch.dropDuplicates(["request_id", "prompt_sha"]).join(done, ["request_id", "prompt_sha"], "left_anti")
        answer_batch(todo, complete, provider).write.mode("append").json(responses)

    spark.createDataFrame([], RESPONSE).write.mode("append").json(responses)  # the folder must exist to be read
    stream = spark.readStream.schema(REQUEST).json(requests)
    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
