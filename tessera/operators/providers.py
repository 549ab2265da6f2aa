"""Who drafts answers: providers by name. A provider is given prompts (question_id, prompt) and gives
(question_id, text, provider, error); calling a model is the caller's function, run in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPLIES = "question_id string, text string, provider string, error string"
Provider = Callable[[DataFrame], DataFrame]


def calling(name: str, complete: Callable[[str], str]) -> Provider:
    """A provider that calls ``complete`` on every prompt, in the tasks; what it raises is the row's
    error, and the other rows go on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for qid, prompt in zip(pdf["question_id"], pdf["prompt"]):
                try:
                    out.append((qid, complete(prompt), name, None))
                except Exception as e:  # noqa: BLE001 - one failed call is one failed row
                    out.append((qid, None, name, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["question_id", "text", "provider", "error"], dtype=object)

    return lambda prompts: prompts.select("question_id", "prompt").mapInPandas(run, REPLIES)


def scripted(replies: DataFrame, name: str = "scripted") -> Provider:
    """Canned replies (question_id, text); a question without one has an error."""

    def ask(prompts: DataFrame) -> DataFrame:
        rows = prompts.select("question_id").join(replies.select("question_id", "text").dropDuplicates(["question_id"]), "question_id", "left")
        return rows.select("question_id", "text", F.lit(name).alias("provider"), F.when(F.col("text").isNull(), "no reply").alias("error"))

    return ask


class Registry:
    """Providers by name. A name that needs a model and is not there is an error where a model is
    required, else the fallback answers, and its name is recorded as such."""

    def __init__(self, fallback: tuple[str, Provider] | None = None) -> None:
        self._known: dict[str, Provider] = {}
        self._fallback = fallback

    def register(self, name: str, provider: Provider) -> None:
        self._known[name] = provider

    def get(self, name: str, require_model: bool = False) -> Provider:
        if name in self._known:
            return self._known[name]
        if require_model or self._fallback is None:
            raise KeyError(f"no provider {name!r}")
        used, provider = self._fallback
        return lambda prompts: provider(prompts).withColumn("provider", F.lit(f"{used} (for {name})"))


def entailment(provider: Provider, statements: DataFrame) -> DataFrame:
    """(claim_id, source_id) of the statements (claim_id, source_id, claim, stated) a model does not confirm:
    asked whether the passage states the claim, it says no, or fails. For ``answering.verify``."""
    prompt = F.concat(F.lit("Claim: "), "claim", F.lit("\n\nPassage: "), "stated", F.lit("\n\nDoes the passage state the claim? Answer YES or NO."))
    key = F.concat_ws("\x1f", "claim_id", "source_id")
    said = provider(statements.where("stated is not null").select(key.alias("question_id"), prompt.alias("prompt")))
    no = said.where(F.col("error").isNotNull() | ~F.coalesce(F.upper(F.trim("text")).startswith("YES"), F.lit(False)))
    parts = F.split("question_id", "\x1f")
    return no.select(parts[0].alias("claim_id"), parts[1].alias("source_id"))
