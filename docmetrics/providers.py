"""Models as user-defined functions over requests."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from docmetrics.operators.extract import mock_replies, unreadable
from docmetrics.functions.text import json_object

#: Own wording: what a model is asked for, and how a reply that isn't JSON is sent back.
FIELDS_WANTED = "revenue, net_income, operating_income, total_assets, total_liabilities, cash_and_equivalents and eps"
REPLY_FORM = "Answer with one JSON object that has a key for each of them: null, or an object with value, unit, currency, source_text and confidence."
PROMPTS = {
    "text_only": f"From the pages of an annual report below, read {FIELDS_WANTED}. {REPLY_FORM}",
    "layout_aware": f"From the tables of an annual report below, each under the head of its page, read {FIELDS_WANTED}. {REPLY_FORM}",
    "hybrid": f"From the tables and pages of an annual report below, read {FIELDS_WANTED}; where they differ, trust the tables. {REPLY_FORM}",
}
CORRECTION = "The following reply isn't a JSON object. Send the same content as one JSON object only:\n"


class ProviderError(RuntimeError):
    """A model can't be reached or set up."""


@dataclass
class Reply:
    text: str
    input_tokens: int | None = None
    output_tokens: int | None = None


class Provider(Protocol):
    """What a model must offer; it is made inside of each task by its factory."""

    name: str
    model: str

    def extract(self, prompt: str, context: str) -> Reply: ...


class OpenAI:
    name = "openai"

    def __init__(self, model: str = "gpt-4o-mini", timeout: float = 60.0) -> None:
        try:
            import openai
        except ImportError as e:
            raise ProviderError("the openai package isn't installed on this worker") from e
        self.model, self.client = model, openai.OpenAI(timeout=timeout)

    def extract(self, prompt: str, context: str) -> Reply:
        messages = [{"role": "system", "content": prompt}, {"role": "user", "content": context}]
        r = self.client.chat.completions.create(model=self.model, messages=messages, temperature=0, response_format={"type": "json_object"})
        return Reply(r.choices[0].message.content or "", r.usage and r.usage.prompt_tokens, r.usage and r.usage.completion_tokens)


class Anthropic:
    name = "anthropic"

    def __init__(self, model: str = "claude-3-5-haiku-20241022", timeout: float = 60.0) -> None:
        try:
            import anthropic
        except ImportError as e:
            raise ProviderError("the anthropic package isn't installed on this worker") from e
        self.model, self.client = model, anthropic.Anthropic(timeout=timeout)

    def extract(self, prompt: str, context: str) -> Reply:
        r = self.client.messages.create(model=self.model, system=prompt, max_tokens=2048, temperature=0, messages=[{"role": "user", "content": context}])
        return Reply("".join(b.text for b in r.content if b.type == "text"), r.usage.input_tokens, r.usage.output_tokens)


FACTORIES: dict[str, Callable[..., Provider]] = {"openai": OpenAI, "anthropic": Anthropic}


def prompt_for(pipeline: str) -> str:
    """The prompt of a pipeline; unknown ones have that of text_only."""
    return PROMPTS.get(pipeline, PROMPTS["text_only"])


def _prompt_column() -> "F.Column":
    out = F.lit(PROMPTS["text_only"])
    for p, text in PROMPTS.items():
        out = F.when(F.col("pipeline") == p, text).otherwise(out)
    return out


def call_models(requests: DataFrame, factory: Callable[[], Provider], attempts: int = 3, wait: float = 1.0) -> DataFrame:
    """(document_id, pipeline, text, provider, model, input_tokens, output_tokens, latency_ms, error) for requests (document_id, pipeline, prompt, context).

    The client is made once a task.  A failed call is repeated up to ``attempts`` times, waiting ``wait`` times a power of two; after that
    its error is in the row.  Calls may be paid for and differ each time: write the result before it is used twice, and leave out what
    is already stored (:func:`pending`), as Spark may run a task again.
    """
    schema = "document_id string, pipeline string, text string, provider string, model string, input_tokens bigint, output_tokens bigint, latency_ms double, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = factory()
        for pdf in batches:
            rows = []
            for doc, pipeline, prompt, context in zip(pdf["document_id"], pdf["pipeline"], pdf["prompt"], pdf["context"]):
                start, reply, error = time.monotonic(), Reply(None), None
                for k in range(attempts):
                    try:
                        reply, error = provider.extract(prompt, context), None
                        break
                    except Exception as e:  # noqa: BLE001 - any failure of the remote side is tried again
                        error = f"{type(e).__name__}: {e}"
                        if k + 1 < attempts:
                            time.sleep(wait * 2**k)
                rows.append((doc, pipeline, reply.text, provider.name, provider.model, reply.input_tokens, reply.output_tokens, (time.monotonic() - start) * 1000, error))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]).astype({"input_tokens": "Int64", "output_tokens": "Int64"})

    return requests.select("document_id", "pipeline", "prompt", "context").mapInPandas(run, schema)


def pending(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """The requests without a stored reply."""
    return requests.join(stored.select("document_id", "pipeline"), ["document_id", "pipeline"], "left_anti")


def replies(contexts: DataFrame, provider: str | Callable[[], Provider] = "mock", model: str | None = None) -> DataFrame:
    """One reply per context (document_id, pipeline, context).  ``mock`` is the built-in stand-in, which needs no Python worker."""
    asked = contexts.withColumn("prompt", _prompt_column())
    if provider == "mock":
        out = mock_replies(asked, F.col("prompt"))
        return out.select("document_id", "pipeline", "text", "provider", "model", "input_tokens", "output_tokens", F.lit(0.0).alias("latency_ms"), F.lit(None).cast("string").alias("error"))
    if isinstance(provider, str):
        if provider not in FACTORIES:
            raise ValueError(f"unknown provider: {provider}")
        made = FACTORIES[provider]
        return call_models(asked, (lambda: made(model)) if model else made)
    return call_models(asked, provider)


def corrected(first: DataFrame, factory: Callable[[], Provider]) -> DataFrame:
    """The replies, those that aren't a JSON object asked for once more; a second failure keeps the first text, and calls that failed altogether aren't repeated.  Tokens of the second request aren't counted."""
    again = unreadable(first.where("text IS NOT NULL")).select("document_id", "pipeline", F.lit(PROMPTS["text_only"]).alias("prompt"), F.concat(F.lit(CORRECTION), F.coalesce("reply_start", F.lit(""))).alias("context"))
    second = call_models(again, factory).select("document_id", "pipeline", F.when(json_object(F.col("text")).isNotNull(), F.col("text")).alias("_second"))
    return first.join(second, ["document_id", "pipeline"], "left").withColumn("text", F.coalesce("_second", "text")).drop("_second")
