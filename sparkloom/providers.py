"""What stands outside of Spark: language models, authorization, optional models for embedding and reranking."""

from __future__ import annotations

import importlib.util
import json
import os
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Usage:
    input_tokens: int = 0
    output_tokens: int = 0
    cached_input_tokens: int | None = None
    cache_creation_input_tokens: int | None = None


class LanguageModel(Protocol):
    name: str

    def generate(self, prompt: str, max_tokens: int) -> tuple[str, Usage]: ...

    def stream(self, prompt: str, max_tokens: int) -> Iterator[str]: ...


class NoModel:
    """Stands where no model is set up: whoever asks it gets an error."""

    name = "none"

    def generate(self, prompt: str, max_tokens: int) -> tuple[str, Usage]:
        raise RuntimeError("no language model is configured")

    def stream(self, prompt: str, max_tokens: int) -> Iterator[str]:
        raise RuntimeError("no language model is configured")


class MessagesModel:
    """A model behind an HTTP messages interface, whole or as an event stream; used on the driver alone."""

    def __init__(self, url: str, model: str, key_variable: str = "LLM_API_KEY", headers: dict[str, str] | None = None, timeout: float = 120.0):
        self.url, self.name, self.key_variable, self.headers, self.timeout = url, model, key_variable, headers or {}, timeout

    def _open(self, prompt: str, max_tokens: int, stream: bool):
        body = {"model": self.name, "max_tokens": max_tokens, "messages": [{"role": "user", "content": prompt}], "stream": stream}
        head = {"content-type": "application/json", "x-api-key": os.environ.get(self.key_variable, "")} | self.headers
        return urllib.request.urlopen(urllib.request.Request(self.url, json.dumps(body).encode(), head), timeout=self.timeout)

    def generate(self, prompt: str, max_tokens: int) -> tuple[str, Usage]:
        with self._open(prompt, max_tokens, False) as r:
            data = json.load(r)
        u = data.get("usage") or {}
        text = "".join(b.get("text", "") for b in data.get("content") or [] if b.get("type") == "text")
        return text, Usage(u.get("input_tokens") or 0, u.get("output_tokens") or 0, u.get("cache_read_input_tokens"), u.get("cache_creation_input_tokens"))

    def stream(self, prompt: str, max_tokens: int) -> Iterator[str]:
        with self._open(prompt, max_tokens, True) as r:
            yield from deltas(line.decode("utf-8", "replace") for line in r)


def deltas(lines) -> Iterator[str]:
    """The text of an event stream, as it comes; lines that can't be read are passed over."""
    for line in lines:
        if line.startswith("data:"):
            try:
                event = json.loads(line[5:])
            except ValueError:
                continue
            if isinstance(event, dict) and event.get("type") == "content_block_delta" and (event.get("delta") or {}).get("text"):
                yield event["delta"]["text"]


class Authorization(Protocol):
    def allowed(self, user: str | None) -> list[int] | None:
        """The repositories that a user may read; None: all."""


class Everyone:
    def allowed(self, user: str | None) -> list[int] | None:
        return None


def installed(module: str) -> bool:
    return importlib.util.find_spec(module) is not None


def model_embedder(model: str):
    """A pandas UDF text -> array<float> (unit vectors), with the model loaded once in each Python worker.

    It needs the sentence_transformers package; without it this raises, and hash embeddings are what there is.
    """
    if not installed("sentence_transformers"):
        raise RuntimeError("the sentence_transformers package isn't installed")

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from sentence_transformers import SentenceTransformer

        m = SentenceTransformer(model)
        for texts in batches:
            yield pd.Series(list(m.encode(list(texts.fillna("")), batch_size=32, normalize_embeddings=True)))

    return embed


def rerank_pairs(candidates: DataFrame, score: Column, *, first: int = 50) -> DataFrame:
    """candidates (query_id, symbol_id, rank) reordered by `score` up to rank `first`; the rest follow as they were, without score."""
    from pyspark.sql import Window

    c = candidates.withColumn("rerank_score", F.when(F.col("rank") <= first, score))
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc_nulls_last(), "rank", "symbol_id")
    return c.withColumn("rank", F.row_number().over(order).cast("long"))


def cross_scorer(model: str):
    """A pandas UDF (question, text) -> double of a cross-encoder; needs the same package as model_embedder()."""
    if not installed("sentence_transformers"):
        raise RuntimeError("the sentence_transformers package isn't installed")

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        from sentence_transformers import CrossEncoder

        m = CrossEncoder(model)
        for questions, texts in batches:
            yield pd.Series(m.predict(list(zip(questions, texts, strict=True))))

    return score


def token_counter(vocabulary: str | None = None):
    """A function of a text column: the ids of a tokenizer's vocabulary file, or the estimate where there is none."""
    from sparkloom.functions.text import token_count

    if vocabulary is None or not installed("tokenizers"):
        return token_count

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(vocabulary)
        for texts in batches:
            yield pd.Series([len(t.encode(x or "", add_special_tokens=False).ids) for x in texts])

    return count
