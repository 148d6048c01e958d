"""Text generation inside tasks: the contract, retries, an offline backend, and the call itself."""

from __future__ import annotations

import hashlib
import json
import random
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitspark.cluster import ship


class TextBackend(Protocol):
    """Answers prompts; last_usage has the tokens of the last call, if known. It must be picklable."""

    last_usage: dict | None

    def generate(self, prompt: str, system: str | None = None, temperature: float = 0.2, max_tokens: int = 2048) -> str: ...


class RateLimitError(RuntimeError):
    """The service asks to wait: not tried again."""


class TransientBackendError(RuntimeError):
    """The service failed several times."""


TRANSIENT = re.compile(r"\b(?:500|503|504)\b|INTERNAL|UNAVAILABLE|DEADLINE")


@dataclass
class Retry:
    """Up to `tries` calls; waits double from `first` seconds, with jitter, up to `most`."""

    tries: int = 3
    first: float = 0.8
    most: float = 8.0
    jitter: float = 0.25
    sleep: Callable[[float], None] = time.sleep

    def __call__(self, call: Callable[[], str]) -> str:
        last: Exception | None = None
        for i in range(self.tries):
            try:
                answer = call()
                if answer and answer.strip():
                    return answer
                last = RuntimeError("empty answer")
            except Exception as e:
                if "429" in str(e) or isinstance(e, RateLimitError):
                    raise RateLimitError(str(e)) from e
                if not TRANSIENT.search(str(e)):
                    raise
                last = e
            if i + 1 < self.tries:
                self.sleep(min(self.most, self.first * 2**i + random.uniform(0, self.jitter)))
        raise TransientBackendError(str(last)) from last


class MockBackend:
    """Fixed answers by the first key that a prompt contains; an empty object otherwise."""

    def __init__(self, answers: dict[str, str] | None = None, error: str | None = None) -> None:
        self.answers, self.error, self.last_usage = answers or {}, error, None

    def generate(self, prompt: str, system: str | None = None, temperature: float = 0.2, max_tokens: int = 2048) -> str:
        if self.error:
            raise RateLimitError(self.error) if "429" in self.error else RuntimeError(self.error)
        self.last_usage = {"total_tokens": len(prompt) // 4 + 40}
        return next((a for k, a in self.answers.items() if k in prompt), "{}")


class MockJudge(MockBackend):
    """Scores a prompt by each occurrence of words that speak for or against, with a small jitter that depends on the prompt alone."""

    FOR = ("led", "designed", "architected", "from scratch", "years of experience")
    AGAINST = ("clerk", "filing", "scheduling", "helped with")

    def generate(self, prompt: str, system: str | None = None, temperature: float = 0.2, max_tokens: int = 2048) -> str:
        self.last_usage = {"total_tokens": len(prompt) // 4 + 40}
        low = prompt.lower()
        score = 50 + 8 * sum(map(low.count, self.FOR)) - 10 * sum(map(low.count, self.AGAINST))
        jitter = int(hashlib.sha256(prompt.encode()).hexdigest(), 16) % 7 - 3
        return json.dumps({"fit_0_100": max(0, min(100, max(5, min(95, score)) + jitter))})


ANSWERS = "answer string, ok boolean, error string, tokens long, elapsed_s double, tries int"


def ask(prompts: DataFrame, backend: TextBackend, *, prompt: str = "prompt", system: str | None = None, retry: Retry | None = None, reformat: bool = True) -> DataFrame:
    """Add answer, ok, error, tokens, elapsed_s and tries to each row with a prompt.

    An answer without JSON is asked for once more. Errors become rows, so that one
    call that fails loses no others. A lost task asks again: write the result before
    using it twice.
    """
    ship(prompts.sparkSession)
    retry = retry or Retry()
    schema = prompts.select("*", *(F.lit(None).cast(t).alias(n) for n, t in (x.split() for x in ANSWERS.split(", ")))).schema

    def one(text: str | None) -> tuple:
        began, tokens, answer, error, n = time.time(), None, None, None, 0
        for again in range(2 if reformat else 1):
            n += 1
            wanted = text or ""
            if again:
                wanted += "\n\nAnswer with one JSON value and nothing else."
            try:
                answer = retry(lambda: backend.generate(wanted, system=system))
                error = None
            except Exception as e:
                answer, error = None, f"{type(e).__name__}: {e}"
                break
            usage = getattr(backend, "last_usage", None) or {}
            if usage.get("total_tokens") is not None:
                tokens = (tokens or 0) + usage["total_tokens"]
            if "{" in answer or "[" in answer:
                break
        return answer, error is None, error, tokens, round(time.time() - began, 3), n

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [one(t) for t in b.column(b.schema.get_field_index(prompt)).to_pylist()]
            kinds = (pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.float64(), pa.int32())
            added = [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([*b.columns, *added], schema.names)

    return prompts.mapInArrow(mapped, schema)


def entries(answers: DataFrame, *, leaf: str = "leaf", prompt: str = "prompt") -> DataFrame:
    """Telemetry of answered prompts: a preview of the prompt, seconds to three decimals."""
    preview = F.when(F.length(prompt) > 400, F.concat(F.substring(prompt, 1, 400), F.lit("…"))).otherwise(F.col(prompt))
    return answers.select(F.col(leaf).alias("leaf"), preview.alias("prompt"), "ok", F.bround("elapsed_s", 3).alias("elapsed_s"), "tokens", "error")


def write_entries(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)
