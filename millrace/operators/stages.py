"""Stages that call a model: an injected client in Arrow batches, answers parsed, failures kept as rows, done rows skipped."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.dedup import pending


def call(client: Callable[[str], str], prompt: str, retries: int = 4, pause: float = 1.0, most: float = 30.0) -> tuple[str | None, str | None]:
    """The reply, or the error after all retries; pauses double up to `most` seconds."""
    error = None
    for attempt in range(retries):
        try:
            return client(prompt), None
        except Exception as e:  # noqa: BLE001  becomes a row
            error = f"{type(e).__name__}: {e}"
            if attempt + 1 < retries:
                time.sleep(min(most, pause * 2**attempt))
    return None, error


def run(df: DataFrame, key: str, prompt: str, client: Callable[[str], str], workers: int = 4, done: DataFrame | None = None, retries: int = 4, pause: float = 1.0) -> DataFrame:
    """(key, reply, error) of each row not done: `workers` partitions bound how many calls run at once."""
    todo = df if done is None else pending(df, done, key)

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = [call(client, p, retries, pause) for p in pdf[prompt]]
            yield pd.DataFrame({key: pdf[key], "reply": [r for r, _ in out], "error": [e for _, e in out]})

    return todo.select(key, prompt).repartition(workers).mapInPandas(batches, f"{key} {dict(df.dtypes)[key]}, reply string, error string")


def routed(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that went well, and failures."""
    return results.filter(F.col("error").isNull()), results.filter(F.col("error").isNotNull())


def provider(*candidates: dict | None) -> dict | None:
    """The first configured provider, or none."""
    return next((c for c in candidates if c), None)


REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def registered(name: str) -> Callable:
    """Registers a transformation by name."""
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        REGISTRY[name] = f
        return f

    return add
