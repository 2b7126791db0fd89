"""External producers (speech, vision, language) as injected functions over DataFrames.

The engine never calls a model itself: a producer is a plain function that runs where the rows are.
The stand-ins here are deterministic, for tests and dry runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import memo_split


def ask(requests: DataFrame, fn: Callable[[str, str], str], retries: int = 2, concurrency: int = 3, cache: DataFrame | None = None) -> DataFrame:
    """Answers for (tag, key, system, prompt); what the cache holds is not asked again.

    A failing call becomes a row with ``error``, never an exception. Replies are matched by tag.
    """
    schema = "tag string, key string, reply string, error string"
    reminder = "\nAnswer with one JSON object only."

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for tag, key, system, prompt in pdf[["tag", "key", "system", "prompt"]].itertuples(index=False):
                reply, error = None, None
                for attempt in range(retries + 1):
                    try:
                        reply, error = fn(system, prompt + (reminder if attempt else "")), None
                        break
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                out.append((tag, key, reply, error))
            yield pd.DataFrame(out, columns=["tag", "key", "reply", "error"])

    hits, misses = (None, requests) if cache is None else memo_split(requests, cache, ["key"])
    made = misses.repartition(concurrency).mapInPandas(run, schema)
    return made if hits is None else made.unionByName(hits.select("tag", "key", "reply", F.lit(None).cast("string").alias("error")))


def speak(lines: DataFrame, fn: Callable[[str], float]) -> DataFrame:
    """Seconds of speech per distinct (key, narration), joined back to every line."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "seconds": [float(fn(t)) for t in pdf["narration"]]})

    distinct = lines.groupBy("key").agg(F.first("narration").alias("narration"))
    return lines.join(distinct.mapInPandas(run, "key string, seconds double"), "key", "left")


def embed(rows: DataFrame, text: str, fn: Callable[[list[str]], np.ndarray], batch: int = 8) -> DataFrame:
    """Unit vectors for a text column, in batches, order kept inside each Arrow batch."""

    @F.pandas_udf("array<float>")
    def vectors(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            out = []
            for i in range(0, len(s), batch):
                m = np.asarray(fn(list(s.iloc[i : i + batch])), dtype=np.float32)
                n = np.linalg.norm(m, axis=1, keepdims=True)
                out += list(m / np.where(n == 0, 1, n))
            yield pd.Series(out)

    return rows.withColumn("embedding", vectors(F.col(text)))


def stub_seconds(words_per_minute: float = 150.0) -> Callable[[str], float]:
    return lambda t: len((t or "").split()) / words_per_minute * 60


def stub_vectors(dim: int = 512) -> Callable[[list[str]], np.ndarray]:
    def fn(texts: list[str]) -> np.ndarray:
        seeds = [int.from_bytes(hashlib.blake2b((t or "").encode(), digest_size=8).digest(), "little") for t in texts]
        return np.stack([np.random.default_rng(s).standard_normal(dim) for s in seeds]).astype(np.float32)

    return fn


def preprocess_image(bgr: np.ndarray, mean, std) -> np.ndarray:
    """BGR bytes (h, w, 3) to a normalised float32 (3, h, w) tensor."""
    rgb = bgr[..., ::-1].astype(np.float32) / 255.0
    return ((rgb - np.asarray(mean, np.float32)) / np.asarray(std, np.float32)).transpose(2, 0, 1)


def mean_luma(bgr: np.ndarray) -> float:
    return round(float(bgr.mean()), 2)


def wav_seconds(header_frames: int, rate: int) -> float:
    return header_frames / rate if rate else 0.0
