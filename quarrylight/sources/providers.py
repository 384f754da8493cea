"""Providers of embeddings and pair scores; a caller may bring models of their own."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import prefixed


def hashing_embedding(text: Column, dim: int = 64) -> Column:
    """A deterministic embedding for tests and offline use: signed counts of hashed words, of length one."""

    @F.pandas_udf("array<float>")
    def make(own: pd.Series) -> pd.Series:
        def one(value: str | None) -> np.ndarray:
            v = np.zeros(dim, np.float64)
            for w in (value or "").lower().split():
                h = zlib.crc32(w.encode())
                v[h % dim] += 1 if h >> 16 & 1 else -1
            n = np.linalg.norm(v)
            return (v / n if n else v).astype(np.float32)

        return own.map(one)

    return make(text)


def model_embedding(load: Callable[[], Callable[[list[str]], np.ndarray]], *, kind: str | None = "passage", batch: int = 64, normalize: bool = True) -> Callable[[Column], Column]:
    """An embedding by a model of the caller's, for use in place of ``hashing_embedding``.

    load: called once in a task; returns a function from texts to an array with a row for
    each. Texts get the prefix of their kind and go to the model in batches of texts of like
    length, so that padding is short; null counts as empty; vectors are scaled to length one.
    """

    @F.pandas_udf("array<float>")
    def make(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for own in parts:
            texts = [x or "" for x in own]
            order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
            out: list[np.ndarray | None] = [None] * len(texts)
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                got = np.asarray(model([texts[i] for i in some]), np.float64)
                if normalize:
                    got = got / np.maximum(np.linalg.norm(got, axis=1, keepdims=True), 1e-12)
                for i, v in zip(some, got.astype(np.float32), strict=True):
                    out[i] = v
            yield pd.Series(out)

    return lambda text: make(prefixed(F.coalesce(text, F.lit("")), kind))


def model_logit(load: Callable[[], Callable[[list[str], list[str]], np.ndarray]], *, batch: int = 32) -> Callable[[DataFrame], DataFrame]:
    """A pair score by a model of the caller's, for use in place of ``overlap_logit``: of text and content, in batches."""

    @F.pandas_udf("double")
    def make(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for texts, contents in parts:
            a, b = ([x or "" for x in c] for c in (texts, contents))
            yield pd.Series(np.concatenate([np.zeros(0), *(np.asarray(model(a[i : i + batch], b[i : i + batch]), np.float64) for i in range(0, len(a), batch))]))

    return lambda pairs: pairs.withColumn("logit", make("text", "content"))


def overlap_logit(pairs: DataFrame) -> DataFrame:
    """A pair score in place of a cross-encoder: shared words of task and content, as a logit."""
    own = F.array_distinct(F.split(F.lower("text"), r"\s+"))
    shared = F.size(F.array_intersect(own, F.split(F.lower("content"), r"\s+")))
    return pairs.withColumn("logit", 4.0 * shared / F.greatest(F.size(own), F.lit(1)) - 2.0)


def embed_backlog(units: DataFrame, done: DataFrame, key: str, text: Column, embed=hashing_embedding) -> DataFrame:
    """Vectors of all units that ``done`` lacks: a join for what is missing, then the provider in batches."""
    return units.join(done.select(key), key, "left_anti").select(key, embed(text).alias("vector"))
