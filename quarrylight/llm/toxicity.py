"""Toxicity by a factorization machine over hashed terms.

A text is the set of its terms: words with A-Z lower-cased and without punctuation
at either end, hashed to ``buckets`` slots. The score is the logistic value of
bias + sum of w_i + sum over pairs of <v_i, v_j>, the pair sum in linear time. The
pair factors learn that two terms together, such as an insult and the mention of a
group, mean more than both apart, which additive weights cannot express.

The classifier is fitted on the driver from at most ``sample`` labelled rows, those
with the smallest hash of the identifier; that bound does not grow with the
corpus. A slot takes part if its occurrence differs between the labels, relative to its
standard error, or if it is frequent and that of some pair it belongs to differs from what
its two slots alone imply: a pair can decide a label where neither term does. Every whole text is scored where it lies: scoring
shuffles nothing and needs a few thousand numbers.

Defined cases: null or empty text has the score of the bias; without labels of both
kinds every score is the base rate of the sample (0 if it has none); repeated rows
are scored each; a document labelled twice counts by its largest label; labels
without a document are ignored; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column_bytes, documents, lean, remainder

_EDGE = bytes(c for c in range(33, 127) if not chr(c).isalnum())
MOD, HELD = 3, 1


def terms(text: bytes) -> set[bytes]:
    """Distinct terms of a text."""
    return {w.strip(_EDGE) for w in set(text.lower().split())} - {b""}


@dataclass
class FactorizationMachine:
    """slot: the weight row of each hashed term, -1 for none. w, v, bias: weights."""

    buckets: int
    slots: dict[int, int]
    bias: float
    w: np.ndarray
    v: np.ndarray

    def slot(self, term: bytes) -> int:
        return self.slots.get(zlib.crc32(term) % self.buckets, -1)

    def score(self, own: list[int]) -> float:
        if not own:
            return float(_logistic(self.bias))
        rows = self.v[own]
        s = rows.sum(axis=0)
        return float(_logistic(self.bias + self.w[own].sum() + 0.5 * (s @ s - (rows * rows).sum())))


def _logistic(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _paired(flat: np.ndarray, owner: np.ndarray, seen: np.ndarray, labels: np.ndarray, frequent: int = 512, least: float = 6.0) -> np.ndarray:
    """Slots of pairs, among the most frequent slots, whose joint occurrence depends on the label.

    For each label, how often two slots occur together is held against what it would be if
    they were independent; ``least`` is the difference between the labels in standard errors.
    """
    n = len(labels)
    own = np.argsort(-seen, kind="stable")[:frequent]
    own = np.sort(own[seen[own] >= 20])
    at = np.full(len(seen), -1)
    at[own] = np.arange(len(own))
    x = np.zeros((n, len(own)), np.float32)
    use = at[flat] >= 0
    x[owner[use], at[flat[use]]] = 1
    lift, error = [], []
    for part in (x[labels > 0], x[labels <= 0]):
        m, share = len(part), part.mean(axis=0, dtype=np.float64)
        joint, alone = (part.T @ part) / m, np.outer(share, share)
        lift.append(joint - alone)
        error.append(np.outer(share * (1 - share), share * (1 - share)) / m)
    z = (lift[0] - lift[1]) / np.sqrt(sum(error) + 1 / n**2)
    np.fill_diagonal(z, 0)
    return own[(np.abs(z) > least).any(axis=0)]


def fit(rows: list[list[int]], labels: np.ndarray, buckets: int, *, keep: int = 1024, factors: int = 4, epochs: int = 80, seed: int = 7) -> FactorizationMachine:
    """rows: the distinct hashed terms of each text."""
    n, positive = len(rows), int(labels.sum())
    if not 0 < positive < n:
        rate = min(max(positive / n if n else 0.0, 1e-9), 1 - 1e-9)
        return FactorizationMachine(buckets, {}, float(np.log(rate / (1 - rate))), np.zeros(0), np.zeros((0, factors)))
    flat = np.fromiter((t for r in rows for t in r), np.int64)
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    seen = np.bincount(flat, minlength=buckets).astype(float)
    hit = np.bincount(flat, weights=labels[owner].astype(float), minlength=buckets)
    p, rate = positive, positive / n
    a, b = (hit + 0.5) / (p + 1), (seen - hit + 0.5) / (n - p + 1)
    z = (a - b) / np.sqrt(a * (1 - a).clip(1e-9) / (p + 1) + b * (1 - b).clip(1e-9) / (n - p + 1))
    z[seen < 5] = 0
    chosen = np.argsort(-np.abs(z), kind="stable")[:keep]
    chosen = np.union1d(chosen[np.abs(z[chosen]) > 3], _paired(flat, owner, seen, labels))
    slots = {int(t): i for i, t in enumerate(chosen)}
    if not slots:
        return FactorizationMachine(buckets, {}, float(np.log(rate / (1 - rate))), np.zeros(0), np.zeros((0, factors)))
    at = np.full(buckets, -1)
    at[chosen] = np.arange(len(chosen))
    x = np.zeros((n, len(chosen)), np.float32)
    use = at[flat] >= 0
    x[owner[use], at[flat[use]]] = 1
    rng = np.random.default_rng(seed)
    w, v, bias = np.zeros(len(chosen)), rng.normal(0, 0.05, (len(chosen), factors)), np.log(rate / (1 - rate))
    moments = [np.zeros_like(w), np.zeros_like(v), 0.0], [np.zeros_like(w), np.zeros_like(v), 0.0]
    step = 0
    for epoch in range(epochs):
        for part in np.array_split(rng.permutation(n), max(1, n // 256)):
            xb, step = x[part].astype(float), step + 1
            s = xb @ v
            score = bias + xb @ w + 0.5 * ((s * s).sum(axis=1) - xb @ (v * v).sum(axis=1))
            g = (_logistic(score) - labels[part]) / len(part)
            gw = xb.T @ g + 2e-5 * w
            gv = xb.T @ (g[:, None] * s) - (xb.T @ g)[:, None] * v + 1e-4 * v
            rate_now = 0.03 * (1 - epoch / epochs) + 0.002
            new = []
            for k, (value, grad) in enumerate(((w, gw), (v, gv), (bias, g.sum()))):
                moments[0][k] = 0.9 * moments[0][k] + 0.1 * grad
                moments[1][k] = 0.99 * moments[1][k] + 0.01 * grad * grad
                new.append(value - rate_now * (moments[0][k] / (1 - 0.9**step)) / (np.sqrt(moments[1][k] / (1 - 0.99**step)) + 1e-8))
            w, v, bias = new
    return FactorizationMachine(buckets, slots, float(bias), w, v)


def _hashed(buckets: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted({zlib.crc32(t) % buckets for t in terms(x)}) for x in column_bytes(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "toxic", "terms"])

    return make


def train(docs: DataFrame, labels: DataFrame, *, sample: int = 8000, buckets: int = 1 << 18) -> FactorizationMachine:
    """Fits on at most ``sample`` labelled rows outside the held-out fold."""
    key = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (key % MOD != HELD))
    own = own.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    joined = texts.join(F.broadcast(own), "doc_id").select("doc_id", "toxic", "text")  # bounded by ``sample``
    got = joined.mapInArrow(lean(_hashed(buckets)), "doc_id long, toxic int, terms array<int>").orderBy("doc_id").limit(sample).toArrow()
    return fit(got.column("terms").to_pylist(), got.column("toxic").to_numpy().astype(float), buckets)


def _score(model: FactorizationMachine, threshold: float, most: int = 300_000):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for b in batches:
            scores = []
            for text in column_bytes(b, "text"):
                own = set()
                for word in set(text.lower().split()):
                    if (at := known.get(word)) is None:
                        if len(known) >= most:
                            known.clear()
                        at = known[word] = model.slot(word.strip(_EDGE)) if word.strip(_EDGE) else -1
                    if at >= 0:
                        own.add(at)
                scores.append(model.score(sorted(own)))
            held = [remainder(i, MOD) == HELD for i in b.column("doc_id").to_pylist()]
            out = np.array(scores, float)
            kept = [n for n in b.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), b.column("text"), pa.array(held, pa.bool_()), pa.array(out), pa.array((out >= threshold).astype(np.int32))], names=[*kept, "text", "held_out", "score", "predicted"])

    return make


def toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, sample: int = 8000) -> DataFrame:
    """doc_id, text, held_out, score and predicted for every row; ``_rest`` holds the other columns, if any."""
    model = train(docs, labels, sample=sample)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), *([F.struct(*rest).alias("_rest")] if rest else []), "text")
    ddl = "".join(f"{c} {t}, " for c, t in source.dtypes) + "held_out boolean, score double, predicted int"
    return source.mapInArrow(lean(_score(model, threshold)), ddl)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity(documents(spark, sf_dir).select("doc_id", "text"), labels).drop("text")
