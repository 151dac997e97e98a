"""Hashed byte n-gram features and a small linear learner, shared by the classifiers.

The learner runs in one task over a bounded sample: features are made where the sampled
texts are, meet in one executor, and only the fitted model comes to the driver.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from korpuslab.llm.common import quoted

#: Buckets of the hashed features, the length of a gram, and the bytes hashed at once.
BUCKETS_LOG2, GRAM, BLOCK = 12, 3, 1 << 20
BUCKETS = 1 << BUCKETS_LOG2
#: Documents whose features a task holds at once.
ROWS = 256


def features(texts: list[str | None], lower: bool) -> np.ndarray:
    """A row for each text: square roots of the shares of its hashed 3-byte grams, of length 1.

    Whole texts count, with a space at each end; a null text is an empty one.
    """
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for row, text in zip(out, texts, strict=True):
        raw = (f" {text.lower() if lower else text} " if text else "   ").encode("utf-8", "surrogatepass")
        for at in range(0, len(raw) - GRAM + 1, BLOCK):
            b = np.frombuffer(raw[at : at + BLOCK + GRAM - 1], np.uint8).astype(np.uint32)
            code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
            row += np.bincount((code * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS_LOG2), minlength=BUCKETS)
    np.sqrt(out, out=out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 200, penalty: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and offsets of a logistic model for each column of targets (0 to 1), by accelerated gradient steps.

    Deterministic: starts at zero, full batches, a step set by the features' largest variance.
    """
    mean = x.mean(0)
    x -= mean  # in place: the sample is the largest thing a fit holds
    v = np.ones(x.shape[1], np.float32) / np.sqrt(x.shape[1])
    for _ in range(20):  # the largest eigenvalue of the covariance
        v = x.T @ (x @ v)
        size = float(np.linalg.norm(v)) or 1.0
        v /= size
    step = 1.0 / (0.25 * (size / len(x) + 1.0) + penalty)
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    last_w, last_b = w.copy(), b.copy()
    scale = np.float32(8.0)  # unit-length rows are short: their weights may be long
    for t in range(steps):
        k = t / (t + 3.0)
        at_w, at_b = w + k * (w - last_w), b + k * (b - last_b)
        gap = 1.0 / (1.0 + np.exp(-(scale * (x @ at_w) + at_b))) - y
        last_w, last_b = w, b
        w = (at_w - step / scale * (scale * (x.T @ gap) / len(x) + penalty * at_w)).astype(np.float32)
        b = (at_b - step * gap.mean(0)).astype(np.float32)
    w *= scale
    x += mean
    return w, (b - mean @ w).astype(np.float32)


def sample_rows(rows: DataFrame, label: str, total: int) -> DataFrame:
    """At most ``total`` rows, the same number of each label, in the order of a hash of ``doc_id`` and ``text``.

    Counts come first, so only a few times the sample is ever ranked; the row of least hash is always among
    them, so no label gets lost, however its rows repeat. Of more than ``total`` labels those with most rows count.
    """
    at = F.abs(F.xxhash64(F.lit("sample"), "doc_id", "text") % 1_000_000) / 1_000_000
    rows = rows.withColumn("_at", at)
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_least")).orderBy(F.desc("_n"), label).limit(total)
    each = max(1, total // max(1, counts.count()))
    near = rows.join(F.broadcast(counts), label).where((F.col("_at") * F.col("_n") < 4 * each + 100) | (F.col("_at") == F.col("_least")))
    rank = F.row_number().over(W.partitionBy(label).orderBy("_at", "doc_id"))
    return near.withColumn("_rank", rank).where(F.col("_rank") <= each).drop("_n", "_at", "_least", "_rank")


def _features(make: Callable[[list[str | None]], np.ndarray], others: list[str]):
    """Rows with the text replaced by its features as bytes, ``x``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.schema.get_field_index("text")
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = make(part.column(texts).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), pa.array([r.tobytes() for r in x], pa.binary())], names=[*others, "x"])

    return run


def fitted(rows: DataFrame, make: Callable[[list[str | None]], np.ndarray], fit: Callable[[np.ndarray, dict[str, list]], Any]) -> Any:
    """What ``fit`` makes of the features and other columns of sampled rows, in one task; None if there are no rows.

    Rows come to it in the order of their columns, so the fit does not depend on the run.
    """
    others = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(*(batch.column(c).to_pylist() for c in others), batch.column("x").to_pylist()) for batch in batches]
        columns = [[x for part in held for x in part[i]] for i in range(len(others) + 1)]
        raw = columns.pop()
        order = sorted(range(len(raw)), key=lambda i: (*((c[i] is not None, c[i]) for c in columns), raw[i]))
        if order:
            x = np.frombuffer(b"".join(raw[i] for i in order), np.float32).reshape(len(order), -1).copy()
            model = fit(x, {name: [c[i] for i in order] for name, c in zip(others, columns, strict=True)})
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    made = rows.mapInArrow(_features(make, others), ", ".join(f"{quoted(c)} {t}" for c, t in rows.dtypes if c != "text") + ", x binary")
    found = made.repartition(1).mapInArrow(run, "model binary").first()
    return None if found is None else pickle.loads(found["model"])
