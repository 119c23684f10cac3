"""Ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - f), with one hashed-text score f for all grades and ordered
thresholds.  The fit takes the labelled rows whose hash lies in a share that gives ``SAMPLE`` of them (a documented
bound; all, if there are fewer) in one task; the share is found from the labels alone, and the ids are sent to the
texts.  Every document is scored over its whole text.

Defined cases: a null or empty text has f = 0; rows without a grade are scored, not learned from; without
any labels, f = 0 and one grade 0; repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recengine.llm.common import slices, texts, word_hashes

BUCKETS, SAMPLE, STEPS, L2 = 1 << 16, 8000, 120, 1e-4
_LETTERS = bytes(b for b in range(256) if b >= 128 or chr(b).isalnum())


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and unit-length log counts of the words and of what is left of them without letters."""
    raw = text.encode()
    tokens = raw.split() + [b"\0" + t for t in raw.translate(None, _LETTERS).split()]
    if not tokens:
        return np.empty(0, np.int64), np.empty(0)
    at, n = np.unique((word_hashes().of(tokens) % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
    v = np.log1p(n)
    return at, v / np.sqrt((v * v).sum())


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: list[str], grades: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds (Adam on the whole sample)."""
    k = int(grades.max()) + 1
    xs = [features(t) for t in rows]
    row = np.repeat(np.arange(len(xs)), [len(a) for a, _ in xs])
    at, v = np.concatenate([a for a, _ in xs]), np.concatenate([b for _, b in xs])
    share = np.clip(np.cumsum(np.bincount(grades, minlength=k))[:-1] / len(grades), 0.01, 0.99)
    first = np.log(share / (1 - share))
    p = np.concatenate([np.zeros(BUCKETS), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    m, s = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, STEPS + 1):
        f = np.bincount(row, v * p[at], len(xs))
        gaps = np.exp(p[BUCKETS + 1:])
        theta = np.concatenate([[-np.inf], p[BUCKETS] + np.concatenate([[0], np.cumsum(gaps)]), [np.inf]])
        hi, lo = _sigmoid(theta[grades + 1] - f), _sigmoid(theta[grades] - f)
        prob = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi) / prob, lo * (1 - lo) / prob
        gf = (dhi - dlo) / len(xs)
        gt = np.array([(-dhi[grades == j].sum() + dlo[grades == j + 1].sum()) / len(xs) for j in range(k - 1)])
        g = np.concatenate([np.bincount(at, v * gf[row], BUCKETS) + L2 * p[:BUCKETS], [gt.sum()],
                            gaps * np.array([gt[j + 1:].sum() for j in range(k - 2)])])
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        p -= 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-8)
    return p[:BUCKETS], p[BUCKETS] + np.concatenate([[0], np.cumsum(np.exp(p[BUCKETS + 1:]))])


def classify(docs: DataFrame, labels: DataFrame, grade: str = "quality", at_least: int = 1, tail: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, tail_probability (grade >= ``at_least``), keep."""
    spark = docs.sparkSession
    rated = labels.select("doc_id", F.col(grade).cast("int").alias("y")).where("y >= 0")
    share = math.ceil(min(1.0, SAMPLE / max(rated.count(), 1)) * (1 << 30))
    chosen = rated.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share)
    # broadcast: about SAMPLE ids and grades, whatever the input
    sample = texts(docs).join(F.broadcast(chosen), "doc_id")

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        w, theta = fit(pdf["text"].tolist(), pdf["y"].to_numpy())
        return pd.DataFrame({"w": [w.astype("<f8").tobytes()], "theta": [theta.astype("<f8").tobytes()]})

    got = sample.groupBy().applyInPandas(learn, "w binary, theta binary").collect()  # one model of BUCKETS weights
    w = np.frombuffer(got[0].w, "<f8") if got else np.zeros(BUCKETS)
    theta = np.frombuffer(got[0].theta, "<f8") if got else np.empty(0)
    model = spark.sparkContext.broadcast((w, theta))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, theta = model.value
        for batch in slices(batches, 8 << 20):
            f = np.array([(w[a] * v).sum() for a, v in map(features, batch.column(1).to_pylist())], float)
            above = 1 - _sigmoid(theta[None, :] - f[:, None])
            p = above[:, at_least - 1] if at_least <= len(theta) else np.zeros(len(f))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(above.sum(1)), pa.array(p), pa.array(p >= tail)],
                                             ["doc_id", "expected_grade", "tail_probability", "keep"])

    return texts(docs).mapInArrow(run, "doc_id long, expected_grade double, tail_probability double, keep boolean")
