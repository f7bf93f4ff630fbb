"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of a text (lengths, character classes, repetition of words and lines, entropy) are standardised and
mapped by random Fourier features, whose inner products approximate a Gaussian kernel. Each partition sums its
normal equations; their total gives the ridge scores. A part of the labelled rows that the ridge has not seen
calibrates the scores: label rates by score bin, pooled until they rise (pool adjacent violators).

Defined cases: null and empty texts have all-zero statistics and a score like any other; null labels are left
out, several labels of a row count each; with no labels every score is 0.5; an empty table gives an empty table;
repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import SPACE, crc32_text, documents, staged, steps, table, text_bytes, word_hashes, words

FEATURES, GAMMA, RIDGE, SEED = 256, 0.05, 1.0, 11
BINS = 512
#: Pseudo-counts at the overall rate, spread over the bins as their rows are.
PRIOR = 2.0
CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "stop": b".,;:", "mark": b"!?", "odd": b"#$%&*+=<>@^~\\", "bar": b"|/_-", "bracket": b"()[]{}\"'`", "high": range(128, 256)}
KIND = np.zeros(256, np.uint8)
for _i, _bytes in enumerate(CLASSES.values(), 1):
    KIND[list(_bytes)] = _i
STATISTICS = ["bytes", "words", "lines", "word_mean", "word_sd", "long_words", "distinct_words", "top_word", "same_next", "distinct_lines", "entropy", "spaces", *CLASSES, "odd_words", "upper_words"]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, statistics) of the texts in data."""
    n = len(offsets) - 1
    out = np.zeros((n, len(STATISTICS)))
    start, end, doc = words(data, offsets)
    h = word_hashes(data, start, end) if len(start) else np.zeros(0, np.uint64)
    odd = np.concatenate([[0], np.cumsum(KIND[data] == 6)])
    upper = np.concatenate([[0], np.cumsum(KIND[data] == 1)])
    size = end - start
    weird, loud = (odd[end] - odd[start]) >= 2, (upper[end] - upper[start]) >= np.maximum(2, 0.8 * size - 2)
    at = np.searchsorted(doc, np.arange(n + 1))
    for i in range(n):
        raw = data[offsets[i] : offsets[i + 1]]
        if not len(raw):
            continue
        kinds = np.bincount(KIND[raw], minlength=len(CLASSES) + 1)[1:] / len(raw)
        p = np.bincount(raw, minlength=256)
        p = p[p > 0] / len(raw)
        lines = raw.tobytes().split(b"\n")
        w, k = slice(at[i], at[i + 1]), at[i + 1] - at[i]
        row = [np.log1p(len(raw)), np.log1p(k), np.log1p(len(lines))]
        if k:
            s, x = size[w], h[w]
            _, times = np.unique(x, return_counts=True)
            row += [s.mean() / 10, s.std() / 10, (s > 20).mean(), len(times) / k, times.max() / k, (x[1:] == x[:-1]).mean() if k > 1 else 0.0]
        else:
            row += [0.0] * 6
        row += [len(set(lines)) / len(lines), float(-(p * np.log2(p)).sum()) / 8, SPACE[raw].mean(), *kinds]
        row += [weird[w].mean(), loud[w].mean()] if k else [0.0, 0.0]
        out[i] = row
    return out


def statistics_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, x array<double>) of each row; a narrow pass over the text."""
    kind = docs.schema[key].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for i, j in steps(offsets):
                o = offsets[i : j + 1]
                x = statistics(data[o[0] : o[-1]], o - o[0])
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), flat], ["key", "x"])

    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(each, f"key {kind}, x array<double>").withColumnRenamed("key", key)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray  # scores and calibrated probabilities
    rates: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return fourier((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.rates), 0, 1)


def fourier(z: np.ndarray) -> np.ndarray:
    """Random Fourier features of exp(-GAMMA |x - y|^2), the standardised statistics themselves, and a constant."""
    rng = np.random.default_rng(SEED)
    w = rng.normal(0, np.sqrt(2 * GAMMA), (z.shape[1], FEATURES))
    b = rng.uniform(0, 2 * np.pi, FEATURES)
    z = np.clip(z, -8, 8)
    return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ w + b), np.ones((len(z), 1))])


def column(batch: pa.RecordBatch, i: int) -> np.ndarray:
    return np.asarray(batch.column(i).flatten()).reshape(batch.num_rows, -1)


def summed(rows: DataFrame, of) -> np.ndarray | None:  # noqa: ANN001
    """The sum over all rows of of(x, y), a vector a partition; partitions' vectors are added entry by entry on the executors."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                v = of(column(batch, 0), np.asarray(batch.column(1)))
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["v"])

    got = rows.select("x", "y").mapInArrow(each, "v array<double>").select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()  # as many rows as the vector has entries
    return np.array([r["v"] for r in sorted(got, key=lambda r: r["i"])]) if got else None


def isotonic(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Rising rates nearest to y by weight n: pool adjacent violators."""
    pools: list[list[float]] = []
    for rate, weight in zip(y, n, strict=True):
        pools.append([rate, weight, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            r, w, c = pools.pop()
            p = pools[-1]
            p[0] = (p[0] * p[1] + r * w) / (p[1] + w)
            p[1] += w
            p[2] += c
    return np.concatenate([np.full(int(c), r) for r, _, c in pools])


def fit(train: DataFrame, calibrate: Column) -> Model | None:
    """train(x, y, ...): rows where calibrate is false give the ridge, the others its calibration."""
    ridge, cal = train.where(~calibrate), train.where(calibrate)
    moments = summed(ridge, lambda x, y: np.concatenate([[len(x)], x.sum(axis=0), (x**2).sum(axis=0)]))
    if moments is None:
        return None
    k = len(STATISTICS)
    mean = moments[1 : k + 1] / moments[0]
    scale = np.sqrt(np.maximum(moments[k + 1 :] / moments[0] - mean**2, 0))
    scale = np.where(scale > 1e-6, scale, 1.0)

    def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        f = fourier((x - mean) / scale)
        return np.concatenate([(f.T @ f).ravel(), f.T @ y])

    total = summed(ridge, equations)
    m = FEATURES + 1
    a, b = total[: m * m].reshape(m, m), total[m * m :]
    penalty = np.eye(m) * RIDGE
    penalty[-1, -1] = 1e-6
    model = Model(mean, scale, np.linalg.solve(a + penalty, b), np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def binned(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = np.clip((model.raw(x) + 0.5) / 2 * BINS, 0, BINS - 1).astype(int)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, weights=y, minlength=BINS)])

    bins = summed(cal, binned)
    if bins is not None:
        n, y = bins[:BINS], bins[BINS:]
        used = n > 0
        rate = y.sum() / n.sum()
        rates = isotonic((y[used] + PRIOR * rate * n[used] / n.sum()) / (n[used] + PRIOR * n[used] / n.sum()), n[used])
        model.knots = ((np.arange(BINS) + 0.5) / BINS * 2 - 0.5)[used]
        model.rates = rates
    return model


def score(stats: DataFrame, model: Model | None, key: str = "doc_id") -> DataFrame:
    kind = stats.schema[key].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = model.score(column(batch, 1)) if model else np.full(batch.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], ["key", "score"])

    return stats.select(F.col(key).alias("key"), "x").mapInArrow(each, f"key {kind}, score double").withColumnRenamed("key", key)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = crc32_text(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5
    stats = staged(spark, statistics_of(documents(spark, sf_dir).select("doc_id", "text")), "quality")
    labels = table(spark, sf_dir, "labels").where("quality is not null").select("doc_id", F.col("quality").cast("double").alias("y"))
    train = stats.join(labels, "doc_id").where(fold != 0)
    model = fit(train, fold == 4)
    found = score(stats, model)
    return found.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
