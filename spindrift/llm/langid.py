"""Language identification by nearest centroid.

A document is the TF-IDF vector of its hashed byte 1- to 3-grams (letters lowered, other characters
ignored), length-normalised. Document frequencies come from every training row. Per language a bounded
sample of training vectors is clustered by spherical k-means into several centroids. A document takes the
language of its nearest centroid by cosine; one farther from it than the language's radius is rejected. Radii go by length, as
distinct n-grams: few are far from any centroid, so each class of lengths has its own radius, between what letter soup of
that length reaches and what the language's sample does at that length, each half of it against centroids of the other half.

Defined cases: null text, or text without a letter, is language "und" with score 0, rejected; null languages
are not learned; repeated rows count each time; with no training rows every document is "und"; ties go to the
alphabetically first language; texts of any length are read whole, in steps; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from spindrift.llm.common import crc32_text, documents, steps, text_bytes

#: Buckets of the n-grams of each order; 4096 in all.
ORDERS = ((1, 256), (2, 1024), (3, 2816))
DIM = sum(n for _, n in ORDERS)
#: Training vectors a language that centroids are fitted on (those of least hash), and centroids a language.
SAMPLE, CENTROIDS, ROUNDS = 500, 4, 12
#: Ids of the sample that are broadcast at most.
SENT_IDS = 1_000_000
#: A document is rejected below this share of the median cosine that its language's pieces of its length have to centroids fitted without them,
#: and below what letter soup of its length reaches (all but a hundredth of it, and a tenth more), unless that is over KEPT of what all but a hundredth of the pieces reach, as is the radius of texts of SHORT distinct n-grams and fewer.
RADIUS, KEPT, SHORT = 0.28, 0.9, 32
#: Texts a language needs for that; centroids of fewer are the texts themselves, whose own cosines say nothing of others, and take LOOSE of the cosine.
LEAST_TEXTS, LOOSE = 20, 0.05
#: Classes of lengths (powers of two of distinct n-grams), bytes of a sample's text that pieces are taken from, pieces a class needs, and soups of a length.
LENGTHS, PIECES_FROM, LEAST_PIECES, SOUPS = 12, 4096, 3, 200
#: ASCII letters lowered, bytes of other characters as they are, all else 0.
LETTER = np.zeros(256, np.uint8)
LETTER[65:91] = np.arange(97, 123)
LETTER[97:123] = np.arange(97, 123)
LETTER[128:] = np.arange(128, 256)


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # (languages * CENTROIDS, DIM)
    radius: np.ndarray  # by centroid and class of lengths


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def gram_counts(raw: np.ndarray) -> np.ndarray:
    """Counts of the hashed n-grams of one text; n-grams with a non-letter are left out, but word ends count as 0."""
    b = LETTER[raw]
    out = np.zeros(DIM, np.float32)
    if not len(b):
        return out
    keep = b != 0
    keep[1:] |= b[:-1] != 0
    b = np.concatenate([[0], b[keep], [0]]).astype(np.uint32)  # runs of other characters become one word end
    at = 0
    for n, size in ORDERS:
        code = b[: len(b) - n + 1].copy()
        for j in range(1, n):
            code = code * np.uint32(257) + b[j : len(b) - n + 1 + j]
        if n == 1:
            code = code[code != 0]
        else:
            code = (code * np.uint32(2654435761)) >> np.uint32(12)
        out[at : at + size] = np.bincount(code % np.uint32(size), minlength=size)[:size]
        at += size
    return out


def vectors(data: np.ndarray, offsets: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.stack([gram_counts(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
    v = np.log1p(v) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def length_class(v: np.ndarray) -> np.ndarray:
    """The power of two of each text's distinct n-grams: a text that repeats itself is as short as what it repeats."""
    return np.clip(np.log2(np.maximum(np.count_nonzero(v, axis=1), 1)).astype(np.int64), 0, LENGTHS - 1)


def soups(n: int, count: int) -> list[bytes]:
    """Random letters in words of random lengths, n letters each; the same ones every time."""
    rng = np.random.default_rng(n)
    out = []
    for _ in range(count):
        letters = rng.integers(97, 123, n).astype(np.uint8)
        cut = np.cumsum(rng.integers(2, 10, n))
        out.append(b" ".join(p.tobytes() for p in np.split(letters, cut[cut < n])))
    return out


def joined(parts: list[bytes], idf: np.ndarray) -> np.ndarray:
    return vectors(np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0] + [len(p) for p in parts]), idf)


def radii(texts: list[bytes], v: np.ndarray, idf: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Radius of each class of lengths: between what letter soup and what pieces of the texts, from the start and the middle, reach at that
    length. Each half of the texts meets centroids of the other half; medians don't mind a sample's junk."""
    halves = [cluster(v[h::2], min(CENTROIDS, len(v[h::2]))) for h in (0, 1)]
    letters = [np.flatnonzero(LETTER[np.frombuffer(t, np.uint8)]) for t in texts]
    own, own_class, soup, soup_class = [], [], [], []
    for k in range(LENGTHS):
        for h in (0, 1):
            parts = [t[at[i] : at[i + 2**k - 1] + 1] for t, at in list(zip(texts, letters, strict=True))[1 - h :: 2] for i in {0, len(at) // 2} if i + 2**k <= len(at)]
            if parts:
                p = joined(parts, idf)
                own.append((p @ halves[h].T).max(axis=1))
                own_class.append(length_class(p))
        p = joined(soups(2**k, SOUPS), idf)
        soup.append((p @ c.T).max(axis=1))
        soup_class.append(length_class(p))
    own, own_class, soup, soup_class = (np.concatenate(x) if x else np.zeros(0) for x in (own, own_class, soup, soup_class))
    out = np.zeros(LENGTHS)
    for k in range(LENGTHS):
        mine, other = own[own_class == k], soup[soup_class == k]
        if len(mine) < LEAST_PIECES:
            out[k] = out[k - 1] if k else 0.0  # no text is so long: the looser radius of shorter ones
            continue
        low = KEPT * np.quantile(mine, 0.01)
        out[k] = max(RADIUS * np.median(mine), min(1.1 * np.quantile(other, 0.99), low) if len(other) else 0.0)
        if 2**k <= SHORT:
            out[k] = min(out[k], low)
    return out


def nearest_of(m: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid of each text, the cosine to it, and whether that is beyond the radius."""
    v = vectors(data, offsets, m.idf)
    cosine = v @ m.centroids.T
    best = cosine.argmax(axis=1)
    score = np.clip(cosine[np.arange(len(best)), best].astype(float), 0, 1)
    return best, score, score < m.radius[best, length_class(v)]


def document_frequencies(train: DataFrame) -> np.ndarray:
    """Of all training rows: how many texts hold each bucket; the last entry is the number of texts. One small row a partition."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIM + 1, np.int64)
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                total[:-1] += gram_counts(data[a:b]) > 0
                total[-1] += 1
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], ["n"])

    counts = train.select("text").mapInArrow(count, "n array<long>")
    sums = counts.select(F.posexplode("n").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect()  # DIM + 1 rows
    df = np.zeros(DIM + 1)
    for r in sums:
        df[r["i"]] = r["n"]
    return df


def cluster(v: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from farthest-first seeds; deterministic for an order of rows."""
    seeds = [v.mean(axis=0)]
    seeds[0] = seeds[0] / max(np.linalg.norm(seeds[0]), 1e-9)
    while len(seeds) < k:
        seeds.append(v[np.argmin((v @ np.stack(seeds).T).max(axis=1))])
    c = np.stack(seeds)
    for _ in range(ROUNDS):
        near = (v @ c.T).argmax(axis=1)
        c = np.stack([v[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(k)])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def fit(docs: DataFrame, train: Column) -> Model | None:
    """docs(doc_id, text, lang); train marks the rows to learn from. The sample: the SAMPLE rows a language of least hash."""
    rows = docs.where(train & F.col("lang").isNotNull() & has_letter(F.col("text"))).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    df = document_frequencies(rows)
    if not df[-1]:
        return None
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 0.1).astype(np.float32)
    order = W.partitionBy("lang").orderBy(F.xxhash64(F.col("doc_id")), "doc_id")
    ids = rows.select("doc_id", "lang").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= SAMPLE).select("doc_id").distinct()
    ids = F.broadcast(ids) if ids.count() <= SENT_IDS else ids
    sample = rows.join(ids, "doc_id", "left_semi").select("lang", "doc_id", "text")

    def vectorise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            for i, j in steps(offsets, 1 << 20):
                o = offsets[i : j + 1]
                v = vectors(data[o[0] : o[-1]], o - o[0], idf)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array([x.tobytes() for x in v], pa.binary()), pa.array([data[a : min(a + PIECES_FROM, b)].tobytes() for a, b in zip(o[:-1], o[1:], strict=True)], pa.binary())], ["lang", "doc_id", "v", "head"])

    def centroids(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id").head(SAMPLE)
        v = np.stack([np.frombuffer(x, np.float32) for x in group["v"]])
        c = cluster(v, min(CENTROIDS, len(v)))
        if len(v) < LEAST_TEXTS:
            radius = np.full(LENGTHS, np.quantile((v @ c.T).max(axis=1), 0.01) * LOOSE)
        else:
            radius = radii(group["head"].tolist(), v, idf, c)
        return pd.DataFrame({"lang": group["lang"].iloc[0], "c": [x.tobytes() for x in c.astype(np.float32)], "radius": [radius.tolist()] * len(c)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    # a language's group is SAMPLE rows at most (more only if ids repeat, and then cut again)
    found = sample.mapInArrow(vectorise, f"lang string, doc_id {kind}, v binary, head binary").groupBy("lang").applyInPandas(centroids, "lang string, c binary, radius array<double>").collect()
    found = sorted(found, key=lambda r: (r["lang"], r["c"]))
    return Model([r["lang"] for r in found], idf, np.stack([np.frombuffer(r["c"], np.float32) for r in found]), np.array([r["radius"] for r in found]))


def predict(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, rejected) of each row; score is the cosine to the nearest centroid."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.when(has_letter(F.col(text)), F.col(text)).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # languages * CENTROIDS vectors of DIM floats

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            known = np.asarray(batch.column(1).is_valid())
            for i, j in steps(offsets, 1 << 20):
                n = j - i
                best, score, far = np.zeros(n, np.int64), np.zeros(n), np.ones(n, bool)
                if m is not None:
                    o = offsets[i : j + 1]
                    best, score, far = nearest_of(m, data[o[0] : o[-1]], o - o[0])
                ok = known[i:j] & (m is not None)
                langs = [m.langs[b] if k else "und" for b, k in zip(best, ok, strict=True)] if m is not None else ["und"] * n
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), pa.array(langs, pa.string()), pa.array(np.where(ok, score, 0.0)), pa.array(far | ~ok)], ["key", "lang_pred", "score", "rejected"])

    return rows.mapInArrow(nearest, f"key {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("key", key)


def keep_accepted(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs' rows, all columns, without those that predict() rejects; one narrow pass, no join."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(at))
            flag = np.asarray(batch.column(batch.num_columns - 1))
            for i, j in steps(offsets, 1 << 20):
                keep = np.zeros(j - i, bool)
                if m is not None:
                    o = offsets[i : j + 1]
                    keep = ~nearest_of(m, data[o[0] : o[-1]], o - o[0])[2] & flag[i:j]
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(part.columns[:-1], names=part.schema.names[:-1]).filter(pa.array(keep))

    marked = docs.select("*", has_letter(F.col(text)).alias("__has_letter"))
    return marked.mapInArrow(accept, docs.schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held = crc32_text(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    found = predict(docs, fit(docs, ~held))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
