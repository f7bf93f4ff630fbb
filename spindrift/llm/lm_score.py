"""LM scoring by masked pseudo-likelihood: a small bidirectional window network predicts each token from both sides.

Tokens are words (A-Z lowered), hashed to BUCKETS buckets whose counts are taken over the whole corpus. The most frequent buckets have a
row each, the others share rows by hash; rows are dealt to classes of equal size by frequency. The network sees
the REACH tokens on each side of a masked position: their rows' embeddings, each scaled by its offset's gate, are summed through a
tanh layer; one softmax predicts the token's class, a second one, trained for each class, the row within it. Both see the context and begin
at the corpus shares. Only buckets that share a row are told apart by their corpus shares alone. A document's score is the sum of the
log-probabilities of all its tokens.

Each round of training masks one in MASK positions of the documents, by hash, other ones each round, and one of each document at
least, so examples grow with the corpus. They are dealt to shards by a hash of the document's key and text, as many shards as the
corpus' tokens ask for (a shard's examples are bounded by that), and sorted there, so a model doesn't depend on how the files were dealt to partitions. In a round each
shard makes one pass of mini-batch steps from the round's parameters, and the results are averaged by
examples in a tree of grouped jobs, so the driver gets a few parameter sets at most.

Defined cases: null, empty and wordless texts have no tokens, sum 0 and a null mean; repeated rows have equal scores, as have ties of a key; a very long
text is one row of examples, a sixth of its size or so; rows without a key are dealt by their place in the input, rows that
repeat key and text meet in one shard; with no
training examples the network is its initial one; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import LOWER, documents, mix, staged, steps, text_bytes, word_hashes, words

BUCKETS, CLASSES, INPUTS = 1 << 16, 64, 1 << 12
SLOTS = INPUTS // CLASSES
REACH, WIDTH = 3, 24
OFFSETS = [o for o in range(-REACH, REACH + 1) if o]
MASK, ROUNDS, BATCH, RATE, SEED = 16, 3, 512, 2.0, 3
TOKENS_A_SHARD = 1 << 22
#: Partitions whose parameters one group averages.
FAN_IN = 16
SHAPES = {"embed": (INPUTS + 1, WIDTH), "gate": (len(OFFSETS), WIDTH), "bias": (WIDTH,), "out": (WIDTH, CLASSES), "out_bias": (CLASSES,), "inner": (CLASSES, WIDTH, SLOTS), "inner_bias": (CLASSES, SLOTS)}
POSITIONS_AT_ONCE = 1 << 14


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of each word."""
    data = LOWER[data]
    start, end, doc = words(data, offsets)
    h = word_hashes(data, start, end) if len(start) else np.zeros(0, np.uint64)
    return (h >> np.uint64(48)).astype(np.int64), doc


@dataclass
class Vocabulary:
    """Row of each bucket, log-share of the bucket in its row, and log of each row's share of the corpus. A row's class is
    row // SLOTS, its slot there row % SLOTS."""

    row: np.ndarray
    share: np.ndarray
    prior: np.ndarray

    @staticmethod
    def of(counts: np.ndarray) -> Vocabulary:
        """The most frequent buckets have half of the rows, one each; the others share the rest by hash."""
        n = counts + 1.0
        order = np.argsort(-n, kind="stable")
        row = np.zeros(BUCKETS, np.int64)
        row[order] = np.where(np.arange(BUCKETS) < INPUTS // 2, np.arange(BUCKETS), INPUTS // 2 + order % (INPUTS - INPUTS // 2))
        total = np.bincount(row, weights=n, minlength=INPUTS)
        return Vocabulary(row, np.log(n / total[row]), np.log(total / total.sum()))


def initial(prior: np.ndarray | None = None) -> np.ndarray:
    """All parameters as one vector: small random embeddings and output weights, open gates, biases that give the corpus shares."""
    rng = np.random.default_rng(SEED)
    parts = {"embed": rng.normal(0, 0.3, SHAPES["embed"]), "gate": np.ones(SHAPES["gate"]), "bias": np.zeros(SHAPES["bias"]), "out": rng.normal(0, 0.1, SHAPES["out"]), "inner": rng.normal(0, 0.1, SHAPES["inner"])}
    prior = np.zeros(SHAPES["inner_bias"]) if prior is None else prior.reshape(SHAPES["inner_bias"])
    parts["out_bias"] = np.log(np.exp(prior).sum(axis=1))
    parts["inner_bias"] = prior - parts["out_bias"][:, None]
    return np.concatenate([parts[k].ravel() for k in SHAPES]).astype(np.float32)


def unpacked(vector: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = vector[at : at + n].reshape(shape)
        at += n
    return out


def contexts(row: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(positions, offsets) input rows around each position; INPUTS (a zero-trained row of its own) beyond the text."""
    out = np.full((len(at), len(OFFSETS)), INPUTS, np.int64)
    for k, o in enumerate(OFFSETS):
        j = at + o
        ok = (j >= 0) & (j < len(row))
        ok[ok] = doc[j[ok]] == doc[at[ok]]
        out[ok, k] = row[j[ok]]
    return out


def hidden(p: dict[str, np.ndarray], context: np.ndarray) -> np.ndarray:
    total = np.zeros((len(context), WIDTH), np.float32) + p["bias"]
    for k in range(len(OFFSETS)):
        total += p["embed"][context[:, k]] * p["gate"][k]
    return np.tanh(total)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    z /= z.sum(axis=1, keepdims=True)
    return z


def by_class(row: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order of the rows by class, and (class, first, last) of each run in it."""
    klass = row // SLOTS
    order = np.argsort(klass, kind="stable")
    upto = np.concatenate([[0], np.cumsum(np.bincount(klass, minlength=CLASSES))])
    return order, [(c, upto[c], upto[c + 1]) for c in range(CLASSES) if upto[c] < upto[c + 1]]


def log_probabilities(p: dict[str, np.ndarray], context: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Of each row, given its context: of its class, and of it within the class."""
    order, runs = by_class(row)
    h, row = hidden(p, context)[order], row[order]
    found = np.log(softmax(h @ p["out"] + p["out_bias"])[np.arange(len(row)), row // SLOTS])
    for c, i, j in runs:
        found[i:j] += np.log(softmax(h[i:j] @ p["inner"][c] + p["inner_bias"][c])[np.arange(j - i), row[i:j] % SLOTS])
    out = np.zeros(len(row), np.float32)
    out[order] = found
    return out


def train(vector: np.ndarray, context: np.ndarray, row: np.ndarray, rate: float) -> np.ndarray:
    """One pass of mini-batch gradient steps over the examples."""
    vector = vector.copy()
    p = unpacked(vector)
    for i in range(0, len(row), BATCH):
        order, runs = by_class(row[i : i + BATCH])
        c, y = context[i : i + BATCH][order], row[i : i + BATCH][order]
        h = hidden(p, c)
        z = softmax(h @ p["out"] + p["out_bias"])
        z[np.arange(len(y)), y // SLOTS] -= 1
        step = np.float32(rate / len(y))
        back = z @ p["out"].T
        for k, a, b in runs:
            inner = p["inner"][k]
            d = softmax(h[a:b] @ inner + p["inner_bias"][k])
            d[np.arange(b - a), y[a:b] % SLOTS] -= 1
            back[a:b] += d @ inner.T
            d *= np.float32(rate / max(b - a, 16))  # a mean over many examples, a fixed rate for each of a few
            inner -= h[a:b].T @ d
            p["inner_bias"][k] -= d.sum(axis=0)
        back *= 1 - h * h
        p["out"] -= step * (h.T @ z)
        p["out_bias"] -= step * z.sum(axis=0)
        p["bias"] -= step * back.sum(axis=0)
        flat = c.ravel()
        e = p["embed"][flat].reshape(len(y), len(OFFSETS), WIDTH)
        # embeddings take the whole rate: each row is in few examples of a batch; the parts of a row are summed, then taken off
        parts = (back[:, None, :] * (p["gate"] * np.float32(rate / 16))).reshape(-1, WIDTH)
        order = np.argsort(flat, kind="stable")
        rows = flat[order]
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        p["embed"][rows[first]] -= np.add.reduceat(parts[order], first, axis=0)
        p["gate"] -= step * (back[:, None, :] * e).sum(axis=0)
    return vector


def count_tokens(docs: DataFrame) -> np.ndarray:
    """Corpus counts of the buckets, over all rows; partial counts are added by bucket on the executors."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for i, j in steps(offsets):
                o = offsets[i : j + 1]
                total += np.bincount(tokens(data[o[0] : o[-1]], o - o[0])[0], minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    got = docs.select("text").mapInArrow(each, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # BUCKETS rows at most
    counts = np.zeros(BUCKETS)
    counts[got["bucket"].to_numpy(np.int64)] = got["n"]
    return counts


def masked_at(bucket: np.ndarray, doc: np.ndarray, n: int, round_: int) -> np.ndarray:
    """The positions that a round masks in n texts: other ones each round, and one of each text with tokens at least."""
    if not len(doc):
        return doc
    first = np.searchsorted(doc, np.arange(n + 1))
    place = np.arange(len(doc)) - first[doc]
    # by place, and by the sum of the text's buckets, so that texts don't mask the same places
    own = np.bincount(doc, weights=bucket, minlength=n).astype(np.uint64)[doc]
    h = mix((place.astype(np.uint64) << np.uint64(40)) + own)
    some = np.flatnonzero(np.diff(first))
    turn = mix(h + np.uint64(round_))
    least = np.zeros(n, np.uint64)
    least[some] = np.minimum.reduceat(turn, first[some])
    return np.flatnonzero((h % np.uint64(MASK) == round_ % MASK) | (turn == least[doc]))


def examples(docs: DataFrame, vocabulary: Vocabulary, round_: int) -> DataFrame:
    """docs(spot, text): (spot, context, row) blobs of the positions of each text that a round masks."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for i, j in steps(offsets):
                o = offsets[i : j + 1]
                bucket, doc = tokens(data[o[0] : o[-1]], o - o[0])
                masked = masked_at(bucket, doc, j - i, round_)
                row = v.row[bucket]
                upto = np.searchsorted(doc[masked], np.arange(j - i + 1))
                blobs = []
                for values in (contexts(row, doc, masked), row[masked]):
                    flat = values.astype(np.int16).ravel()
                    ends = pa.array(upto * (2 * (values.shape[1] if values.ndim > 1 else 1)), pa.int32())
                    blobs.append(pa.Array.from_buffers(pa.binary(), j - i, [None, ends.buffers()[1], pa.py_buffer(flat.tobytes())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *blobs], ["spot", "context", "row"])

    return docs.select("spot", "text").mapInArrow(each, "spot long, context binary, row binary").where("length(row) > 0")


def trainer(sent: Broadcast, rate: float) -> Callable[[pa.Table], pa.Table]:
    """A shard's pass from the parameters sent: its number of examples and its parameters."""

    def each(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("spot", "ascending"), ("row", "ascending"), ("context", "ascending")])
        c, y = (np.frombuffer(b"".join(shard.column(k).to_pylist()), np.int16).astype(np.int64) for k in ("context", "row"))
        now = train(sent.value, c.reshape(-1, len(OFFSETS)), y, rate)
        return pa.table({"n": pa.array([len(y)], pa.int64()), "vector": pa.array([now.tobytes()], pa.binary()), "part": shard.column("shard").combine_chunks()[:1]})

    return each


def fit(docs: DataFrame, key: str | None = None) -> tuple[Vocabulary, np.ndarray]:
    """docs(text, and key if named): counts and network of the whole corpus."""
    spark = docs.sparkSession
    counts = count_tokens(docs)
    vocabulary = Vocabulary.of(counts)
    vector = initial(vocabulary.prior)
    n_shards = max(1, -(-int(counts.sum()) // TOKENS_A_SHARD))
    place = F.monotonically_increasing_id().cast("string")
    own = F.coalesce(F.col(key).cast("string"), place) if key else place
    rows = docs.select(F.xxhash64(own, F.col("text").cast("string")).alias("spot"), F.col("text").cast("string").alias("text"))
    for round_ in range(ROUNDS):
        data = examples(rows, vocabulary, round_).withColumn("shard", F.pmod("spot", F.lit(n_shards)))
        sent, rate = spark.sparkContext.broadcast(vector), RATE / (1 + round_)

        trained = staged(spark, data.groupBy("shard").applyInArrow(trainer(sent, rate), "n long, vector binary, part long"), "trained")
        while trained.count() > FAN_IN:
            trained = staged(spark, trained.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("part").applyInPandas(average, "n long, vector binary, part long"), "averaged")
        rest = trained.orderBy("part").toPandas()  # FAN_IN parameter sets at most
        if len(rest):
            vector = np.frombuffer(average(rest)["vector"].iloc[0], np.float32)
    return vocabulary, vector


def average(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("part")
    n = group["n"].to_numpy(float)
    total = np.zeros(sum(int(np.prod(s)) for s in SHAPES.values()))
    for w, v in zip(n, group["vector"], strict=True):
        total += w * np.frombuffer(v, np.float32)
    return pd.DataFrame({"n": [int(n.sum())], "vector": [(total / n.sum()).astype(np.float32).tobytes()], "part": [int(group["part"].iloc[0])]})


def token_scores(data: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary, vector: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-probability and text of each token."""
    p = unpacked(vector)
    bucket, doc = tokens(data, offsets)
    row = vocabulary.row[bucket]
    out = np.zeros(len(bucket))
    for i in range(0, len(bucket), POSITIONS_AT_ONCE):
        at = np.arange(i, min(i + POSITIONS_AT_ONCE, len(bucket)))
        out[at] = log_probabilities(p, contexts(row, doc, at), row[at])
    return out + vocabulary.share[bucket], doc


def score(docs: DataFrame, model: tuple[Vocabulary, np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, log_prob, mean_log_prob) of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, vector = sent.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for i, j in steps(offsets):
                o = offsets[i : j + 1]
                logp, doc = token_scores(data[o[0] : o[-1]], o - o[0], vocabulary, vector)
                n = np.bincount(doc, minlength=j - i)
                total = np.round(np.bincount(doc, weights=logp, minlength=j - i), 6)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n), pa.array(total), pa.array(total / np.maximum(n, 1), mask=n == 0)], ["key", "n_tokens", "log_prob", "mean_log_prob"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(each, f"key {kind}, n_tokens long, log_prob double, mean_log_prob double").withColumnRenamed("key", key)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return score(docs, fit(docs, "doc_id"))
