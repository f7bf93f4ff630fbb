"""Shared helpers of the training-data operators: shared storage, Arrow text access, word and shingle hashes."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on; a longer single text is a step of its own.
STEP_BYTES = 1 << 19
LONG_WORD = 512
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
MIXERS = np.array([pow(0xD1342543DE82EF95, k + 1, 1 << 64) | 1 for k in range(8)], np.uint64)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spindrift-')}"
        spark.conf.set("spark.checkpoint.dir", found) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    return found.rstrip("/")


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def staged(spark: SparkSession, df: DataFrame, label: str, arrow_rows: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: the cut of lineage that survives lost executors. arrow_rows bounds the
    rows of a batch that goes to Python, for tables of long texts; the session's own setting comes back after."""
    path = f"{shared_dir(spark)}/spindrift/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(ARROW_ROWS)
    try:
        spark.conf.set(ARROW_ROWS, str(arrow_rows or before))
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(ARROW_ROWS, before)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column and its int64 offsets (rebased to 0); nulls are empty."""
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def steps(offsets: np.ndarray, budget: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most budget bytes, or one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + budget, "right")) - 1)
        yield i, min(j, n)
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that low and high bits of the result depend on all bits."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**j and BASE**-j modulo 2**64 for j < n."""
    if len(_powers.get("up", ())) < n:
        for key, base in (("up", BASE), ("down", BASE_INV)):
            a = np.full(n, base, np.uint64)
            a[0] = 1
            _powers[key] = np.cumprod(a, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each run of non-space bytes; runs end with their document."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word, equal for equal words wherever they stand. Words of LONG_WORD bytes or more,
    of which there are few, take a digest: sums modulo 2**64 have known collisions among strings of a thousand bytes or so."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    out = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    for i in np.flatnonzero(end - start >= LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each k-word shingle of A-Z-lowered texts; a text of fewer words is one shingle."""
    data = LOWER[data]
    start, end, doc = words(data, offsets)
    h = word_hashes(data, start, end)
    n = len(h) - k + 1
    if n > 0:
        whole = doc[: n] == doc[k - 1 :]
        s = np.zeros(n, np.uint64)
        for j in range(k):
            s += h[j : j + n] * MIXERS[j]
        s, owner = mix(s)[whole], doc[:n][whole]
    else:
        s, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    count = np.bincount(doc, minlength=len(offsets) - 1)
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        at = np.concatenate([[0], np.cumsum(count)])
        extra = np.array([sum(int(h[at[d] + j]) * int(MIXERS[j]) for j in range(count[d])) + int(count[d]) for d in few], dtype=object) % (1 << 64)
        s, owner = np.concatenate([s, mix(extra.astype(np.uint64))]), np.concatenate([owner, few])
        order = np.argsort(owner, kind="stable")
        s, owner = s[order], owner[order]
    return s, owner


def crc32_text(col: F.Column) -> F.Column:
    """crc32 of a value's text, as the folds of the contracts take it."""
    return F.crc32(col.cast("string").cast("binary"))


def connected(spark: SparkSession, links: DataFrame, label: str) -> DataFrame:
    """(id, component) for each id in links(a, b): the least id that links reach. Labels spread along
    links and jump to the label of their label; one small shuffle a round, each round a written table."""
    links = staged(spark, links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).union(links.select(F.col("b").cast("long"), F.col("a").cast("long"))).where("a <> b").distinct(), f"{label}-links")
    now = staged(spark, links.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("component")), f"{label}-round")
    while True:
        near = links.join(now.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = now.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("up"))
        jump = now.select(F.col("id").alias("up"), F.col("component").alias("far"))
        new = staged(spark, step.join(jump, "up").select("id", "old", F.least("up", "far").alias("component")), f"{label}-round")
        done = new.where("old <> component").isEmpty()
        now = new.select("id", "component")
        if done:
            return now
