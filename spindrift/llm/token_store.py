"""Token ids in a content-addressed store: rolling-hash chunks, document recipes, Merkle manifests.

Documents are encoded, each ended by an end id, and each id stream is cut where a hash of its last WINDOW ids has
given low bits, so equal passages give equal chunks wherever they stand. The store has three Parquet tables:

chunks    address (BLAKE2b-128 of the ids' bytes), ids (little-endian, 2 or 4 bytes each); each chunk once
recipes   part, doc_id, start, n_tokens, addresses, leaf; in ascending doc_id order, part by part
manifest  part, start, n_docs, n_tokens, width, root: bytes an id, and the Merkle root of the part's leaves

A leaf hashes a document's id, token count and addresses, so roots and addresses together verify a reconstruction. Whatever is
read goes through them: recipes whose leaves don't give the manifest's root, chunks that are missing or don't fit their
address, and documents whose chunks don't have its token count are errors.

Words (runs without ASCII white space, which this kind of vocabulary never spans) are encoded by the tokenizers
library once a worker and kept by 64-bit hash, MEMO words at most.

Defined cases: null and empty texts have the end id alone; very long texts are many chunks of MOST ids at most; a null id sorts first; rows with equal ids follow each
other in order of their addresses; an empty table gives empty tables; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from spindrift.llm.common import documents, mix, shared_dir, staged, steps, text_bytes, word_hashes, words
from spindrift.llm.suffix_dedup import ragged

END_ID = 1
WINDOW, CUT_BITS, MOST = 16, 9, 8192
MEMO = 1 << 22
#: A character that is one token; words are encoded many at a time with it in between.
MARK = "|"
RECIPES_A_PART = 100_000


class Encoder:
    """Encodes words with the tokenizers library and remembers their ids."""

    def __init__(self, vocabulary: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 and self._alone(mark[0]) else None
        self.forget()

    def _alone(self, mark: int) -> bool:
        return self.tokenizer.encode(f"a {MARK} b", add_special_tokens=False).ids[1:2] == [mark]

    def forget(self) -> None:
        # sorted hashes with each word's place and count in ids: most words in the first level, the latest in the second
        self.levels = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(2)]
        self.ids, self.size = np.zeros(1 << 16, np.uint32), 0

    def find(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and count in ids of each remembered hash; count -1 of the others."""
        at, n = np.zeros(len(value), np.int64), np.full(len(value), -1, np.int64)
        for known, start, count in self.levels:
            if len(known):
                slot = np.minimum(np.searchsorted(known, value), len(known) - 1)
                hit = known[slot] == value
                at[hit], n[hit] = start[slot[hit]], count[slot[hit]]
        return at, n

    def remember(self, value: np.ndarray, at: np.ndarray, n: np.ndarray, ids: np.ndarray) -> None:
        """Add words whose ids come next; the latest words join the others when they are many."""

        def joined(a: tuple, b: tuple) -> tuple:
            both = [np.concatenate(x) for x in zip(a, b, strict=True)]
            order = np.argsort(both[0], kind="stable")
            return tuple(x[order] for x in both)

        if self.size + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.size], np.zeros(max(self.size, len(ids)), np.uint32)])
        self.ids[self.size : self.size + len(ids)] = ids
        self.size += len(ids)
        old, recent = self.levels[0], joined(self.levels[1], (value, at, n))
        if len(recent[0]) > max(1 << 14, len(old[0]) // 8):
            old, recent = joined(old, recent), tuple(x[:0] for x in recent)
        self.levels = [old, recent]

    def look_up(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the words, and where in them each word starts and how many it has."""
        mark = MARK.encode()
        many: list[int] = []
        alone: list[int] = []
        for i, w in enumerate(found):
            (alone if self.mark is None or mark in w else many).append(i)
        text = lambda i: found[i].decode("utf-8", "replace")
        groups = [many[i : i + 256] for i in range(0, len(many), 256)]
        between = b" " + mark + b" "
        flat, n = [], np.zeros(len(found), np.int64)
        order: list[int] = []
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([between.join([found[i] for i in g]).decode("utf-8", "replace") for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            at = np.flatnonzero(ids == self.mark)
            if len(at) != len(group) - 1:  # a word gave the mark's id by itself
                alone += group
                continue
            flat.append(np.delete(ids, at))
            n[group] = np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1
            order += group
        for i, e in zip(alone, self.tokenizer.encode_batch_fast([text(i) for i in alone], add_special_tokens=False), strict=True):
            flat.append(np.array(e.ids, np.uint32))
            n[i] = len(e.ids)
        order += alone
        start = np.zeros(len(found), np.int64)
        start[order] = np.cumsum(n[order]) - n[order]
        return np.concatenate(flat), start, n

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in data, each ended by end_id, and where each text starts in them."""
        start, end, doc = words(data, offsets)
        h = word_hashes(data, start, end) if len(start) else np.zeros(0, np.uint64)
        value, first, of = np.unique(h, return_index=True, return_inverse=True)
        at, n = self.find(value)
        new = n < 0
        if new.any():
            if sum(len(known) for known, *_ in self.levels) > MEMO:
                self.forget()
                new[:] = True
            raw, first = data.tobytes(), first[new]
            ids, here, n[new] = self.look_up([raw[i:j] for i, j in zip(start[first].tolist(), end[first].tolist(), strict=True)])
            at[new] = here + self.size
            self.remember(value[new], at[new], n[new], ids)
        take, owner = ragged(at[of], at[of] + n[of])
        doc = doc[owner] if len(owner) else np.zeros(0, np.int64)
        count = np.bincount(doc, minlength=len(offsets) - 1) + 1
        out = np.full(count.sum(), end_id, np.uint32)
        out[np.arange(len(take)) + doc] = self.ids[take]
        return out, np.concatenate([[0], np.cumsum(count)])


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """One a worker and vocabulary."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def cuts(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ends of the chunks of the streams that start at starts[:-1] in ids."""
    n = len(ids)
    h = ids.astype(np.uint64) + np.uint64(1)
    span = 1
    while span < WINDOW:  # the hash of the last 2, 4, ... WINDOW ids; positions with fewer in their document aren't used
        h[span:] += h[:-span] * np.uint64(pow(0x5851F42D4C957F2D, span, 1 << 64))
        span *= 2
    own = np.arange(n) - np.repeat(starts[:-1], np.diff(starts)) >= WINDOW - 1
    at = np.flatnonzero(own & ((mix(h) & np.uint64((1 << CUT_BITS) - 1)) == 0)) + 1
    at = np.unique(np.concatenate([at, starts[1:]]))
    size = np.diff(np.concatenate([[0], at]))
    long = np.flatnonzero(size > MOST)
    extra = [np.arange(at[i] - size[i] + MOST, at[i], MOST) for i in long]
    return np.unique(np.concatenate([at, *extra])) if extra else at


@functools.lru_cache(4096)
def zeros_matrix(n_bytes: int) -> tuple[int, ...]:
    """What n_bytes zero bytes do to a crc32, as the images of its 32 bits."""
    if n_bytes == 0:
        return tuple(1 << i for i in range(32))
    if n_bytes == 1:
        m = tuple([0xEDB88320] + [1 << i for i in range(31)])  # one zero bit
        for _ in range(3):
            m = tuple(apply(m, x) for x in m)
        return m
    half = zeros_matrix(n_bytes // 2)
    m = tuple(apply(half, x) for x in half)
    return tuple(apply(zeros_matrix(1), x) for x in m) if n_bytes % 2 else m


def apply(m: tuple[int, ...], x: int) -> int:
    out, i = 0, 0
    while x:
        if x & 1:
            out ^= m[i]
        x >>= 1
        i += 1
    return out


@functools.cache
def zeros_tables(bit: int) -> np.ndarray:
    """What 2**bit zero bytes do to a crc32, as four tables of its bytes."""
    m = zeros_matrix(1 << bit)
    return np.array([[apply(m, value << (8 * k)) for value in range(256)] for k in range(4)], np.uint32)


def joined_crcs(crc: np.ndarray, n_bytes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The crc32 of each run of parts set end to end, from the parts' crc32 and length; runs begin at first, none is empty.
    A part's crc counts as moved over the bytes that follow it in its run."""
    upto = np.cumsum(n_bytes)
    run = np.diff(np.concatenate([first, [len(crc)]]))
    left = np.repeat(upto[first + run - 1], run) - upto
    crc = crc.astype(np.uint32)
    for bit in range(int(left.max(initial=0)).bit_length()):
        some = np.flatnonzero(left >> bit & 1)
        t, x = zeros_tables(bit), crc[some]
        crc[some] = t[0][x & 255] ^ t[1][x >> 8 & 255] ^ t[2][x >> 16 & 255] ^ t[3][x >> 24]
    return np.bitwise_xor.reduceat(crc, first).astype(np.int64)


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """The crc32 of parts set end to end, from each part's crc32 and length in bytes."""
    crc, n = (np.array(x, np.int64) for x in zip(*parts, strict=True))
    return int(joined_crcs(crc, n, np.zeros(1, np.int64))[0])


def merkle_root(leaves: list[bytes]) -> bytes:
    level = leaves or [b""]
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 2])).digest() for i in range(0, len(level), 2)]
    return level[0]


def address(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


class Store:
    """A store in a folder that all executors see."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @staticmethod
    def write(docs: DataFrame, vocabulary: str, path: str | None = None, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> Store:
        spark = docs.sparkSession
        store = Store(spark, path or f"{shared_dir(spark)}/spindrift/ids-{uuid.uuid4().hex}")

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            e = encoder(vocabulary)
            kind = np.uint32 if e.wide else np.uint16
            seen: set[bytes] = set()
            for batch in batches:
                data, offsets = text_bytes(batch.column(1))
                for i, j in steps(offsets):
                    o = offsets[i : j + 1]
                    ids, starts = e.encode(data[o[0] : o[-1]], o - o[0], end_id)
                    ends = cuts(ids, starts)
                    raw, size = ids.astype(kind).tobytes(), np.diff(np.concatenate([[0], ends]))
                    width = np.dtype(kind).itemsize
                    bodies = [raw[(b - n) * width : b * width] for b, n in zip(ends, size, strict=True)]
                    names = [address(b) for b in bodies]
                    for k, name in enumerate(names):  # a task sends a chunk's ids once
                        if name in seen:
                            bodies[k] = None
                        seen.add(name)
                    if len(seen) > MEMO:
                        seen.clear()
                    lists = pa.array(np.concatenate([[0], np.searchsorted(ends, starts[1:], "right")]), pa.int32())
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(starts)), pa.ListArray.from_arrays(lists, pa.array(names, pa.binary())), pa.ListArray.from_arrays(lists, pa.array(bodies, pa.binary()))], ["doc_id", "n_tokens", "addresses", "bodies"])

        rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
        encoded = staged(spark, rows.mapInArrow(encode, "doc_id long, n_tokens long, addresses array<binary>, bodies array<binary>"), "encoded")
        parts = encoded.select(F.explode(F.arrays_zip("addresses", "bodies")).alias("c")).where("c.bodies is not null").select(F.col("c.addresses").alias("address"), F.col("c.bodies").alias("ids"))
        store._put(parts.groupBy("address").agg(F.first("ids").alias("ids")), "chunks")
        # ascending doc_id, part by part: a part's running sums begin at the total of the parts before it
        n_parts = max(8, -(-encoded.count() // RECIPES_A_PART))
        placed = staged(spark, encoded.select("doc_id", "n_tokens", "addresses").repartitionByRange(n_parts, F.col("doc_id").asc_nulls_first()).withColumn("part", F.spark_partition_id()), "placed")
        totals = placed.groupBy("part").agg(F.sum("n_tokens").alias("total"), F.count(F.lit(1)).alias("n_docs"))
        before = totals.withColumn("before", F.coalesce(F.sum("total").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row a part
        running = W.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "addresses").rowsBetween(W.unboundedPreceding, -1)
        leaf = F.unhex(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"), F.lit(":").cast("binary"), F.col("n_tokens").cast("string").cast("binary"), F.lit(":").cast("binary"), F.aggregate("addresses", F.lit(b""), lambda a, x: F.concat(a, x))), 256))
        recipes = placed.join(F.broadcast(before.select("part", "before")) if n_parts <= 1_000_000 else before.select("part", "before"), "part").select("part", "doc_id", (F.col("before") + F.coalesce(F.sum("n_tokens").over(running), F.lit(0))).alias("start"), "n_tokens", "addresses", leaf.alias("leaf"))
        store._put(recipes.sortWithinPartitions("part", "start"), "recipes")
        store._put(store.roots().join(before.select("part", "n_docs", F.col("total").alias("n_tokens"), F.col("before").alias("start"), F.lit(4 if encoder(vocabulary).wide else 2).alias("width")), "part"), "manifest")
        return store

    def _put(self, df: DataFrame, name: str) -> None:
        df.write.option("compression", "zstd").parquet(f"{self.path}/{name}")

    def roots(self) -> DataFrame:
        """(part, root) from the recipes as they are stored."""

        def root(group: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"part": [group["part"].iloc[0]], "root": [merkle_root(list(group.sort_values("start")["leaf"]))]})

        return self.table("recipes").select("part", "start", "leaf").groupBy("part").applyInPandas(root, "part int, root binary")

    def verified(self) -> DataFrame:
        """(doc_id, start, n_tokens, addresses) of the recipes; an error where a part's leaves don't give the manifest's root or its
        documents, token counts and starts aren't the manifest's."""

        def check(recipes: pa.Table, entry: pa.Table) -> pa.Table:
            recipes = recipes.sort_by("start").combine_chunks()
            ids, starts, n = (recipes.column(c).to_pylist() for c in ("doc_id", "start", "n_tokens"))
            leaves = [hashlib.sha256(b"%s:%d:%s" % (b"" if i is None else str(i).encode(), k, b"".join(a))).digest() for i, k, a in zip(ids, n, recipes.column("addresses").to_pylist(), strict=True)]
            found = [(len(ids), sum(n), starts[0] if ids else 0, merkle_root(leaves))]
            if found != [tuple(r[c] for c in ("n_docs", "n_tokens", "start", "root")) for r in entry.to_pylist()] or starts != np.cumsum([found[0][2], *n])[:-1].tolist():
                raise ValueError("recipes and manifest differ")
            return recipes.select(["doc_id", "start", "n_tokens", "addresses"])

        recipes = self.table("recipes").select("part", "doc_id", "start", "n_tokens", "addresses").groupBy("part")
        return recipes.cogroup(self.table("manifest").groupBy("part")).applyInArrow(check, "doc_id long, start long, n_tokens long, addresses array<binary>")

    def _width(self) -> int:
        """Bytes an id."""
        one = self.table("manifest").select("width").first()
        return one["width"] if one else 2

    def checked_chunks(self) -> DataFrame:
        """(address, ids, n, crc) of each stored chunk, from its bytes; an error where bytes and address differ."""
        kind = f"<u{self._width()}"

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, crc = [], []
                for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if address(raw) != name:
                        raise ValueError(f"chunk {name.hex()} is damaged")
                    ids = np.frombuffer(raw, kind).astype("<u4")
                    n.append(len(ids))
                    crc.append(zlib.crc32(ids.tobytes()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["address", "ids", "n", "crc"])

        return self.table("chunks").select("address", "ids").mapInArrow(check, "address binary, ids binary, n long, crc long")

    def _parts(self, *columns: str) -> DataFrame:
        """(doc_id, start, n_tokens, parts): each verified recipe with its chunks' columns; missing chunks have nulls."""
        uses = self.verified().select("doc_id", "start", "n_tokens", F.posexplode("addresses").alias("at", "address"))
        found = uses.join(self.checked_chunks().select("address", *columns), "address", "left")
        return found.groupBy("doc_id", "start", "n_tokens").agg(F.collect_list(F.struct("at", *columns)).alias("parts"))

    def facts(self) -> DataFrame:
        """(doc_id, start, n_tokens, ids_crc32) of each document, from the stored chunks and verified recipes."""

        def join_crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                parts = batch.column(3).flatten()
                at, n, crc = (parts.field(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "n", "crc"))
                doc = np.repeat(np.arange(len(batch)), batch.column(3).value_lengths().to_numpy(zero_copy_only=False))
                order = np.lexsort([at, doc])
                first = np.searchsorted(doc, np.arange(len(batch)))  # every document has a chunk
                wrong = np.flatnonzero(np.add.reduceat(n, first) != batch.column(2).to_numpy())
                if len(wrong):
                    raise ValueError(f"chunks of document {batch.column(0)[int(wrong[0])].as_py()} are missing")
                crcs = joined_crcs(crc[order], 4 * n[order], first)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

        return self._parts("n", "crc").mapInArrow(join_crcs, "doc_id long, start long, n_tokens long, ids_crc32 long")

    def read(self) -> DataFrame:
        """(doc_id, start, ids array<long>): every document put together again from its verified recipe."""
        kind = f"<u{self._width()}"

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = []
                for doc, n, parts in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                    ids.append(np.frombuffer(b"".join(p["ids"] or b"" for p in sorted(parts, key=lambda p: p["at"])), kind).astype(np.int64))
                    if n != len(ids[-1]):
                        raise ValueError(f"chunks of document {doc} are missing")
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "start", "ids"])

        return self._parts("ids").mapInArrow(build, "doc_id long, start long, ids array<long>")

    def verify(self) -> DataFrame:
        """(part, ok): whether each part's recipes still give the manifest's root."""
        return self.roots().withColumnRenamed("root", "now").join(self.table("manifest"), "part").select("part", (F.col("now") == F.col("root")).alias("ok"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return Store.write(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")).facts()
