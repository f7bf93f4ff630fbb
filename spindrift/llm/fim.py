"""Fill-in-middle transformation over an index of distinct texts.

Texts are grouped by digest and content: equal texts are one row of the index however many documents have them, and a digest that
two texts share leaves two rows. The index lies in buckets of digests. In its bucket each distinct text gets the list of the byte offsets
of its code points once, in Elias-Fano form: low bits in fixed width, high bits in unary with the number of ones before each block.
Documents come to the buckets as keys and digests, join their text there by digest (by content, should texts share one), select the
two offsets of their seeded cut from the list, and cut the text's bytes. Texts are shuffled once. Texts with more than COPIES documents meet
within tasks first, and have a row for each share of their documents, so that none's documents meet in one task.

Defined cases: null text is empty; an empty text, and one that holds a sentinel, stays plain; a null key has the seed of "1:"; texts of
any length are cut whole; repeated rows each give their row, alike; cuts on one place leave an empty middle; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import documents, staged

#: Documents that one row of the index serves, raised until no more than SENT_ROWS texts have more, whose digests are broadcast; documents of a
#: bucket, and of a partition of buckets; bits of a block of high bits.
COPIES, SENT_ROWS, BUCKET_ROWS, PART_ROWS, BLOCK = 64, 500_000, 1 << 10, 1 << 13, 512


@dataclass(frozen=True)
class Form:
    """Sentinels of the prefix, suffix and middle, shares of a hundred, and what precedes the key in the seed."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    cut_percent: int = 90
    spm_percent: int = 20
    seed: str = "1:"


# --- Elias-Fano
def boundaries(data: np.ndarray) -> np.ndarray:
    """Offset of each code point of UTF-8 bytes, and the end."""
    return np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))


def elias_fano(values: np.ndarray, universe: int) -> bytes:
    """A rising list of n values up to universe: n, the low bits' width, the low bits, and the high bits, in which value i is a one
    at place (value >> width) + i, after the ones before each block."""
    n = len(values)
    width = max(0, int(universe // max(n, 1)).bit_length() - 1)
    low = np.packbits((values[:, None] >> np.arange(width)) & 1, bitorder="little") if width else np.zeros(0, np.uint8)
    n_blocks = ((universe >> width) + n) // BLOCK + 1
    bits = np.zeros(n_blocks * BLOCK, np.uint8)
    bits[(values >> width) + np.arange(n)] = 1
    ones = bits.reshape(n_blocks, BLOCK).sum(axis=1, dtype=np.int64)
    head = np.array([n, width, n_blocks], "<i8")
    return b"".join([head.tobytes(), (np.cumsum(ones) - ones).astype("<i8").tobytes(), np.packbits(bits, bitorder="little").tobytes(), low.tobytes()])


def select(packed: bytes, i: int) -> int:
    """Value i of the list, from one block of the high bits and its own low bits."""
    _, width, n_blocks = np.frombuffer(packed, "<i8", 3).tolist()
    before = np.frombuffer(packed, "<i8", n_blocks, 24)
    block = int(np.searchsorted(before, i, "right")) - 1
    at = 24 + 8 * n_blocks
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8, BLOCK // 8, at + block * BLOCK // 8), bitorder="little"))
    high = block * BLOCK + int(ones[i - before[block]]) - i
    if not width:
        return high
    first = i * width
    part = packed[at + n_blocks * BLOCK // 8 + first // 8 : at + n_blocks * BLOCK // 8 + (first + width + 7) // 8]
    return high << width | int.from_bytes(part, "little") >> first % 8 & (1 << width) - 1


def length(packed: bytes) -> int:
    """Code points of the text."""
    return int(np.frombuffer(packed, "<i8", 1)[0]) - 1


# --- the cut of one document
def seeds(form: Form, key: str) -> tuple[int, int, int, int]:
    h = hashlib.sha256((form.seed + key).encode()).hexdigest()
    return int(h[:8], 16), int(h[8:16], 16), int(h[16:24], 16), int(h[24:32], 16)


def cut(form: Form, key: str, text: bytes, packed: bytes, plain: bool) -> tuple[int, str, int | None, int | None, bytes]:
    """Code points, form, those of prefix and middle (None where plain), and the output."""
    n = length(packed)
    h1, h2, h3, h4 = seeds(form, key)
    if plain or h3 % 100 >= form.cut_percent:
        return n, "plain", None, None, text
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = select(packed, i), select(packed, j)
    p, s, m = form.prefix.encode(), form.suffix.encode(), form.middle.encode()
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < form.spm_percent:
        return n, "spm", i, j - i, b"".join([s, suffix, p, prefix, m, middle])
    return n, "psm", i, j - i, b"".join([p, prefix, s, suffix, m, middle])


def restored(form: Form, output: bytes, name: str) -> bytes:
    """The text of an output; no part of a text that was cut holds a sentinel, nor does a sentinel begin within another."""
    if name == "plain":
        return output
    p, s, m = form.prefix.encode(), form.suffix.encode(), form.middle.encode()
    first, second = (p, s) if name == "psm" else (s, p)
    if not output.startswith(first):
        raise ValueError("the output doesn't begin with its sentinel")
    head, _, rest = output[len(first) :].partition(second)
    tail, _, middle = rest.partition(m)
    prefix, suffix = (head, tail) if name == "psm" else (tail, head)
    return prefix + middle + suffix


# --- the index
def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def text_index(rows: DataFrame) -> DataFrame:
    """(bucket, digest, text, copies) of each distinct text of rows(bucket, digest, text), where they are if they go by bucket already."""
    return rows.groupBy("bucket", "digest", "text").agg(F.count(F.lit(1)).alias("copies"))


def transform(docs: DataFrame, form: Form | None = None, key: str = "doc_id", text: str = "text", digest=digest) -> DataFrame:  # noqa: ANN001
    """(key, n, form, prefix_chars, middle_chars, output, restored) of each row; restored is rebuilt from output and form.
    The rows are written to the shared folder."""
    return _cuts(docs, form or Form(), key, text, digest, "output binary, restored binary", lambda output, back: (output, back))


def digests(docs: DataFrame, form: Form | None = None, key: str = "doc_id", text: str = "text", digest=digest) -> DataFrame:  # noqa: ANN001
    """The same with sha256 digests in place of the output and the restored text."""
    sha = lambda output, back: (hashlib.sha256(output).hexdigest(), hashlib.sha256(back).hexdigest())
    return _cuts(docs, form or Form(), key, text, digest, "output_sha256 string, restored_sha256 string", sha)


def _cuts(docs: DataFrame, form: Form, key: str, text: str, digest, columns: str, told) -> DataFrame:  # noqa: ANN001
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = lambda: docs.select(F.col(key).alias("key"), digest(whole).alias("digest"), F.xxhash64(F.col(key), F.monotonically_increasing_id()).alias("deal"), whole.alias("text"))
    keys = staged(spark, rows().drop("text"), "fim-keys")
    counts = staged(spark, keys.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > COPIES), "fim-counts")
    copies = COPIES
    while counts.where(F.col("copies") > copies).count() > SENT_ROWS:
        copies *= 2
    hot = F.broadcast(counts.where(F.col("copies") > copies).select("digest", F.ceil(F.col("copies") / copies).cast("int").alias("shares")))  # SENT_ROWS rows at most
    total = keys.count()
    n_buckets, n = -(-total // BUCKET_ROWS) or 1, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_ROWS))
    bucket = lambda *by: F.pmod(F.xxhash64(*by), F.lit(n_buckets)).alias("bucket")

    def parts(left: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
        """Index and keys, by bucket both: of the texts of few documents, and of the others in shares."""
        texts = docs.select(digest(whole).alias("digest"), whole.alias("text"))
        cold = text_index(texts.join(hot, "digest", "left_anti").select(bucket("digest"), "digest", "text").repartition(n, "bucket")), left.join(hot, "digest", "left_anti").select(bucket("digest"), *left.columns).repartition(n, "bucket")
        shared = text_index(texts.join(hot, "digest", "left_semi").withColumn("bucket", F.lit(0).cast("long"))).join(hot, "digest")
        # shares that meet in one bucket have one row there: a second one would look like another text of that digest
        shares = F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("shares") - 1), lambda share: F.pmod(F.xxhash64("digest", share), F.lit(n_buckets))))
        dealt = left.join(hot, "digest").withColumn("share", F.pmod("deal", "shares").cast("int"))
        return [cold, (shared.select(F.explode(shares).alias("bucket"), "digest", "text", "copies"), dealt.select(bucket("digest", "share"), *left.columns))]

    names = [c.split()[0] for c in columns.split(", ")]
    kinds = [pa.binary() if c.endswith("binary") else pa.string() for c in columns.split(", ")]
    marks = [s.encode() for s in (form.prefix, form.suffix, form.middle)]

    def cuts(index: pa.Table, left: pa.Table) -> pa.Table:
        places: dict[bytes, list[int]] = {}
        for i, d in enumerate(index.column("digest").to_pylist()):
            places.setdefault(d, []).append(i)
        texts = index.column("text").cast(pa.large_binary()).combine_chunks()
        lists: dict[int, tuple[bytes, bytes, bool]] = {}
        by_content = "text" in left.column_names
        own = left.column("text").cast(pa.large_binary()) if by_content else None
        out: list[tuple] = []
        for row, (k, d) in enumerate(zip(left.column("key").to_pylist(), left.column("digest").to_pylist(), strict=True)):
            found = places[d]
            at = next(i for i in found if texts[i] == own[row]) if by_content else found[0]
            if at not in lists:
                t = texts[at].as_py()
                lists[at] = t, elias_fano(boundaries(np.frombuffer(t, np.uint8)), len(t)), not t or any(m in t for m in marks)
            *facts, output = cut(form, "" if k is None else str(k), *lists[at])
            out.append((*facts, *told(output, restored(form, output, facts[1])), 1 if by_content else len(found)))
        n, name, i, j, *more, n_texts = zip(*out, strict=True) if out else [()] * (5 + len(names))
        values = [left.column("key"), pa.array(n, pa.int64()), pa.array(name, pa.string()), pa.array(i, pa.int64()), pa.array(j, pa.int64()), *[pa.array(x, t) for x, t in zip(more, kinds, strict=True)], pa.array(n_texts, pa.int64())]
        return pa.table(values, ["key", "n", "form", "prefix_chars", "middle_chars", *names, "texts"])

    def joined(left: DataFrame) -> DataFrame:
        a, b = (index.groupBy("bucket").cogroup(k.groupBy("bucket")).applyInArrow(cuts, f"key {kind}, n long, form string, prefix_chars long, middle_chars long, {columns}, texts long") for index, k in parts(left))
        return staged(spark, a.unionByName(b), "fim")

    found = joined(keys)
    if not found.where("texts > 1").isEmpty():  # texts of one digest: the content decides
        found = joined(rows())
    return found.drop("texts").withColumnRenamed("key", key)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir).select("doc_id", "text"))


#: The first four groups of eight digits of each document's seed as integers, then the same cuts by characters.
ORACLE = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id::VARCHAR) AS h FROM documents
), s AS (
  SELECT doc_id, t, n, ('0x' || substr(h, 1, 8))::UBIGINT AS h1, ('0x' || substr(h, 9, 8))::UBIGINT AS h2,
    ('0x' || substr(h, 17, 8))::UBIGINT AS h3, ('0x' || substr(h, 25, 8))::UBIGINT AS h4 FROM d
), c AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS i, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS j,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM s
), p AS (
  SELECT *, substring(t, 1, i) AS prefix, substring(t, i + 1, j - i) AS middle, substring(t, j + 1) AS suffix FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN i END AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
