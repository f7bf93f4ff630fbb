"""Mixing sources to target weights: temperature mixing realised as budgeted block permutations.

Source weights are the sources' token shares raised to an exponent and normalised. The exponent is
bisected: down to the least value at which no source repeats more than max_repeats times, or to the value
at which the weights have a target entropy. The budget is the largest token count at which the most
down-weighted source is used exactly once, so every document stays, and the others repeat: a source with
weight w gets budget * w tokens as whole passes and one last partial pass. Each pass permutes the source's
blocks (a block is a fixed slice of the document hash) one to one, and the documents in each; the partial pass
takes whole blocks in its own permuted order and cuts the last by its documents' order, so its budget is met
within one document.

Defined cases: very long texts count by their words like others; a null source is a source of its own; null and empty texts count 0 tokens and are in every
whole pass; ties of the permutation are broken by key, equal rows share their fate; an empty table gives an
empty table; with no tokens at all each row appears once; other columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from spindrift.llm.common import documents, staged

#: Blocks of a source: the top bits of a hash.
BLOCK_BITS = 12
BLOCKS = 1 << BLOCK_BITS
#: Sources whose parameters are sent to all executors; beyond it they are joined by a shuffle.
MAX_BROADCAST_SOURCES = 100_000


def token_count(text: Column) -> Column:
    """Words between white space."""
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", 0).otherwise(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+"))).cast("long")


def weights_at(shares: list[float], alpha: float) -> list[float]:
    raised = [s**alpha if s > 0 else 0.0 for s in shares]
    total = sum(raised)
    return [r / total for r in raised] if total else raised


def repeats_at(shares: list[float], alpha: float) -> list[float]:
    """Passes of each source if the least repeated one is used once."""
    ratio = [w / s if s > 0 else 0.0 for w, s in zip(weights_at(shares, alpha), shares, strict=True)]
    least = min((r for r in ratio if r > 0), default=1.0)
    return [r / least if r > 0 else 1.0 for r in ratio]


def bisect_alpha(shares: list[float], max_repeats: float | None = None, entropy: float | None = None) -> float:
    """The exponent in 0..1: the least that keeps repeats within max_repeats, or the one of a target entropy (nats)."""

    def too_flat(alpha: float) -> bool:
        if entropy is not None:
            return -sum(w * math.log(w) for w in weights_at(shares, alpha) if w > 0) > entropy
        return max(repeats_at(shares, alpha), default=1.0) > (max_repeats or 1.0) + 1e-12

    low, high = 0.0, 1.0
    if not too_flat(low):
        return low
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if too_flat(mid) else (low, mid)
    return high


def source_key(source: Column) -> Column:
    return F.when(source.isNull(), "null").otherwise(F.concat(F.lit("="), source.cast("string")))


def block_of(key: Column, seed: int) -> Column:
    """A row's block: a fixed slice of its hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(-1), key), 64 - BLOCK_BITS)


def place(key: Column, pass_no: Column, seed: int) -> Column:
    """A row's 32-bit position among its block in a pass."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), pass_no, key), 32)


def permuted(block: Column, pass_no: Column, source: Column, seed: int) -> Column:
    """The place of a source's block in a pass: two rounds of an odd multiple, an offset and a shift, which map the blocks
    one to one."""
    x = block
    for i in range(2):
        h = F.xxhash64(F.lit(seed), F.lit(i), pass_no.cast("long"), source)
        x = (x * F.shiftrightunsigned(h, 40).bitwiseOR(F.lit(1)) + h.bitwiseAND(F.lit(BLOCKS - 1))).bitwiseAND(F.lit(BLOCKS - 1))
        x = x.bitwiseXOR(F.shiftright(x, BLOCK_BITS // 2))
    return x


def entropy_alpha(shares: DataFrame, entropy: float) -> float:
    """The exponent at which the weights of shares(s) have the entropy: a grid of exponents a job, narrowed six times."""
    low, high = 0.0, 1.0
    for _ in range(6):
        grid = [low + (high - low) * i / 32 for i in range(33)]
        raised = [F.pow("s", F.lit(a)) for a in grid]
        row = shares.where("s > 0").agg(*[F.sum(r).alias(f"z{i}") for i, r in enumerate(raised)], *[F.sum(r * a * F.log("s")).alias(f"e{i}") for i, (a, r) in enumerate(zip(grid, raised, strict=True))]).first()
        flat = [i for i in range(33) if row[f"z{i}"] and math.log(row[f"z{i}"]) - row[f"e{i}"] / row[f"z{i}"] > entropy]
        if not flat:
            return low
        low, high = grid[flat[-1]], grid[min(flat[-1] + 1, 32)]
    return high


def mix_sources(docs: DataFrame, max_repeats: float = 2.0, entropy: float | None = None, seed: int = 7, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """docs' rows, each as often as its source's weight asks, with __mix_source, __mix_tokens, __mix_pass, __mix_block and __mix_place."""
    spark = docs.sparkSession
    base = docs.withColumn("__mix_source", source_key(F.col(source))).withColumn("__mix_tokens", token_count(F.col(text)))
    slim = staged(spark, base.select("__mix_source", "__mix_tokens", F.col(key).alias("__mix_key")), "mix-rows").withColumn("__mix_part", block_of(F.col("__mix_key"), seed))
    blocks = staged(spark, slim.groupBy("__mix_source", "__mix_part").agg(F.sum("__mix_tokens").alias("tokens")), "mix-blocks")
    totals = staged(spark, blocks.groupBy("__mix_source").agg(F.sum("tokens").alias("total")), "mix-sources")
    known = totals.agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("whole"), F.min(F.when(F.col("total") > 0, F.col("total"))).alias("least"), F.max("total").alias("most")).first()
    if known["whole"]:
        least, most = known["least"] / known["whole"], known["most"] / known["whole"]
        # repeats are powers of shares, so the least and the greatest share decide on the limit
        alpha = bisect_alpha([least, most], max_repeats) if entropy is None else entropy_alpha(totals.select((F.col("total") / known["whole"]).alias("s")), entropy)
        times = F.when(F.col("total") > 0, F.pow(F.col("total") / known["most"], F.lit(alpha - 1))).otherwise(1.0)
    else:
        times = F.lit(1.0)
    small = (lambda df: F.broadcast(df)) if known["n"] <= MAX_BROADCAST_SOURCES else (lambda df: df)
    whole = F.floor(times + 1e-9)
    plan = totals.select("__mix_source", whole.cast("int").alias("__mix_passes"), F.floor(F.greatest(times - whole, F.lit(0.0)) * F.col("total")).alias("__mix_rest"))
    # Where the partial pass ends: the first block of its order whose running sum exceeds the rest, then the place in it.
    own = permuted(F.col("__mix_part"), F.col("__mix_passes"), F.col("__mix_source"), seed)
    order = W.partitionBy("__mix_source").orderBy("__mix_own")
    running = blocks.join(small(plan), "__mix_source").withColumn("__mix_own", own).withColumn("upto", F.sum("tokens").over(order)).where("upto > __mix_rest")
    edge = running.groupBy("__mix_source").agg(F.min(F.struct("__mix_own", "__mix_part", (F.col("__mix_rest") - F.col("upto") + F.col("tokens")).alias("left"), "__mix_passes")).alias("e")).select("__mix_source", "e.*")
    edge = staged(spark, edge, "mix-edges")
    inside = slim.join(small(edge), ["__mix_source", "__mix_part"]).withColumn("__mix_at", place(F.col("__mix_key"), F.col("__mix_passes"), seed))
    sums = inside.groupBy("__mix_source", "__mix_at", "left").agg(F.sum("__mix_tokens").alias("tokens")).withColumn("upto", F.sum("tokens").over(W.partitionBy("__mix_source").orderBy("__mix_at")))
    cut = sums.where("upto > left").groupBy("__mix_source").agg(F.min("__mix_at").alias("__mix_cut"))
    plan = plan.join(small(edge.select("__mix_source", F.col("__mix_own").alias("__mix_edge"))), "__mix_source", "left").join(small(cut), "__mix_source", "left")
    out = base.join(small(staged(spark, plan, "mix-plan")), "__mix_source")
    part = block_of(F.col(key), seed)
    own, at = permuted(part, F.col("__mix_passes"), F.col("__mix_source"), seed), place(F.col(key), F.col("__mix_passes"), seed)
    # a null edge: every block fits in the rest, whose pass is whole then
    extra = F.when((F.col("__mix_rest") > 0) & (F.col("__mix_edge").isNull() | (own < F.col("__mix_edge")) | ((own == F.col("__mix_edge")) & (at < F.col("__mix_cut")))), 1).otherwise(0)
    out = out.withColumn("__mix_pass", F.explode(F.sequence(F.lit(0), F.col("__mix_passes") + extra - 1)))
    block = permuted(part, F.col("__mix_pass"), F.col("__mix_source"), seed)
    return out.withColumn("__mix_block", block).withColumn("__mix_place", place(F.col(key), F.col("__mix_pass"), seed)).drop("__mix_passes", "__mix_rest", "__mix_edge", "__mix_cut")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return mixed.select("doc_id", "source", F.col("__mix_tokens").alias("n_tokens"), F.col("__mix_pass").alias("pass"), F.col("__mix_block").alias("block"), F.col("__mix_place").alias("place"))
