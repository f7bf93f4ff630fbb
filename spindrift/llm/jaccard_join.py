"""N-gram Jaccard join with a token-group matrix: exact links of texts whose shingle sets are similar.

A text's set is its distinct k-word shingles. Sets of similarity s or more have sizes within the ratio s and
share a token of their prefixes, if a prefix is the first n - ceil(s n) + 1 tokens of a set in any order that
all sets follow; here frequent tokens come last, so prefixes are rare tokens.

1. One pass over the text: sets' sizes, keys (equal sets, equal keys), bit signatures, and locally frequent tokens.
2. Second pass: prefix tokens, shuffled by token in packed blocks. Tokens that one set alone has end here.
3. Groups: each set is compared with a pivot of its reach in each of its rows; a group is a set and those linked to it.
   Pivots are the sets whose prefixes have the largest share of frequent tokens: a copy's edits make rare tokens, so of a
   large group of near copies that is the text with the fewest edits, and the others link to it.
4. The token-group matrix has the union of each group's prefix tokens and its range of sizes. Two groups that no links
   connect yet qualify if they have a row in common, their sizes allow the overlap and their centers' signatures, which
   bound overlap from above, leave their members within reach; only those are opened, and their members compared,
   by signatures first and then by their texts.
5. Components of the links found in 3 and 4.

A frequent token's row is split over salted blocks, each with pivots of its own, which are compared in turn.

Defined cases: null or wordless texts have the empty set, linked with nothing; copies have one class; a very long text
is one row's set; rows with the same key are one document, of which the largest set is compared; rows with a null key have a null component; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import connected, documents, mix, shingles, staged, steps, text_bytes

WORDS, PERCENT = 5, 80
#: A token that this many sets have goes to the end of the order; at most FREQUENT_KEPT such tokens, the most
#: frequent, are sent to all executors. Any order is right; this one keeps rows of the matrix short.
FREQUENT, FREQUENT_KEPT = 64, 1 << 18
LOCAL_REPORT, LOCAL_BLOCK = 3, 1 << 20
#: Prefix tokens that a task packs before it passes them on, and tokens that a bucket shall have.
FLUSH, BUCKET = 1 << 19, 200_000
#: Sets in a salted block of a frequent token's row.
BLOCK = 20_000
#: Ids that are broadcast to filter the text; beyond it the text is shuffled.
MAX_BROADCAST_IDS = 4_000_000
#: Texts of a batch, and pairs of texts.
ARROW_TEXTS, ARROW_PAIRS = 1024, 256


def prefix_size(n: np.ndarray | int, percent: int = PERCENT):  # noqa: ANN201
    return n - -(-percent * n // 100) + 1


def sets_of(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    s, owner = shingles(data, offsets, k)
    at = np.searchsorted(owner, np.arange(len(offsets)))
    return [np.unique(s[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def signature(tokens: np.ndarray) -> bytes:
    """Parities of the tokens' counts in twice as many bits as the set has tokens, rounded up to a power of two."""
    m = 1 << max(6, int(2 * len(tokens) - 1).bit_length()) if len(tokens) else 64
    return np.packbits((np.bincount((mix(tokens.copy()) & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1).astype(np.uint8)).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference of two sets, by their signatures; the longer is folded."""
    x, y = np.unpackbits(np.frombuffer(a, np.uint8)), np.unpackbits(np.frombuffer(b, np.uint8))
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int((x != y).sum())


def filter_by_ids(docs: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """docs with (left_semi) or without (left_anti) the keys in ids(id): ids are broadcast if few, else both sides shuffle."""
    side = ids.select(F.col("id").alias("__id"))
    if ids.count() <= MAX_BROADCAST_IDS:
        side = F.broadcast(side)
    return docs.join(side, docs[key] == side["__id"], how)


class Join:
    """The join's tables over docs(key, text): members, links and components."""

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = WORDS, percent: int = PERCENT) -> None:
        self.spark: SparkSession = docs.sparkSession
        self.k, self.percent = k, percent
        self.docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
        passed = staged(self.spark, self.docs.mapInArrow(self._describe(), "id long, n long, set binary, bits binary, tokens binary, counts binary"), "sets", ARROW_TEXTS)
        #: (id, n, rep): each row's set size, and the least id with an equal set; null reps are empty sets
        described = passed.where("tokens is null")
        full = described.where("n > 0 and id is not null")
        # a table of its own, so that the join shuffles it anew and a set of very many copies can be split
        classes = staged(self.spark, full.groupBy("set").agg(F.min("id").alias("rep")), "classes")
        named = full.join(classes, "set").select("id", "n", "rep", F.when(F.col("id") == F.col("rep"), F.col("bits")).alias("bits"))
        rest = described.where("n = 0 or id is null").select("id", "n", F.lit(None).cast("long").alias("rep"), F.lit(None).cast("binary").alias("bits"))
        self.members = staged(self.spark, named.unionByName(rest), "members")
        self.frequent = self._frequent(passed)
        self.sets = self.members.where("id = rep").groupBy("id").agg(F.max(F.struct("n", "bits")).alias("s")).select("id", "s.*")

    def _describe(self):  # noqa: ANN202
        k = self.k

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[np.ndarray] = []
            seen: set[bytes] = set()
            size = 0
            names = ["id", "n", "set", "bits", "tokens", "counts"]

            def report() -> pa.RecordBatch:
                t, c = np.unique(np.concatenate(held), return_counts=True)
                often = c >= LOCAL_REPORT
                return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([0], pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([t[often].tobytes()], pa.binary()), pa.array([c[often].astype(np.int64).tobytes()], pa.binary())], names)

            for batch in batches:
                data, offsets = text_bytes(batch.column(1))
                for i, j in steps(offsets):
                    o = offsets[i : j + 1]
                    sets = sets_of(data[o[0] : o[-1]], o - o[0], k)
                    keys = [hashlib.md5(s.tobytes()).digest() for s in sets]
                    for s, key in zip(sets, keys, strict=True):
                        if key not in seen:  # copies count once a task
                            seen.add(key)
                            held.append(s)
                            size += len(s)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array([signature(s) for s in sets], pa.binary()), pa.nulls(j - i, pa.binary()), pa.nulls(j - i, pa.binary())], names)
                    if size >= LOCAL_BLOCK:
                        yield report()
                        held, size = [], 0
                        seen.clear()
            if held:
                yield report()

        return each

    def _frequent(self, passed: DataFrame) -> np.ndarray:
        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for t, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(t, np.int64)), pa.array(np.frombuffer(c, np.int64))], ["token", "c"])

        counts = passed.where("tokens is not null").select("tokens", "counts").mapInArrow(unpack, "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))
        top = counts.where(F.col("c") >= FREQUENT).orderBy(F.desc("c"), "token").limit(FREQUENT_KEPT).select("token").collect()  # FREQUENT_KEPT longs at most
        return np.sort(np.array([r["token"] for r in top], np.int64).view(np.uint64))

    def matrix(self) -> DataFrame:
        """(token, id, n, pivot, often): prefix tokens that several sets have, with the pivot each set is compared to."""
        frequent = self.spark.sparkContext.broadcast(self.frequent)
        k, percent = self.k, self.percent
        total = self.sets.agg(F.coalesce(F.sum(prefix_size_column(percent)), F.lit(0)), F.count(F.lit(1))).first()
        bits = max(4, int(max(1, total[0] // BUCKET)).bit_length())
        salts = max(1, -(-total[1] // BLOCK))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            often = frequent.value
            held: list[tuple[np.ndarray, ...]] = []
            seen: set[bytes] = set()
            size = 0

            def flush() -> pa.RecordBatch:
                token, ids, n, late, weight = (np.concatenate(x) for x in zip(*held, strict=True))
                bucket = (token >> np.uint64(64 - bits)).astype(np.int64)
                salt = np.where(late, 1 + (mix(ids.view(np.uint64).copy()) % np.uint64(salts)).astype(np.int64), 0)
                order = np.lexsort((token, salt, bucket))
                token, ids, n, weight, bucket, salt = (x[order] for x in (token, ids, n, weight, bucket, salt))
                cut = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (salt[1:] != salt[:-1])]))
                ends = np.append(cut[1:], len(token))
                blob = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary())
                return pa.RecordBatch.from_arrays([pa.array(bucket[cut]), pa.array(salt[cut]), blob(token), blob(ids), blob(n.astype(np.int32)), blob(weight)], ["bucket", "salt", "token", "ids", "n", "weight"])

            for batch in batches:
                data, offsets = text_bytes(batch.column(1))
                ids = batch.column(0).to_pylist()
                for i, j in steps(offsets):
                    o = offsets[i : j + 1]
                    for doc, s in zip(ids[i:j], sets_of(data[o[0] : o[-1]], o - o[0], k), strict=True):
                        if not len(s) or doc is None or (key := hashlib.md5(s.tobytes()).digest()) in seen:
                            continue
                        seen.add(key)
                        n = len(s)
                        p = int(prefix_size(n, percent))
                        late = np.zeros(n, bool)
                        if len(often):
                            late = often[np.minimum(np.searchsorted(often, s), len(often) - 1)] == s
                        light = s[~late][:p]
                        s = np.concatenate([light, s[late][: p - len(light)]])
                        held.append((s, np.full(p, doc, np.int64), np.full(p, n, np.int64), np.arange(p) >= len(light), np.full(p, 1000 * (p - len(light)) // p, np.int16)))
                        size += p
                    if size >= FLUSH:
                        yield flush()
                        held, size = [], 0
                        if len(seen) > 1_000_000:
                            seen.clear()
            if held:
                yield flush()

        def meet(group: pd.DataFrame) -> pd.DataFrame:
            token = np.frombuffer(b"".join(group["token"]), np.uint64)
            ids, n = np.frombuffer(b"".join(group["ids"]), np.int64), np.frombuffer(b"".join(group["n"]), np.int32).astype(np.int64)
            weight = np.frombuffer(b"".join(group["weight"]), np.int16)
            order = np.lexsort((ids, -weight, token))
            token, ids, n, weight = token[order], ids[order], n[order], weight[order]
            same = np.concatenate([[False], (token[1:] == token[:-1]) & (ids[1:] == ids[:-1])])  # copies met in one task are gone, rows may repeat
            token, ids, n, weight = token[~same], ids[~same], n[~same], weight[~same]
            fresh = np.concatenate([[True], token[1:] != token[:-1]])
            run = np.cumsum(fresh) - 1
            shared = (np.bincount(run)[run] > 1) | bool(group["salt"].iloc[0])
            token, ids, n, weight = token[shared], ids[shared], n[shared], weight[shared]
            pivot = pivots(token, n, percent)
            return pd.DataFrame({"token": token.view(np.int64), "id": ids, "n": n, "pivot": ids[pivot], "pivot_n": n[pivot], "pivot_weight": weight[pivot], "often": bool(group["salt"].iloc[0])})

        blocks = self.docs.mapInArrow(pack, "bucket long, salt long, token binary, ids binary, n binary, weight binary")
        return staged(self.spark, blocks.groupBy("bucket", "salt").applyInPandas(meet, "token long, id long, n long, pivot long, pivot_n long, pivot_weight int, often boolean"), "matrix", ARROW_TEXTS)

    def linked(self, pairs: DataFrame, label: str) -> DataFrame:
        """The (a, b) of pairs (ids of distinct sets) that link: sizes, then signatures, then the texts themselves."""
        a = self.sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a"))
        b = self.sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b"))
        sized = pairs.join(a, "a").join(b, "b").where(F.expr(f"100 * least(na, nb) >= {self.percent} * greatest(na, nb)"))
        percent, k = self.percent, self.k

        def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                na, nb, x, y = (batch.column(i).to_pylist() for i in (2, 3, 4, 5))
                # |A & B| <= (na + nb - d) / 2 for a difference of d or more
                keep = [(200 + 2 * percent) * (p + q - least_difference(s, t)) // 2 >= 2 * percent * (p + q) for p, q, s, t in zip(na, nb, x, y, strict=True)]
                yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

        near = staged(self.spark, sized.select("a", "b", "na", "nb", "bits_a", "bits_b").mapInArrow(bounded, "a long, b long"), f"{label}-near")
        ids = staged(self.spark, near.select(F.col("a").alias("id")).union(near.select("b")).distinct(), f"{label}-ids")
        texts = filter_by_ids(self.docs, ids, "id")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                one, two = text_bytes(batch.column(2)), text_bytes(batch.column(3))
                for i, j in steps(one[1] + two[1]):
                    x, y = (sets_of(d[o[i] : o[j]], o[i : j + 1] - o[i], k) for d, o in (one, two))
                    keep = [jaccard_at_least(s, t, percent) for s, t in zip(x, y, strict=True)]
                    yield pa.RecordBatch.from_arrays([c.slice(i, j - i) for c in batch.columns[:2]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

        both = near.join(texts.withColumnRenamed("id", "a").withColumnRenamed("text", "text_a"), "a").join(texts.withColumnRenamed("id", "b").withColumnRenamed("text", "text_b"), "b")
        return staged(self.spark, both.select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long"), f"{label}-links", ARROW_PAIRS)

    def links(self) -> tuple[DataFrame, DataFrame]:
        """Links found on the way (a, b), enough for the components, and the matrix rows with their sets' representatives."""
        rep = self.members.where("rep is not null").select("id", "rep").distinct()
        rows = self.matrix()
        # pivots of the salted blocks of a frequent token meet the first of their size band
        heads = rows.where("often").select("token", "pivot", "pivot_weight", F.floor(F.log("pivot_n") / F.log(F.lit(100 / self.percent))).alias("band")).distinct()
        first = heads.groupBy("token", "band").agg(F.min(F.struct(-F.col("pivot_weight"), "pivot")).alias("first")).select("token", "band", F.col("first.pivot").alias("first"))
        met = heads.join(first, ["token", "band"]).select(F.col("first").alias("x"), F.col("pivot").alias("y"))
        stars = rows.select(F.col("pivot").alias("x"), F.col("id").alias("y")).union(met).where("x <> y").distinct()
        named = lambda c, to: rep.select(F.col("id").alias(c), F.col("rep").alias(to))
        tried = staged(self.spark, stars.join(named("x", "p"), "x").join(named("y", "q"), "y").where("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), "stars")
        found = self.linked(tried, "stars")
        labels = connected(self.spark, found, "groups")
        groups = staged(self.spark, self._centers(found).join(labels, "id"), "centers")
        # the token-group matrix: each group's union of tokens and its range of sizes
        placed = rows.select("token", "id", "n").join(rep, "id").join(groups.select(F.col("id").alias("rep"), "center", "component"), "rep", "left").select("token", "n", F.coalesce("center", "rep").alias("g"), F.coalesce("component", "rep").alias("whole"))
        union = placed.groupBy("token", "g").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("whole").alias("whole"))
        several = union.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token")
        union = staged(self.spark, union.join(several, "token", "left_semi"), "token-groups")
        one, two = (union.select("token", *(F.col(c).alias(f"{c}{i}") for c in ("g", "low", "high", "whole"))) for i in (1, 2))
        fits = F.expr(f"g1 < g2 and whole1 <> whole2 and 100 * high1 >= {self.percent} * low2 and 100 * high2 >= {self.percent} * low1")
        shared = one.join(two, "token").where(fits).groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("c"), *(F.min(f"low{i}").alias(f"low{i}") for i in (1, 2)), *(F.max(f"high{i}").alias(f"high{i}") for i in (1, 2)))
        pairs = shared.where(enough_common(self.percent)).select("g1", "g2")
        # two single sets that were compared already needn't be opened again
        grouped = [groups.select(F.col("center").alias(f"g{i}"), F.lit(1).alias(f"m{i}")).distinct() for i in (1, 2)]
        seen = tried.select(F.col("a").alias("g1"), F.col("b").alias("g2")).join(grouped[0], "g1", "left_anti").join(grouped[1], "g2", "left_anti")
        pairs = pairs.join(seen, ["g1", "g2"], "left_anti").join(grouped[0], "g1", "left").join(grouped[1], "g2", "left")
        open_ = staged(self.spark, self._in_reach(pairs), "open")
        # centers first: groups that their links connect needn't be opened
        found = staged(self.spark, found.union(self.linked(open_.select(F.col("g1").alias("a"), F.col("g2").alias("b")), "centers")), "found")
        labels = connected(self.spark, found, "joined")
        whole = [labels.select(F.col("id").alias(f"g{i}"), F.col("component").alias(f"whole{i}")) for i in (1, 2)]
        apart = open_.join(whole[0], "g1", "left").join(whole[1], "g2", "left").where("whole1 is null or whole2 is null or whole1 <> whole2")
        open_ = staged(self.spark, apart.select("g1", "g2"), "apart")
        inside = self.sets.select("id", "n").join(groups.select("id", "center"), "id", "left").select(F.coalesce("center", "id").alias("g"), "id", "n")
        both = open_.join(inside.select(F.col("g").alias("g1"), F.col("id").alias("x"), F.col("n").alias("nx")), "g1").join(inside.select(F.col("g").alias("g2"), F.col("id").alias("y"), F.col("n").alias("ny")), "g2")
        opened = both.where(F.expr(f"100 * least(nx, ny) >= {self.percent} * greatest(nx, ny)")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        return found.union(self.linked(staged(self.spark, opened, "opened"), "opened")), rows

    def _centers(self, found: DataFrame) -> DataFrame:
        """(id, center): for each linked set the one of most links among itself and the sets it links to, so members link to their center."""
        ways = found.select("a", "b").union(found.select("b", "a")).distinct()
        degree = ways.groupBy(F.col("b").alias("b")).agg(F.count(F.lit(1)).alias("links"))
        near = ways.union(ways.select("a", "a").distinct()).join(degree, "b")
        return near.groupBy(F.col("a").alias("id")).agg(F.max(F.struct("links", (-F.col("b")).alias("b"))).alias("top")).select("id", (-F.col("top.b")).alias("center"))

    def _in_reach(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (g1, g2, m1, m2) those that may have linked members. Jaccard distance is a metric and members are within a
        link's distance of their center, so centers are within one, two or three links' distance; signatures bound theirs from below."""
        percent = self.percent

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                na, nb, x, y, links = (batch.column(i).to_pylist() for i in (2, 3, 4, 5, 6))
                keep = []
                for p, q, s, t, k in zip(na, nb, x, y, links, strict=True):
                    common = (p + q - least_difference(s, t)) // 2
                    keep.append(100 * common >= (100 - k * (100 - percent)) * (p + q - common))
                yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["g1", "g2"]).filter(pa.array(keep, pa.bool_()))

        side = lambda i: self.sets.select(F.col("id").alias(f"g{i}"), F.col("n").alias(f"n{i}"), F.col("bits").alias(f"bits{i}"))
        links = F.lit(1) + F.coalesce("m1", F.lit(0)) + F.coalesce("m2", F.lit(0))
        return pairs.join(side(1), "g1").join(side(2), "g2").select("g1", "g2", "n1", "n2", "bits1", "bits2", links.alias("links")).mapInArrow(near, "g1 long, g2 long")

    def components(self) -> DataFrame:
        """(id, n, rep, component) of each row of docs."""
        labels = connected(self.spark, self.links()[0], "components").select(F.col("id").alias("rep"), "component")
        found = self.members.select("id", "n", "rep").join(labels, "rep", "left")
        return found.select("id", "n", "rep", F.coalesce("component", "rep", "id").alias("component"))


def prefix_size_column(percent: int) -> F.Column:
    return F.expr(f"n - ceil({percent} * n / 100) + 1")


def enough_common(percent: int) -> F.Column:
    """Whether groups with c tokens in common can have linked members. Of linked sets of nx <= ny tokens the overlap is t (nx + ny) / (1 + t)
    or more, and at most t ny of it lies outside the prefix that ends first; the rest is common to both prefixes."""
    t = percent / 100
    a, b = t / (1 + t), t / (1 + t) - t
    return F.expr(f"c + 1e-6D >= least({a!r}D * low1 + ({b!r}D) * high2, {a!r}D * low2 + ({b!r}D) * high1)")


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return bool(common) and 100 * common >= percent * (len(a) + len(b) - common)


def pivots(token: np.ndarray, n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """For rows sorted by token and by choice: the row of the pivot of each. A token's first row is one, and so is the first
    row whose size is out of reach of those before, until none is left."""
    pivot = np.full(len(token), -1, np.int64)
    todo = np.arange(len(token))
    while len(todo):
        head = todo[np.concatenate([[True], token[todo][1:] != token[todo][:-1]])]
        mine = head[np.searchsorted(token[head], token[todo])]
        reach = 100 * np.minimum(n[mine], n[todo]) >= percent * np.maximum(n[mine], n[todo])
        pivot[todo[reach]] = mine[reach]
        todo = todo[~reach]
    return pivot


ROW = "__row"


def ids_repeat(docs: DataFrame, key: str = "doc_id") -> bool:
    return not docs.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").isEmpty()


def with_rows(docs: DataFrame, key: str) -> DataFrame:
    """docs, written, with ROW: a number of its own for each row with a key."""
    return staged(docs.sparkSession, docs.withColumn(ROW, F.when(F.col(key).isNotNull(), F.monotonically_increasing_id())), "rows")


def ranked(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(component, rank) of each row with a key: rank orders rows by key, text and all their values, alike however rows are dealt."""
    own = [c for c in rows.columns if c != ROW]
    facts = rows.where(F.col(ROW).isNotNull()).select(F.col(ROW).alias("id"), F.struct(F.col(key).cast("long").alias("key"), F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256).alias("digest"), F.xxhash64(*[F.col(f"`{c}`") for c in own]).alias("h"), F.col(ROW).alias("row")).alias("rank"))
    return Join(rows, ROW, text).components().where("id is not null").select("id", "component").join(facts, "id").select("component", "rank")


def document_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, component) of each row of docs: the least id of the documents that links reach. Rows that share an id are documents of their own."""
    if not ids_repeat(docs, key):
        return Join(docs, key, text).components().select("id", "n", "component")
    rows = with_rows(docs, key)
    found = staged(docs.sparkSession, Join(rows, ROW, text).components().select("id", "n", "component"), "components")
    keys = rows.where(F.col(ROW).isNotNull()).select(F.col(ROW).alias("id"), F.col(key).cast("long").alias("key"))
    least = found.join(keys, "id").groupBy("component").agg(F.min("key").alias("least"))
    return found.join(keys, "id", "left").join(least, "component", "left").select(F.col("key").alias("id"), "n", F.col("least").alias("component"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs' rows without those that links reach from another row that stays: that of the least id. Where ids repeat, rows of one id with texts
    that aren't linked all stay, and of rows with equal id and text one does: the least by all their values. Rows without an id stay."""
    spark = docs.sparkSession
    if not ids_repeat(docs, key):
        found = staged(spark, Join(docs, key, text).components(), "components")
        return filter_by_ids(docs, staged(spark, found.where("component <> id").select("id").distinct(), "dropped"), key, "left_anti")
    rows = with_rows(docs, key)
    first = ranked(rows, key, text).groupBy("component").agg(F.min("rank").alias("rank"))
    kept = staged(spark, first.groupBy("rank.key", "rank.digest").agg(F.min(F.struct("rank.h", "rank.row")).alias("best")).select(F.col("best.row").alias("id")), "kept")
    dropped = staged(spark, rows.where(F.col(ROW).isNotNull()).select(F.col(ROW).alias("id")).join(kept, "id", "left_anti"), "dropped")
    return filter_by_ids(rows, dropped, ROW, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = document_components(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
