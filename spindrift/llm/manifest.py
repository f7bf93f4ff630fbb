"""Merkle manifest of a dataset: a tree of digests a group, a tree over the groups' roots, and a proof for every row.

Rows take their place in their group by a range shuffle, numbers within partitions and the sums of the partitions before. Aligned
buckets of 8**LEVELS places are Arrow tables on which executors run DuckDB: each level is one query of sha256 over string_agg in the
order of places. Spark combines the buckets' roots level by level, up to the groups' roots and the root over those, keeps what stands
left and right of each bucket's path, and joins these outer proofs to the buckets, where a second query folds each row's leaf up to
the root. Only digests are shuffled, never texts, and no task holds more than a bucket.

Defined cases: a null column is "-" in its leaf; null groups and null keys come first; rows of equal group and key are ordered by
leaf, so that ties don't change a digest, and repeated rows each have a leaf; texts of any length are hashed whole; a table of one
group has its subroot as root, a lone row its leaf, with the proof of no siblings; an empty table gives an empty table; a row
without a key isn't tampered with; columns that aren't named are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from spindrift.llm.common import crc32_text, documents, staged

#: Children of a node, and the levels below a bucket's root: buckets of 4,096 places.
FAN, LEVELS = 8, 4


def leaf(*columns: Column) -> Column:
    """The digest of values: "-" for null, else UTF-8 length, ":" and the value."""
    parts = []
    for c in columns:
        value = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def placed(rows: DataFrame, by: list[str], label: str) -> DataFrame:
    """rows(grp, ...) with place, the number of the row in its group in the order of the columns by, and size, the group's rows."""
    spark = rows.sparkSession
    order = [F.col(c).asc_nulls_first() for c in ("grp", *by)]
    dealt = rows.withColumn("deal", F.monotonically_increasing_id())  # rows alike in all else needn't meet in one task
    dealt = dealt.repartitionByRange(*order, "deal").sortWithinPartitions(*order, "deal").drop("deal").withColumn("at", F.monotonically_increasing_id())
    found = staged(spark, dealt.withColumn("part", F.shiftright("at", 33)), f"{label}-ordered")
    # a row a partition and group
    starts = found.groupBy("grp", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    group = W.partitionBy("grp")
    starts = starts.select("grp", "part", "first", F.sum("n").over(group).alias("size"), (F.sum("n").over(group.orderBy("part")) - F.col("n")).alias("before"))
    here = starts.select(F.col("grp").alias("g"), F.col("part").alias("p"), "first", "size", "before")
    joined = found.join(here, F.col("grp").eqNullSafe(F.col("g")) & (F.col("part") == F.col("p")))
    return joined.select(*rows.columns, (F.col("at") - F.col("first") + F.col("before")).alias("place"), "size")


# --- buckets, in DuckDB
def levels_of(size: int) -> int:
    n = 0
    while FAN**n < size:
        n += 1
    return n


def level_queries(levels: int) -> str:
    """Common table expressions l0 to l{levels} over bucket(pos, h): each level's nodes by place in the bucket."""
    parts = ["l0 AS (SELECT pos AS p, h FROM bucket)"]
    parts += [f"l{k} AS (SELECT p // {FAN} AS p, sha256(string_agg(h, '' ORDER BY p)) AS h FROM l{k - 1} GROUP BY p // {FAN})" for k in range(1, levels + 1)]
    return ", ".join(parts)


def engine(bucket: pa.Table):  # noqa: ANN201
    """DuckDB in this process: one thread, in memory, with the bucket as a view."""
    import duckdb

    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "512MB", "temp_directory": "", "autoload_known_extensions": "false", "autoinstall_known_extensions": "false"})
    con.register("bucket", bucket)
    return con


def bucket_root(bucket: pa.Table, most: int) -> pa.Table:
    """(grp, bucket, h, size) of one bucket(grp, bucket, pos, h, size): its root, and the number of the group's buckets."""
    size = bucket.column("size")[0].as_py()
    levels = min(most, levels_of(size))
    con = engine(bucket.select(["pos", "h"]))
    try:
        root = con.execute(f"WITH {level_queries(levels)} SELECT h FROM l{levels}").fetchall()
    finally:
        con.close()
    if len(root) != 1:
        raise ValueError("a bucket has one root")
    return pa.table({"grp": bucket.column("grp").slice(0, 1), "bucket": bucket.column("bucket").slice(0, 1), "h": [root[0][0]], "size": pa.array([-(-size // FAN**most)], pa.int64())})


def bucket_proofs(bucket: pa.Table, outer: pa.Table, most: int) -> pa.Table:
    """(key, leaf, subroot, root, proof_sha256, folded_root) of each row of a bucket(key, pos, h, other, size) with its outer(path, subroot, root):
    the other digest is folded with the siblings of the row's own."""
    size = bucket.column("size")[0].as_py()
    levels = min(most, levels_of(size))
    path = outer.column("path")[0].as_py()
    sides = [f"s{k} AS (SELECT p, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM l{k} WINDOW w AS (PARTITION BY p // {FAN} ORDER BY p))" for k in range(levels)]
    folds = ["f0 AS (SELECT pos, other AS f, '' AS proof FROM bucket)"]
    folds += [f"f{k + 1} AS (SELECT pos, sha256(a || f || b) AS f, proof || a || b AS proof FROM f{k} JOIN s{k} ON p = pos // {FAN**k})" for k in range(levels)]
    values: dict[str, str] = {}
    for k, (a, b) in enumerate(((p["a"], p["b"]) for p in path), levels):
        values |= {f"a{k}": a, f"b{k}": b}
        folds.append(f"f{k + 1} AS (SELECT pos, sha256($a{k} || f || $b{k}) AS f, proof || $a{k} || $b{k} AS proof FROM f{k})")
    con = engine(bucket.select(["pos", "h", "other"]))
    try:
        sql = f"WITH {', '.join([level_queries(levels), *sides, *folds])} SELECT pos, sha256(proof) AS proof_sha256, f AS folded_root FROM f{levels + len(path)} ORDER BY pos"
        found = con.sql(sql, params=values).to_arrow_table() if values else con.sql(sql).to_arrow_table()
    finally:
        con.close()
    bucket = bucket.sort_by("pos")
    n = len(bucket)
    return pa.table({"key": bucket.column("key"), "leaf": bucket.column("h"), "subroot": [outer.column("subroot")[0].as_py()] * n, "root": [outer.column("root")[0].as_py()] * n, "proof_sha256": found.column("proof_sha256"), "folded_root": found.column("folded_root")})


# --- above the buckets, in Spark
def combined(nodes: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """For nodes(grp, bucket, h, size), with bucket from 0 and size the nodes of the group: (grp, bucket, path) with the digests left and
    right of each node's way up, level by level, and (grp, root). One small aggregation a level: an eighth of the rows each time."""
    spark = nodes.sparkSession
    nodes = staged(spark, nodes, f"{label}-nodes")
    most = nodes.agg(F.max("size")).first()[0] or 0
    paths = nodes.select("grp", "bucket", F.col("bucket").alias("at"), F.expr("cast(array() as array<struct<a:string,b:string>>)").alias("path"))
    level = nodes.select("grp", F.col("bucket").alias("at"), "h", "size")
    for k in range(levels_of(most)):
        run = W.partitionBy("grp", F.expr(f"at div {FAN}")).orderBy("at")
        beside = lambda low, high, run=run: F.concat_ws("", F.collect_list("h").over(run.rowsBetween(low, high)))  # noqa: E731  FAN rows at most
        sides = level.select(F.col("grp").alias("g"), F.col("at").alias("p"), F.when(F.col("size") > 1, F.struct(beside(W.unboundedPreceding, -1).alias("a"), beside(1, W.unboundedFollowing).alias("b"))).alias("side"))
        joined = paths.join(sides, F.col("grp").eqNullSafe(F.col("g")) & (F.col("at") == F.col("p")))
        paths = joined.select("grp", "bucket", F.expr(f"at div {FAN}").alias("at"), F.when(F.col("side").isNull(), F.col("path")).otherwise(F.array_append("path", F.col("side"))).alias("path"))
        up = level.groupBy("grp", F.expr(f"at div {FAN}").alias("at"), "size").agg(F.sort_array(F.collect_list(F.struct("at", "h"))).alias("run"))
        joined_up = F.concat_ws("", F.transform("run", lambda x: x["h"]))
        level = staged(spark, up.select("grp", "at", F.when(F.col("size") > 1, F.sha2(joined_up, 256)).otherwise(joined_up).alias("h"), F.expr(f"(size + {FAN - 1}) div {FAN}").alias("size")), f"{label}-level{k}")
        paths = staged(spark, paths, f"{label}-paths{k}")
    return paths.select("grp", "bucket", "path"), level.select("grp", F.col("h").alias("root"))


def buckets(rows: DataFrame, levels: int) -> DataFrame:
    return rows.withColumns({"bucket": F.expr(f"place div {FAN**levels}"), "pos": F.col("place") % FAN**levels})


def roots(rows: DataFrame, levels: int) -> DataFrame:
    """(grp, bucket, h, size) of the buckets of rows(grp, place, size, h)."""
    group = rows.schema["grp"].dataType.simpleString()
    return buckets(rows, levels).select("grp", "bucket", "pos", "h", "size").groupBy("grp", "bucket").applyInArrow(lambda bucket: bucket_root(bucket, levels), f"grp {group}, bucket long, h string, size long")


def manifest(rows: DataFrame, by: list[str], levels: int = LEVELS, label: str = "manifest") -> tuple[DataFrame, DataFrame]:
    """For rows(grp, key, h, other) and buckets of so many levels: their places, ordered by the columns by and h, and (grp, bucket, path, subroot, root), a row a bucket."""
    spark = rows.sparkSession
    found = staged(spark, placed(rows, [*by, "h"], label), f"{label}-placed")
    paths, subroots = combined(roots(found, levels), label)
    # the groups' roots are the leaves of the tree over the groups
    over = placed(subroots.select(F.lit(0).alias("grp"), F.col("grp").alias("name"), F.col("root").alias("h")), ["name"], f"{label}-groups")
    group_paths, top = combined(over.select("grp", F.col("place").alias("bucket"), "h", "size"), f"{label}-top")
    groups = over.select(F.col("name").alias("g"), F.col("place").alias("n"), F.col("h").alias("subroot")).join(group_paths.select(F.col("bucket").alias("n"), F.col("path").alias("above")), "n").crossJoin(top.select("root"))  # one row
    outer = paths.join(groups, F.col("grp").eqNullSafe(F.col("g"))).select("grp", "bucket", F.concat("path", "above").alias("path"), "subroot", "root")
    return found, staged(spark, outer, f"{label}-outer")


def proofs(rows: DataFrame, by: list[str], levels: int = LEVELS, label: str = "manifest") -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root) of each of rows(grp, key, h, other); the folded root is that of other in place
    of the row's own h."""
    found, outer = manifest(rows, by, levels, label)
    kind = rows.schema["key"].dataType.simpleString()
    left = buckets(found, levels).select("grp", "bucket", "pos", "key", "h", "other", "size").groupBy("grp", "bucket")
    return left.cogroup(outer.groupBy("grp", "bucket")).applyInArrow(lambda bucket, outer: bucket_proofs(bucket, outer, levels), f"key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string")


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = F.coalesce(crc32_text(F.col("doc_id")) % 3 == 0, F.lit(False))
    rows = docs.select(F.col("lang").alias("grp"), F.col("doc_id").alias("key"), leaf(*columns).alias("h"), F.when(tampered, leaf(*columns[:-1], lowered(F.col("text")))).alias("other"))
    rows = rows.withColumn("other", F.coalesce("other", "h"))
    found = proofs(rows, ["key"])
    return found.withColumnRenamed("key", "doc_id").withColumn("verified", F.col("folded_root") == F.col("root"))


_LEVELS = 12


def _oracle() -> str:
    """All levels of both trees written out (8**12 rows a language), and crc32 bit by bit."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    head = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bit = "lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    digits = "list_transform(range(1, strlen(doc_id::VARCHAR)::BIGINT + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)"
    crc = f"list_reduce(list_prepend(4294967295::BIGINT, {digits}), lambda s, b: list_reduce(list_prepend(xor(s, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), {bit}))"

    def tree(name: str, grp: str, first: str) -> list[str]:
        parts = [f"{name}0 AS ({first})"]
        for k in range(_LEVELS):
            window = f"(PARTITION BY {grp}, p // 8 ORDER BY p ROWS BETWEEN"
            parts.append(f"{name}s{k} AS (SELECT {grp}, p, size, coalesce(string_agg(h, '') OVER {window} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, coalesce(string_agg(h, '') OVER {window} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM {name}{k})")
            parts.append(f"{name}{k + 1} AS (SELECT {grp}, p // 8 AS p, CASE WHEN any_value(size) > 1 THEN sha256(string_agg(h, '' ORDER BY p)) ELSE any_value(h) END AS h, (any_value(size) + 7) // 8 AS size FROM {name}{k} GROUP BY {grp}, p // 8)")
        return parts

    parts = [
        f"d AS (SELECT doc_id, lang, sha256({head} || {field('text')}) AS leaf, CASE WHEN xor({crc}, 4294967295) % 3 = 0 THEN sha256({head} || {field(lower)}) END AS changed FROM documents)",
        "r AS (SELECT *, coalesce(lang, '') AS l, lang IS NOT NULL AS named, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS size FROM d)",
        *tree("t", "named, l", "SELECT named, l, place AS p, leaf AS h, size FROM r"),
        f"g AS (SELECT named, l, h AS subroot, row_number() OVER (ORDER BY named, l) - 1 AS place, count(*) OVER () AS size FROM t{_LEVELS})",
        *tree("u", "one", "SELECT 1 AS one, place AS p, subroot AS h, size FROM g"),
        f"f0 AS (SELECT r.*, g.subroot, g.place AS gp, (SELECT h FROM u{_LEVELS}) AS root, coalesce(changed, leaf) AS f, '' AS proof FROM r JOIN g USING (named, l))",
    ]
    for k in range(2 * _LEVELS):
        side = f"ts{k} s ON s.named = f.named AND s.l = f.l AND s.p = f.place // {8**k}" if k < _LEVELS else f"us{k - _LEVELS} s ON s.p = f.gp // {8 ** (k - _LEVELS)}"
        parts.append(f"f{k + 1} AS (SELECT f.* REPLACE (CASE WHEN s.size > 1 THEN sha256(s.a || f.f || s.b) ELSE f.f END AS f, CASE WHEN s.size > 1 THEN proof || s.a || s.b ELSE proof END AS proof) FROM f{k} f JOIN {side})")
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified FROM f{2 * _LEVELS}"


ORACLE = _oracle()
