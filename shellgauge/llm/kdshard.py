"""Shards of nearly equal bytes by a k-d tree over metadata, with DataFrame operations only.

Every document is a point: log of its size, bytes a character, and language and source (by hash, so that a cut parts
the categories into two sets). A node that has to give k shards is cut along its widest dimension at the weighted
quantile k//2 / k of its bytes, until every leaf is one shard. Widths are weighted standard deviations, each as a share
of the whole table's, so that dimensions of unlike scale compare. Equal texts are next to each other: points
are ordered by coordinate, then text hash, then row hash; a cut falls between two texts unless that would leave a
side off by more than TOLERANCE of a shard, in which case it goes through the copies of one text. The row hash takes in a number
that each row of the table gets, so equal rows and null keys can be parted, too.

The quantiles of all nodes of a level are found together by histograms that are refined
step by step, each one partial aggregation over all rows. The driver gets at most
nodes x 4096 rows of such a histogram, whatever the input. After each level the points are written with their
new nodes to the shared folder.

Null texts have no bytes; null keys, repeated rows and ties are kept, each row gets a slot of its own.
An empty table gives an empty result. Only the key and the results are returned, so further columns
can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

BITS = 20
FINE = 10
#: Share of a shard's bytes that a cut may be off for the sake of keeping the copies of a text together.
TOLERANCE = 0.002
#: Rows of a shard that are numbered by one task.
ROWS_PER_BUCKET = 50_000
#: Bytes that a row counts besides its text.
ROW_BYTES = 8

DIMS = ("c_size", "c_density", "c_lang", "c_source")


def points(df: DataFrame, key: str, text: str, categories: dict[str, str | None]) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    size = F.octet_length(body).cast("long") + ROW_BYTES
    top = 2**BITS - 1
    return df.select(
        F.col(key).alias("key"),
        size.alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.least(F.floor(F.log2(size) / 40 * top), F.lit(top)).cast("long").alias("c_size"),
        F.least(F.floor((F.octet_length(body) / F.greatest(F.char_length(body), F.lit(1)) - 1).cast("double") / 3 * top), F.lit(top)).cast("long").alias("c_density"),
        *[F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("")) if c else F.lit("")), 64 - BITS).alias(name) for name, c in categories.items()],
        F.shiftrightunsigned(F.xxhash64(body, F.lit(1)), 4).alias("u"),
        F.shiftrightunsigned(F.xxhash64(F.col(key).cast("string"), F.monotonically_increasing_id()), 4).alias("v"),
    )


def _left(bound: list[tuple[Column, int]]) -> Column:
    """Whether a row lies left of a cut: it is below [(column, value), ...] in lexicographic order."""
    out, same = F.lit(False), F.lit(True)
    for c, v in bound:
        out = out | (same & (c < F.lit(v)))
        same = same & (c == F.lit(v))
    return out


def _hist(rows: DataFrame, what: dict[int, tuple[Column, Column]]) -> dict[int, list[tuple[int, int]]]:
    """node -> sorted [(value, bytes)] of a column, among the node's rows that pass a filter."""
    value = F.lit(None).cast("long")
    for n, (cond, col) in what.items():
        value = F.when((F.col("node") == n) & cond, col).otherwise(value)
    got = rows.select("node", value.alias("value"), "size").where("value is not null").groupBy("node", "value").agg(F.sum("size").alias("w")).collect()
    out: dict[int, list[tuple[int, int]]] = {n: [] for n in what}
    for r in got:
        out[r["node"]].append((r["value"], r["w"]))
    return {n: sorted(x) for n, x in out.items()}


def _pick(hist: list[tuple[int, int]], before: float, goal: float) -> tuple[int, float, float]:
    """The value in which the running sum passes the goal, the sum before it, and its own weight."""
    for v, w in hist:
        if before + w >= goal or v == hist[-1][0]:
            return v, before, w
        before += w
    return 0, before, 0.0


def split_tree(rows: DataFrame, shards: int) -> tuple[DataFrame, dict[int, int]]:
    """The rows with the leaf (``node``) that each falls in, and the shard of each leaf.

    Node ids are those of a heap: 1 is the root, 2n and 2n+1 are the children of n.
    """
    leaves, level = {1: shards}, [1] if shards > 1 else []
    at = rows.withColumn("node", F.lit(1))
    leaf_bytes, whole = 0.0, {}
    while level:
        mean = lambda x: F.sum(F.col("size") * x) / F.sum("size")
        spread = [F.greatest(mean(F.col(c).cast("double") * F.col(c)) - mean(F.col(c).cast("double")) ** 2, F.lit(0.0)).alias(c) for c in DIMS]
        stats = {r["node"]: r for r in at.where(F.col("node").isin(level)).groupBy("node").agg(F.sum("size").alias("w"), *spread).collect()}
        leaf_bytes = leaf_bytes or (stats[1]["w"] / shards if 1 in stats else 0)
        whole = whole or {c: max(1.0, stats[1][c]) if 1 in stats else 1.0 for c in DIMS}
        dim: dict[int, Column] = {}
        goal: dict[int, float] = {}
        for n in level:
            s = stats.get(n)
            widest = max(DIMS, key=lambda c: s[c] / whole[c]) if s else DIMS[0]
            dim[n], goal[n] = F.col(widest), (s["w"] if s else 0) * (leaves[n] // 2) / leaves[n]
        # coordinate, then text hash, then row hash; each in two steps
        found: dict[int, list[tuple[Column, int]]] = {n: [] for n in level}
        where: dict[int, Column] = {n: F.lit(True) for n in level}
        before = dict.fromkeys(level, 0.0)
        open_ = {n for n in level if n in stats}
        for column, bits, steps in ((None, BITS, (FINE, FINE)), ("u", 60, (12,) * 5), ("v", 60, (12,) * 5)):
            used, top, weight = dict.fromkeys(level, 0), dict.fromkeys(level, 0), dict.fromkeys(level, 0.0)
            for step in steps:
                what = {}
                for n in open_:
                    if used[n] and weight[n] <= TOLERANCE * leaf_bytes:
                        continue  # fine enough
                    c = dim[n] if column is None else F.col(column)
                    inside = F.shiftright(c, bits - used[n]) == top[n] if used[n] else F.lit(True)
                    used[n] += step
                    what[n] = (where[n] & inside, F.shiftright(c, bits - used[n]))
                if not what:
                    break
                for n, h in _hist(at, what).items():
                    top[n], before[n], weight[n] = _pick(h, before[n], goal[n])
            for n in list(open_):
                c = F.shiftright(dim[n] if column is None else F.col(column), bits - used[n])
                low, high = goal[n] - before[n], before[n] + weight[n] - goal[n]
                if column != "v" and min(low, high) > TOLERANCE * leaf_bytes:
                    found[n].append((c, top[n]))
                    where[n] = where[n] & (c == top[n])
                else:
                    found[n].append((c, top[n] + (high < low)))
                    open_.discard(n)
        node = F.col("node")
        for n in level:
            node = F.when(F.col("node") == n, F.when(_left(found[n]), 2 * n).otherwise(2 * n + 1)).otherwise(node)
            leaves[2 * n], leaves[2 * n + 1] = leaves[n] // 2, leaves[n] - leaves[n] // 2
        at = written(at.withColumn("node", node.cast("int")), "kd-level")
        level = [m for n in level for m in (2 * n, 2 * n + 1) if leaves[m] > 1]

    def order(n: int) -> list[int]:
        return [n] if leaves[n] == 1 else [*order(2 * n), *order(2 * n + 1)]

    return at, {n: i for i, n in enumerate(order(1))}


def kd_shards(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text", lang: str | None = "lang", source: str | None = None) -> DataFrame:
    """Key, size, text_crc32, shard (0 to shards - 1) and slot (0, 1, ... without gaps in a shard)."""
    rows = written(points(df, key, text, {"c_lang": lang, "c_source": source}), "kd-points")
    at, shard_of = split_tree(rows, shards)
    shard = F.lit(0)
    for n, i in shard_of.items():
        shard = F.when(F.col("node") == n, i).otherwise(shard)
    total = rows.count()
    buckets = max(1, -(-total // (shards * ROWS_PER_BUCKET)))
    dealt = at.select("key", "size", "text_crc32", "v", shard.alias("shard"), F.pmod("v", F.lit(buckets)).cast("int").alias("bucket"))
    # slots: rows are numbered within a bucket of a shard, after all rows of the buckets before it
    counts = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    offsets = counts.selectExpr("shard", "bucket", "sum(n) over (partition by shard order by bucket rows between unbounded preceding and 1 preceding) as before_")
    within = dealt.selectExpr("*", "row_number() over (partition by shard, bucket order by key, v, text_crc32, size) - 1 as place")
    return within.join(offsets, ["shard", "bucket"]).select(F.col("key").alias(key), "size", "text_crc32", "shard", (F.coalesce("before_", F.lit(0)) + F.col("place")).cast("long").alias("slot"))


def write_shards(df: DataFrame, placed: DataFrame, path: str, key: str = "doc_id") -> None:
    """Writes the rows of a table with unique keys into one folder for each shard, in slot order.

    Rows meet their shard by a shuffle on the key and are then dealt by ranges of shard and slot,
    so that a shard is written by several tasks if it is large.
    """
    out = df.join(placed.select(F.col(key), "shard", "slot"), key)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op4_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = kd_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), 24, source="source")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op4_kd_shards": op4_kd_shards}
SQL: dict[str, str] = {}
