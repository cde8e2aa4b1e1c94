"""Scores, verdicts and their reasons from model tables."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import features as X
from .training import risk_of

# Coefficients below this are pruned; contributions that are shown; how many of them, and in a trace; and tolerances.
PRUNE, SHOWN, TOP, TRACED = 1e-4, 0.01, 8, 10
FOLD_TOLERANCE, GOLDEN_TOLERANCE, DRIFT_TOLERANCE = 1e-9, 1e-4, 1e-9
#: A model's n-grams are broadcast if there are at most so many (about 100 bytes each as rows, 16 as arrays).
BROADCAST_GRAMS = 1_000_000
#: A packed model's n-grams are broadcast up to this many (16 bytes each); more are joined.
PACKED_GRAMS = 8_000_000


def folded(weights: DataFrame, vocab: DataFrame) -> DataFrame:
    """gram, coef: weight times idf."""
    return weights.join(vocab.select("gram", "idf"), "gram").select("gram", (F.col("weight") * F.col("idf")).alias("coef"))


def pruned(coef: DataFrame, floor: float = PRUNE) -> DataFrame:
    return coef.where(F.abs("coef") >= floor)


def _side(coef: DataFrame) -> DataFrame:
    return F.broadcast(coef) if coef.count() <= BROADCAST_GRAMS else coef


def dense_sum(dense: DataFrame) -> Column:
    """The dense part as one expression over the 38 columns; dense: name, coef, mean, std (38 rows)."""
    out = F.lit(0.0)
    for r in sorted(dense.collect(), key=lambda r: X.DENSE.index(r["name"])):
        out = out + F.lit(r["coef"]) * ((F.col(r["name"]) - F.lit(r["mean"])) / F.lit(r["std"]))
    return out


@dataclass
class Packed:
    """A model's n-grams as sorted keys and their coefficients, in the order of the keys; small enough for every task."""

    keys: np.ndarray
    coefs: np.ndarray

    def found(self, text: pa.Array, unquoted: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Row and place in the model of each row's set of known n-grams: one counts once for a row, however often and in
        which view it occurs."""
        row, key = X.row_sets(text, unquoted)
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        known = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
        return row[known], at[known]

    def sums(self, text: pa.Array, unquoted: pa.Array) -> np.ndarray:
        """The sum of the coefficients of each row's set of n-grams."""
        row, at = self.found(text, unquoted)
        return np.bincount(row, self.coefs[at], len(text))

    def largest(self, text: pa.Array, unquoted: pa.Array, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Row and place of each row's ``top`` n-grams of the largest coefficients by size, of equal ones the first by name."""
        row, at = self.found(text, unquoted)
        # keys with their first byte in one place are in order of the names
        size = np.ceil(np.log2(self.keys[at] + 1) / 8).astype(np.int64)
        order = np.lexsort((self.keys[at] << (8 * (X.KEY_BYTES - size)), -np.abs(self.coefs[at]), row))
        row, at = row[order], at[order]
        first = np.searchsorted(row, row)
        inside = np.arange(len(row)) - first < top
        return row[inside], at[inside]

    def listed(self, n: int, row: np.ndarray, at: np.ndarray) -> pa.Array:
        """An array of (feature, weight) for each of n rows."""
        names = [int(k).to_bytes(X.KEY_BYTES, "big").lstrip(b"\0").decode() for k in self.keys[at]]
        entries = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(self.coefs[at])], names=["feature", "weight"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32()), entries)


def sparse_sum(spark: SparkSession, model: Packed, text: str = "text", unquoted: str = "unquoted") -> Column:
    """The n-grams' part of a row's score, from the row alone: no join, no grouping. The model is broadcast once."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def summed(text: pa.Array, unquoted: pa.Array) -> pa.Array:
        (text, unquoted), back = X.once(text, unquoted)
        return pa.array(shared.value.sums(text, unquoted)[back])

    return summed(F.col(text), F.col(unquoted))


def largest_sparse(spark: SparkSession, model: Packed, top: int, text: str = "text", unquoted: str = "unquoted") -> Column:
    """The n-grams of the largest coefficients of a row, as an array of (feature, weight): bounded within the row, so nothing is exploded or ranked."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("array<struct<feature:string,weight:double>>")
    def found(text: pa.Array, unquoted: pa.Array) -> pa.Array:
        (text, unquoted), back = X.once(text, unquoted)
        return shared.value.listed(len(text), *shared.value.largest(text, unquoted, top)).take(pa.array(back))

    return found(F.col(text), F.col(unquoted))


def traced(spark: SparkSession, model: Packed, top: int, text: str = "text", unquoted: str = "unquoted") -> Column:
    """(known, unknown, sparse, top) of a row's n-grams: how many the model has and lacks, the sum, and the largest."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<known:bigint,unknown:bigint,sparse:double,top:array<struct<feature:string,weight:double>>>")
    def found(text: pa.Array, unquoted: pa.Array) -> pa.Array:
        (text, unquoted), back = X.once(text, unquoted)
        model, n = shared.value, len(text)
        row, at = model.found(text, unquoted)
        rows, _ = X.row_sets(text, unquoted)
        known = np.bincount(row, minlength=n)
        parts = [pa.array(known), pa.array(np.bincount(rows, minlength=n) - known), pa.array(np.bincount(row, model.coefs[at], n)), model.listed(n, *model.largest(text, unquoted, top))]
        return pa.StructArray.from_arrays([x.take(pa.array(back)) for x in parts], names=["known", "unknown", "sparse", "top"])

    return found(F.col(text), F.col(unquoted))


@dataclass
class Model:
    """What scoring takes, made once for many scorings: the n-grams' part as a column (or, if there are too many for
    every task, as a table to be joined), and the dense part as a column."""

    sparse: Column | None
    dense: Column
    coef: DataFrame


def packed(coef: DataFrame) -> Packed | None:
    """The n-grams (gram, coef) as arrays; None if they are too many, or too long for a key."""
    if coef.limit(PACKED_GRAMS + 1).count() > PACKED_GRAMS or not coef.where(F.octet_length("gram") > X.KEY_BYTES).isEmpty():
        return None
    rows = coef.select(X.gram_key(F.col("gram")).alias("key"), "coef").toArrow()
    keys, coefs = rows["key"].to_numpy(), rows["coef"].to_numpy()
    order = np.argsort(keys)
    return Packed(keys[order], coefs[order])


def squares(spark: SparkSession, model: Packed, text: str = "text", unquoted: str = "unquoted") -> Column:
    """(known, squares): a row's n-grams in the model, and the sum of their squared coefficients."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<known:bigint,squares:double>")
    def summed(text: pa.Array, unquoted: pa.Array) -> pa.Array:
        (text, unquoted), back = X.once(text, unquoted)
        row, at = shared.value.found(text, unquoted)
        return pa.StructArray.from_arrays([pa.array(np.bincount(row, minlength=len(text))[back]), pa.array(np.bincount(row, shared.value.coefs[at] ** 2, len(text))[back])], names=["known", "squares"])

    return summed(F.col(text), F.col(unquoted))


def both_sums(spark: SparkSession, weights: DataFrame, vocab: DataFrame, text: str = "text", unquoted: str = "unquoted") -> Column | None:
    """(known, plain, folded) of a row: its n-grams in the vocabulary, the sum of weight times idf, each factor looked up by itself, and the sum of
    folded coefficients. None if the n-grams are too many for every task."""
    parts = [packed(weights.select("gram", F.col("weight").alias("coef"))), packed(vocab.select("gram", F.col("idf").alias("coef"))), packed(folded(weights, vocab))]
    if any(p is None for p in parts):
        return None
    shared = spark.sparkContext.broadcast(parts)

    @F.arrow_udf("struct<known:bigint,plain:double,folded:double>")
    def summed(text: pa.Array, unquoted: pa.Array) -> pa.Array:
        weight, idf, coef = shared.value
        (text, unquoted), back = X.once(text, unquoted)
        row, at = weight.found(text, unquoted)
        key = weight.keys[at]
        there = np.isin(key, idf.keys)
        row, at, key = row[there], at[there], key[there]
        plain = np.bincount(row, weight.coefs[at] * idf.coefs[np.searchsorted(idf.keys, key)], len(text))
        known = np.bincount(row, minlength=len(text))
        return pa.StructArray.from_arrays([pa.array(x[back]) for x in (known, plain, coef.sums(text, unquoted))], names=["known", "plain", "folded"])

    return summed(F.col(text), F.col(unquoted))


def prepared(coef: DataFrame, dense: DataFrame) -> Model:
    """coef: gram, coef; dense: name, coef, mean, std."""
    arrays = packed(coef)
    sparse = None if arrays is None else sparse_sum(coef.sparkSession, arrays)
    return Model(sparse, dense_sum(dense), coef)


def score(df: DataFrame, model: Model, bias: float, key: str) -> DataFrame:
    """key, risk (0 to 2) of normalised commands with dense features (see features.dense)."""
    kept = [c for c in df.columns if c not in X.DENSE]
    if model.sparse is not None:
        return df.withColumn("sparse_", model.sparse).select(*kept, risk_of(F.col("sparse_") + model.dense + F.lit(bias)).alias("risk"))
    sparse = X.gram_table(df, key).join(_side(model.coef), "gram").groupBy(key).agg(F.sum("coef").alias("sparse_"))
    return df.join(sparse, key, "left").select(*kept, risk_of(F.coalesce("sparse_", F.lit(0.0)) + model.dense + F.lit(bias)).alias("risk"))


def decided(risk: Column, warn, block) -> Column:
    return F.when(risk >= block, "destructive").when(risk >= warn, "risky").otherwise("safe")


def explained(df: DataFrame, model: Packed, dense: DataFrame, key: str, top: int = TOP) -> DataFrame:
    """key, rank, feature, weight of the largest contributions of each command (with text, unquoted and dense features) above SHOWN, by
    size, of equal ones the first by name. The n-grams' largest and the 38 dense ones are sorted within the row."""
    spec = sorted(dense.collect(), key=lambda r: X.DENSE.index(r["name"]))
    own = [F.struct(F.lit(r["name"]).alias("feature"), (F.lit(r["coef"]) * ((F.col(r["name"]) - F.lit(r["mean"])) / F.lit(r["std"]))).alias("weight")) for r in spec]
    every = F.filter(F.concat(largest_sparse(df.sparkSession, model, top), F.array(*own)), lambda x: F.abs(x["weight"]) > SHOWN)
    ranked = F.array_sort(F.transform(every, lambda x: F.struct((-F.abs(x["weight"])).alias("size"), x["feature"].alias("feature"), x["weight"].alias("weight"))))
    out = df.select(key, F.posexplode(F.slice(ranked, 1, top)).alias("rank", "part"))
    return out.select(key, (F.col("rank") + 1).alias("rank"), "part.feature", "part.weight")


def golden_sample(scored: DataFrame, per_label: int, total: int) -> DataFrame:
    """command, label, risk: per_label of each label by hash, topped up from the rest to ``total``.

    Ranks are over the commands whose hash is below a bound that leaves a few times the number needed,
    so no window holds all rows.
    """
    one = scored.groupBy("command", "label").agg(F.max("risk").alias("risk"))
    place = F.conv(F.substring(F.sha2("command", 256), 1, 12), 16, 10).cast("long")
    one = one.withColumn("place", place)
    sizes = {r["label"]: r["n"] for r in one.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.lit(1.0)
    for label, n in sizes.items():
        share = F.when(F.col("label") == label, min(1.0, 8 * (total + 20) / n)).otherwise(share)
    near = one.where(F.col("place") < share * float(16**12))
    ranked = near.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("place", "command")))
    taken, rest = ranked.where(F.col("k") <= per_label), ranked.where(F.col("k") > per_label)
    room = total - sum(min(n, per_label) for n in sizes.values())
    return taken.unionByName(rest.orderBy("place", "command", "label").limit(max(0, room))).select("command", "label", "risk")


def parity(stored: DataFrame, computed: DataFrame, tolerance: float = GOLDEN_TOLERANCE) -> DataFrame:
    """Rows, largest difference, the command that has it, and whether all agree; both: command, risk."""
    diff = stored.withColumnRenamed("risk", "stored").join(computed.withColumnRenamed("risk", "computed"), "command").withColumn("diff", F.abs(F.col("stored") - F.col("computed")))
    worst = F.max(F.struct("diff", "command"))
    return diff.agg(F.count("*").alias("n"), worst.alias("w")).select("n", F.col("w.diff").alias("max_diff"), F.col("w.command").alias("worst"), (F.coalesce("w.diff", F.lit(0.0)) <= tolerance).alias("ok"))


def drift(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """feature, n, largest difference of dense features that differ; both: key, feature, value."""
    both = left.withColumnRenamed("value", "a").join(right.withColumnRenamed("value", "b"), [key, "feature"])
    gap = F.abs(F.col("a") - F.col("b"))
    return both.where(gap > DRIFT_TOLERANCE).groupBy("feature").agg(F.count("*").alias("n"), F.max(gap).alias("max_diff"))


def drift_in_row(df: DataFrame) -> DataFrame:
    """drift() where one row has both: each dense feature and, as ..._b, the other. Only features that differ become rows."""
    parts = [F.struct(F.lit(n).alias("feature"), F.abs(F.col(n) - F.col(f"{n}_b")).alias("gap")) for n in X.DENSE]
    return df.select(F.inline(F.array(*parts))).where(F.col("gap") > DRIFT_TOLERANCE).groupBy("feature").agg(F.count("*").alias("n"), F.max("gap").alias("max_diff"))
