"""Reports on scored rows: truth (0, 1, 2), risk, and a group column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selection import quantiles
from .training import MISS_COST

RARE = 0.999


def confusion(scores: DataFrame, warn, block) -> DataFrame:
    """Hits and misses at two thresholds, and what follows from them; no division by zero."""
    t, r = F.col("truth"), F.col("risk")
    counts = {
        "tp_block": (t == 2) & (r >= block), "fn_block": (t == 2) & (r < block), "tp_warn": (t >= 1) & (r >= warn),
        "fn_warn": (t >= 1) & (r < warn), "fp_warn": (t == 0) & (r >= warn), "tn_warn": (t == 0) & (r < warn),
    }
    risky = (t == 1) & (r >= warn)
    one = scores.agg(*[F.count_if(c).alias(k) for k, c in counts.items()], F.count_if(risky).alias("risky_"))

    def share(a: Column, b: Column) -> Column:
        return F.when(a + b > 0, a / (a + b)).otherwise(F.lit(0.0))

    c = F.col
    return one.select(*counts, share(c("tp_block"), c("fn_block")).alias("block_recall"), share(c("tp_warn"), c("fn_warn")).alias("warn_recall"), share(c("risky_"), c("fp_warn")).alias("safe_precision"), (MISS_COST * c("fn_block") + c("fp_warn")).alias("cost"))


def ranges(scores: DataFrame) -> DataFrame:
    """Rows and spread of the scores of each class; quantiles are exact and need no task that holds a class (see selection)."""
    shares = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
    found = quantiles(scores, "risk", list(shares.values()), "truth")
    out = scores.groupBy("truth").agg(F.count("*").alias("n"), F.min("risk").alias("low"), F.max("risk").alias("high"))
    for i, name in enumerate(shares):
        at = F.lit(None).cast("double")
        for truth, values in found.items():
            at = F.when(F.col("truth").eqNullSafe(F.lit(truth)), values[i]).otherwise(at)
        out = out.withColumn(name, at)
    return out.select("truth", "n", "low", *shares, "high")


def reachability(scores: DataFrame, block) -> DataFrame:
    """Whether any score, or more than a thousandth of them, can reach the block threshold."""
    r = F.col("risk")
    rare = quantiles(scores, "risk", [RARE]).get(None, [None])[0]
    one = scores.agg(F.max(r).alias("highest"), F.avg((r >= block).cast("double")).alias("fired")).withColumn("p999", F.lit(rare).cast("double"))
    return one.select("highest", "p999", "fired", (F.lit(block) > F.col("highest")).alias("unreachable"), (F.lit(block) > F.col("p999")).alias("rare"))


def sweep(scores: DataFrame, warn: float, top: int = 8) -> DataFrame:
    """The cheapest block thresholds from 0.5 up in twentieths; rows are counted by the step that they reach first."""
    t, r = F.col("truth"), F.col("risk")
    highest = F.greatest(F.max(r), F.lit(2.0))
    # a row is below all candidates from the step on that its score does not reach
    by = scores.groupBy(F.greatest(F.floor(r * 20).cast("int") + 1, F.lit(10)).alias("missed_from")).agg(F.count_if(t == 2).alias("d"))
    one = scores.agg(F.count_if((t == 0) & (r >= warn)).alias("fp"), highest.alias("high"))
    steps = one.select("fp", F.explode(F.sequence(F.lit(10), F.floor(F.col("high") * 20).cast("int"))).alias("step"))
    missed = steps.join(F.broadcast(by), F.col("missed_from") <= F.col("step"), "left").groupBy("step", "fp").agg(F.coalesce(F.sum("d"), F.lit(0)).alias("missed"))
    return missed.select((F.col("step") / 20).alias("block"), "missed", (MISS_COST * F.col("missed") + F.col("fp")).alias("cost")).orderBy("cost", "block").limit(top)


def recall_by(scores: DataFrame, group: str, truth: int, threshold, weak: float = 0.5, times: str | None = None) -> DataFrame:
    """Share of each group's rows of a class that reach a threshold; weak groups are flagged. A row stands for as many as ``times`` says."""
    reached = F.col("risk") >= threshold
    n, share = F.count("*"), F.avg(reached.cast("double"))
    if times:
        n, share = F.sum(times), F.sum(reached.cast("long") * F.col(times)) / F.sum(F.when(reached.isNotNull(), F.col(times)))
    own = scores.where(F.col("truth") == truth).groupBy(group).agg(n.alias("n"), share.alias("recall"))
    return own.withColumn("weak", F.col("recall") < weak)
