"""Corpus assembly: union by authority, first-wins deduplication, statistics, leakage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ("command", "label", "category", "source", "section", "transform")


def united(parts: list[DataFrame]) -> DataFrame:
    """Parts in falling authority, each with COLUMNS and pos; adds priority."""
    return reduce(DataFrame.unionByName, [p.select(*COLUMNS, F.col("pos").cast("long").alias("pos"), F.lit(i).alias("priority")) for i, p in enumerate(parts)])


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key. A grouping with min_by, so that many copies of a key are summed up
    map-side and never meet in one window partition."""
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("row_"))
    return kept.select(*[F.col(c) if c in keys else F.col(f"row_.{c}").alias(c) for c in df.columns])


def contradictions(df: DataFrame) -> DataFrame:
    """Commands with several labels."""
    return df.groupBy("command").agg(F.count_distinct("label").alias("n_labels")).where("n_labels > 1")


def statistics(df: DataFrame) -> DataFrame:
    """kind, key, label, n: totals, and counts by label, source, category x label, section x label and
    family x label, from one aggregation over grouping sets."""
    sets = df.select("command", "label", "category", "source", F.col("section"), F.col("transform"))
    counted = sets.groupingSets([[], ["label"], ["source"], ["category", "label"], ["section", "label"], ["transform", "label"]], "label", "source", "category", "section", "transform").agg(
        F.count("*").alias("n"), F.grouping_id().alias("gid")
    )
    # grouping_id has a bit for each column that a row is not grouped by: label 16, source 8, category 4, section 2, transform 1
    kind = F.when(F.col("gid") == 31, "total").when(F.col("gid") == 15, "label").when(F.col("gid") == 23, "source").when(F.col("gid") == 11, "category").when(F.col("gid") == 13, "section").otherwise("transform")
    key = F.coalesce("source", "category", "section", "transform", F.lit(""))
    out = counted.select(kind.alias("kind"), key.alias("key"), F.coalesce("label", F.lit(-1)).alias("label"), "n")
    unique = df.agg(F.count_distinct("command").alias("n")).select(F.lit("unique").alias("kind"), F.lit("").alias("key"), F.lit(-1).alias("label"), "n")
    return out.where("not (kind in ('section', 'transform') and key = '')").unionByName(unique)


def shares(df: DataFrame, column: str) -> DataFrame:
    """Count and percentage of each value of a column (few values: the window is over the groups)."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 4))


def top_groups(df: DataFrame, column: str, k: int) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def leaks(holdout: DataFrame, train: DataFrame) -> DataFrame:
    """Holdout rows (text) whose normalised text a training row has. A log repeats few texts often, so these
    are made distinct map-side first; AQE broadcasts or splits what is left."""
    return holdout.join(train.select("text").distinct(), "text", "left_semi")
