"""Corpora, models, reports and golden cases as files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Columns of a corpus file, and the labels' names in it.
CORPUS = "command string, label string, category string, source string, section string, transform string"
LABEL_NAMES = {"SAFE": 0, "RISKY": 1, "DESTRUCTIVE": 2}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``); without one, only a
    session on one machine gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-tables-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(context._jsc.hadoopConfiguration()).exists(place)


#: Rows of a task that a scanned table is dealt to, about.
DEALT_ROWS = 50_000


def dealt(df: DataFrame) -> DataFrame:
    """A scanned table in tasks of about DEALT_ROWS rows, as many as there are cores at least: a row group, however large and costly, would
    be one task, and splits without the middle of a row group have no rows. Tables whose splits are near that stay as they are, without an exchange."""
    if df.isStreaming:
        return df
    # the scan behind this reads no column
    held = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()]
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-sum(held) // DEALT_ROWS))
    return df.repartition(tasks) if max(held, default=0) > 2 * -(-sum(held) // tasks) else df


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A corpus CSV with header; commands may hold line ends. Missing section and transform are empty."""
    raw = spark.read.schema(CORPUS).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return labelled(raw)


def labelled(raw: DataFrame) -> DataFrame:
    label = F.coalesce(*[F.when(F.col("label") == k, v) for k, v in LABEL_NAMES.items()])
    return raw.withColumn("label", label).fillna("", ["section", "transform"])


def write_corpus(df: DataFrame, path: str) -> int:
    """Writes corpus rows as CSV and returns their number, counted while they are written."""
    name = F.coalesce(*[F.when(F.col("label") == v, k) for k, v in LABEL_NAMES.items()])
    seen = Observation()
    rows = df.select("command", name.alias("label"), "category", "source", F.coalesce("section", F.lit("")).alias("section"), F.coalesce("transform", F.lit("")).alias("transform"))
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    return seen.get["n"]


def write_report(df: DataFrame, path: str) -> None:
    """A small table as JSON lines in one file."""
    df.coalesce(1).write.json(path)


def write_model(path: str, coef: DataFrame, dense: DataFrame, meta: DataFrame) -> None:
    """A model is three tables: coef (gram, coef), dense (name, coef, mean, std), meta (one row)."""
    coef.write.parquet(f"{path}/coef")
    dense.write.parquet(f"{path}/dense")
    meta.write.parquet(f"{path}/meta")


def read_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        spark.read.schema("gram string, coef double").parquet(f"{path}/coef"),
        spark.read.schema("name string, coef double, mean double, std double").parquet(f"{path}/dense"),
        spark.read.parquet(f"{path}/meta"),
    )
