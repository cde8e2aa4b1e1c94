"""Command generation from rules, lists and the taxonomy, and the command log built on the events table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans import rules as R
from ..sources.tables import dealt


def taxonomy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, r, list(b)) for n, r, b in R.TAXONOMY], "category string, risk int, programs array<string>")


def with_risk(df: DataFrame) -> DataFrame:
    """Adds the risk of each row's category; an unknown category is an error, none is safe.

    The taxonomy is a fixed table of a few rows, so it is broadcast.
    """
    risk = F.when(F.col("category") == "", F.lit(R.SAFE)).when(F.col("risk").isNotNull(), F.col("risk"))
    risk = F.coalesce(risk, F.raise_error(F.concat(F.lit("unknown category: "), F.coalesce("category", F.lit("null")))).cast("int"))
    return df.join(F.broadcast(taxonomy(df.sparkSession).select("category", "risk")), "category", "left").withColumn("risk", risk)


def rule_tables(spark: SparkSession, rules=R.RULES) -> tuple[DataFrame, DataFrame]:
    """Rules (rule_id, category, template, lim) and their slots (rule_id, slot_no, slot, pos, value, size)."""
    heads = [(i, c, t, lim) for i, c, t, _, lim in rules]
    slots = [(i, k, name, p, v, len(vs)) for i, _, _, s, _ in rules for k, (name, vs) in enumerate(s.items()) for p, v in enumerate(vs)]
    return (
        spark.createDataFrame(heads, "rule_id int, category string, template string, lim int"),
        spark.createDataFrame(slots, "rule_id int, slot_no int, slot string, pos int, value string, size int"),
    )


def generate(rules: DataFrame, slots: DataFrame, slot_count: int) -> DataFrame:
    """rule_id, category, idx, command: the product of each rule's slots, at most ``lim`` evenly
    spaced ones, then the first of equal commands."""
    out = rules.select("rule_id", "category", "lim", F.col("template").alias("command"), F.lit(0).alias("idx"), F.lit(1).alias("n"))
    for k in range(slot_count):
        own = slots.where(F.col("slot_no") == k).drop("slot_no")
        filled = F.when(F.col("slot").isNull(), F.col("command")).otherwise(F.expr("replace(command, concat('{', slot, '}'), value)"))
        size = F.coalesce("size", F.lit(1))
        out = out.join(own, "rule_id", "left").select("rule_id", "category", "lim", filled.alias("command"), (F.col("idx") * size + F.coalesce("pos", F.lit(0))).alias("idx"), (F.col("n") * size).alias("n"))
    step = lambda i: F.floor(i * F.col("lim") / F.col("n"))
    spaced = (F.col("n") <= F.col("lim")) | (F.col("idx") == 0) | (step(F.col("idx")) > step(F.col("idx") - 1))
    out = out.where(spaced).withColumn("command", F.trim("command"))
    first = Window.partitionBy("command").orderBy("rule_id", "idx")
    return out.withColumn("rank_", F.row_number().over(first)).where("rank_ = 1").select("rule_id", "category", "idx", "command")


def generated(spark: SparkSession, rules=R.RULES) -> DataFrame:
    return generate(*rule_tables(spark, rules), max(len(r[3]) for r in rules))


def curated(spark: SparkSession) -> DataFrame:
    rows = [(s, p, c) for s, (_, cs) in enumerate(R.CURATED.items()) for p, c in enumerate(cs)]
    return spark.createDataFrame(rows, "rule_id int, idx int, command string").selectExpr("1000 + rule_id as rule_id", "'' as category", "idx", "command")


def safe_side(spark: SparkSession) -> DataFrame:
    """Safe rules, then the curated lists; the first of equal commands."""
    rows = generated(spark, R.SAFE_RULES).unionByName(curated(spark))
    first = Window.partitionBy("command").orderBy("rule_id", "idx")
    return rows.withColumn("rank_", F.row_number().over(first)).where("rank_ = 1").drop("rank_")


def commands(spark: SparkSession) -> DataFrame:
    """pos, command, category, risk, source: all generated commands, numbered; a dimension of a few hundred rows."""
    rows = generated(spark).withColumn("source", F.lit("grammar")).unionByName(safe_side(spark).withColumn("source", F.lit("negatives")))
    first = Window.partitionBy("command").orderBy("rule_id", "idx")
    rows = with_risk(rows.withColumn("rank_", F.row_number().over(first)).where("rank_ = 1"))
    number = F.row_number().over(Window.orderBy("rule_id", "idx")) - 1
    return rows.select(number.cast("long").alias("pos"), "command", "category", "risk", "source")


_tables: dict[str, tuple[list, object]] = {}


def command_table(spark: SparkSession) -> DataFrame:
    """commands() as a local table: it depends on the fixed rules only, so an application generates it once."""
    app = spark.sparkContext.applicationId
    if app not in _tables:
        dim = commands(spark)
        _tables[app] = (dim.collect(), dim.schema)
    return spark.createDataFrame(*_tables[app])


def varied(command: Column, event_id: Column, user_id: Column) -> Column:
    """What users do to commands: an environment variable, a second segment, upper case, quotes."""
    k = event_id % 7
    return (
        F.when(k == 1, F.concat(F.lit("OWNER=u"), user_id.cast("string"), F.lit(" "), command))
        .when(k == 2, F.concat(command, F.lit(" && echo done "), user_id.cast("string")))
        .when(k == 3, F.concat(F.lit("cd /srv/u"), user_id.cast("string"), F.lit(";  "), command))
        .when(k == 5, F.upper(command))
        .otherwise(command)
    )


def command_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, user_id, event_type, command, category, risk, source: one command for each event."""
    dim = command_table(spark)
    n = dim.count()
    events = dealt(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type"))
    joined = events.join(F.broadcast(dim), F.pmod(F.col("event_id") * 7 + F.col("user_id"), F.lit(n)) == F.col("pos"))
    return joined.select("event_id", "ts", "user_id", "event_type", varied(F.col("command"), F.col("event_id"), F.col("user_id")).alias("command"), "category", "risk", "source")
