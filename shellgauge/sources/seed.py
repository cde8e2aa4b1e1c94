"""Command lists: lines of text with headings, comments and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LABEL_MARK = "|||"
UNLABELLED = "unlabelled"
#: Words of a heading, in upper case, and the section they open; the first that a heading contains counts.
SECTIONS = (("EVERYDAY", "routine"), ("BY MISTAKE", "accident"), ("AFRAID OF", "feared"), ("LOOKS DANGEROUS", "looks_scary"), ("NO LABEL", "unlabelled"))
HEADING = r"^#\s*===\s*(.+?)\s*===$"
#: Lines between two places where the section is carried over.
BLOCK = 100_000


class EmptySource(ValueError):
    pass


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line (from 1), value of the lines of text files. Files are read in splits: a line's place is its place in the split, and
    a small window over the splits' line counts carries the numbers over their borders."""
    meta = "_metadata.file_path as path", "_metadata.file_block_start as split", "monotonically_increasing_id() as id", "value"
    lines = spark.read.text(path).selectExpr(*meta)
    within = F.row_number().over(Window.partitionBy("path", "split").orderBy("id"))
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    sizes = lines.groupBy("path", "split").agg(F.count("*").alias("n")).select("path", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = lines.withColumn("within", within).join(sizes, ["path", "split"])
    return numbered.select("path", (F.col("before") + F.col("within")).cast("int").alias("line"), "value")


def write_lines(lines: DataFrame, path: str) -> None:
    """Writes lines (path, line, value) as text files, a folder for each path."""
    lines.repartition("path").sortWithinPartitions("path", "line").select("path", "value").write.partitionBy("path").text(path)


def section_of(heading: Column, sections=SECTIONS) -> Column:
    out = F.concat(F.lit("other:"), F.trim(heading))
    for word, name in reversed(sections):
        out = F.when(F.upper(heading).contains(word), name).otherwise(out)
    return out


def carried_forward(df: DataFrame, value: str, name: str, default: str) -> DataFrame:
    """Adds the last non-null value at or before each line of a path.

    Lines are taken in blocks, so that one long file is not one task: windows within blocks, and a
    window over one row for each block for what comes from before it.
    """
    block = F.floor(F.col("line") / BLOCK)
    df = df.withColumn("block_", block)
    last = df.where(F.col(value).isNotNull()).groupBy("path", "block_").agg(F.max_by(value, "line").alias("at_end_"))
    blocks = df.select("path", "block_").distinct().join(last, ["path", "block_"], "left")
    before = Window.partitionBy("path").orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("path", "block_", F.last("at_end_", True).over(before).alias("before_"))
    within = Window.partitionBy("path", "block_").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("here_", F.last(value, True).over(within)).join(blocks, ["path", "block_"])
    return out.withColumn(name, F.coalesce("here_", "before_", F.lit(default))).drop("here_", "before_", "block_")


def parse_seed(lines: DataFrame) -> DataFrame:
    """path, line, section, command, label_text, label (null if absent or unknown) of the command lines."""
    text = F.regexp_replace("value", r"^\s+|\s+$", "")
    rows = lines.select("path", "line", text.alias("text")).where("text <> ''")
    heading = F.regexp_extract("text", HEADING, 1)
    rows = rows.withColumn("heading_", F.when(heading != "", section_of(heading)))
    rows = carried_forward(rows, "heading_", "section", UNLABELLED).where("not startswith(text, '#')")
    at = F.instr("text", LABEL_MARK)
    command = F.trim(F.when(at > 0, F.substring("text", F.lit(1), at - 1)).otherwise(F.col("text")))
    label_text = F.when(at > 0, F.lower(F.trim(F.substring("text", at + len(LABEL_MARK), F.length("text")))))
    label = F.when(F.col("label_text") == "safe", 0).when(F.col("label_text") == "risky", 1).when(F.col("label_text") == "destructive", 2)
    rows = rows.select("path", "line", "section", command.alias("command"), label_text.alias("label_text"))
    return rows.withColumn("label", label).where("command <> ''")


def bad_labels(parsed: DataFrame) -> DataFrame:
    """Lines whose label is unknown; their commands stay in parse_seed()'s result without label."""
    return parsed.where("label is null and label_text is not null").select("path", "line", "label_text")


def plain_commands(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", "line", "command")


def section_counts(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("section", F.coalesce("label", F.lit(-1)).alias("label")).agg(F.count("*").alias("n"))


def load_seed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Accepted commands and lines with bad labels; a source without commands is an error."""
    parsed = parse_seed(read_lines(spark, path))
    if parsed.isEmpty():
        raise EmptySource(f"no commands in {path}")
    return parsed, bad_labels(parsed)
