"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a range of ranked(), about, while there are not too many ranges.
RANK_ROWS = 20_000

_own_dir: list[str] = []
#: Where written() has put a table.
_places: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()

#: What operators remember in a Python worker between tasks: name -> how to forget it. A task of another
#: operator forgets it first, as Spark goes on with the same workers from stage to stage.
REMEMBERED: dict[str, Callable[[], None]] = {}
#: What of that is forgotten at the end of each task, as a worker without a task may live on for long.
AT_END: dict[str, Callable[[], None]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where the session does not name one, a session on one machine (tests) gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="spark-llm-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return "file://" + _own_dir[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _places[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes the files of tables made by written() that no later step reads; other tables stay as they are."""
    for df in tables:
        if (place := _places.pop(df, None)) is not None:
            context = df.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def crc_mod(col: str | Column, m: int) -> Column:
    """crc32 of the column as text, modulo m. A null key counts as the empty string."""
    col = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % m


def py_crc_mod(value, m: int) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode()) % m


def renamed(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table with plain column names, and old -> new, so that added columns clash with none."""
    names = {c: f"c{i}_" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds rank (from 0, without gaps, nulls first) and n (rows of the group) within each value of ``group``, which isn't null.

    Rows are dealt to range partitions of group, order and a random number, so that neither a group nor equal rows have to
    meet in one task; within a partition a window numbers them, and another over the partitions' sizes carries the numbers on.
    """
    by = [F.col(c).asc_nulls_first() for c in order]
    # explicit, so that ranges are many however small their rows are
    tasks = max(1, min(-(-rows.count() // RANK_ROWS), 64 * rows.sparkSession.sparkContext.defaultParallelism))
    dealt = written(rows.withColumn("r_", F.rand(12)).repartitionByRange(tasks, F.col(group), *by, "r_").drop("r_").withColumn("part_", F.spark_partition_id()), "dealt")
    parts = dealt.groupBy(F.col(group).alias("g_"), F.col("part_").alias("p_")).agg(F.count("*").alias("size_"))
    whole = Window.partitionBy("g_")
    sizes = parts.select("g_", "p_", F.coalesce(F.sum("size_").over(whole.orderBy("p_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"), F.sum("size_").over(whole).alias("n"))
    within = F.row_number().over(Window.partitionBy(group, "part_").orderBy(*by))
    numbered = dealt.withColumn("within_", within).join(sizes, (F.col(group) == F.col("g_")) & (F.col("part_") == F.col("p_")))
    return numbered.select(*rows.columns, (F.col("before_") + F.col("within_") - 1).alias("rank"), "n")


def map_slices(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], dict]],
    schema: str,
    keep: Iterable[str] = (),
    text: str = "text",
    slice_bytes: int = 2 << 20,
    remembers: str = "",
) -> DataFrame:
    """mapInArrow in slices of about ``slice_bytes`` of text, so that memory follows the slice.

    ``make`` is called once a task and gives a function from a slice to columns (name -> list or
    array); ``keep`` names columns that pass through. One text above the limit is a slice alone.
    """
    keep = list(keep)
    out_schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for part in slices(batch, batch.schema.get_field_index(text), slice_bytes):
                made = fn(part)
                cols = {c: part.column(part.schema.get_field_index(c)) for c in keep}
                cols |= {k: v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v) for k, v in made.items()}
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return df.mapInArrow(tidy(run, remembers), out_schema)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], remembers: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, in a worker that forgets first what other operators remember and gives memory back at the end."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(remembers)
        yield from run(batches)
        for forget in AT_END.values():
            forget()
        release()

    return inner


def begin(remembers: str) -> None:
    """At the start of a task: forgets what other operators remember in this worker."""
    for name, forget in list(REMEMBERED.items()):
        if name != remembers:
            forget()
    release()


def release() -> None:
    """Gives memory that a task has freed back to the system, as workers live on between tasks."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def slices(batch: pa.RecordBatch, at: int, slice_bytes: int) -> Iterator[pa.RecordBatch]:
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
    begin, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > slice_bytes:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += int(n)
    if begin < len(lengths):
        yield batch.slice(begin)
