"""Split, loss, fit and thresholds of the risk model."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

from dataclasses import dataclass, field
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import features as X
from ..sources.tables import stored
from .selection import order_statistics

if TYPE_CHECKING:
    from .scoring import Packed

# Share of validation, weight of the middle class, cost of a missed destructive command,
# recalls that the thresholds have to reach, and thresholds where there is nothing to learn from.
VALIDATION, AMBIGUOUS_WEIGHT, MISS_COST = 0.15, 0.7, 20
WARN_RECALL, BLOCK_RECALL = 0.98, 0.995
NO_DATA = (1.0, 3.0)
ALPHAS = (0.003, 0.01, 0.03, 0.1, 0.3, 1.0, 3.0)
#: Distinct scores of a block, about, by which sorted scores are dealt out to tasks.
BLOCK_SCORES = 20_000
#: Entries of the matrix for a task of a pass, at least: passes over a small matrix are few short tasks.
TASK_ENTRIES = 1_000_000
#: Entries of a task for each feature, once there are tasks for all cores.
TASK_REUSE = 100
#: Entries of a block, about, in which a task holds rows: what a pass makes of one stays in a core's cache.
BLOCK_ENTRIES = 300_000
#: Features whose names or coefficients are broadcast up to this many (about 60 bytes each).
BROADCAST_NAMES = 1_000_000
#: The fit ends where no gradient's norm is above TOLERANCE, or after ROUNDS steps.
TOLERANCE, ROUNDS = 1e-6, 500
#: Gradients of tasks are added by the driver up to so many bytes, else by CHUNK features in tasks of their own.
DIRECT_BYTES, CHUNK = 32 << 20, 1024
#: Blocks by which features are numbered; the table of their sizes is broadcast.
NAME_BLOCKS = 1024


def split_hash(command: Column, seed: int = 0) -> Column:
    """52 bits of a digest of the command, as a number that a double holds exactly."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}|"), command), 256), 1, 13), 16, 10).cast("long")


def stratified(df: DataFrame, label: str = "label", command: str = "command", seed: int = 0, share: float = VALIDATION) -> DataFrame:
    """Adds validation: of each label's rows, those of the smallest hashes, a rounded share of them. Rows of one command have one
    hash and stay together, so a label has exactly its share where commands are distinct. The bounds are found by
    refined histograms (see selection): nothing is ranked or sorted."""
    hashed = df.withColumn("hash_", split_hash(F.col(command), seed))
    sizes = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}
    wanted = {g: [int(share * n + 0.5) - 1] for g, n in sizes.items() if int(share * n + 0.5) > 0}
    bounds = order_statistics(hashed, "hash_", wanted, label)
    last = F.lit(-1.0)
    for (g, _), v in bounds.items():
        last = F.when(F.col(label).eqNullSafe(F.lit(g)), v).otherwise(last)
    return hashed.withColumn("validation", F.col("hash_") <= last).drop("hash_")


def ambiguity_weight(label: Column) -> Column:
    return F.when(label == 1, AMBIGUOUS_WEIGHT).otherwise(1.0)


def risk_of(z: Column) -> Column:
    z = F.least(F.greatest(z, F.lit(-60.0)), F.lit(60.0))
    return 2 / (1 + F.exp(-z))


def loss_and_gradient(features: DataFrame, targets: DataFrame, coef: DataFrame, bias: float, alpha: float) -> tuple[DataFrame, DataFrame]:
    """One step as joins and groupings: (loss, n), and (feature, gradient), the bias as feature "".

    features: id, feature, value; targets: id, label, weight; coef: feature, coef.
    """
    # a dense feature has all rows: its key must not be dealt to one task while the coefficients are few
    coef = F.broadcast(coef) if coef.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES else coef
    margin = features.join(coef, "feature").groupBy("id").agg(F.sum(F.col("value") * F.col("coef")).alias("m"))
    risk = risk_of(F.coalesce("m", F.lit(0.0)) + bias)
    rows = targets.join(margin, "id", "left").select("id", "label", "weight", risk.alias("risk"))
    n = targets.count()
    gap = F.col("risk") - F.col("label")
    penalty = coef.agg(F.coalesce(alpha * F.sum(F.col("coef") * F.col("coef")), F.lit(0.0)).alias("penalty"))
    loss = rows.agg((F.sum(F.col("weight") * gap * gap) / n).alias("fit"), F.count("*").alias("n")).crossJoin(penalty).select((F.col("fit") + F.col("penalty")).alias("loss"), "n")
    slope = rows.select("id", (2 * F.col("weight") * gap * F.col("risk") * (1 - F.col("risk") / 2) / n).alias("slope"))
    of_feature = features.join(slope, "id").groupBy("feature").agg(F.sum(F.col("value") * F.col("slope")).alias("g"))
    gradient = of_feature.join(coef, "feature", "left").select("feature", (F.col("g") + 2 * alpha * F.coalesce("coef", F.lit(0.0))).alias("gradient"))
    return loss, gradient.unionByName(slope.agg(F.sum("slope").alias("gradient")).select(F.lit("").alias("feature"), "gradient"))


def numbered(names: DataFrame) -> DataFrame:
    """feature, at (from 0, without gaps) of distinct features: counted within blocks by hash, after a small sum over blocks."""
    by = names.withColumn("block", F.pmod(F.xxhash64("feature"), F.lit(NAME_BLOCKS)))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = by.groupBy("block").agg(F.count("*").alias("size")).select("block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("block").orderBy("feature"))
    return by.join(F.broadcast(sizes), "block").select("feature", (F.col("before") + within - 1).cast("int").alias("at"))


def rows_of_matrix(features: DataFrame, targets: DataFrame, names: DataFrame) -> DataFrame:
    """label, weight, at (positions of features), value: a row of the matrix for each target; names: feature, at."""
    names = F.broadcast(names) if names.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES else names
    own = features.join(names, "feature").groupBy("id").agg(F.collect_list(F.struct("at", "value")).alias("own"))
    return targets.join(own, "id", "left").select("label", "weight", F.coalesce("own.at", F.array().cast("array<int>")).alias("at"), F.coalesce("own.value", F.array().cast("array<double>")).alias("value"))


def packed_rows(rows: DataFrame, idf: Packed, spread: DataFrame, text: str = "text", unquoted: str = "unquoted") -> tuple[DataFrame, DataFrame]:
    """The matrix of normalised commands with dense features, label, weight and validation: label, weight, validation, at (the row's known n-grams, whose
    values are the model's idf), dense (standardised), and the names of the positions (feature, at), dense ones after the n-grams. An entry comes from its
    row alone, as a model's n-grams are found in scoring: nothing is exploded, joined or grouped."""
    spec = sorted(spread.collect(), key=lambda r: X.DENSE.index(r["name"]))
    shared = rows.sparkSession.sparkContext.broadcast(idf)

    @F.arrow_udf("array<int>")
    def entries(text: pa.Array, unquoted: pa.Array) -> pa.Array:
        row, at = shared.value.found(text, unquoted)
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(text) + 1)), pa.int32()), pa.array(at, pa.int32()))

    z = F.array(*[(F.col(r["name"]) - F.lit(r["mean"])) / F.lit(r["std"]) for r in spec])
    own = rows.select(F.col("label").cast("double").alias("label"), "weight", "validation", entries(F.col(text), F.col(unquoted)).alias("at"), z.alias("dense"))
    names = [f"g:{int(k).to_bytes(X.KEY_BYTES, 'big').lstrip(bytes(1)).decode()}" for k in idf.keys] + [f"d:{r['name']}" for r in spec]
    known = rows.sparkSession.createDataFrame(pa.table({"feature": pa.array(names, pa.string()), "at": pa.array(range(len(names)), pa.int32())}))
    return own, known


def _flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and how many each row has."""
    lists = batch.column(batch.schema.get_field_index(name))
    offsets = lists.offsets.to_numpy()
    return lists.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False), np.diff(offsets)


@dataclass
class Block:
    """Rows of the matrix: sparse entries by the block's own columns, and the block's different dense rows. Without values an entry counts as 1: what all of
    a column's entries are goes into its coefficient."""

    columns: np.ndarray
    at: np.ndarray
    sizes: np.ndarray
    value: np.ndarray | None
    dense: np.ndarray
    kind: np.ndarray
    label: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, batches: list[pa.RecordBatch]) -> Block:
        """Rows of label, weight, at and, if there are such columns, value and dense."""
        has = batches[0].schema.names
        column = lambda name: np.concatenate([b.column(b.schema.get_field_index(name)).to_numpy(zero_copy_only=False) for b in batches])
        lists = lambda name: tuple(np.concatenate(x) for x in zip(*[_flat(b, name) for b in batches], strict=True))
        at, sizes = lists("at")
        columns, at = np.unique(at, return_inverse=True)
        dense, kind = lists("dense")[0].reshape(len(sizes), -1) if "dense" in has else np.zeros((len(sizes), 0)), np.zeros(len(sizes), np.int64)
        if dense.shape[1]:
            # equal rows of bytes are equal rows of numbers
            _, first, kind = np.unique(np.ascontiguousarray(dense).view(f"V{dense.itemsize * dense.shape[1]}").ravel(), return_index=True, return_inverse=True)
            dense = dense[first]
        else:
            dense = dense[:1]
        return cls(columns, at.astype(np.min_scalar_type(max(0, len(columns) - 1))), sizes, lists("value")[0] if "value" in has else None, dense, kind, column("label"), column("weight"))

    def risks(self, w: np.ndarray) -> np.ndarray:
        """Risks of the rows under each weight vector (columns of w: sparse and dense coefficients, then the bias)."""
        size, at = len(w) - 1 - self.dense.shape[1], self.at.astype(np.intp)
        z = (self.dense @ w[size:-1])[self.kind] + w[-1]
        # a row's entries lie together and are added up where they lie
        full = np.flatnonzero(self.sizes)
        first = (np.cumsum(self.sizes) - self.sizes)[full]
        for k in range(w.shape[1] if len(full) else 0):
            entries = w[self.columns, k][at]
            z[full, k] += np.add.reduceat(entries if self.value is None else entries * self.value, first)
        return 2 / (1 + np.exp(-np.clip(z, -60, 60)))

    def gradient(self, slope: np.ndarray, total: np.ndarray) -> None:
        """Adds the rows' gradient, by their slopes under each weight vector, to that of all features."""
        size, at = len(total) - 1 - self.dense.shape[1], self.at.astype(np.intp)
        for k in range(slope.shape[1]):
            entries = np.repeat(slope[:, k], self.sizes)
            total[self.columns, k] += np.bincount(at, entries if self.value is None else entries * self.value, len(self.columns))
            total[size:-1, k] += np.bincount(self.kind, slope[:, k], len(self.dense)) @ self.dense
        total[-1] += slope.sum(axis=0)


def blocks(rows: DataFrame) -> RDD:
    """The rows of the matrix (label, weight, at, and value or dense) in blocks of about BLOCK_ENTRIES entries, as they lie in tasks."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, entries = [], 0
        for b in batches:
            held.append(b)
            entries += len(_flat(b, "at")[0])
            if entries >= BLOCK_ENTRIES:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Block.of(held))], pa.binary())], names=["block"])
                held, entries = [], 0
        if any(len(b) for b in held):
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Block.of(held))], pa.binary())], names=["block"])

    return rows.mapInArrow(made, "block binary").rdd.map(lambda r: pickle.loads(r["block"]))


def handed_on(matrix: RDD) -> int:
    """The features of each task's blocks, added up over the tasks."""
    return sum(matrix.mapPartitions(lambda held: [len(np.unique(np.concatenate([np.zeros(0, np.int64), *[b.columns for b in held]])))]).collect())


def evaluate(matrix: RDD, w: np.ndarray, alphas: np.ndarray, n: int, scale: np.ndarray | float = 1.0, handed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Losses and gradients at all columns of w (the last row is the bias), each with its own alpha, by one pass over the blocks. ``scale`` is what the
    entries of a feature are, where blocks have no values; ``handed`` is what handed_on() says.

    A task sums its blocks up and hands on the gradient of the features that it has. The driver adds them up if they are small; else they
    are cut into chunks of features, and each chunk is added up in a task.
    """
    by = np.broadcast_to(scale, len(w))[:, None]
    shared = matrix.context.broadcast(w * by)
    size, columns = w.shape

    def part(held: Iterator[Block]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        w, total, loss, seen = shared.value, np.zeros((size, columns)), np.zeros(columns), np.zeros(size, bool)
        for b in held:
            risk = b.risks(w)
            gap = risk - b.label[:, None]
            loss += (b.weight[:, None] * gap * gap).sum(axis=0) / n
            b.gradient(2 * b.weight[:, None] * gap * risk * (1 - risk / 2) / n, total)
            seen[b.columns] = seen[size - 1 - b.dense.shape[1] :] = True
        own = np.flatnonzero(seen)
        yield loss, own, total[own]

    def cut(found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        yield -1, found[0]
        for c in np.unique(found[1] // CHUNK):
            inside = found[1] // CHUNK == c
            chunk = np.zeros((min(CHUNK, size - c * CHUNK), columns))
            chunk[found[1][inside] - c * CHUNK] = found[2][inside]
            yield int(c), chunk

    loss, gradient = np.zeros(columns), np.zeros((size, columns))
    parts = matrix.mapPartitions(part)
    if max(handed, 1) * columns * w.itemsize > DIRECT_BYTES:
        for c, x in parts.flatMap(cut).reduceByKey(lambda a, b: a + b).collect():
            if c < 0:
                loss += x
            else:
                gradient[c * CHUNK : c * CHUNK + len(x)] += x
    else:
        for own_loss, own, x in parts.collect():
            loss += own_loss
            gradient[own] += x
    shared.destroy()
    gradient *= by
    gradient[:-1] += 2 * alphas * w[:-1]
    return loss + alphas * (w[:-1] ** 2).sum(axis=0), gradient


def _dot(a: np.ndarray, b: np.ndarray) -> float:
    # by one thread: threads of the driver would wait for cores that tasks have
    return float(np.einsum("i,i", a, b))


@dataclass
class Search:
    """Limited-memory quasi-Newton steps of one alpha from zero, with a line search for a weak Wolfe point. ``trial`` is where the loss
    is wanted next. ``times`` is the root of the number of equal features that a coefficient stands for."""

    w: np.ndarray
    loss: float
    gradient: np.ndarray
    times: np.ndarray | float = 1.0
    memory: int = 16
    rounds: int = 0
    past: list = field(default_factory=list)

    def __post_init__(self):
        self._aim()

    def norm(self) -> float:
        return float(np.sqrt(_dot(self.gradient, self.gradient)))

    def _aim(self) -> None:
        d, scales = self.gradient.copy(), []
        for s, y, along in reversed(self.past):
            scales.append(_dot(s, d) / along)
            d -= scales[-1] * y
        if self.past:
            s, y, along = self.past[-1]
            d *= along / _dot(y, y)
        for (s, y, along), a in zip(self.past, reversed(scales), strict=True):
            d += s * (a - _dot(y, d) / along)
        self.down, self.low, self.high = d, 0.0, np.inf
        self.step = 1.0 if self.past else min(1.0, 1 / max(1e-300, float((self.times * np.abs(self.gradient)).sum())))

    @property
    def trial(self) -> np.ndarray:
        return self.w - self.step * self.down

    def take(self, loss: float, gradient: np.ndarray) -> None:
        slope = _dot(self.gradient, self.down)
        if self.high - self.low < 1e-12 * self.step:
            pass  # rounding hides the difference; what there is, is taken
        elif not loss <= self.loss - 1e-4 * self.step * slope:
            self.high = self.step
            self.step = (self.low + self.high) / 2
            return
        elif _dot(gradient, self.down) > 0.9 * slope:
            self.low = self.step
            self.step = 2 * self.step if self.high == np.inf else (self.low + self.high) / 2
            return
        s, y = self.trial - self.w, gradient - self.gradient
        if (along := _dot(s, y)) > 1e-300:
            self.past = [*self.past, (s, y, along)][-self.memory :]
        self.w, self.loss, self.gradient, self.rounds = self.trial, loss, gradient, self.rounds + 1
        self._aim()


def minimise(matrix: RDD, size: int, alphas: tuple[float, ...], n: int, rounds: int = ROUNDS, tolerance: float = TOLERANCE, scale: np.ndarray | float = 1.0, times: np.ndarray | float = 1.0) -> list[Search]:
    """Each alpha's minimum. All alphas that aren't done share each pass over the blocks, one Spark job for all their trial points."""
    zero, handed = np.zeros((size, len(alphas))), handed_on(matrix)
    losses, gradients = evaluate(matrix, zero, np.array(alphas), n, scale, handed)
    searches = [Search(zero[:, k], float(losses[k]), gradients[:, k].copy(), times) for k in range(len(alphas))]
    passes = 0
    while passes < 3 * rounds and (active := [k for k, s in enumerate(searches) if s.norm() > tolerance and s.rounds < rounds]):
        losses, gradients = evaluate(matrix, np.column_stack([searches[k].trial for k in active]), np.array(alphas)[active], n, scale, handed)
        for i, k in enumerate(active):
            searches[k].take(float(losses[i]), gradients[:, i].copy())
            if searches[k].norm() <= tolerance:
                searches[k].past = []
        passes += 1
    return searches


def merged_columns(rows: DataFrame, size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the columns that n rows (at) have entries in, the number of its group, and the groups' rows: columns are of one group if they occur in
    the same rows, by the sums of two digests of their rows (merged_rows checks that the groups are whole in each row)."""
    bits = 62 - n.bit_length()
    digests = [F.shiftrightunsigned(F.xxhash64(F.lit(k), "at", "label", "dense"), 64 - bits).alias(f"h{k}") for k in range(2)]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((2, size), np.int64), np.zeros(size, np.int64)
        for b in batches:
            at, sizes = _flat(b, "at")
            at = at.astype(np.intp)
            counts += np.bincount(at, minlength=size)
            for k in range(2):
                np.add.at(sums[k], at, np.repeat(b.column(b.schema.get_field_index(f"h{k}")).to_numpy(), sizes))
        own = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *[pa.array(x[own]) for x in (*sums, counts)]], names=["at", "h0", "h1", "n"])

    added = rows.select("at", *digests).mapInArrow(part, "at int, h0 bigint, h1 bigint, n bigint").groupBy("at").agg(*[F.sum(c).alias(c) for c in ("h0", "h1", "n")]).toArrow()
    marks = np.zeros((size, 3), np.int64)
    marks[added["at"].to_numpy()] = np.column_stack([added[c].to_numpy() for c in ("h0", "h1", "n")])
    found, group = np.unique(marks, axis=0, return_inverse=True)
    return group.ravel().astype(np.int32), found[:, 2]


def merged_rows(rows: DataFrame, group: np.ndarray, held: np.ndarray, n: int, tasks: int) -> DataFrame:
    """The n rows with groups of columns for columns, dealt to tasks by the rarest of a row's groups: so most groups' rows are in one task, and a pass hands
    their gradient on once. A row without a rare one is dealt by itself."""
    shared = rows.sparkSession.sparkContext.broadcast((group, np.bincount(group, minlength=len(held)), held))

    @F.arrow_udf("struct<at:array<int>,rarest:int>")
    def merged(lists: pa.Array) -> pa.Array:
        group, members, held = shared.value
        at, sizes = _flat(pa.RecordBatch.from_arrays([lists], names=["at"]), "at")
        key = np.unique(np.repeat(np.arange(len(sizes)), sizes) * len(held) + group[at])
        row, own = key // len(held), key % len(held)
        if (np.bincount(row, members[own], len(sizes)) != sizes).any():
            raise ValueError("columns of one group don't occur in the same rows")
        offsets = np.searchsorted(row, np.arange(len(sizes) + 1))
        rarest = np.full(len(sizes), -1)
        order = np.lexsort((own, -held[own], row))
        rarest[row[order]] = np.where(held[own] * 8 * tasks > n, -1, own)[order]
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(own, pa.int32())), pa.array(rarest, pa.int32())], names=["at", "rarest"])

    own = rows.withColumn("own", merged("at"))
    place = F.when(F.col("own.rarest") < 0, F.xxhash64("at", "label")).otherwise(F.xxhash64("own.rarest"))
    return own.withColumn("place", place).repartition(tasks, "place").sortWithinPartitions("place").select("label", "weight", "own.at", "dense")


def tasks_of(spark: SparkSession, entries: int, size: int) -> int:
    """Tasks of a pass: one hands on a gradient of features, so it has TASK_REUSE times as many entries as there are, once all cores are busy."""
    busy = min(spark.sparkContext.defaultParallelism, -(-entries // TASK_ENTRIES))
    return max(1, busy, -(-entries // max(TASK_ENTRIES, TASK_REUSE * size)))


def fit(features: DataFrame, targets: DataFrame, alphas: tuple[float, ...] = ALPHAS, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame, float]:
    """Coefficients (feature, coef; the bias as feature ""), the grid (alpha, mae, loss, gradient, rounds), and the chosen alpha.

    targets: id, label, weight, validation. The alpha of the least mean absolute error on validation
    rows wins, the first of equal ones.
    """
    names = numbered(features.select("feature").distinct()).persist()
    size = names.count()
    matrix = rows_of_matrix(features, targets.where("not validation"), names).persist()
    n, entries = matrix.agg(F.count("*"), F.coalesce(F.sum(F.size("at")), F.lit(0))).first()
    held = blocks(matrix.repartition(tasks_of(matrix.sparkSession, entries, size + 1))).persist(StorageLevel.MEMORY_AND_DISK)
    done = minimise(held, size + 1, alphas, max(1, n), rounds, tolerance)
    out = _chosen(done, np.column_stack([s.w for s in done]), blocks(rows_of_matrix(features, targets.where("validation"), names)), names, alphas)
    for x in (held, matrix, names):
        x.unpersist()
    return out


def fit_rows(rows: DataFrame, idf: Packed, names: DataFrame, alphas: tuple[float, ...] = ALPHAS, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame, float]:
    """fit() of stored rows of packed_rows(), with their idf and names.

    n-grams that occur in the same training rows have one idf, and at each step from zero one gradient, so they have one coefficient. m of them are one
    column with root of m times the entries: its coefficient is root of m times theirs, and loss, penalty, gradient's norm and steps are the same.
    """
    spark, size = rows.sparkSession, len(idf.keys)
    wide = names.count() - size
    train = rows.where("not validation")
    n = train.count()
    group, held = merged_columns(train, size, n)
    times = np.sqrt(np.bincount(group, minlength=len(held)))
    value = np.zeros(len(held))
    value[group] = idf.coefs
    one = np.ones(wide + 1)
    matrix = blocks(merged_rows(train, group, held, n, tasks_of(spark, int(held.sum()), len(held) + wide + 1))).persist(StorageLevel.MEMORY_AND_DISK)
    done = minimise(matrix, len(held) + wide + 1, alphas, max(1, n), rounds, tolerance, np.append(value * times, one), np.append(times, one))
    w = np.column_stack([s.w for s in done])
    w = np.vstack([w[group] / times[group][:, None], w[len(held) :]])
    out = _chosen(done, w, blocks(rows.where("validation").drop("validation")), names, alphas, np.append(idf.coefs, one))
    matrix.unpersist()
    return out


def _chosen(done: list[Search], w: np.ndarray, held: RDD, names: DataFrame, alphas: tuple[float, ...], scale: np.ndarray | float = 1.0) -> tuple[DataFrame, DataFrame, float]:
    """What fit() returns, of each alpha's minimum w, by the blocks of validation rows."""
    spark = names.sparkSession
    shared = spark.sparkContext.broadcast(w * np.broadcast_to(scale, len(w))[:, None])
    sums = held.map(lambda b: (np.abs(b.risks(shared.value) - b.label[:, None]).sum(axis=0), len(b.label))).collect()
    rows = sum(k for _, k in sums)
    mae = [float(e) / rows for e in sum(e for e, _ in sums)] if rows else [float("inf")] * len(alphas)
    best = min(range(len(alphas)), key=lambda k: mae[k])
    known = names.select("feature", "at").toPandas()
    known["coef"] = w[known["at"].to_numpy(), best]
    coef = spark.createDataFrame(known[["feature", "coef"]], "feature string, coef double").unionByName(spark.createDataFrame([("", float(w[-1, best]))], "feature string, coef double"))
    grid = [(float(a), float(m), s.loss, s.norm(), s.rounds) for a, m, s in zip(alphas, mae, done, strict=True)]
    return coef, spark.createDataFrame(grid, "alpha double, mae double, loss double, gradient double, rounds int"), alphas[best]


# Thresholds. scores: truth (0, 1, 2), risk.


def prefix_counts(scores: DataFrame) -> DataFrame:
    """candidate, below_0, below_1, below_2, total_0, total_1, total_2.

    Candidates are the distinct scores, the midpoints between neighbours, and the largest plus 1. Counting by
    score comes first; distinct scores are then dealt to ranges by sampled bounds, so that scores that crowd at one end are
    split as well, and windows over blocks carry sums and neighbours across.
    """
    by = stored(scores.groupBy("risk").agg(*[F.count_if(F.col("truth") == k).alias(f"n_{k}") for k in range(3)]), "scores")
    tasks = max(1, min(-(-by.count() // BLOCK_SCORES), 64 * by.sparkSession.sparkContext.defaultParallelism))
    by = stored(by.repartitionByRange(tasks, "risk").withColumn("block", F.spark_partition_id()), "scores")
    over = Window.orderBy("block")
    sums = by.groupBy("block").agg(*[F.sum(f"n_{k}").alias(f"s_{k}") for k in range(3)], F.min("risk").alias("low"))
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    sums = sums.select("block", F.lead("low").over(over).alias("next_low"), *[F.coalesce(F.sum(f"s_{k}").over(before), F.lit(0)).alias(f"b_{k}") for k in range(3)], *[F.sum(f"s_{k}").over(every).alias(f"total_{k}") for k in range(3)])
    within = Window.partitionBy("block").orderBy("risk")
    upto = within.rowsBetween(Window.unboundedPreceding, -1)
    rows = by.join(F.broadcast(sums), "block").select(
        "risk", F.coalesce(F.lead("risk").over(within), "next_low").alias("next"),
        *[(F.col(f"b_{k}") + F.coalesce(F.sum(f"n_{k}").over(upto), F.lit(0))).alias(f"below_{k}") for k in range(3)],
        *[f"n_{k}" for k in range(3)], *[f"total_{k}" for k in range(3)],
    )
    totals = [f"total_{k}" for k in range(3)]
    own = rows.select(F.col("risk").alias("candidate"), *[f"below_{k}" for k in range(3)], *totals)
    middle = F.when(F.col("next").isNotNull(), (F.col("risk") + F.col("next")) / 2).otherwise(F.col("risk") + 1)
    between = rows.select(middle.alias("candidate"), *[(F.col(f"below_{k}") + F.col(f"n_{k}")).alias(f"below_{k}") for k in range(3)], *totals)
    return own.unionByName(between)


def cost(scores: DataFrame, warn: float, block: float) -> DataFrame:
    """Cost of a pair: 20 for each destructive row below block, 1 for each risky one below warn and each safe one not below it."""
    t, r = F.col("truth"), F.col("risk")
    return scores.agg((MISS_COST * F.count_if((t == 2) & (r < block)) + F.count_if((t == 1) & (r < warn)) + F.count_if((t == 0) & (r >= warn))).alias("cost"))


def cheapest(prefix: DataFrame) -> DataFrame:
    """The pair of least cost. Raising block never lowers the cost, so block is warn, and one pass finds it."""
    total = MISS_COST * F.col("below_2") + F.col("below_1") + F.col("total_0") - F.col("below_0")
    return prefix.agg(F.min(F.struct(total.alias("cost"), F.col("candidate").alias("warn"))).alias("m")).select("m.warn", F.col("m.warn").alias("block"), "m.cost")


def at_recall(prefix: DataFrame, k: int, floor: float) -> Column:
    """Aggregate: the highest candidate at which a class's recall reaches the floor; without rows of the class, the highest."""
    reached = (F.col(f"total_{k}") == 0) | ((F.col(f"total_{k}") - F.col(f"below_{k}")) / F.col(f"total_{k}") >= floor)
    return F.max(F.when(reached, F.col("candidate")))


def thresholds(scores: DataFrame) -> DataFrame:
    """warn, block: by the recall floors, warn capped at block, six decimals."""
    prefix = prefix_counts(scores)
    two = prefix.agg(at_recall(prefix, 1, WARN_RECALL).alias("w"), at_recall(prefix, 2, BLOCK_RECALL).alias("b"))
    return two.select(F.coalesce(F.round(F.least("w", "b"), 6), F.lit(NO_DATA[0])).alias("warn"), F.coalesce(F.round("b", 6), F.lit(NO_DATA[1])).alias("block"))
