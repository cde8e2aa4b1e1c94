"""Feature columns of normalised commands: character n-grams and 38 dense features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZES = (2, 3, 4, 5)
MIN_DF = 3
#: Characters of an n-gram that fit into a key.
KEY_BYTES = 7
#: Cells of the sketch that stops rare n-grams, one byte each, and of a chunk in which tasks' cells are added up.
SKETCH_CELLS, SKETCH_CHUNK = 1 << 22, 1 << 16
#: Different n-grams that a task holds before it passes its counts on.
HELD_KEYS = 2_000_000

# The patterns of the dense features. They read lower-cased ASCII, so the capitals in
# some of them never match; they stay as they are, as scores depend on them.
SYSTEM_PATH = r"(?:^|[\s;&|(])/(?:etc|usr|var|bin|sbin|boot|lib|opt|srv|root|home|sys|proc|dev|sdcard|storage|data)(?:/|\b)"
HOME_PATH = r"(?:^|[\s;&|(])(~|\$\{?HOME\}?|\$\{?PWD\}?|\$\(pwd\))(?:/|\b|$)"
WILDCARD = r"(?:^|[\s;&|(])\*(?:\.\*)?\*?(?:/|$)"
RELATIVE = r"\./"
DISPOSABLE = (
    r"node_modules|\bbuild/?\b|\bdist/?\b|\btarget/?\b|\.gradle|\.venv|\bvenv/?\b|__pycache__|\.pytest_cache|\.mypy_cache|\.next|\.nuxt|\.cache|vendor/?\b"
    r"|pods/?\b|deriveddata|\.terraform|\bcoverage\b|\.tox|\.parcel-cache|\.turbo|\*\.o\b|\*\.class\b|\*\.pyc\b|\.ds_store|\*\.log\b|\*\.tmp\b|\*\.bak\b"
)
FLAGS = {
    "has_sudo": r"(?:^|\s)sudo\b",
    "has_su": r"(?:^|\s)su\s+-|\bsu\s+c\b",
    "has_doas": r"(?:^|\s)doas\b",
    "rm_recursive_force": r"\brm\b[^;|&]*\s-{1,2}[a-z]*r[a-z]*f\b|\brm\s+-[a-z]*f[a-z]*r\b",
    "rm_any_recursive": r"\brm\b[^;|&]*\s-{1,2}(?:r\b|recursive)",
    "has_dd": r"\bdd\b",
    "block_device": r"/dev/(?:sd[a-z]|nvme\d|mmcblk|hd[a-z])",
    "has_mkfs": r"\bmkfs\b|\bmke2fs\b|\bmkswap\b",
    "has_fs_table_tool": r"\b(?:fdisk|parted|sgdisk|gparted|blkdiscard|wipefs)\b",
    "has_fork_bomb": r":\s*\(\s*\)\s*\{",
    "has_chmod_777": r"chmod[^;|&]*777",
    "chmod_recursive": r"chmod\s+-R\b|chmod\s+-r\b",
    "has_chown_recursive_root": r"chown\s+-R\b[^;|&]*(?:root|0:0)",
    "has_curl_or_wget": r"\b(?:curl|wget|fetch)\b",
    "curl_pipe_to_shell": r"(?:curl|wget)[^;|&]*\|\s*(?:sudo\s+)?(?:ba|z|k|da)?sh\b|\|\s*(?:sudo\s+)?(?:python3?|perl|ruby|node|php)\b",
    "has_base64_decode": r"base64\s+(?:-d|--decode|-D)",
    "has_eval": r"(?:^|\s)eval\b",
    "has_history_tamper": r"history\s+-c|unset\s+HIST|>\s*~?/?\.bash_history",
    "touches_ssh_keys": r"\.ssh/|authorized_keys|id_rsa",
    "has_shutdown": r"\b(?:shutdown|reboot|poweroff|halt|init\s+[06])\b",
    "has_kill_broad": r"kill\s+-9\s+-1|killall|pkill",
    "has_git_destructive": r"git\s+(reset\s+--hard|clean\s+-f|push\s+-[a-z]*f|--force)",
    "has_docker_prune": r"docker\s+(system|image|volume|container)\s+prune",
    "has_kubectl_delete": r"kubectl\s+delete",
    "has_package_remove": r"(?:apt|apt-get|yum|dnf)\s+(remove|purge|autoremove)|(?:pip|npm|gem)\s+uninstall",
    "has_truncate_or_log_empty": r"truncate\s+-s|>\s*[\w./-]*\.log",
}
DANGER_WORD = r"\brm\b|\bdd\b|mkfs|chmod 777|fork bomb|:\{"
DANGER_VERB = r"\brm\s+-|^\s*dd\b|\bmkfs\b|chmod|chown|shutdown|reboot|kill"
FLAG_TOKEN = r"(?:^|\s)-{1,2}[a-zA-Z][\w-]*"
PATH_TOKEN = r"(?:/|~|\$\{?HOME\}?)/[\w./-]*"
RM_WORD = r"\brm\b"
MAX_PATH_DEPTH = 8

# The order of the dense features.
DENSE = (
    "segment_count", "has_sudo", "has_su", "has_doas", "rm_recursive_force", "rm_any_recursive",
    "delete_target_system_path", "delete_target_home", "delete_target_wildcard", "delete_target_relative", "delete_target_disposable",
    "has_dd", "dd_to_block_device", "has_mkfs", "has_fs_table_tool", "has_fork_bomb", "has_chmod_777", "chmod_recursive", "has_chown_recursive_root",
    "has_curl_or_wget", "curl_pipe_to_shell", "has_base64_decode", "has_eval", "has_history_tamper", "touches_ssh_keys", "has_shutdown", "has_kill_broad",
    "has_git_destructive", "has_docker_prune", "has_kubectl_delete", "has_package_remove", "has_truncate_or_log_empty",
    "subshell_depth", "backtick_count", "quote_nesting", "flag_density", "path_depth", "mentions_only",
)


def grams_of(view: Column) -> Column:
    """All character n-grams of one view, repeats included. A view shorter than a size has none of it
    (a sequence from 1 to 0 would count down)."""

    def of_size(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(view) - n + 1)
        return F.when(F.length(view) >= n, F.transform(starts, lambda i: F.substring(view, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    sizes = [of_size(n) for n in SIZES]
    return F.concat(*sizes)


def ngrams(text: Column, unquoted: Column) -> Column:
    """The set of n-grams of both views. Commands without quotes have one view only to cut up."""
    return F.when(text == unquoted, F.array_distinct(grams_of(text))).otherwise(F.array_distinct(F.concat(grams_of(text), grams_of(unquoted))))


def joined_ngrams(text: Column, unquoted: Column) -> Column:
    """The other definition: n-grams of both views joined by a NUL, which some of them hold."""
    return F.array_distinct(grams_of(F.concat(text, F.char(F.lit(0)), unquoted)))


def gram_table(df: DataFrame, key: str) -> DataFrame:
    """One row for each key and n-gram of its command."""
    return df.select(key, F.explode(ngrams(F.col("text"), F.col("unquoted"))).alias("gram"))


def gram_key(gram: Column) -> Column:
    """An n-gram of up to KEY_BYTES ASCII characters as a number, one byte each: equal only for equal n-grams, as no byte is zero."""
    return F.conv(F.hex(gram), 16, 10).cast("long")


def keys_in(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of all n-grams of normalised texts, repeats included; a null text has none."""
    text = text.cast(pa.large_string())
    at = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].astype(np.int64)
    row = np.repeat(np.arange(len(text)), np.diff(at))
    rows, keys, key = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], data
    for n in range(2, max(SIZES) + 1):
        if len(data) < n:
            break
        key = key[:-1] << 8 | data[n - 1 :]
        if n in SIZES:
            whole = row[: len(key)] == row[n - 1 :]
            rows.append(row[: len(key)][whole])
            keys.append(key[whole])
    return np.concatenate(rows), np.concatenate(keys)


#: Bits of a key, and rows whose numbers fit above them in one word.
_KEY_BITS = 8 * max(SIZES)
_ROWS = 1 << (63 - _KEY_BITS)


def row_sets(*views: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of each row's set of n-grams of all views, in order."""
    parts = []
    for start in range(0, len(views[0]), _ROWS):
        own = [keys_in(view.slice(start, _ROWS)) for view in views]
        both = np.concatenate([rows << _KEY_BITS | keys for rows, keys in own])
        both.sort()
        both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
        parts.append(((both >> _KEY_BITS) + start, both & ((1 << _KEY_BITS) - 1)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def once(*columns: pa.Array) -> tuple[list[pa.Array], np.ndarray]:
    """The different rows of text columns, and the place of each row among them: logs repeat commands, and what follows from the texts alone is
    computed once for a batch."""
    table = pa.table({str(i): c for i, c in enumerate(columns)}).append_column("row", pa.array(np.arange(len(columns[0]))))
    first = table.group_by([str(i) for i in range(len(columns))], use_threads=False).aggregate([("row", "list")])
    lists = first["row_list"].combine_chunks()
    back = np.empty(len(table), np.int64)
    back[lists.flatten().to_numpy()] = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    return [first[str(i)].combine_chunks() for i in range(len(columns))], back


def gram_count(text: Column, unquoted: Column) -> Column:
    """The size of ngrams(), from packed keys."""

    @F.arrow_udf("bigint")
    def counted(text: pa.Array, unquoted: pa.Array) -> pa.Array:
        (text, unquoted), back = once(text, unquoted)
        return pa.array(np.bincount(row_sets(text, unquoted)[0], minlength=len(text))[back])

    return counted(text, unquoted)


def joined_gram_counts(text: Column, unquoted: Column) -> Column:
    """(n, across): the size of joined_ngrams() and how many of them hold the NUL. Normalised texts are printable, so a control
    stands for the NUL in keys, which have no zero byte."""

    @F.arrow_udf("struct<n:bigint,across:bigint>")
    def counted(joined: pa.Array) -> pa.Array:
        (joined,), back = once(joined)
        row, key = row_sets(joined)
        across = np.zeros(len(key), bool)
        for k in range(max(SIZES)):
            across |= (key >> (8 * k)) & 0xFF == 1
        return pa.StructArray.from_arrays([pa.array(np.bincount(row[m], minlength=len(joined))[back]) for m in (np.ones(len(row), bool), across)], names=["n", "across"])

    return counted(F.concat(text, F.lit("\x01"), unquoted))


def gram_difference(text: Column, unquoted: Column, other_text: Column, other_unquoted: Column) -> Column:
    """(common, only_left, only_right) of the n-gram sets of two normalised commands of one row."""

    @F.arrow_udf("struct<common:bigint,only_left:bigint,only_right:bigint>")
    def compared(text: pa.Array, unquoted: pa.Array, other_text: pa.Array, other_unquoted: pa.Array) -> pa.Array:
        views, back = once(text, unquoted, other_text, other_unquoted)
        n = len(views[0])
        left, right, every = (np.bincount(row_sets(*v)[0], minlength=n) for v in (views[:2], views[2:], views))
        return pa.StructArray.from_arrays([pa.array(x[back]) for x in (left + right - every, every - right, every - left)], names=["common", "only_left", "only_right"])

    return compared(text, unquoted, other_text, other_unquoted)


def added_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys and the sums of their counts."""
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def vocabulary(grams: DataFrame, n_commands: Column | int, min_df: int = MIN_DF) -> DataFrame:
    """gram, df, idf of the n-grams that at least min_df commands have. Smoothed idf: ln((1+n)/(1+df)) + 1."""
    n = n_commands if isinstance(n_commands, Column) else F.lit(n_commands)
    return grams.groupBy("gram").agg(F.count("*").alias("df")).where(F.col("df") >= min_df).withColumn("idf", F.log((1 + n) / (1 + F.col("df"))) + 1)


def _cells(keys: np.ndarray) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (SKETCH_CELLS.bit_length() - 1))).astype(np.int64)


def _sketch(views: DataFrame, min_df: int) -> np.ndarray:
    """For each cell, whether the n-grams that fall into it occur in min_df commands together: if not, each of them is rare. Tasks count
    up to min_df in a byte a cell; chunks of cells are added up in tasks, and the driver gets SKETCH_CELLS bytes."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH_CELLS, np.uint8)
        for b in batches:
            views, back = once(b.column(0), b.column(1))
            row, keys = row_sets(*views)
            cells, n = added_up([(_cells(keys), np.bincount(back, minlength=len(views[0]))[row])])
            counts[cells] = np.minimum(counts[cells] + np.minimum(n, min_df), min_df)
        chunks = [c for c in range(0, SKETCH_CELLS, SKETCH_CHUNK) if counts[c : c + SKETCH_CHUNK].any()]
        yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int32()), pa.array([counts[c : c + SKETCH_CHUNK].tobytes() for c in chunks], pa.binary())], names=["at", "counts"])

    def added(key, table):
        total = np.zeros(SKETCH_CHUNK, np.uint8)
        for x in table["counts"].to_pylist():
            total = np.minimum(total + np.frombuffer(x, np.uint8), min_df)
        return pa.table({"at": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.astype(np.uint8).tobytes()], pa.binary())})

    out = np.zeros(SKETCH_CELLS, bool)
    merged = views.mapInArrow(part, "at int, counts binary").groupBy("at").applyInArrow(added, "at int, counts binary")
    for r in merged.toArrow().to_pylist():
        out[r["at"] : r["at"] + SKETCH_CHUNK] = np.frombuffer(r["counts"], np.uint8) >= min_df
    return out


def vocabulary_of(df: DataFrame, n_commands: Column | int, min_df: int = MIN_DF) -> DataFrame:
    """vocabulary() of normalised commands (text, unquoted) by two passes: a sketch first, then exact counts of the n-grams that it
    doesn't know to be rare. What is exchanged are keys with a task's counts, so most rare n-grams never leave their task."""
    if min_df > 100:
        raise ValueError("the sketch counts in bytes")
    views = df.where("text is not null").select("text", "unquoted")
    # every n-gram that occurs reaches a least frequency of 1
    shared = df.sparkSession.sparkContext.broadcast(_sketch(views, min_df) if min_df > 1 else np.ones(SKETCH_CELLS, bool))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, new = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
        for b in batches:
            views, back = once(b.column(0), b.column(1))
            row, more = row_sets(*views)
            good = shared.value[_cells(more)]
            held.append(added_up([(more[good], np.bincount(back, minlength=len(views[0]))[row[good]])]))
            new += len(held[-1][0])
            # what is held is merged once as much again has come, not for each batch
            if new > max(len(held[0][0]), HELD_KEYS // 4):
                held, new = [added_up(held)], 0
            if len(held[0][0]) > HELD_KEYS:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["key", "n"])
                held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in added_up(held)], names=["key", "n"])

    n = n_commands if isinstance(n_commands, Column) else F.lit(n_commands)
    exact = views.mapInArrow(part, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("df")).where(F.col("df") >= min_df)
    return exact.select(F.unhex(F.hex("key")).cast("string").alias("gram"), "df", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf"))


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


def _count(c: Column, s: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(s), F.lit("")))) / len(s)).cast("double")


def dense(df: DataFrame) -> DataFrame:
    """Adds the 38 dense features, as doubles, to a table with text and segments."""
    text, target = F.col("text"), F.col("target_")
    first_rm = F.element_at(F.filter("segments", lambda s: s.rlike(RM_WORD)), 1)
    out = df.withColumn("target_", F.coalesce(F.when(F.exists("segments", lambda s: s.rlike(RM_WORD)), first_rm), F.array_join("segments", " ")))
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    paths = F.transform(F.regexp_extract_all(text, F.lit(PATH_TOKEN), F.lit(0)), lambda p: F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit(""))))
    made = {k: _flag(text.rlike(p)) for k, p in FLAGS.items()}
    made |= {
        "segment_count": F.size("segments").cast("double"),
        "delete_target_system_path": _flag(target.rlike(SYSTEM_PATH)),
        "delete_target_home": _flag(target.rlike(HOME_PATH)),
        "delete_target_wildcard": _flag(target.rlike(WILDCARD)),
        "delete_target_relative": _flag(target.rlike(RELATIVE)),
        "delete_target_disposable": _flag(target.rlike(DISPOSABLE)),
        "dd_to_block_device": _flag(text.rlike(FLAGS["has_dd"]) & text.rlike(FLAGS["block_device"])),
        "subshell_depth": _count(text, "$(") + _count(text, "${"),
        "backtick_count": _count(text, "`"),
        "quote_nesting": F.floor((_count(text, '"') + _count(text, "'")) / 2).cast("double"),
        "flag_density": F.regexp_count(text, F.lit(FLAG_TOKEN)) / F.greatest(F.lit(1), words),
        "path_depth": F.least(F.coalesce(F.array_max(paths), F.lit(0)), F.lit(MAX_PATH_DEPTH)).cast("double"),
        "mentions_only": _flag(text.rlike(DANGER_WORD) & ~text.rlike(DANGER_VERB)),
    }
    return out.select(*df.columns, *[made[n].alias(n) for n in DENSE])


def dense_long(df: DataFrame, key: str) -> DataFrame:
    """key, feature, value: the dense features as rows."""
    return df.unpivot(key, list(DENSE), "feature", "value")


def standardiser(df: DataFrame) -> DataFrame:
    """name, mean, std of each dense feature in one pass; std is that of the population, at least 1e-6."""
    one = df.agg(*[f(n).alias(f"{k}_{n}") for n in DENSE for k, f in (("mean", F.avg), ("std", F.stddev_pop))])
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"mean_{n}").alias("mean"), F.greatest(F.col(f"std_{n}"), F.lit(1e-6)).alias("std")) for n in DENSE])
    return one.select(F.inline(rows))


def standardised(long: DataFrame, spec: DataFrame) -> DataFrame:
    """The long table with z = (value - mean) / std. The spec has one row for each of 38 features."""
    spec = F.broadcast(spec.withColumnRenamed("name", "feature"))
    return long.join(spec, "feature").withColumn("z", (F.col("value") - F.col("mean")) / F.col("std"))


def matrix(grams: DataFrame, vocab: DataFrame, z: DataFrame, key: str) -> DataFrame:
    """key, feature, value: known n-grams with their idf, then standardised dense features."""
    sparse = grams.join(vocab.select("gram", "idf"), "gram").select(key, F.concat(F.lit("g:"), "gram").alias("feature"), F.col("idf").alias("value"))
    return sparse.unionByName(z.select(key, F.concat(F.lit("d:"), "feature").alias("feature"), F.col("z").alias("value")))
