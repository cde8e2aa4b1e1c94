"""Quality rules: divergence of a document's character classes and common words from its language's.

The references come from the table itself, over all documents with a language: the shares of
character classes, and the shares of common words (those that make up at least 1/COMMON of a
language's words, so at most COMMON words each) with one bucket for all others. A document is compared
with every language's references by the Jensen-Shannon distance (square root of the divergence,
base 2), and the nearest counts. Documents shorter than a guard are not judged by that
histogram. A document fails if a distance is above its limit, or by the base rules (too few words, or too
many words in repeated 8-word windows).

References are counted in tasks, word by word, and summed by (language, word); the driver gets those above the
share only. Each language of at least COMMON words gives references (with fewer, every word would be common). Documents
of the others are judged by the base rules only, as are all if there are no references.

Null texts have no words and fail the base rule; null languages and keys, ties, repeated rows and
empty tables are kept row by row. Only the key passes, so further columns can't clash.
"""

from __future__ import annotations

import itertools
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_slices, slices, tidy

MIN_WORDS, WINDOW, REPEAT_PERCENT = 20, 8, 30
SYMBOLS = b"#*$%&|<>"
COMMON = 1000
#: Guards: word characters and words that a text needs to be judged by a histogram.
GUARD_CHARS, GUARD_WORDS = 200, 50
#: Limits of the distances. A text without any common word is at about 0.43 from languages whose
#: common words are a third of the text, so the second limit asks for more than that.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.30, 0.50
#: Entries of a task's word counter before it is passed on.
COUNTER_SIZE = 300_000

#: Character classes, by UTF-8 bytes; a non-ASCII character counts by its first byte.
CLASSES = ("aeiou", "bcdfghjklmnpqrstvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\n\v\f\r", ".,;:!?'\"()-")
_CLASS = np.full(256, len(CLASSES), np.int64)  # other ASCII
for _i, _chars in enumerate(CLASSES):
    _CLASS[np.frombuffer(_chars.encode(), np.uint8)] = _i
_CLASS[0x80:0xC0] = len(CLASSES) + 2  # not a first byte: left out
_CLASS[0xC0:] = len(CLASSES) + 1
N_CLASSES = len(CLASSES) + 2
_SPACE = np.frombuffer(b" \t\n\v\f\r", np.uint8)
_SYMBOL = np.frombuffer(SYMBOLS, np.uint8)


_MIX = np.random.default_rng(1).integers(0, 1 << 63, 4096).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def byte_counts(data: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(data, np.uint8), minlength=256)


def class_counts(by_byte: np.ndarray) -> np.ndarray:
    return np.bincount(_CLASS, by_byte, N_CLASSES + 1)[:N_CLASSES]


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words in windows that occur twice or more. Exact: windows get ids by doubling, as pairs of ids."""
    import pandas as pd

    if len(ids) < window:
        return 0
    mixed = _MIX[ids % len(_MIX)] * (ids.astype(np.uint64) * np.uint64(2) + np.uint64(1))
    sums = np.zeros(len(ids) - window + 1, np.uint64)
    for k in range(window):
        sums = sums * np.uint64(0x9E3779B97F4A7C15) + mixed[k : k + len(sums)]
    sums.sort()
    if not (sums[1:] == sums[:-1]).any():
        return 0  # equal windows have equal sums
    names, width = ids.astype(np.int64), 1
    while width < window:
        step = min(width, window - width)
        names = pd.factorize(names[:-step] * (len(ids) + 1) + names[step:])[0].astype(np.int64)
        width += step
    again = np.flatnonzero(np.bincount(names)[names] > 1)
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def references(df: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, tuple[np.ndarray, dict[bytes, float]]]:
    """language -> (class shares, common word -> share)."""

    def count(batches):
        words: dict[str, Counter] = defaultdict(Counter)
        classes: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(N_CLASSES + 1))
        n_docs: Counter = Counter()

        def flush(last: bool):
            rows = [(k, 0, w, n) for k, c in words.items() for w, n in c.items()]
            if last:
                rows += [(k, 1, str(i).encode(), int(n)) for k, c in classes.items() for i, n in enumerate(c)]
                rows += [(k, 2, b"", n) for k, n in n_docs.items()]
            for i in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows[i : i + 50_000], strict=True), (pa.string(), pa.int32(), pa.binary(), pa.int64()), strict=True)], names=["lang", "kind", "word", "n"])
            words.clear()

        for part in itertools.chain.from_iterable(slices(b, b.schema.get_field_index("text"), 4 << 20) for b in batches):
            by_lang: dict[str, list[bytes]] = defaultdict(list)
            for t, k in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                n_docs[k] += 1
                by_lang[k].append((t or "").encode())
            for k, texts in by_lang.items():
                data = b"\n".join(texts)
                classes[k][:N_CLASSES] += class_counts(byte_counts(data))
                words[k].update(data.lower().split())
            if sum(map(len, words.values())) > COUNTER_SIZE:
                yield from flush(False)
        yield from flush(True)

    known = df.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("lang is not null")
    counted = known.mapInArrow(tidy(count), "lang string, kind int, word binary, n bigint").groupBy("lang", "kind", "word").agg(F.sum("n").alias("n"))
    totals = Counter()
    counted = counted.persist()
    for r in counted.where("kind = 2 or kind = 0").groupBy("lang", "kind").agg(F.sum("n").alias("n")).collect():
        totals[r["lang"], r["kind"]] = r["n"]
    langs = sorted(k for (k, kind), n in totals.items() if kind == 0 and n >= COMMON)
    out = {}
    if langs:
        least = counted.sparkSession.createDataFrame([(k, totals[k, 0] / COMMON) for k in langs], "lang string, least double")
        rows = counted.join(F.broadcast(least), "lang").where("kind = 1 or kind = 0 and n >= least").select("lang", "kind", "word", "n").collect()
        of_lang: dict[str, list] = defaultdict(list)
        for r in rows:
            of_lang[r["lang"]].append(r)
        for k in langs:
            hist = np.zeros(N_CLASSES)
            for r in of_lang[k]:
                if r["kind"] == 1 and int(r["word"]) < N_CLASSES:
                    hist[int(r["word"])] = r["n"]
            common = {bytes(r["word"]): r["n"] / totals[k, 0] for r in of_lang[k] if r["kind"] == 0}
            if hist.sum():
                out[k] = (hist / hist.sum(), dict(sorted(common.items())))
    counted.unpersist()
    return out


def _divergence(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The terms of twice the Jensen-Shannon divergence."""
    mid = (a + b) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num(a * np.log2(a / mid)) + np.nan_to_num(b * np.log2(b / mid))


def js_distances(own: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances of a histogram of sum 1 to each row of refs: 0 (equal) to 1 (disjoint)."""
    return np.sqrt(np.maximum(0.0, _divergence(own, refs).sum(axis=1) / 2))


class Judge:
    """Compares documents with references; made once a task."""

    def __init__(self, refs: dict[str, tuple[np.ndarray, dict[bytes, float]]]):
        self.langs = frozenset(refs)
        self.class_refs = np.array([r[0] for r in refs.values()])
        known: dict[bytes, int] = {}
        for _, common in refs.values():
            for w in common:
                known.setdefault(w, len(known))
        # sparse rows by word: the languages it is common in, and its share there
        words = np.array([known[w] for _, common in refs.values() for w in common], np.int64)
        langs = np.repeat(np.arange(len(refs)), [len(common) for _, common in refs.values()])
        order = np.argsort(words, kind="stable")
        self.lang_of = langs[order].astype(np.int32)
        self.share_of = np.array([x for _, common in refs.values() for x in common.values()], float)[order]
        self.begins = np.concatenate([[0], np.cumsum(np.bincount(words, minlength=len(known)))])
        self.rest = np.maximum(0.0, 1 - np.bincount(self.lang_of, self.share_of, len(refs)))
        #: a common word is met in lower case, capitalised or in upper case
        self.words = {form: i for w, i in known.items() for form in (w.upper(), w.capitalize(), w)}

    def distances(self, classes: np.ndarray, n_chars: int, at: list[int], counts: list[int], n_words: int) -> tuple[float | None, float | None]:
        """To the nearest language; null below the guard. at, counts: known words of the text."""
        c = w = None
        if len(self.class_refs) and n_chars >= GUARD_CHARS and classes.sum():
            c = float(js_distances(classes / classes.sum(), self.class_refs).min())
        if len(self.rest) and n_words >= GUARD_WORDS:
            at = np.array(at, np.int64)
            number = self.begins[at + 1] - self.begins[at]
            entry = np.arange(number.sum()) + np.repeat(self.begins[at] - np.cumsum(number) + number, number)
            lang, there = self.lang_of[entry], self.share_of[entry]
            here = np.repeat(np.array(counts, float) / n_words, number)

            def by_lang(x: np.ndarray) -> np.ndarray:
                return np.bincount(lang, x, len(self.rest))

            other = np.maximum(0.0, 1 - by_lang(here))
            missing = np.maximum(0.0, 1 - by_lang(there) - self.rest)  # words of the language that the text lacks
            terms = by_lang(_divergence(here, there)) + _divergence(other, self.rest) + missing
            w = float(np.sqrt(np.maximum(0.0, terms / 2)).min())
        return c, w

    def judge(self, text: str | None, lang: str | None = None) -> tuple:
        data = (text or "").encode()
        words = data.split()
        n = len(words)
        by_byte = byte_counts(data)
        word_chars = int(by_byte[:0x80].sum() + by_byte[0xC0:].sum() - by_byte[_SPACE].sum())
        lines = [x for x in data.split(b"\n") if x.strip(b" \t\n\v\f\r")]
        dup_lines = len(lines) - len(set(lines))
        names: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
        ids = np.fromiter(map(names.__getitem__, words), np.int64, n)
        repeat = repeated_words(ids)
        base_failed = n < MIN_WORDS or 100 * repeat > REPEAT_PERCENT * n
        found: Counter = Counter()
        if n:
            for u, i in zip(names, np.bincount(ids).tolist(), strict=True):
                if u in self.words:
                    found[self.words[u]] += i
        c, w = (None, None) if lang is not None and lang not in self.langs else self.distances(class_counts(by_byte), word_chars, [*found], [*found.values()], n)
        bad = (c is not None and c > MAX_CHAR_DISTANCE) or (w is not None and w > MAX_WORD_DISTANCE)
        return n, word_chars, int(by_byte[_SYMBOL].sum()), dup_lines, repeat, base_failed, not (base_failed or bad), c, w


COLUMNS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, char_distance double, word_distance double"


def judge_quality(df: DataFrame, refs: dict | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Key and COLUMNS of each row. refs: see references(); by default those of the table itself."""
    refs = references(df, text, lang) if refs is None else refs
    shared = df.sparkSession.sparkContext.broadcast(refs)  # at most COMMON words a language
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2

    def make():
        judge = Judge(shared.value).judge

        def fn(part):
            rows = [judge(t, k) for t, k in zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in ("text_", "lang_")), strict=True)]
            return {n: pa.array(list(x), k) for n, x, k in zip(names, zip(*rows, strict=True), kinds, strict=True)} if rows else {n: pa.array([], k) for n, k in zip(names, kinds, strict=True)}

        return fn

    return map_slices(df.select(F.col(key), F.col(text).alias("text_"), F.col(lang).cast("string").alias("lang_")), make, COLUMNS, [key], "text_")


def op1_js_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return judged.drop("char_distance", "word_distance")


QUERIES = {"op1_js_divergence": op1_js_divergence}
SQL: dict[str, str] = {}
