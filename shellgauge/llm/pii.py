"""Personal data by proposed spans and gradient-boosted trees.

Base spans are those of four fixed patterns with their checks. Besides them, generators propose many
overlapping spans of each kind: digit runs with up to four separators of any sort between digits and all their runs of
groups, mails with a written-out "at" or "dot", addresses with guarded dots. Each proposal gets features of its format
(digits, groups, separators, Luhn, largest part, ...) and of its context (neighbouring characters, cue words), and
boosted trees with logistic loss give its probability, calibrated by Platt scaling. Of the proposals above
their kind's threshold, the likeliest that don't overlap each other or a base span are added.

The trees learn from all proposals of all documents: base spans are positive, proposals apart from them
negative. Spark counts equal features and then, by exact quantiles of each feature, equal bins ("cells"), in which trees on
bins see all that they could see in the rows; the driver fits them on at most CELLS cells, with fewer bins where there are more. Rewritten copies teach the formats that the base
patterns can't see: numbers without their plus sign or with other separators, mails with "(at)", addresses with "[.]", which count
as positive by their format or with a cue word and as negative without, and numbers whose check fails, which are negative.
Calibration and thresholds come from probabilities of documents that the trees in question have not seen: the documents
are parted in FOLDS, and trees of the others judge each. A kind's threshold is the least with a precision of
PRECISION on its own proposals, the more of them the more it counts against that of all kinds together.
All documents are searched whole, in time linear in the text. Without base spans, nothing is added.

Null texts count as empty. Rows are kept one by one; only the kept columns pass.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, map_slices, renamed, slices, tidy, written

KINDS = ("email", "ip", "card", "phone")
#: Most cells that the driver fits the trees on, and the size from which on features count alike.
CELLS, LONGEST = 200_000, 1000
PRECISION, FOLDS = 0.98, 4
#: Positive proposals at which a kind's own threshold and that of all kinds count alike.
OWN_WEIGHT = 30
TREES, DEPTH, RATE, BINS = 60, 3, 0.2, 32

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
# a match of these starts at the first digit of a run, so looking behind and never giving back digits change nothing but the time
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Words before a span that speak for a kind.
CUES = {
    "email": ("mail", "contact", "write", "reach"),
    "ip": ("ip", "server", "host", "address"),
    "card": ("card", "visa", "credit", "pay"),
    "phone": ("tel", "phone", "call", "fax", "mobile"),
}
_RUN = re.compile(r"\+?\(?[0-9](?:[\x20\t\u00a0()./_\-]{0,4}[0-9])++")
_GROUP = re.compile(r"[0-9]+")
_GUARDED = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\x20?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\))\x20?[0-9]{1,3}){3}(?![0-9])", re.I)
_AT = re.compile(r"\x20?[(\[]at[)\]]\x20?|\x20at\x20(?=[A-Za-z0-9-]+\x20?(?:dot\x20|\(dot\)|\[dot\]))", re.I)
_AT_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:(?:\.|\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?)[A-Za-z0-9-]+)+", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(_GROUP.findall(s))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        # leftmost match: the run of allowed characters before the "@", after the last match
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := only_digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(only_digits(m[0])) <= 15]
    return sorted(out)


def proposals(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all proposed spans; they overlap."""
    out = []
    if _DIGIT.search(text):
        for m in _RUN.finditer(text):
            groups = [(g.start() + m.start(), g.end() + m.start()) for g in _GROUP.finditer(m[0])]
            for i, (a, _) in enumerate(groups):
                lead = a
                if i == 0:
                    lead = m.start()
                elif text[a - 1] == "(":
                    lead = a - 1
                total = 0
                for j in range(i, len(groups)):
                    total += groups[j][1] - groups[j][0]
                    if total > 19:
                        break
                    end = groups[j][1]
                    if j == i + 3 and "(" not in text[a:end]:
                        out.append((a, 1, end))
                    if 14 <= total:
                        out.append((a, 2, end))
                    if 9 <= total <= 15:
                        out.append((lead, 3, end))
    low = text.lower()
    if "[.]" in low or "(.)" in low or "dot" in low:
        out += [(m.start(), 1, m.end()) for m in _GUARDED.finditer(text)]
    if "at)" in low or "at]" in low or "dot" in low:
        for m in _AT.finditer(text):
            start = m.start()
            while start > 0 and text[start - 1] in _LOCAL:
                start -= 1
            d = _AT_DOMAIN.match(text, m.end())
            if d and start < m.start():
                out.append((start, 0, d.end()))
    return out


N_FEATURES = 16


def _side(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 3 if c in ".,;:!?)\"'" else 4


def features(kind: int, span: str, left: str, right: str) -> list[float]:
    digits = only_digits(span)
    groups = _GROUP.findall(span)
    seps = {c for c in span if not c.isalnum()}
    low = left.lower()
    return [
        kind, min(LONGEST, len(digits)), min(LONGEST, len(span)), min(LONGEST, len(groups)), min(LONGEST, len(seps)), span[:1] == "+", "@" in span, luhn(digits) if digits else 0,
        max((min(999, int(g[:4])) for g in groups), default=-1), any(c in low for c in CUES[KINDS[kind]]), _side(left[-1:]), _side(right[:1]),
        len(set(digits)), digits[:1] == "0", any(g in span.lower() for g in ("(at)", "[at]", "dot", "[.]", "(.)")), min(LONGEST, len(groups[-1])) if groups else 0,
    ]


def _context(text: str, start: int, end: int) -> tuple[str, str, str]:
    return text[start:end], text[max(0, start - 24) : start], text[end : end + 4]


def rewritten(kind: int, span: str, left: str, right: str) -> list[tuple[str, str, int]]:
    """(span, left context, label) of copies of a base span in other formats."""
    cue = f" {CUES[KINDS[kind]][len(span) % len(CUES[KINDS[kind]])]}: "
    if kind == 0:
        name, _, domain = span.partition("@")
        return [(f"{name}(at){domain}", left, 1), (f"{name} [at] {domain.replace('.', ' [dot] ')}", left, 1), (f"{name} at {domain.replace('.', ' dot ')}", cue, 1)]
    digits = only_digits(span)
    if kind == 1:
        return [("300." + span.split(".", 1)[1], left, 0), (span.replace(".", " "), left, 0), (span.replace(".", "[.]"), left, 1), (span.replace(".", " (dot) "), left, 1), ("300[.]" + span.replace(".", "[.]").split("[.]", 1)[1], left, 0)]
    if kind == 2:
        wrong = digits[:-1] + str((int(digits[-1]) + 1 + len(left) % 8) % 10)
        return [(" ".join(digits[i : i + 4] for i in range(0, len(digits), 4)), left, 1), (".".join(digits[i : i + 4] for i in range(0, len(digits), 4)), cue, 1), (".".join(digits[i : i + 4] for i in range(0, len(digits), 4)), left, 0)] + ([(wrong, left, 0), (wrong, cue, 0)] if not luhn(wrong) else [])
    bare = span.lstrip("+")
    return [(bare, cue, 1), (" - ".join(_GROUP.findall(bare)), cue, 1), ("/".join(_GROUP.findall(bare)), left, 0), (bare, left, 0), (digits, cue, 1), (digits, left, 0), (digits[:-2], left, 0)]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)


@dataclass
class Trees:
    """Boosted trees of fixed depth with logistic loss, fitted on binned features."""

    edges: list[np.ndarray] = field(default_factory=list)
    #: of each tree: feature and bin of each inner node (heap order), value of each leaf
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    start: float = 0.0

    @staticmethod
    def _leaf(b: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
        node = np.zeros(len(b), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (b[np.arange(len(b)), feature[node]] > cut[node])
        return node - (2**DEPTH - 1)

    def fit(self, b: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
        """Fits on bins (below BINS) of the features, by the edges given."""
        p0 = np.average(y, weights=weight)
        self.start = float(np.log(p0 / (1 - p0)))
        z = np.full(len(y), self.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-z))
            g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
            feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, BINS, np.int64)
            node = np.zeros(len(y), np.int64)
            for n in range(2**DEPTH - 1):
                mine = node == n
                gain_best = 1e-9
                gs, hs = g[mine].sum(), h[mine].sum()
                for f in range(b.shape[1]):
                    gl = np.cumsum(np.bincount(b[mine, f], g[mine], BINS + 1))
                    hl = np.cumsum(np.bincount(b[mine, f], h[mine], BINS + 1))
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    k = int(gain.argmax())
                    if gain[k] > gain_best:
                        gain_best, feature[n], cut[n] = gain[k], f, k
                node[mine] = 2 * n + 1 + (b[mine, feature[n]] > cut[n])
            leaf = node - (2**DEPTH - 1)
            value = -RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
            self.trees.append((feature, cut, value))
            z += value[leaf]
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.binned_logits(binned(x, self.edges))

    def binned_logits(self, b: np.ndarray) -> np.ndarray:
        return self.start + sum(v[self._leaf(b, f, c)] for f, c, v in self.trees)


@dataclass
class Finder:
    """Base spans, and what the trees add. Without trees, base spans only."""

    trees: Trees | None = None
    platt: tuple[float, float] = (1.0, 0.0)
    thresholds: tuple[float, ...] = (1.0,) * len(KINDS)

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, b = self.platt
        return 1 / (1 + np.exp(-(a * self.trees.logits(x) + b)))

    def find(self, text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """Base spans, and all spans: (start, kind, end) in order."""
        text = text or ""
        base = base_spans(text)
        if self.trees is None:
            return base, base
        taken = list(base)
        more = _apart(proposals(text), base)
        if more:
            x = np.array([features(k, *_context(text, a, b)) for a, k, b in more], float)
            p = self.probability(x)
            added: list[tuple[int, int, int]] = []
            for i in np.lexsort((np.arange(len(more)), [a - b for a, _, b in more], -p)):
                a, k, b = more[i]
                if p[i] >= self.thresholds[k] and _free(added, a, b):
                    _insert(added, (a, k, b))
            taken += added
        return base, sorted(taken)


def _insert(spans: list, span: tuple[int, int, int]) -> None:
    import bisect

    bisect.insort(spans, span)


def _free(spans: list[tuple[int, int, int]], a: int, b: int) -> bool:
    """Whether [a, b) overlaps none of the spans, which are in order and apart from each other."""
    import bisect

    i = bisect.bisect_left(spans, (b,))
    return i == 0 or spans[i - 1][2] <= a


def _apart(spans: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans that overlap no base span (those of different kinds may overlap each other)."""
    joined: list[tuple[int, int, int]] = []
    for a, k, b in base:
        if joined and a < joined[-1][2]:
            joined[-1] = (joined[-1][0], k, max(b, joined[-1][2]))
        else:
            joined.append((a, k, b))
    return [s for s in spans if _free(joined, s[0], s[2])]


def counted(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """fold, label, rewritten, x, n: how often base spans (label 1), proposals apart from them (0) and copies of base spans in other formats
    have the features x (packed 16-bit integers), over all documents. Documents are parted in folds by hash of key and length."""
    rows = df.select(F.pmod(F.xxhash64(F.col(key).cast("string"), F.length(text)), F.lit(FOLDS)).cast("int").alias("fold"), F.col(text).alias("text_"))

    def gather(batches):
        for part in chain.from_iterable(slices(b, 1, 4 << 20) for b in batches):
            n = Counter()
            for fold, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                base = base_spans(text or "")
                for (a, k, b), y in chain(zip(base, repeat(1)), zip(_apart(proposals(text or ""), base), repeat(0))):
                    span, left, right = _context(text, a, b)
                    n[fold, y, False, _pack(features(k, span, left, right))] += 1
                    for s, lf, label in rewritten(k, span, left, right) if y else ():
                        n[fold, label, True, _pack(features(k, s, lf, right))] += 1
            cols = [*zip(*n, strict=True)] if n else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*cols, list(n.values())], (pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.int64()), strict=True)], names=["fold", "label", "rewritten", "x", "n"])

    made = rows.mapInArrow(tidy(gather), "fold int, label int, rewritten boolean, x binary, n bigint")
    return made.groupBy("fold", "label", "rewritten", "x").agg(F.sum("n").alias("n"))


def _pack(x: list[float]) -> bytes:
    return np.array(x, "<i2").tobytes()


def _unpacked(x: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.to_pylist()), "<i2").reshape(-1, N_FEATURES)


def value_counts(rows: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """The values of each feature in order, at most some LONGEST, and how many rows have them."""

    def part(batches):
        for b in batches:
            x, n = _unpacked(b.column(0)), b.column(1).to_numpy()
            for f in range(N_FEATURES):
                value, at = np.unique(x[:, f], return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), f, np.int32)), pa.array(value.astype(np.int32)), pa.array(np.bincount(at, n, len(value)).astype(np.int64))], names=["f", "value", "n"])

    got = rows.select("x", "n").mapInArrow(part, "f int, value int, n bigint").groupBy("f", "value").agg(F.sum("n").alias("n")).toArrow().sort_by([("f", "ascending"), ("value", "ascending")])
    f, value, n = (got[c].to_numpy() for c in ("f", "value", "n"))
    return [(value[f == k], n[f == k]) for k in range(N_FEATURES)]


def edges_of(counts: list[tuple[np.ndarray, np.ndarray]], bins: int) -> list[np.ndarray]:
    """Of each feature the different lower quantiles that part its rows in so many bins."""
    places = np.linspace(0, 1, bins + 1)[1:-1]
    return [np.unique(value[np.searchsorted(np.cumsum(n), np.floor(places * (n.sum() - 1)), side="right")]) for value, n in counts]


def cells(rows: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """fold, kind, label, b, n, halves: the rows of each cell, and twice their weight (a rewritten copy weighs a half)."""

    def part(batches):
        for batch in batches:
            x = _unpacked(batch.column("x"))
            b = binned(x, edges).astype(np.uint8)
            cols = [batch.column(c) for c in ("fold", "label", "rewritten", "n")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(x[:, 0].astype(np.int32)), pa.array([r.tobytes() for r in b], pa.binary())], names=["fold", "label", "rewritten", "n", "kind", "b"])

    made = rows.mapInArrow(part, "fold int, label int, rewritten boolean, n bigint, kind int, b binary")
    return made.groupBy("fold", "kind", "label", "b").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("rewritten"), F.col("n")).otherwise(2 * F.col("n"))).alias("halves"))


def learn(df: DataFrame, key: str = "doc_id", text: str = "text") -> Finder:
    """Fits the trees on all documents."""
    rows = written(counted(df, key, text), "proposals")
    counts = value_counts(rows)
    if not len(counts[0][0]):
        return Finder()
    bins = BINS
    while True:
        edges = edges_of(counts, bins)
        table = written(cells(rows, edges), "cells")
        if table.count() <= CELLS or bins == 1:
            break
        discard(table)
        bins //= 2
    got = table.toArrow().sort_by([(c, "ascending") for c in ("fold", "kind", "label", "b")])
    discard(rows, table)
    b = np.frombuffer(b"".join(got["b"].to_pylist()), np.uint8).reshape(-1, N_FEATURES)
    fold, kind, n = (got[c].to_numpy() for c in ("fold", "kind", "n"))
    y, w = got["label"].to_numpy().astype(float), got["halves"].to_numpy() / 2
    if y.min() == y.max() or not all(0 < y[fold != f].sum() < (fold != f).sum() for f in range(FOLDS)):
        return Finder()
    z = np.empty(len(y))
    for f in range(FOLDS):
        z[fold == f] = Trees(edges).fit(b[fold != f], y[fold != f], w[fold != f]).binned_logits(b[fold == f])
    finder = Finder(Trees(edges).fit(b, y, w), platt(z, y, w))
    slope, offset = finder.platt
    p = 1 / (1 + np.exp(-(slope * z + offset)))
    whole = threshold(p, y, w)
    limits = []
    for k in range(len(KINDS)):
        mine = kind == k
        own_n = float(n[mine & (y == 1)].sum())
        own = threshold(p[mine], y[mine], w[mine]) if own_n else whole
        limits.append((own_n * own + OWN_WEIGHT * whole) / (own_n + OWN_WEIGHT))
    finder.thresholds = tuple(limits)
    return finder


def threshold(p: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """The least probability, of 0.5 or more, from which on PRECISION of the proposals are positive; just above all if there is none."""
    order = np.argsort(-p, kind="stable")
    good, weight, q = y[order], w[order], p[order]
    precision = np.cumsum(good * weight) / np.cumsum(weight)
    last = np.append(q[1:] < q[:-1], True)  # a threshold can't part equal probabilities
    ok = np.flatnonzero((precision >= PRECISION) & last & (q >= 0.5))
    return float(q[ok[-1]]) if len(ok) else float(np.nextafter(max(0.5, q[0]), 1))


def platt(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make the labels likeliest, by Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([np.sum(w * (p - y) * z) + 1e-3 * (a - 1), np.sum(w * (p - y))])
        s = w * p * (1 - p)
        h = np.array([[np.sum(s * z * z) + 1e-3, np.sum(s * z)], [np.sum(s * z), np.sum(s) + 1e-6]])
        step = np.linalg.solve(h, g)
        size = max(1.0, float(np.abs(step).max()) / 2)
        a, b = a - step[0] / size, b - step[1] / size
    return float(a), float(b)


def span_names(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


COLUMNS = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_spans bigint"


def find_pii(df: DataFrame, finder: Finder, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """The kept columns, the counts of base spans, their digest, all spans and their number."""
    shared = df.sparkSession.sparkContext.broadcast(finder)

    def make():
        find = shared.value.find

        def fn(part):
            numbers, digests, spans, n_spans = [], [], [], []
            for t in part.column(part.schema.get_field_index(text)).to_pylist():
                base, every = find(t)
                numbers.append([sum(k == i for _, k, _ in base) for i in range(len(KINDS))])
                digests.append(hashlib.sha256(span_names(base).encode()).hexdigest())
                spans.append(span_names(every))
                n_spans.append(len(every))
            counts = {f"n_{k}": pa.array([x[i] for x in numbers], pa.int64()) for i, k in enumerate(KINDS)}
            return counts | {"base_sha256": pa.array(digests, pa.string()), "spans": pa.array(spans, pa.string()), "n_spans": pa.array(n_spans, pa.int64())}

        return fn

    return map_slices(df.select(*dict.fromkeys([*keep, text])), make, COLUMNS, keep, text)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k]}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, finder: Finder, text: str = "text") -> DataFrame:
    """The same columns, with personal data replaced; null texts stay null."""
    shared = df.sparkSession.sparkContext.broadcast(finder)
    rows, names = renamed(df)

    def make():
        find = shared.value.find

        def fn(part):
            texts = part.column(part.schema.get_field_index(names[text])).to_pylist()
            return {"redacted_": pa.array([None if t is None else redacted(t, find(t)[1]) for t in texts], pa.string())}

        return fn

    out = map_slices(rows, make, "redacted_ string", [n for c, n in names.items() if c != text], names[text])
    return out.select(*[F.col("redacted_" if c == text else n).alias(c) for c, n in names.items()])


def op6_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_pii(docs, learn(docs))


QUERIES = {"op6_boosted_pii": op6_boosted_pii}
SQL: dict[str, str] = {}
