"""Benchmark decontamination by a generalised suffix automaton of the test items.

Texts are reduced to words (ASCII lower-cased; runs of digits, letters and non-ASCII characters).
The automaton, over word ids, holds all items; the words of a document run through it, and for each
position the length of the longest item passage that ends there is known. A window is WINDOW
consecutive item words, or all words of a shorter item; where the length reaches a window's, its
words are hit. Words that no item has break every match, so only runs of item words that are long
enough for a window go through the automaton; all others can't be hit.

Items are bounded: a block of at most about BLOCK_WORDS item words makes one automaton, which is broadcast.
More items make more blocks; each block is one pass over the documents, and the passes' hits are
united row by row. Window ids are counted exactly: a window's items are those of the automaton
state that the window ends in. No state deeper than the window is followed, and from a state only the linked states
that have windows are visited, so that the time is linear in the words, however repetitive.

An item without id counts for hits but not among the items. Null texts have no words and no hits; empty tables, repeated rows, ties and null keys are kept row by row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_slices, renamed, written

WINDOW = 13
#: A document is contaminated if at least one word in so many is hit.
SHARE = 20
#: Words of test items in one automaton (about 300 bytes each).
BLOCK_WORDS = 200_000

_FOLD = bytes(
    (c + 32 if 0x41 <= c <= 0x5A else c) if 0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)


def words(text: str | None) -> list[bytes]:
    """The words of a text, in UTF-8."""
    return (text or "").encode().translate(_FOLD).split()


class Automaton:
    """A suffix automaton over the word ids of several items.

    windows[state][n]: the items with a window of n words whose automaton state is this one.
    """

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.shortest = min([window, *(len(w) for _, w in items if w)])
        numbered = [(item, [self.ids.setdefault(w, len(self.ids)) for w in ws]) for item, ws in items]
        for _, seq in numbered:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        self.windows: dict[int, dict[int, set[int]]] = {}
        for item, seq in numbered:
            n = min(window, len(seq))
            state, length = 0, 0
            for c in seq:
                state, length = self.step(state, length, c)
                while state and self.len[self.link[state]] >= n:
                    state = self.link[state]
                    length = self.len[state]
                if length >= n:
                    self.windows.setdefault(state, {}).setdefault(n, set()).add(item)
        self.window = window
        #: the nearest state with windows on the way of links from each state, itself first; -1: there is none
        self.near = [-1] * len(self.len)
        for state in sorted(range(1, len(self.len)), key=self.len.__getitem__):
            self.near[state] = state if state in self.windows else self.near[self.link[state]]

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, c, q)
        cur = len(self.len)
        self.next.append({})
        self.len.append(self.len[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        new = len(self.len)
        self.next.append(dict(self.next[q]))
        self.len.append(self.len[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def step(self, state: int, length: int, c: int) -> tuple[int, int]:
        """Follow one word: the state and length of the longest passage that ends with it."""
        while state and c not in self.next[state]:
            state = self.link[state]
            length = self.len[state]
        to = self.next[state].get(c)
        return (0, 0) if to is None else (to, length + 1)

    def scan(self, seq: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans [start, end) of words, merged and in order, and the items whose windows occur."""
        get = self.ids.get
        known = np.fromiter((get(w, -1) for w in seq), np.int64, len(seq))
        edges = np.concatenate([[-1], np.flatnonzero(known < 0), [len(seq)]])
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        link, depth, near, window = self.link, self.len, self.near, self.window
        for k in np.flatnonzero(np.diff(edges) - 1 >= self.shortest):
            a, b = int(edges[k]) + 1, int(edges[k + 1])
            state, length = 0, 0
            for i, c in enumerate(known[a:b].tolist(), a + 1):
                state, length = self.step(state, length, c)
                while state and depth[link[state]] >= window:  # passages longer than a window say no more
                    state = link[state]
                    length = depth[state]
                at, longest = near[state], 0
                while at > 0:
                    for n, whose in self.windows[at].items():
                        if length >= n > depth[link[at]]:
                            items |= whose
                            longest = max(longest, n)
                    at = near[link[at]]
                if longest:
                    spans.append((i - longest, i))
        return united(spans), items


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(items: DataFrame, key: str = "item_id", text: str = "text", block_words: int = BLOCK_WORDS):
    """Automata of the items, block by block; the driver holds two blocks at most."""
    block: list[tuple[int, list[bytes]]] = []
    total = 0
    for r in items.select(F.col(key).alias("k"), F.col(text).alias("t")).toLocalIterator():
        ws = words(r["t"])
        if not ws:
            continue
        block.append((r["k"], ws))
        total += len(ws)
        if total >= block_words:
            yield Automaton(block)
            block, total = [], 0
    if block:
        yield Automaton(block)


KINDS = "n_words bigint, hit_spans array<struct<start:int,end:int>>, hit_items array<string>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def find_hits(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS, finish: tuple[str, Callable] | None = None) -> DataFrame:
    """All columns of docs (but for clashing ones), and n_words, hit_spans (in words, [start, end))
    and hit_items (sorted as text).

    ``finish``, a schema and a function of texts, word numbers and spans, makes more columns in place of the text. It runs in
    the last pass's workers, as a map of its own would double the workers of an executor.
    """
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c not in ("n_words", "hit_spans", "hit_items")]
    found = blocks(items, item_key, item_text, block_words)
    block, out, first = next(found, None) or Automaton([]), docs.select(*keep), True
    while block is not None:
        shared, block = spark.sparkContext.broadcast(block), next(found, None)
        last = finish if block is None else None

        def make(shared=shared, first=first, last=last):
            automaton = shared.value

            def fn(part):
                col = lambda c: part.column(part.schema.get_field_index(c)).to_pylist()
                old = [([], [])] * part.num_rows if first else zip(col("hit_spans"), col("hit_items"), strict=True)
                n, spans, whose = [], [], []
                for t, (s, i) in zip(col(text), old, strict=True):
                    ws = words(t)
                    s2, i2 = automaton.scan(ws)
                    n.append(len(ws))
                    spans.append(united([*((x["start"], x["end"]) for x in s), *s2]))
                    whose.append(sorted({*i, *(str(x) for x in i2 if x is not None)}))
                more = last[1](col(text), n, spans) if last else {}
                spans = [[{"start": a, "end": b} for a, b in x] for x in spans]
                return {"n_words": pa.array(n, pa.int64()), "hit_spans": pa.array(spans, _SPANS), "hit_items": pa.array(whose, pa.list_(pa.string()))} | more

            return fn

        out = map_slices(out, make, f"{KINDS}, {last[0]}" if last else KINDS, [c for c in keep if not last or c != text], text)
        first = False
        if block is not None:
            out = written(out, "hits")
    return out


def contaminated(n_hit, n_words):
    return (n_hit > 0) & (SHARE * n_hit >= n_words)


def judge(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, n_words, n_hit, n_items, items_sha256, contaminated of each row."""
    hits = find_hits(docs.select(F.col(key).alias("key_"), F.col(text).alias("text")), items)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"]).cast("long"))
    out = hits.select("key_", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"))
    return out.select(F.col("key_").alias(key), "n_words", "n_hit", "n_items", "items_sha256", contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    data = text.encode()
    inside = np.frombuffer(data.translate(_FOLD), np.uint8) != 0x20
    steps = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    begins, ends = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
    out, at = [], 0
    for a, b in spans:
        out.append(data[at : begins[a]])
        at = int(ends[b - 1])
    return b"".join([*out, data[at:]]).decode()


def clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents without the passages that occur in test items, where a document is
    contaminated; one of which no word is left goes. Documents below the limit, without words or with a null text
    stay as they are. Same columns as docs."""
    rows, names = renamed(docs)

    def cleaned(texts: list, n_words: list, spans: list) -> dict:
        made, gone = [], []
        for t, n, own in zip(texts, n_words, spans, strict=True):
            hit = sum(end - start for start, end in own)
            bad = hit and SHARE * hit >= n
            made.append(remove_spans(t, own) if bad else t)
            gone.append(bool(bad and hit == n))
        return {"cleaned_": pa.array(made, pa.string()), "gone_": pa.array(gone, pa.bool_())}

    out = find_hits(rows, items, names[text], finish=("cleaned_ string, gone_ boolean", cleaned))
    return out.where("not gone_").select(*[F.col("cleaned_" if c == text else n).alias(c) for c, n in names.items()])


def op8_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_LIST = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SQL = f"""
with d as (select row_number() over () as r, doc_id, coalesce({_LIST}, []) as w from documents),
b as (select item_id, {_LIST} as w from benchmark),
bw as (select item_id, array_to_string(w[i:i + least({WINDOW}, len(w)) - 1], ' ') as win, least({WINDOW}, len(w)) as n
       from (select item_id, w, unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) as i from b where len(w) > 0)),
ns as (select distinct n from bw),
dw as (select r, n, i, array_to_string(w[i:i + n - 1], ' ') as win from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from d, ns)),
h as (select r, i, dw.n, item_id from dw join bw on dw.n = bw.n and dw.win = bw.win),
hw as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from h) group by r),
hi as (select r, count(*) as n_items, string_agg(s, ',' order by s) as items from (select distinct r, item_id::varchar as s from h where item_id is not null) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and {SHARE} * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hw using (r) left join hi using (r)
"""

QUERIES = {"op8_suffix_automaton": op8_suffix_automaton}
SQL = {"op8_suffix_automaton": _SQL}
