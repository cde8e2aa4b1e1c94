"""Near duplicates by Order MinHash and banded alignment.

A text is its lower-cased words between white space, and its shingles are all runs of K words (a text of
fewer words, but not none, is one shingle). Shingles are labelled by their occurrence number, so that repeats count.
Each of BANDS x ROWS hash functions picks the ELL smallest labelled shingles and keeps them in
text order; ROWS such picks make a band key. Two texts are candidates if a band key of theirs
agrees; at similarity 0.8 about one pair in 17000 has none that does, at 0.85 one in four million.

A pair is verified by alignment of the shingle sequences: with M matches in order, its similarity is
M / (n_a + n_b - M), and it has to reach SIMILARITY. At most (n_a + n_b) / 9 shingles may then stay
unmatched, so the alignment is restricted to that band of diagonals; it runs bit-parallel.

No group is ever expanded into pairs. Texts with equal words are one node from the start. In each bucket all members
are verified against its most central one: the node whose buckets hold the most nodes, so that the original of a
group of edited copies leads all of its buckets and each copy is verified about once. The links' connected components
are found; members that are in no earlier leader's component get a leader among themselves, as long as such
rounds link a good part of what they test (MERGING). This is linear in the bucket entries. What is left are pairs of
different components in one bucket, most of them unlike; all of these are looked at in the join itself, and a pair leaves it only if
the labelled shingles that the two texts share, in whatever order, are enough for the similarity. This bound is exact,
so each pair that shares a bucket is verified, excluded by it or already in one component. Components are
found by star contraction over the components of the round before: joins and groupings by node, in rounds that are written to the shared folder.

Null texts are in a class of their own, each; texts without words equal each other. Null keys are
ignored in naming a class (its smallest key). Repeated rows get the same class. Only the key and
the results are returned.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, map_slices, renamed, written

K = 5
ELL, ROWS, BANDS = 2, 3, 32
#: Rounds of leaders go on while one in so many tested pairs is a link; the exact join does the rest.
MERGING = 8
#: Texts of a round's nodes that are broadcast to the pairs, in bytes; more are shuffled.
BROADCAST_TEXT = 32 << 20
#: Pairs that a task looks at for links across components, about, and those of one bucket; a larger bucket's pairs are dealt as a grid.
TASK_PAIRS, BUCKET_PAIRS = 50_000, 100_000
#: Words of 64 bits in the bitmap of a text's labelled shingles.
MARKS = 32
#: Similarity as a fraction.
SIMILARITY = (4, 5)
#: Nodes whose texts are fetched by a broadcast of their keys (about 60 bytes each), else by a shuffle.
BROADCAST_NODES = 400_000

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_seeds = np.random.default_rng(20240229).integers(0, 1 << 31, (2, ROWS * BANDS)).astype(np.uint32) * np.uint32(2) + np.uint32(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M1
    return x ^ (x >> np.uint64(31))


def words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split()


class Sketcher:
    """Order MinHash of texts; remembers hashes of words (at most CACHE)."""

    CACHE = 150_000

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def word_hashes(self, ws: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.CACHE:
            known.clear()
        for w in set(ws):
            if w not in known:
                known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        return np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))

    def labelled(self, ws: list[bytes]) -> np.ndarray:
        """Hashes of the shingles with their occurrence numbers, in text order."""
        h = self.word_hashes(ws)
        n = max(1, len(h) - K + 1)
        s = np.zeros(n, np.uint64)
        for k in range(min(K, len(h))):
            s = (s ^ h[k : k + n]) * _M1
            s ^= s >> np.uint64(29)
        order = np.argsort(s, kind="stable")
        new = np.concatenate([[True], s[order][1:] != s[order][:-1]])
        begin = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        occurrence = np.empty(n, np.uint64)
        occurrence[order] = (np.arange(n) - begin).astype(np.uint64)
        return mix(s + occurrence * _M2)

    def bands(self, ws: list[bytes]) -> np.ndarray:
        """The band keys: each from ROWS hash functions' smallest shingles in text order; none for a text without words."""
        if not ws:
            return np.zeros(0, np.int64)
        s = self.labelled(ws)
        n, r = len(s), ROWS * BANDS
        order = (s >> np.uint64(32)).astype(np.uint32)  # what the hash functions order by; of equal values the first wins
        picks = np.empty(r, np.uint64)
        step = max(1, min(r, (1 << 16) // n))
        for i in range(0, r, step):
            v = (order[None] ^ _seeds[0, i : i + step, None]) * _seeds[1, i : i + step, None]
            at = np.arange(len(v))
            least = np.empty((len(v), min(ELL, n)), np.int64)
            for k in range(least.shape[1]):
                least[:, k] = v.argmin(axis=1)
                v[at, least[:, k]] = np.uint32(0xFFFFFFFF)
            least.sort(axis=1)  # back to text order
            pick = np.zeros(len(v), np.uint64)
            for k in range(least.shape[1]):
                pick = mix(pick * _M1 + s[least[:, k]])
            picks[i : i + step] = pick
        key = np.arange(BANDS, dtype=np.uint64)
        for k in range(ROWS):
            key = mix(key * _M1 + picks[k::ROWS])
        return key.view(np.int64)


def shingles(ws: list[bytes]) -> list[tuple]:
    return list(zip(*(ws[k:] for k in range(K)), strict=False)) if len(ws) >= K else [tuple(ws)] if ws else []


def needed(na: int, nb: int) -> int:
    """Matches that a pair needs at least: M / (na + nb - M) >= p / q."""
    p, q = SIMILARITY
    return -(-p * (na + nb) // (p + q))


def matches(a: list, b: list, slack: int) -> int:
    """Longest common subsequence of two sequences within the diagonals -slack to slack, bit-parallel.

    Bit i of ``row`` is 0 where the best alignment so far gains at a[i]. Only the bits of the band are held:
    those below it have settled (their zeros are counted as they leave), those above it are untouched ones.
    """
    head = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not a or not b:
        return head + tail
    where: dict = {}
    for i, x in enumerate(a):
        where.setdefault(x, []).append(i)
    width = 2 * slack + 1
    full = (1 << width) - 1
    row, gained = full, 0
    for j, y in enumerate(b):
        base = j - slack  # a's index of the lowest bit
        if j:
            gained += not row & 1
            row = (row >> 1) | (1 << (width - 1))
        at = where.get(y)
        if at:
            mask = 0
            for i in at[bisect_left(at, base) : bisect_left(at, base + width)]:
                mask |= 1 << (i - base)
            hit = row & mask
            row = ((row + hit) | (row - hit)) & full
    return head + tail + gained + width - row.bit_count()


def similar(a: list, b: list) -> bool:
    need = needed(len(a), len(b))
    if need > min(len(a), len(b)):
        return False
    return matches(a, b, len(a) + len(b) - 2 * need) >= need


def signatures(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, node (digest of the words; null for a null text), n (shingles) and band keys of each row."""

    def make():
        sketcher = Sketcher()

        def fn(part):
            nodes, sizes, bands = [], [], []
            for t in part.column(part.schema.get_field_index("text_")).to_pylist():
                ws = words(t or "")
                nodes.append(None if t is None else hashlib.md5(b" ".join(ws)).digest())
                sizes.append(max(1, len(ws) - K + 1) if ws else 0)
                bands.append([] if t is None else sketcher.bands(ws))
            return {"node": pa.array(nodes, pa.binary()), "n": pa.array(sizes, pa.int64()), "bands": pa.array(bands, pa.list_(pa.int64()))}

        return fn

    return map_slices(df.select(F.col(key).alias("key_"), F.col(text).alias("text_")), make, "node binary, n bigint, bands array<bigint>", ["key_"], "text_")


def compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b and ok (whether similar) of pairs of nodes with texts (node, text)."""
    if (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= BROADCAST_TEXT:
        texts = F.broadcast(texts)
    one = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = one.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")

    def make():
        last: list = [None, None, None]

        def parsed(t: str) -> tuple[list, Counter]:
            if last[0] != t:
                last[0], last[1] = t, shingles(words(t))
                last[2] = Counter(last[1])
            return last[1], last[2]

        def alike(x: str, y: str) -> bool:
            (sy, cy), sx = parsed(y), shingles(words(x))
            # shingles in common, in whatever order, bound the matches from above
            common = sum(min(k, cy[v]) for v, k in Counter(sx).items() if v in cy)
            return common >= needed(len(sx), len(sy)) and similar(sx, sy)

        def fn(part):
            col = lambda c: part.column(part.schema.get_field_index(c)).to_pylist()
            return {"ok": pa.array([alike(x, y) for x, y in zip(col("text_a"), col("text_b"), strict=True)], pa.bool_())}

        return fn

    return map_slices(both.select("a", "b", "text_a", "text_b"), make, "ok boolean", ["a", "b"], "text_a", 1 << 20)


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of all nodes of some edges (a, b): star contraction."""
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        # large star: each node's larger neighbours move to its smallest neighbour
        both = edges.union(edges.selectExpr("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").selectExpr("v as u", "m as v").union(edges.groupBy("u").agg(F.min("v").alias("v"))).distinct()
        # small star: each node's smaller neighbours move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        last, edges = edges, written(joined.where("v > m").selectExpr("v as u", "m as v").union(least.selectExpr("u", "m as v")).distinct(), "links")
        discard(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == now:
            return edges.selectExpr("u as node", "v as root")
        before = now


def classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and class_id (the smallest key of the row's class) of each row, and n_in_class."""
    rows = written(signatures(df, key, text), "sketches")
    known = rows.where("node is not null")
    nodes = written(known.groupBy("node").agg(F.min("key_").alias("key_"), F.count("*").alias("rows"), F.first("n").alias("n"), F.first("bands").alias("bands")), "nodes")
    slim = written(rows.select("key_", "node"), "keys")
    discard(rows)
    members = _members(nodes)
    sizes = written(nodes.drop("bands"), "nodes")
    discard(nodes)
    rows, nodes = slim, sizes
    roots = _linked(df, key, text, nodes, members)
    named = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "key_", "rows")
    of_root = named.groupBy("root").agg(F.min("key_").alias("class_id"), F.sum("rows").alias("n_in_class"))
    class_of = written(named.join(of_root, "root").select("node", "class_id", "n_in_class"), "classes")
    discard(nodes, roots, members)
    out = rows.select("key_", "node").join(class_of, "node", "left")
    return out.select(F.col("key_").alias(key), F.when(F.col("node").isNull(), F.col("key_")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_in_class", F.lit(1)).cast("long").alias("n_in_class"))


def _members(nodes: DataFrame) -> DataFrame:
    """bucket, node, n, weight (nodes in all buckets of the node) of all nodes that share a bucket with another."""
    # one exchange serves the count and the join; it's the widest of the job, and most buckets have one node
    buckets = nodes.select("node", F.explode("bands").alias("bucket")).repartition("bucket")
    shared = buckets.groupBy("bucket").agg(F.count("node").alias("size")).where("size > 1")
    members = written(buckets.join(shared, "bucket"), "members")
    central = members.groupBy("node").agg(F.sum("size").alias("weight"))
    out = written(members.join(central, "node").join(nodes.select("node", "n"), "node").select("bucket", "node", "n", "weight"), "members")
    discard(members)
    return out


def _linked(df: DataFrame, key: str, text: str, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """node, root of all nodes that share a bucket with another."""
    roots = members.select("node", F.col("node").alias("root")).distinct()
    led = None  # bucket, leader, round of the rounds so far
    while True:
        placed, n_round = members.join(roots, "node"), 0
        if led is not None:
            # what the leaders so far lead, in each bucket: at most one component a round
            n_round = led.agg(F.max("round")).first()[0] + 1
            of_leaders = led.join(roots, led["leader"] == roots["node"]).groupBy("bucket").agg(F.collect_set("root").alias("done"))
            placed = placed.join(of_leaders, "bucket").where(~F.array_contains("done", F.col("root"))).drop("done")
        placed = written(placed, "placed")
        leaders = placed.groupBy("bucket").agg(F.max(F.struct("weight", "node", "n", "root")).alias("l"), F.count("*").alias("size")).where("size > 1")
        leaders = leaders.select("bucket", F.col("l.node").alias("leader"), F.col("l.n").alias("n_b"), F.col("l.root").alias("root_b"))
        pairs = placed.join(leaders, "bucket").where(F.col("root") != F.col("root_b")).where(_like_sizes("n", "n_b"))
        pairs = written(pairs.select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct(), "pairs")
        tested = pairs.count()
        links = 0
        if tested:
            leaders = leaders.select("bucket", "leader", F.lit(n_round).alias("round"))
            last, led = led, written(leaders if led is None else led.unionByName(leaders), "leaders")
            if last is not None:
                discard(last)
            found = _verified(df, key, text, nodes, pairs)
            links = found.count()
            if links:
                last, roots = roots, _merged(roots, found)
                discard(last)
            discard(found)
        discard(placed, pairs)
        if links * MERGING < tested or not tested:
            break
    if led is None:
        return roots
    pairs = _across(df, key, text, nodes, members, led.where("round = 0"), roots)
    if pairs is None or pairs.isEmpty():
        return roots
    last, found = roots, _verified(df, key, text, nodes, pairs)
    roots = _merged(roots, found)
    discard(last, found, pairs, led)
    return roots


def _verified(df: DataFrame, key: str, text: str, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links."""
    texts = node_texts(df, key, text, nodes, pairs)
    out = written(compared(pairs, texts).where("ok").select("a", "b"), "links")
    discard(texts)
    return out


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """node, root after more links: components of the components."""
    ends = links.join(roots.selectExpr("node as a", "root as root_a"), "a").join(roots.selectExpr("node as b", "root as root_b"), "b").where("root_a <> root_b")
    new = components(ends.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    new = new.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return written(roots.join(new, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")


def _like_sizes(a: str, b: str):
    """Whether two sizes allow the similarity: its largest value is that of a text within the other."""
    p, q = SIMILARITY
    return F.least(a, b) * q >= F.greatest(a, b) * p


def _across(df: DataFrame, key: str, text: str, nodes: DataFrame, members: DataFrame, led: DataFrame, roots: DataFrame) -> DataFrame | None:
    """Pairs (a, b) of different components in a bucket, each made in the first bucket that both share, if sizes and
    common labelled shingles allow the similarity. In a bucket, the members outside its first leader's component meet all others."""
    p, q = SIMILARITY
    main = led.join(roots, led["leader"] == roots["node"]).select("bucket", F.col("root").alias("main"))
    placed = written(members.join(roots, "node").join(main, "bucket").select("bucket", "node", "n", "root", (F.col("root") != F.col("main")).alias("outside")), "placed")
    work = placed.groupBy("bucket").agg((F.count_if("outside") * F.count("*")).alias("work")).where("work > 0").selectExpr("bucket", "work", f"ceil(sqrt(work / {BUCKET_PAIRS})) as grid")
    mixed = written(placed.join(work, "bucket"), "mixed")
    total = work.agg(F.sum("work")).first()[0]
    if not total:
        return None
    tasks = -(-int(total) // TASK_PAIRS)
    texts = node_texts(df, key, text, nodes, mixed.selectExpr("node as a", "node as b"))
    of_node = written(mixed.groupBy("node").agg(F.collect_set("bucket").alias("buckets")).join(_bags(texts), "node"), "bags")
    discard(placed, texts)
    in_buckets = mixed
    mixed = mixed.join(of_node, "node")
    own = lambda side: [f"{c} as {c}_{side}" for c in ("n", "root", "buckets", "bag", "marks")]
    left = mixed.where("outside").selectExpr("bucket", "pmod(xxhash64(node), grid) as row", "explode(sequence(0L, grid - 1L)) as col", "node as a", *own("a"))
    right = mixed.selectExpr("bucket", "pmod(xxhash64(node), grid) as col", "explode(sequence(0L, grid - 1L)) as row", "node as b", "outside as outside_b", *own("b"))
    once = F.expr("root_a <> root_b and (not outside_b or a > b)") & _like_sizes("n_a", "n_b")
    # the alignment's matches are at most the labelled shingles in common, see needed(); each bit that one text's bitmap
    # has and the other's lacks stands for at least one that is not in common
    not_in = "aggregate(zip_with(marks_a, marks_b, (x, y) -> bit_count(x & ~y)), 0, (s, x) -> s + x)"
    enough = F.expr(f"(n_a - {not_in}) * {p + q} >= (n_a + n_b) * {p} and array_min(array_intersect(buckets_a, buckets_b)) = bucket and size(array_intersect(bag_a, bag_b)) * {p + q} >= (n_a + n_b) * {p}")
    left, right = (side.repartition(tasks, "bucket", "row", "col") for side in (left, right))  # by work, as bytes say little about it
    out = written(left.join(right, ["bucket", "row", "col"]).where(once & enough).select("a", "b").distinct(), "pairs")
    discard(in_buckets, of_node)
    return out


def marks(bag: np.ndarray) -> np.ndarray:
    """A bitmap of hashes, MARKS words of 64 bits."""
    bits = np.zeros(64 * MARKS, bool)
    bits[(bag >> np.uint64(20)) % np.uint64(64 * MARKS)] = True
    return np.packbits(bits).view(np.int64)


def _bags(texts: DataFrame) -> DataFrame:
    """node, bag (hashes of its labelled shingles, all different) and marks."""

    def make():
        sketcher = Sketcher()

        def fn(part):
            bags = [sketcher.labelled(words(t)) for t in part.column(part.schema.get_field_index("text")).to_pylist()]
            return {"bag": pa.array([x.view(np.int64) for x in bags], pa.list_(pa.int64())), "marks": pa.array([marks(x) for x in bags], pa.list_(pa.int64()))}

        return fn

    return map_slices(texts, make, "bag array<bigint>, marks array<bigint>", ["node"])


def node_texts(df: DataFrame, key: str, text: str, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """node, text of the nodes in some pairs: the texts of their smallest keys, told apart by the words' digest."""
    inside = written(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "node").join(nodes.select("node", "key_"), "node"), "inside")
    small = inside.count() <= BROADCAST_NODES
    docs = df.select(F.col(key).alias("key_"), F.col(text).alias("text"))
    side = F.broadcast(inside) if small else inside
    found = docs.join(side, docs["key_"].eqNullSafe(side["key_"])).select("node", "text")

    def make():
        def fn(part):
            col = lambda c: part.column(part.schema.get_field_index(c)).to_pylist()
            return {"mine": pa.array([t is not None and hashlib.md5(b" ".join(words(t))).digest() == n for n, t in zip(col("node"), col("text"), strict=True)], pa.bool_())}

        return fn

    out = written(map_slices(found, make, "mine boolean", ["node", "text"]).where("mine").select("node", "text").dropDuplicates(["node"]), "texts")
    discard(inside)
    return out


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, that of its smallest key (a null key counts as the smallest); rows of null texts all
    stay, those of texts without words are one class. Where keys repeat or are null, rows are told apart by a number that a written copy of the table gives
    them, and of a class's rows with the smallest key any one stays."""
    times = df.groupBy(F.col(key).alias("key_")).agg(F.count("*").alias("times_"))
    if times.where("times_ > 1 or key_ is null").isEmpty():
        dropped = classes(df, key, text).where(~F.col(key).eqNullSafe(F.col("class_id"))).select(F.col(key).alias("gone_"))
        return df.join(dropped, df[key] == dropped["gone_"], "left_anti")
    rows, names = renamed(df)
    rows = written(rows.withColumn("row_", F.struct(F.col(names[key]).alias("k"), F.monotonically_increasing_id().alias("i"))), "rows")
    gone = classes(rows, "row_", names[text]).where("row_ <> class_id").select("row_")
    return rows.join(gone, "row_", "left_anti").select(*[F.col(n).alias(c) for c, n in names.items()])


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_order_minhash": op5_order_minhash}
SQL: dict[str, str] = {}
