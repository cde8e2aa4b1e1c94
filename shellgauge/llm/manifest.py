"""A Merkle manifest of a dataset: leaf digests by source, proofs, and what a changed leaf folds to.

Each row is a leaf: SHA-256 of its fields, each as its UTF-8 length, ":" and value, "-" where it is null.
In each group (source) leaves are ordered by key, and runs of ARITY nodes become their parent until one is left;
the groups' roots, ordered by group (null first, bytewise), become one tree in the same way.

Nodes are labelled by the interval of leaf ranks [lo, hi) that they cover. A level's nodes cover ARITY ** level ranks
each (the last of a group fewer), so a node's bucket at a level, lo divided by that width, finds the only
interval of the level that can contain it: ancestors are attached by an equality join on group and bucket with containment as its
condition. A node's siblings are its parent's interval without its own: the children that end at or before lo, and those
that begin at or after hi. Proofs are handed down level by level, so each join has as many rows as the level has nodes;
leaves take part in the last join only.

Ranks within groups are made by range partitions and a window over their sizes, so a group of a third of all rows is dealt
over many tasks (see common.ranked). Texts are hashed in the scan; only digests are shuffled. All of it is DataFrame functions.

Null groups are a group of their own, before all others. Null keys come first and count as the empty text where tampering is
decided. Rows of one key are ordered by digest; repeated rows are leaves each. Columns other than those named are
not read. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, discard, ranked, written

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts: Column) -> Column:
    """SHA-256, as bytes, of the joined hex texts of an array of digests."""
    return F.unhex(F.sha2(F.array_join(F.transform(parts, lambda d: F.lower(F.hex(d))), "").cast("binary"), 256))


def shown(d: Column) -> Column:
    return F.lower(F.hex(d))


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256, as bytes, of a row's fields."""

    def part(c: Column) -> Column:
        c = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*map(part, fields)).cast("binary"), 256))


def _bucket(width: int) -> Column:
    return F.floor(F.col("lo") / F.lit(width)).cast("long")


@dataclass
class Tree:
    """levels[k]: grp, n (leaves of the group), lo, hi, digest, and from level 1 on kids (lo, hi, digest of the children), of every group
    that reaches the level. tops: grp, level, digest of each group's last node."""

    levels: list[DataFrame]
    tops: DataFrame

    @classmethod
    def over(cls, leaves: DataFrame) -> Tree:
        """leaves: grp, n, rank, digest."""
        levels = [leaves.select("grp", "n", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest")]
        most = leaves.agg(F.max("n")).first()[0] or 0
        width = 1
        while width < most:
            run = levels[-1].where(F.col("n") > width).groupBy("grp", "n", _bucket(width * ARITY).alias("run"))
            kids = run.agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "digest"))).alias("kids"))  # at most ARITY
            levels.append(written(kids.select("grp", "n", F.col("kids")[0]["lo"].alias("lo"), F.array_max("kids.hi").alias("hi"), digest(F.col("kids.digest")).alias("digest"), "kids"), "level"))
            width *= ARITY
        last = [d.where(_is_top(k)).select("grp", F.lit(k).alias("level"), "digest") for k, d in enumerate(levels)]
        tops = last[0]
        for d in last[1:]:
            tops = tops.unionByName(d)
        return cls(levels, written(tops, "tops"))

    def proofs(self, of_tops: DataFrame) -> DataFrame:
        """grp, lo, path of every leaf; of_tops: grp, path of the groups' last nodes. A path is an array of (left, right): the digests
        of a node's siblings before and after it, joined, from the node itself up to the root."""
        above = None
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            here = level.where(_is_top(k)).join(of_tops, "grp").select(*level.columns, "path")
            if above is not None:
                here = here.unionByName(_attached(level.where(~_is_top(k)), above, ARITY ** (k + 1)))
            above = here
        return above.select("grp", "lo", "path")


def _is_top(k: int) -> Column:
    return (F.col("n") <= ARITY**k) & (F.lit(k == 0) | (F.col("n") > ARITY ** max(0, k - 1)))


def _attached(nodes: DataFrame, parents: DataFrame, width: int) -> DataFrame:
    """The nodes with their paths: containment in a parent's interval, found by its bucket; siblings by the interval's difference."""
    p = parents.select(F.col("grp").alias("grp_"), _bucket(width).alias("bucket_"), F.col("lo").alias("lo_"), F.col("hi").alias("hi_"), F.col("kids").alias("kids_"), F.col("path").alias("path_"))
    both = nodes.withColumn("bucket_", _bucket(width)).join(p, "bucket_").where("grp = grp_ and lo_ <= lo and hi <= hi_")
    joined = lambda keep: F.unhex(F.array_join(F.transform(F.filter("kids_", keep), lambda x: F.hex(x["digest"])), ""))
    left, right = joined(lambda x: x["hi"] <= F.col("lo")), joined(lambda x: x["lo"] >= F.col("hi"))
    return both.select(*nodes.columns, F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), "path_").alias("path"))


def folded(leaf: Column, path: Column) -> Column:
    """The root, as hex text, that a leaf's digest gives with the siblings of a path."""
    return F.aggregate(path, shown(leaf), lambda d, x: F.sha2(F.concat(shown(x["left"]), d, shown(x["right"])).cast("binary"), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(shown(x["left"]), shown(x["right"]))), "").cast("binary"), 256)


def manifest(df: DataFrame, tampered: dict[str, Column], fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "source") -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root, verified of each row. ``tampered`` replaces fields of the leaf that is folded."""
    changed = leaf_digest([tampered.get(f, F.col(f)) for f in fields])
    # "s" before the name sorts null, as the empty text, before all groups
    rows = df.select(F.coalesce(F.concat(F.lit("s"), F.col(group).cast("string")), F.lit("")).alias("grp"), F.col(key).alias("key"), leaf_digest([F.col(f) for f in fields]).alias("digest"), changed.alias("changed"))
    rows = written(rows, "leaves")
    leaves = written(ranked(rows, "grp", ["key", "digest"]), "ranked")
    discard(rows)
    tree = Tree.over(leaves)
    over = written(ranked(tree.tops.select(F.lit("").alias("grp"), F.col("grp").alias("key"), "digest"), "grp", ["key"]), "ranked")
    upper = Tree.over(over)
    top = upper.tops.first()
    root = F.lit(top["digest"].hex() if top else None).cast("string")
    no_path = F.array().cast("array<struct<left:binary,right:binary>>")
    upper_paths = upper.proofs(upper.tops.select("grp", no_path.alias("path"))).join(over.select("grp", F.col("rank").alias("lo"), "key"), ["grp", "lo"])
    of_groups = written(upper_paths.select(F.col("key").alias("grp"), "path"), "paths")
    paths = tree.proofs(of_groups)
    out = leaves.join(paths.withColumnRenamed("lo", "rank"), ["grp", "rank"]).join(tree.tops.select("grp", F.col("digest").alias("subroot")), "grp")
    out = out.select(
        F.col("key").alias(key), shown(F.col("digest")).alias("leaf"), shown(F.col("subroot")).alias("subroot"), root.alias("root"),
        proof_digest(F.col("path")).alias("proof_sha256"), folded(F.col("changed"), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cut = F.when(crc_mod("doc_id", 2) == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return manifest(docs, {"text": cut})


def _sql() -> str:
    part = lambda c: f"coalesce(octet_length(encode({c}::varchar)) || ':' || {c}::varchar, '-')"
    leaf = "sha256(" + " || ".join(part(c) for c in FIELDS) + ")"
    # DuckDB has no crc32: bits of the ten digits are shifted through one by one
    crc = "with recursive crc(doc_id, i, c) as (select distinct doc_id, 0, 4294967295::bigint from documents union all select doc_id, i + 1, list_reduce(list_prepend(xor(c, case when i < length(coalesce(doc_id::varchar, '')) then ascii(substr(doc_id::varchar, i + 1, 1)) else 0 end::bigint), range(0, 8)), lambda a, b: case when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end) from crc where i < length(coalesce(doc_id::varchar, '')))"
    return f"""
{crc},
even as (select doc_id from crc where i = length(coalesce(doc_id::varchar, '')) and xor(c, 4294967295) % 2 = 0),
changed as (select doc_id, source, lang, n_chars, case when exists (select 1 from even e where e.doc_id is not distinct from documents.doc_id) then replace(text, chr(10), '') else text end as text, {leaf} as leaf from documents),
leaves as materialized (select *, {leaf} as other, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as r, count(*) over (partition by source) as n, coalesce('s' || source, '') as g from changed),
lv(g, k, i, d, n) as (select g, 0, r, leaf, n from leaves union all select g, k + 1, i // {ARITY}, sha256(string_agg(d, '' order by i)), n from lv where n > {ARITY} ** k group by g, k, i // {ARITY}, n),
tops as materialized (select g, d, k, row_number() over (order by g) - 1 as r, count(*) over () as n from lv where n <= {ARITY} ** k and (k = 0 or n > {ARITY} ** (k - 1))),
up(k, i, d, n) as (select 0, r, d, n from tops union all select k + 1, i // {ARITY}, sha256(string_agg(d, '' order by i)), n from up where n > {ARITY} ** k group by k, i // {ARITY}, n),
nodes as materialized (select g, k, i, d from lv union all select null, k, i, d from up),
-- each leaf's own nodes on the way to the root, numbered from the leaf up
way as (select l.g, l.r as leaf_r, k, k as step, floor(l.r / ({ARITY} ** k))::bigint as i, false as upper_ from leaves l, lateral (select unnest(range(0, (select t.k from tops t where t.g = l.g))) as k)
  union all select l.g, l.r, u.k, t.k + u.k, floor(t.r / ({ARITY} ** u.k))::bigint, true from leaves l join tops t on t.g = l.g, lateral (select unnest(range(0, (select max(k) from up))) as k) u),
steps as materialized (select w.g, w.leaf_r, w.step, coalesce(string_agg(x.d, '' order by x.i) filter (x.i < w.i), '') as a, coalesce(string_agg(x.d, '' order by x.i) filter (x.i > w.i), '') as b
  from way w join nodes x on x.k = w.k and x.i // {ARITY} = w.i // {ARITY} and (case when w.upper_ then x.g is null else x.g = w.g end) group by all),
fold(g, leaf_r, step, d) as (select g, r, 0, other from leaves union all select f.g, f.leaf_r, f.step + 1, sha256(s.a || f.d || s.b) from fold f join steps s on s.g = f.g and s.leaf_r = f.leaf_r and s.step = f.step),
proof as (select g, leaf_r, sha256(string_agg(a || b, '' order by step)) as p from steps group by 1, 2),
ends as (select g, leaf_r, arg_max(d, step) as d from fold group by 1, 2)
select doc_id, leaf, t.d as subroot, root, coalesce(p, sha256('')) as proof_sha256, e.d as folded_root, e.d = root as verified
from leaves l join tops t on t.g = l.g join ends e on e.g = l.g and e.leaf_r = l.r left join proof p on p.g = l.g and p.leaf_r = l.r, (select arg_max(d, k) as root from up)
"""


QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
SQL: dict[str, str] = {"op12_merkle_manifest": _sql()}
