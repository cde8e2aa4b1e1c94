"""URL verdicts by rules and by trust that spreads over the graph of hosts.

Host edges come from the absolute links in the pages: anchors, areas, frames, canonical and other link elements, base
addresses (relative links stay on their host and count as no edge); and each host has an edge to its parent domain, as
sub.example.com is part of example.com. Trust is a personalised PageRank along the links, from the hosts that an
allow rule fits: each host passes DAMPING of its trust on, parted by its links. Distrust runs against the links, from the
hosts that a rule blocks as a whole: a host gets DAMPING times the mean distrust of what it links to. So
many others that link to the same blocked host do not thin it out. Seeds have 1 each. A host needs no page of
its own for that; a link to or from it is enough. A host is blocked if its distrust is at least MIN_DISTRUST and above its
trust. A page's verdict is its rule's, else its host's. Both spread in rounds until no host gets TOLERANCE more in a
round; what further rounds would add to a host's distrust is below DAMPING / (1 - DAMPING) of that.

Everything is DataFrame operations: edges are summed before they are shuffled, each round of
PageRank joins the ranks with the edges by host and is written to the shared folder. Hosts that
hold a large part of the pages are summed up map-side; the last join takes host scores to pages by host,
where Spark splits skewed partitions or broadcasts the scores if they are small.

A null url, or one without "://", has an empty host and path; null html has no links. Rows are kept
one by one, repeated ones and null keys too. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMPING = 0.85
TOLERANCE = 1e-4
MIN_DISTRUST = 0.2
#: A tag ends at the next "<" or ">" at the latest, so that the search is linear.
LINK = r"(?i)<(?:a|area|base|link|frame|iframe)\s[^<>]*?(?:href|src)\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'\s<>]+)"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path as the contract has them: cut by the first "://", no further parsing."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...], take) -> Column:
    """take(rule) of the longest rule that fits; null if none does. One CASE expression, for lists of rules made by hand."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(take(r))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n of the links between different hosts and from hosts to their parent domains; pages: host, html."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("dst"))
    links = links.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where("src <> dst and src <> '' and dst <> ''")
    links = links.groupBy("src", "dst").agg(F.count("*").alias("n"))
    hosts = pages.select("host").distinct().union(links.select("dst")).union(links.select("src")).distinct()
    parents = hosts.select(F.col("host").alias("src"), F.regexp_extract("host", r"^[^.]+\.(.+\..+)$", 1).alias("dst")).where("dst <> ''")
    return links.unionByName(parents.withColumn("n", F.lit(1).cast("long"))).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def spread(shares: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """host, rank: what reaches each host from the seeds (host, one row each, which have 1 each and get nothing).

    shares: src, dst, share: of what src has got in a round, dst gets damping * share in the next one.
    """
    seeds = written(seeds.select("host").distinct(), "rank-seeds")
    ways = written(shares.join(seeds, shares["dst"] == seeds["host"], "left_anti").select("src", "dst", "share"), "rank-shares")
    term = rank = seeds.select("host", F.lit(1.0).alias("rank"))
    while True:
        moved = term.join(ways, term["host"] == ways["src"]).groupBy("dst").agg((damping * F.sum(F.col("rank") * F.col("share"))).alias("rank"))
        term = written(moved.select(F.col("dst").alias("host"), "rank"), "rank-term")
        most = term.agg(F.max("rank")).first()[0]
        if most is None:
            return rank
        rank = written(rank.unionByName(term).groupBy("host").agg(F.sum("rank").alias("rank")), "rank")
        if most < tolerance:
            return rank


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Key, host, path, rule, verdict."""
    host, path = url_parts(F.col(url))
    parts = pages.select(F.col(key).alias("key_"), host.alias("host"), path.alias("path"), F.col(html).alias("html"))
    name, verdict = (rule_of(F.col("host"), F.col("path"), rules, take) for take in (lambda r: r.name, lambda r: r.verdict))
    named = parts.select("key_", "host", "path", name.alias("rule"), verdict.alias("told"))
    whole = rule_of(F.col("host"), F.lit("/"), tuple(r for r in rules if r.path in ("", "/")), lambda r: r.verdict)
    good = written(named.where("host <> '' and told = 'allow'").select("host").distinct(), "url-seeds")
    edges = written(host_edges(parts), "url-edges")
    seen = named.where("host <> ''").select("host").distinct().union(edges.select("src")).union(edges.select("dst"))
    bad_seeds = seen.where(F.coalesce(whole == "block", F.lit(False))).distinct()
    out = edges.groupBy("src").agg(F.sum("n").alias("out_n"))
    shares = written(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("out_n")).alias("share")), "url-shares")
    trust = spread(shares, good)
    distrust = spread(shares.selectExpr("dst as src", "src as dst", "share"), bad_seeds)
    scores = distrust.select("host", F.col("rank").alias("distrust")).join(trust.select("host", F.col("rank").alias("trust")), "host", "left")
    d, t = F.round("distrust", 9), F.round(F.coalesce("trust", F.lit(0.0)), 9)
    bad = scores.where((d >= MIN_DISTRUST) & (d > t)).select("host", F.lit("block").alias("spread"))
    return named.join(bad, "host", "left").select(F.col("key_").alias(key), "host", "path", "rule", F.coalesce("told", "spread", F.lit("allow")).alias("verdict"))


def op10_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _sql() -> str:
    """The same in DuckDB: the rounds are a recursive query, as many as reach the tolerance in any graph."""
    import math

    fits = "(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
    by_length = sorted(RULES, key=lambda r: (-len(r.name), r.name))
    case = lambda take: "case " + " ".join(f"when {fits.format(h=r.host, p=r.path)} then '{take(r)}'" for r in by_length) + " end"
    whole = " or ".join(f"host = '{r.host}' or ends_with(host, '.{r.host}')" for r in RULES if r.path == "/" and r.verdict == "block")
    link = LINK.replace("'", "''")
    rounds = math.ceil(math.log(TOLERANCE) / math.log(DAMPING))
    parts = [
        "cut as (select page_id, html, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) end as rest from pages)",
        "raw as (select page_id, html, rest, regexp_extract(rest, '^[^/?#]*', 0) as h from cut)",
        f"named0 as (select page_id, html, coalesce(translate(h, '{UPPER}', '{LOWER}'), '') as host, coalesce(regexp_extract(substr(rest, length(h) + 1), '^[^?#]*', 0), '') as path from raw)",
        f"named as (select page_id, host, path, html, {case(lambda r: r.name)} as rule, {case(lambda r: r.verdict)} as told from named0)",
        f"links0 as (select host as src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{UPPER}', '{LOWER}') as dst from named)",
        "links as (select src, dst, count(*) as n from links0 where src <> dst and src <> '' and dst <> '' group by src, dst)",
        "hosts as (select host from named where host <> '' union select src from links union select dst from links)",
        r"parents as (select host as src, regexp_extract(host, '^[^.]+\.(.+\..+)$', 1) as dst from hosts)",
        "edges as (select src, dst, sum(n) as n from (select * from links union all select src, dst, 1 from parents where dst <> '') group by src, dst)",
        "shares as (select src, dst, n / sum(n) over (partition by src) as share from edges)",
        "good as (select distinct host from named where host <> '' and told = 'allow')",
        f"bad as (select host from hosts where {whole})",
    ]
    for name, seeds, src, dst in (("trust", "good", "src", "dst"), ("distrust", "bad", "dst", "src")):
        parts += [
            f"{name}_ways as (select {src} as a, {dst} as b, share from shares where {dst} not in (select host from {seeds}))",
            f"{name}_terms as (select 0 as i, host, 1.0::double as rank from {seeds} union all select i + 1, b, sum({DAMPING} * rank * share) from {name}_terms join {name}_ways on host = a where i < {rounds} group by i + 1, b)",
            f"{name} as (select host, sum(rank) as rank from {name}_terms group by host)",
        ]
    parts.append(f"blocked as (select d.host from distrust d left join trust t on d.host = t.host where round(d.rank, 9) >= {MIN_DISTRUST} and round(d.rank, 9) > round(coalesce(t.rank, 0), 9))")
    return "with recursive " + ",\n".join(parts) + "\nselect page_id, host, path, rule, coalesce(told, case when host in (select host from blocked) then 'block' end, 'allow') as verdict from named"


QUERIES = {"op10_link_graph": op10_link_graph}
SQL = {"op10_link_graph": _sql()}
