"""Order statistics of large groups by refined histograms.

A value of given rank is closed in by counting: rows between a lower and an upper bound are counted in BUCKETS steps, the step that
holds the rank becomes the next pair of bounds (its own least and largest values), until both are equal. Each round is one
partial aggregation of at most BUCKETS rows for each wanted rank, so no task and no sort ever holds a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 2048


def order_statistics(df: DataFrame, value: str, ranks: dict[object, list[int]], group: str | None = None) -> dict[tuple[object, int], float]:
    """(group, rank) -> the value of that rank, from 0, among the group's values in order; nulls are no values.

    ``ranks`` has the few groups and ranks that are wanted (group None: all rows); ranks have to exist.
    """
    rows = df.where(F.col(value).isNotNull()).select((F.col(group) if group else F.lit(None).cast("int")).alias("g"), F.col(value).cast("double").alias("v"))
    kind = rows.schema["g"].dataType.simpleString()
    ends = {r["g"]: (r["lo"], r["hi"]) for r in rows.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
    # (lowest, highest value, rank within these bounds) of each wanted rank that isn't settled
    open_ = {(g, k): (*ends[g], k) for g, ks in ranks.items() for k in set(ks)}
    found: dict[tuple[object, int], float] = {}
    while True:
        found |= {key: lo for key, (lo, hi, _) in open_.items() if lo == hi}
        open_ = {key: b for key, b in open_.items() if key not in found}
        if not open_:
            return found
        spans = sorted({(key[0], lo, hi) for key, (lo, hi, _) in open_.items()}, key=str)
        table = rows.sparkSession.createDataFrame([(g, lo, hi, i) for i, (g, lo, hi) in enumerate(spans)], f"g_ {kind}, lo double, hi double, span int")
        inside = rows.join(F.broadcast(table), F.col("g").eqNullSafe(F.col("g_")) & F.col("v").between(F.col("lo"), F.col("hi")))
        # halves keep the difference of two large bounds finite; the step grows with the value, so steps are in order
        step = F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BUCKETS), F.lit(BUCKETS - 1))
        steps = inside.groupBy("span", step.alias("step")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        by_span: dict[int, list] = {}
        for r in sorted(steps, key=lambda r: (r["span"], r["step"])):
            by_span.setdefault(r["span"], []).append(r)
        place = {s: by_span[i] for i, s in enumerate(spans)}
        for key, (lo, hi, k) in open_.items():
            for r in place[key[0], lo, hi]:
                if k < r["n"]:
                    open_[key] = (r["lo"], r["hi"], k)
                    break
                k -= r["n"]


def quantiles(df: DataFrame, value: str, shares: list[float], group: str | None = None) -> dict[object, list[float]]:
    """Each group's quantiles, linear between neighbouring values, of the groups that have values."""
    known = df.where(F.col(value).isNotNull())
    sizes = {r["g"]: r["n"] for r in known.groupBy((F.col(group) if group else F.lit(None).cast("int")).alias("g")).agg(F.count("*").alias("n")).collect()}
    at = lambda n, q: divmod(q * (n - 1), 1)
    ranks = {g: [min(n - 1, int(at(n, q)[0]) + k) for q in shares for k in (0, 1)] for g, n in sizes.items()}
    values = order_statistics(known, value, ranks, group)
    out = {}
    for g, n in sizes.items():
        two = [(values[g, ranks[g][2 * i]], values[g, ranks[g][2 * i + 1]], at(n, q)[1]) for i, q in enumerate(shares)]
        out[g] = [a + (b - a) * part for a, b, part in two]
    return out
