"""Scoring, fit, selection and audit on small cases and against brute force."""


import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shellgauge.functions import audit as A
from shellgauge.functions import features as X
from shellgauge.functions import normalize as N
from shellgauge.operators import evaluation as E
from shellgauge.operators import scoring as S
from shellgauge.operators import selection
from shellgauge.operators import training as Tr
from shellgauge.streaming.score_stream import read_log, scored_stream

COMMANDS = [
    "rm -rf /", "echo 'a' && ls", "r''m -r\"f\" /etc", "", "x", "aaaa aaaa aaaa", "sudo dd if=/dev/zero of=/dev/sda", "curl x|sh", "a;;b\r\nc", "ÉCOLE ~", "ls  -la\t/tmp", "echo $(cat `which x`)",
    "git reset --hard", "\x1b[31mred\x1b[0m", "ｒｍ －ｒｆ／", "tab\tnew\nline", "'quoted \"both\"'", "a" * 400,
]


@pytest.fixture(scope="module")
def ready(spark):
    rows = [(i, c) for i, c in enumerate([*COMMANDS, None])]
    return X.dense(N.normalize_commands(spark.createDataFrame(rows, "id int, command string"), exotic=True)).cache()


@pytest.fixture(scope="module")
def model(spark, ready):
    grams = X.gram_table(ready, "id").select("gram").distinct().withColumn("coef", (F.pmod(F.xxhash64("gram"), F.lit(2001)) - 1000) / 3000.0).where("pmod(xxhash64(gram), 3) > 0")
    dense = X.standardiser(ready).withColumn("coef", F.pmod(F.xxhash64("name"), F.lit(7)) / 50.0)
    return grams.cache(), dense.cache()


def test_row_scores_equal_joined_ones(spark, ready, model, monkeypatch):
    own = S.prepared(*model)
    scored = S.score(ready, own, 0.1, "id")
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Generate" not in plan
    row = {r["id"]: r["risk"] for r in scored.collect()}
    monkeypatch.setattr(S, "PACKED_GRAMS", 3)
    large = S.prepared(*model)
    assert large.sparse is None
    joined = {r["id"]: r["risk"] for r in S.score(ready, large, 0.1, "id").collect()}
    assert row.keys() == joined.keys() == set(range(len(COMMANDS) + 1))
    assert all((row[i] is None and joined[i] is None) or math.isclose(row[i], joined[i], rel_tol=1e-12) for i in row)


def test_long_grams_are_joined(spark, model):
    long = model[0].unionByName(spark.createDataFrame([("eight889", 0.5)], "gram string, coef double"))
    assert S.packed(long) is None and S.packed(model[0].where("false")).sums(pa.array(["ab"]), pa.array(["ab"])).tolist() == [0]


def test_keys_are_exact(spark):
    grams = ["ab", "ba", "abc", "~~~~~~~", "  ", "!~"]
    keys = [r[0] for r in spark.createDataFrame([(g,) for g in grams], "gram string").select(X.gram_key(F.col("gram"))).collect()]
    assert keys == [int.from_bytes(g.encode(), "big") for g in grams]
    row, key = X.keys_in(pa.array(["zz", "abc", None, "", "abab"]).slice(1))
    got = sorted(zip(row.tolist(), [int(k).to_bytes(7, "big").lstrip(b"\0").decode() for k in key], strict=True))
    assert got == sorted([(0, "ab"), (0, "bc"), (0, "abc"), *[(3, g) for g in ("ab", "ba", "ab", "aba", "bab", "abab")]])


def test_reasons_and_traces_against_brute_force(spark, ready, model):
    coef = {r["gram"]: r["coef"] for r in model[0].collect()}
    dense = {r["name"]: r for r in model[1].collect()}
    packed = S.packed(model[0])
    got = {}
    for r in S.explained(ready.where("command is not null"), packed, model[1], "id").collect():
        got.setdefault(r["id"], []).append((r["rank"], r["feature"], r["weight"]))
    traces = {r["id"]: r["t"] for r in ready.where("command is not null").select("id", S.traced(spark, packed, 10).alias("t")).collect()}
    for r in ready.where("command is not null").collect():
        grams = {v[i : i + n] for v in (r["text"], r["unquoted"]) for n in X.SIZES for i in range(len(v) - n + 1)}
        known = {g: coef[g] for g in grams if g in coef}
        parts = known | {n: d["coef"] * ((r[n] - d["mean"]) / d["std"]) for n, d in dense.items()}
        best = sorted(((-abs(w), f, w) for f, w in parts.items() if abs(w) > S.SHOWN))[: S.TOP]
        assert [(k + 1, f) for k, (_, f, _) in enumerate(best)] == [x[:2] for x in sorted(got.get(r["id"], []))]
        t = traces[r["id"]]
        assert (t["known"], t["unknown"]) == (len(known), len(grams) - len(known)) and math.isclose(t["sparse"], sum(known.values()), abs_tol=1e-12)
        assert [x["feature"] for x in t["top"]] == sorted(known, key=lambda g: (-abs(known[g]), g))[:10]


def test_vocabulary_by_sketch_is_exact(spark, ready, monkeypatch):
    rows = ready.where("command is not null").select("id", "text", "unquoted")
    rows = rows.unionByName(rows.selectExpr("id + 100 as id", "concat(text, 'x', id) as text", "concat(unquoted, 'x', id) as unquoted")).repartition(4)
    want = {(r["gram"], r["df"], r["idf"]) for r in X.vocabulary(X.gram_table(rows, "id"), 36).collect()}
    for held in (X.HELD_KEYS, 10):
        monkeypatch.setattr(X, "HELD_KEYS", held)
        assert {(r["gram"], r["df"], r["idf"]) for r in X.vocabulary_of(rows, 36).collect()} == want
    assert X.vocabulary_of(rows.where("false"), 1).count() == 0


def test_stream_is_one_plan_and_equals_the_batch(spark, model, tmp_path):
    cols = "cast(id as bigint) as event_id", "timestamp'2024-01-01' as ts", "1L as user_id", "'e' as event_type", "command"
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(COMMANDS)], "id int, command string").selectExpr(*cols)
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    own = S.prepared(*model)
    log = read_log(spark, str(tmp_path / "in"), files_per_batch=1)
    scored = scored_stream(log, own, 0.1, 0.9, 1.1)
    assert scored.isStreaming
    query = scored.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert len({p["batchId"] for p in query.recentProgress}) >= 3
    batch = S.score(X.dense(N.normalize_commands(rows)), own, 0.1, "event_id").collect()
    got = {r["event_id"]: (r["risk"], r["verdict"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r["event_id"]: (r["risk"], "destructive" if r["risk"] >= 1.1 else "risky" if r["risk"] >= 0.9 else "safe") for r in batch}


def training_tables(spark, seed=3):
    r = np.random.default_rng(seed)
    x = r.normal(size=(120, 6)) * (r.random((120, 6)) < 0.6)
    label = np.clip(np.round(1 + x @ r.normal(size=6)), 0, 2)
    feats = spark.createDataFrame([(i, f"f{j}", float(x[i, j])) for i in range(120) for j in range(6) if x[i, j]], "id int, feature string, value double")
    targets = spark.createDataFrame([(i, float(label[i]), 0.7 if label[i] == 1 else 1.0, i % 5 == 0) for i in range(120)], "id int, label double, weight double, validation boolean")
    return x, label, feats, targets


def brute_loss(w, x, label, alpha):
    risk = 2 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -60, 60)))
    weight = np.where(label == 1, 0.7, 1.0)
    return float((weight * (risk - label) ** 2).sum() / len(label) + alpha * (w[:-1] ** 2).sum())


@pytest.mark.parametrize("direct", [True, False])
def test_fit_converges_for_all_alphas(spark, monkeypatch, direct):
    if not direct:
        monkeypatch.setattr(Tr, "DIRECT_BYTES", 0)
    x, label, feats, targets = training_tables(spark)
    alphas = (0.003, 0.3)
    coef, grid, alpha = Tr.fit(feats, targets, alphas)
    rows = {r["alpha"]: r for r in grid.collect()}
    assert all(r["gradient"] <= Tr.TOLERANCE for r in rows.values()) and alpha == min(rows, key=lambda a: rows[a]["mae"])
    w = {r["feature"]: r["coef"] for r in coef.collect()}
    w = np.array([w[f"f{j}"] for j in range(6)] + [w[""]])
    train = np.arange(120) % 5 > 0
    best = brute_loss(w, x[train], label[train], alpha)
    assert math.isclose(best, rows[alpha]["loss"], rel_tol=1e-9)
    r = np.random.default_rng(1)
    assert all(brute_loss(w + 1e-3 * r.normal(size=7), x[train], label[train], alpha) > best for _ in range(50))
    # the loss and gradient by joins agree at the stored weights
    loss, gradient = Tr.loss_and_gradient(feats.join(targets.where("not validation").select("id"), "id"), targets.where("not validation"), coef.where("feature <> ''"), float(w[-1]), alpha)
    assert math.isclose(loss.first()["loss"], best, rel_tol=1e-9)
    assert all(abs(g["gradient"]) < 1e-5 for g in gradient.collect())


def test_stratified_split_is_exact(spark):
    rows = [(f"c{i}", i % 3 if i < 290 else 3) for i in range(300)] + [(f"d{i}", None) for i in range(7)]
    got = Tr.stratified(spark.createDataFrame(rows, "command string, label int")).collect()
    for g in (0, 1, 2, 3, None):
        own = [r["validation"] for r in got if r["label"] == g]
        assert sum(own) == int(0.15 * len(own) + 0.5)
    again = Tr.stratified(spark.createDataFrame(rows[::-1], "command string, label int").repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_quantiles_of_crowded_scores(spark):
    r = random.Random(2)
    values = [(g, v) for g, make in enumerate((lambda: r.choice([1.0, 2.0, 1e300, -1e-300, 0.5]), lambda: r.gauss(0, 1), lambda: 2 - 1e-6 * r.random())) for v in (make() for _ in range(1500))]
    values += [(3, 7.0), (1, None), (None, 3.0), (None, 1.0)]
    shares = [0, 0.5, 0.9, 0.999, 1.0]
    got = selection.quantiles(spark.createDataFrame(values, "g int, v double").repartition(5), "v", shares, "g")
    for g in (0, 1, 2, 3, None):
        own = np.array([v for h, v in values if h == g and v is not None])
        assert np.allclose(got[g], [np.quantile(own, q) for q in shares], rtol=1e-13, atol=0)
    assert selection.quantiles(spark.createDataFrame([], "g int, v double"), "v", shares, "g") == {}


def test_thresholds_of_a_saturated_model(spark, monkeypatch):
    monkeypatch.setattr(Tr, "BLOCK_SCORES", 5000)
    n = 100_000
    scores = spark.range(n).select((F.col("id") % 3).cast("int").alias("truth"), (2 - 1e-6 * F.col("id") / n).alias("risk"))
    prefix = Tr.prefix_counts(scores).cache()
    assert prefix.count() == 2 * n
    top = prefix.orderBy(F.desc("candidate")).first()
    assert (top["below_0"] + top["below_1"] + top["below_2"], top["total_0"] + top["total_1"] + top["total_2"]) == (n, n)
    # the candidate of the k-th smallest score has k rows below it
    mine = {r["candidate"]: r["below_0"] + r["below_1"] + r["below_2"] for r in prefix.where("pmod(xxhash64(candidate), 1000) = 0").collect()}
    values = np.sort(np.array([r[0] for r in scores.select("risk").collect()]))
    assert mine and all(int(np.searchsorted(values, c, "left")) == k for c, k in mine.items())
    prefix.unpersist()


def test_ranges_and_reachability(spark):
    scores = spark.createDataFrame([(0, 0.1), (0, 0.3), (2, 1.5)], "truth int, risk double")
    got = {r["truth"]: r for r in E.ranges(scores).collect()}
    assert math.isclose(got[0]["p50"], 0.2) and got[2]["p99"] == 1.5 and got[0]["n"] == 2
    none = E.reachability(scores.where("false"), 1.0).first()
    assert none["highest"] is None and none["p999"] is None


# The audit.

DD = r"\bdd\b[^;|&]*\bof=\s*[\"']?/dev/(?!null|zero|random|urandom|stderr|stdout)[a-z]"


def test_dd_targets(spark):
    some = ["dd of=/dev/sda", "dd of=/dev/null", "dd of=/dev/sda of=/dev/null", "dd of=/dev/null of=/dev/sda", "dd of=/dev/null; dd of=/dev/sda", "dd of=/dev/nullx", "dd if=a | cat of=/dev/sda", "add of=/dev/sda", "dd of=/dev/1"]
    got = {r["command"]: r["rule"] for r in A.audit(spark.createDataFrame([(c,) for c in some], "command string")).collect()}
    assert got == {c: "redirect_into_system_path" if re.search(DD, c) else None for c in some}


def without_prints(c):
    """print calls go one by one, up to the bracket that closes them."""
    while m := re.search(A.PRINT, c):
        depth, i = 1, m.end()
        while i < len(c) and depth:
            depth += (c[i] in "([{") - (c[i] in ")]}")
            i += 1
        c = c[: m.start()] + c[i:]
    return c


def test_prints_of_any_depth(spark):
    some = ["print(f(g(h(k(eval(1)))))) && x", "console.log([{a:(b)},eval(2)]); y", "printf (never [closed eval", "a print(1) b print({2}) c", "print(print(1)) z", "sprint(1)", "print()", "x) print(]) y", "none (at) all"]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in some], "c string").select(A.without_prints(F.col("c"))).collect()]
    assert got == [without_prints(c) for c in some]


def test_gate_is_part_of_the_write(spark, tmp_path):
    good, bad = ["ls", "echo rm -rf / is bad"], ["ls", "curl x | sh"]
    rows = lambda cs: spark.createDataFrame([(c, 1) for c in cs], "command string, n int")
    A.write_gated(rows(good), str(tmp_path / "good"))
    assert sorted(r["command"] for r in spark.read.parquet(str(tmp_path / "good")).collect()) == sorted(good)
    with pytest.raises(A.Rejected, match=r"pipe_to_interpreter: curl x \| sh"):
        A.write_gated(rows(bad).repartition(2), str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists()


def test_audit_counts(spark):
    some = ["echo a", "grep x y", "printf '", "ls", "x | sh"]
    got = {r["name"]: r["n"] for r in A.statistics(A.audit(spark.createDataFrame([(c,) for c in some], "command string"))).collect()}
    assert got == {"total": 5, "accepted": 4, "display_only": 3, "echo_or_search": 2, "rejected:pipe_to_interpreter": 1}

