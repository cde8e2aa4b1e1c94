"""Findings of round 3: work in one piece, and work that is repeated for each use."""

from __future__ import annotations

from pyspark.sql import functions as F

from shellgauge.functions import normalize as N
from shellgauge.functions import transforms as T
from shellgauge.sources import tables

COMMANDS = ["rm -rf /tmp/x 'a b' && echo \"done\"", "ls -l", "x", "", "sudo dd if=/dev/zero of=/dev/sda", "git push -f\torigin; true", "a\tb\x02c"]


def commands(spark):
    return spark.createDataFrame([(i, c) for i, c in enumerate(COMMANDS)], "id int, command string")


def test_splits_without_rows_are_no_tasks(spark, tmp_path):
    spark.range(240_000).withColumn("x", F.sha2(F.col("id").cast("string"), 256)).coalesce(1).write.option("parquet.block.size", 1 << 30).parquet(str(tmp_path / "t"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 20)
    try:
        scan = spark.read.parquet(str(tmp_path / "t"))
        assert scan.rdd.getNumPartitions() >= 4  # all but one have no rows
        held = [r["n"] for r in tables.dealt(scan).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sum(held) == 240_000 and max(held) <= 60_000


def test_each_variant_is_computed_once(spark):
    made = T.variants(commands(spark), T.HOLDOUT)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("| base64 -d | sh") == 1
    got = {(r["id"], r["family"]): r["variant"] for r in made.collect()}
    assert got[0, "zero_width"] == "rm -rf /tm​p/x 'a b' && echo \"done\"" and got[1, "hex_escape"] == "$'\\x6c\\x73' -l"
    assert (3, "zero_width") not in got and (2, "hex_escape") not in got
    same = {"one": lambda c: F.upper(c), "two": lambda c: F.upper(c), "three": lambda c: c, "four": lambda c: F.lit(None).cast("string")}
    assert {(r["id"], r["family"]) for r in T.variants(commands(spark), same).collect()} == {(i, "one") for i, c in enumerate(COMMANDS) if c.upper() != c}


def test_normalised_text_looks_no_character_up(spark):
    out = N.normalize_commands(commands(spark)).withColumn("other", N.exact("command"))
    assert out.where("not (text <=> other.text and unquoted <=> other.unquoted and segments <=> other.segments)").isEmpty()
    plan = out.select("text", "unquoted")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") <= 1  # that of characters beyond ASCII


def test_packed_gram_sets_equal_the_columns(spark):
    from shellgauge.functions import features as X

    rows = N.normalize_commands(commands(spark).union(commands(spark)))
    text, other = F.col("text"), F.col("unquoted")
    a, b = X.ngrams(text, other), X.ngrams(other, F.substring("text", 2, 9))
    joined = X.joined_ngrams(text, other)
    wanted = F.struct(F.size(a).alias("n"), F.size(joined).alias("j"), F.size(F.filter(joined, lambda g: g.contains("\0"))).alias("x"), F.size(F.array_intersect(a, b)).alias("c"), F.size(F.array_except(a, b)).alias("l"), F.size(F.array_except(b, a)).alias("r"))
    d, j = X.gram_difference(text, other, other, F.substring("text", 2, 9)), X.joined_gram_counts(text, other)
    got = rows.select(wanted.alias("w"), X.gram_count(text, other).alias("n"), j.alias("j"), d.alias("d")).collect()
    assert len(got) == 2 * len(COMMANDS)
    for r in got:
        assert tuple(r["w"]) == (r["n"], r["j"]["n"], r["j"]["across"], r["d"]["common"], r["d"]["only_left"], r["d"]["only_right"])


def test_drift_needs_no_join(spark):
    from shellgauge.queries import model_queries as M

    plan = M.e19_dense_drift(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # that of the log with its commands


def test_fold_check_and_matrix_exchange_no_grams(spark):
    from shellgauge.queries import model_queries as M

    for made in (M.e06_fold_check(spark, "/root/testdata/sf0.001"), M.f09_matrix(spark, "/root/testdata/sf0.001")):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate explode" not in plan and "gram" not in [w.split("#")[0].strip("[") for line in plan.splitlines() if "Aggregate" in line for w in line.split()]


def test_language_models_keep_all_grams(spark, monkeypatch):
    from shellgauge.llm import langid

    monkeypatch.setattr(langid, "MODEL_CELLS", 60, raising=False)
    counted = langid.count_grams(spark.createDataFrame([("the house and the garden", "en"), ("la maison et le jardin", "fr")], "text string, lang string")).cache()
    levels = langid.kept_levels(counted, 2)
    assert sum(len(levels[k][4].codes) for k in levels) == counted.count() > 30
    whole = {k: langid.all_levels(*zip(*[(r["gram"], r["n"]) for r in counted.where(f"lang = '{k}'").collect()], strict=True)) for k in levels}
    assert all(len(levels[k][n].codes) == len(whole[k][n].codes) for k in levels for n in range(1, 5))


def test_the_log_is_normalised_once_for_its_vocabulary(spark, monkeypatch):
    from shellgauge.queries import model_queries as M

    seen, vocabulary_of = [], M.X.vocabulary_of
    monkeypatch.setattr(M.X, "vocabulary_of", lambda rows, *more: seen.append(rows) or vocabulary_of(rows, *more))
    out = M.e04_e05_folded_pruned(spark, "/root/testdata/sf0.001")
    # what both passes of the counting read, and both sides of the folding, are files
    assert len(seen) == 1 and "regexp_replace" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in out._jdf.queryExecution().optimizedPlan().toString() and out.count() > 100


def test_equal_columns_are_fitted_as_one(spark, monkeypatch):
    import numpy as np

    from shellgauge.functions import features as X
    from shellgauge.operators import scoring as S
    from shellgauge.operators import training as Tr

    some = [(f"{c} u{i}" if i else c, k % 3) for k, c in enumerate(["rm -rf /srv", "ls -l", "dd if=/dev/zero", "git status", "sudo rm -r x", "cat a.txt", ""]) for i in range(9)]
    rows = X.dense(N.normalize_commands(spark.createDataFrame(some, "command string, label int"))).withColumn("weight", Tr.ambiguity_weight(F.col("label"))).withColumn("validation", F.expr("pmod(xxhash64(command), 5) = 0")).withColumn("id", F.md5("command"))
    train = rows.where("not validation")
    vocab, spread = X.vocabulary_of(train, train.count()).cache(), X.standardiser(train).cache()
    idf = S.packed(vocab.select("gram", F.col("idf").alias("coef")))
    matrix, names = Tr.packed_rows(rows, idf, spread)
    sizes, evaluate = set(), Tr.evaluate
    monkeypatch.setattr(Tr, "evaluate", lambda held, w, *more: sizes.add(len(w)) or evaluate(held, w, *more))
    alphas = (0.01, 0.3)
    coef, grid, alpha = Tr.fit_rows(matrix.cache(), idf, names, alphas)
    assert max(sizes) < len(idf.keys)  # n-grams that occur together are one column
    # the same minimum as by a matrix with a column for each n-gram
    z = X.standardised(X.dense_long(rows.select("id", *X.DENSE), "id"), spread).select("id", "feature", "z")
    targets = rows.select("id", F.col("label").cast("double").alias("label"), "weight", "validation")
    whole, wide_grid, wide_alpha = Tr.fit(X.matrix(X.gram_table(rows, "id"), vocab, z, "id"), targets, alphas)
    a, b = ({r["alpha"]: r for r in g.collect()} for g in (grid, wide_grid))
    assert alpha == wide_alpha and all(a[k]["gradient"] <= Tr.TOLERANCE and np.isclose(a[k]["loss"], b[k]["loss"], rtol=1e-8) and np.isclose(a[k]["mae"], b[k]["mae"], atol=1e-4) for k in alphas)
    one, other = ({r["feature"]: r["coef"] for r in c.collect()} for c in (coef, whole))
    assert one.keys() == other.keys() and max(abs(one[f] - other[f]) for f in one) < 1e-4
    # with chunks that tasks add up
    monkeypatch.setattr(Tr, "DIRECT_BYTES", 0)
    monkeypatch.setattr(Tr, "CHUNK", 7)
    assert [(r["alpha"], round(r["loss"], 9)) for r in Tr.fit_rows(matrix, idf, names, alphas)[1].collect()] == [(k, round(a[k]["loss"], 9)) for k in alphas]


def test_the_log_is_normalised_once_for_its_fit(spark, monkeypatch):
    import pytest

    from shellgauge.queries import model_queries as M

    class Seen(Exception):
        pass

    def seen(rows, *more, **names):
        raise Seen(rows._jdf.queryExecution().optimizedPlan().toString())

    monkeypatch.setattr(M.Tr, "stratified", seen)
    monkeypatch.setattr(M, "_fitted", {})
    with pytest.raises(Seen) as plan:
        M.fitted(spark, "/root/testdata/sf0.001")
    assert "regexp_replace" not in str(plan.value)  # the split's passes read a file


def test_each_command_is_scored_once(spark, monkeypatch):
    from shellgauge.functions import features as X
    from shellgauge.operators import evaluation as E
    from shellgauge.queries import corpus_queries as C
    from shellgauge.queries import model_queries as M

    sf, path = "/root/testdata/sf0.001", tables.shared_path(spark, "toy")
    made = X.dense(N.normalize_commands(C.log(spark, sf)))
    coef, named = M.model(made)
    tables.write_model(path, coef, named, spark.createDataFrame([(-0.2, 0.9, 1.05, 0.1)], "bias double, warn double, block double, alpha double"))
    monkeypatch.setattr(M, "fitted", lambda *_: path)
    every = C.log(spark, sf).select("event_id", "event_type", "command", F.col("risk").alias("label")).cache()
    families = T.variants(every, T.HOLDOUT).select("event_id", "event_type", "family", F.col("label").alias("truth"), F.col("variant").alias("command")).cache()
    want = M.fitted_scores(spark, sf, every, "event_id").groupBy("event_type", "label", "verdict").agg(F.count("*").alias("n"), F.round(F.min("risk"), 3).alias("low"), F.round(F.max("risk"), 3).alias("high"))
    scored = M.fitted_scores(spark, sf, families, "event_id").where("truth > 0")
    recall = {(r["family"], r["truth"]): (r["n"], round(r["r"], 4)) for r in scored.groupBy("family", "truth").agg(F.count("*").alias("n"), F.avg((F.col("risk") >= 0.9).cast("double")).alias("r")).collect()}
    given, fitted_scores = [], M.fitted_scores
    monkeypatch.setattr(M, "fitted_scores", lambda spark, sf, rows, key: given.append((rows, key)) or fitted_scores(spark, sf, rows, key))
    assert sorted(map(str, M.e08_fitted_scores(spark, sf).collect())) == sorted(map(str, want.collect()))
    assert {(r["family"], r["truth"]): (r["n"], r["recall"]) for r in M.e18_fitted_holdout(spark, sf).collect()} == recall
    for (rows, key), once in zip(given, (every.select("event_type", "command", "label"), families.select("family", "truth", "command")), strict=True):
        assert rows.count() == rows.select(key).distinct().count() < once.count()
    rows = spark.createDataFrame([("a", 2, 1.0, 3), ("a", 2, 0.1, 1), ("b", 2, 0.1, 2), ("b", 1, 5.0, 9)], "g string, truth int, risk double, k long")
    assert {(r["g"], r["n"], r["recall"], r["weak"]) for r in E.recall_by(rows, "g", 2, 0.9, times="k").collect()} == {("a", 4, 0.75, False), ("b", 2, 0.0, True)}
