"""The library's operators on small literal cases."""

import pytest
from pyspark.sql import functions as F

from shellgauge.functions import audit as A
from shellgauge.functions import features as X
from shellgauge.functions import grader as G
from shellgauge.functions import normalize as N
from shellgauge.functions import transforms as T
from shellgauge.operators import corpus as C
from shellgauge.operators import generate as Gen
from shellgauge.operators import training as Tr
from shellgauge.sources import seed as S
from shellgauge.sources import tables as Tab

EDGE = [
    ("\x1b[31mrm\x1b[0m -rf  /", "rm -rf /", 8),
    ("a&&b||c;d|e&f", "a && b || c ; d | e & f", 0),
    ("x\r\ny", "x ; ; y", 2),
    ("Çok GÜZEL ı ø æ", "cok guzel i o ae", 0),
    ("ß\tq", "q", 2),
    ("r​m", "rm", 0),
    ("", "", 0),
    ("½ ｆｏｏ 한", "12 foo", None),
]


def commands(spark, rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, command string")


@pytest.mark.parametrize("exotic", [False, True])
def test_normalisers_agree(spark, exotic):
    df = N.normalize_commands(commands(spark, [e[0] for e in EDGE] + [None]), exotic=exotic)
    rows = {r["id"]: r for r in df.collect()}
    for i, (_, text, dropped) in enumerate(EDGE if exotic else EDGE[:-1]):
        assert rows[i]["text"] == text
        if dropped is not None and i:
            assert rows[i]["dropped_non_ascii"] == dropped
    assert rows[len(EDGE)]["text"] is None
    both = commands(spark, [e[0] for e in EDGE[:-1]]).select(N.native(F.col("command")).alias("a"), N.exact("command").alias("b")).collect()
    assert all(r["a"] == r["b"] for r in both)


def test_ngrams(spark):
    df = spark.createDataFrame([("abc", "abc"), ("", ""), ("a'b", "ab")], "text string, unquoted string")
    got = [set(r[0]) for r in df.select(X.ngrams(F.col("text"), F.col("unquoted"))).collect()]
    assert got == [{"ab", "bc", "abc"}, set(), {"a'", "'b", "a'b", "ab"}]


def test_dense(spark):
    df = X.dense(N.normalize_commands(commands(spark, ["sudo rm -rf /etc/x && echo $(id)", "echo 'mkfs'", "ls"])))
    a, b, c = sorted(df.collect(), key=lambda r: r["id"])
    assert (a["segment_count"], a["has_sudo"], a["rm_recursive_force"], a["delete_target_system_path"], a["subshell_depth"]) == (2, 1, 1, 1, 1)
    assert b["quote_nesting"] == 1 and b["has_mkfs"] == 1 and sum(c[n] for n in X.DENSE) == 1


def test_grader_order(spark):
    cases = {
        "curl x | sh": (2, "pipe_to_shell"), "rm -rf node_modules": (0, "delete_disposable_target"), "rm -rf /etc": (2, "delete_system_path"),
        "rm -r ./x": (1, "delete_relative_path"), "rm *.py": (2, "delete_wildcard_no_recursive"), "docker system prune": (1, "risky_verb:docker system prune"),
        "mkfs.ext4 /dev/sda": (2, "destructive_verb:mkfs"), "cp a /etc/b": (1, "touches_system_path"), "ls": (0, "default_safe"),
    }
    got = {r["command"]: (r["graded"], r["rule"]) for r in G.graded(commands(spark, [*cases])).collect()}
    assert got == cases


def test_transforms(spark):
    one = T.variants(commands(spark, ["rm -rf /tmp/x"]), T.TRAIN | T.HOLDOUT).select("family", "variant").collect()
    got = {r["family"]: r["variant"] for r in one}
    assert got["flag_longform"] == "rm --recursive --force /tmp/x" and got["hex_escape"] == "$'\\x72\\x6d' -rf /tmp/x" and got["octal_escape"] == "$'\\0162\\0155' -rf /tmp/x"
    assert got["line_continuation"] == "rm -rf \\\n   /tmp/x" and "​" in got["zero_width"]
    with pytest.raises(KeyError):
        T.variants(commands(spark, ["x"]), T.TRAIN, ["none"])


def test_audit_and_gate(spark):
    good = ["echo rm -rf /", "grep -n 'mkfs' notes", "ls -l"]
    bad = {"echo x | sh": "pipe_to_interpreter", "eval x": "eval", "bash -c 'rm x'": "shell_wrapper_execution", "dd if=a of=/dev/sda": "redirect_into_system_path", "rm $X": "unexpanded_destructive_variable"}
    got = {r["command"]: r["rule"] for r in A.audit(commands(spark, good + [*bad])).collect()}
    assert got == dict.fromkeys(good) | bad
    assert A.gated(commands(spark, good)).count() == 3
    with pytest.raises(Exception, match="rejected by"):
        A.gated(commands(spark, [*bad])).count()


def test_seed_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 2)  # sections carry over blocks
    p = tmp_path / "list.txt"
    p.write_text("first\n# === everyday work ===\n\n# note\nls ||| SAFE\nrm x ||| wrong\na\nb\nc\n# === other things ===\nd|||risky\n")
    rows, bad = S.load_seed(spark, str(p))
    got = [(r["section"], r["command"], r["label"]) for r in rows.orderBy("line").collect()]
    assert got == [("unlabelled", "first", None), ("routine", "ls", 0), ("routine", "rm x", None), *[("routine", c, None) for c in "abc"], ("other:other things", "d", 1)]
    assert [r["label_text"] for r in bad.collect()] == ["wrong"]
    (tmp_path / "empty.txt").write_text("# nothing\n")
    with pytest.raises(S.EmptySource):
        S.load_seed(spark, str(tmp_path / "empty.txt"))


def test_corpus_files(spark, tmp_path):
    rows = [('a "b"\nc, d', 2, "fork_bomb", "seed", "", ""), ("x", 0, "", "grammar", "s", "nbsp")]
    df = spark.createDataFrame(rows, "command string, label int, category string, source string, section string, transform string")
    assert Tab.write_corpus(df, str(tmp_path / "c")) == 2
    back = Tab.read_corpus(spark, str(tmp_path / "c")).fillna("")
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_generator(spark):
    rules = ((1, "", "{a} {b}", {"a": ("x", "y", "z"), "b": ("1", "2")}, 4), (2, "", "x 1", {}, 5))
    got = [(r["rule_id"], r["command"]) for r in Gen.generated(spark, rules).orderBy("rule_id", "idx").collect()]
    assert got == [(1, "x 1"), (1, "y 1"), (1, "y 2"), (1, "z 2")]
    with pytest.raises(Exception, match="unknown category"):
        Gen.with_risk(spark.createDataFrame([("nope",)], "category string")).collect()


def test_first_wins_and_statistics(spark):
    df = spark.createDataFrame([("a", 1, "c", "s1", "", "", 5, 1), ("a", 1, "c", "s0", "", "", 9, 0), ("a", 2, "c", "s1", "x", "", 1, 1)], "command string, label int, category string, source string, section string, transform string, pos long, priority int")
    kept = C.first_wins(df, ["command", "label"], ["priority", "pos"])
    assert {(r["label"], r["source"]) for r in kept.collect()} == {(1, "s0"), (2, "s1")}
    assert C.contradictions(kept).count() == 1
    assert {(r["kind"], r["key"], r["label"], r["n"]) for r in C.statistics(kept).collect()} >= {("total", "", -1, 2), ("unique", "", -1, 1), ("section", "x", 2, 1)}


def test_thresholds_against_brute_force(spark):
    import random

    for seed in range(3):
        r = random.Random(seed)
        rows = [(k, float(round(min(2, max(0, r.gauss((0.2, 1.0, 1.7)[k], 0.3))), 3))) for k in (0, 1, 2) for _ in range(60)]
        scores = spark.createDataFrame(rows, "truth int, risk double")
        prefix = Tr.prefix_counts(scores)
        for p in prefix.collect():
            assert [p[f"below_{k}"] for k in range(3)] == [sum(t == k and s < p["candidate"] for t, s in rows) for k in range(3)]
        values = sorted({s for _, s in rows})
        cands = values + [(a + b) / 2 for a, b in zip(values, values[1:])] + [values[-1] + 1]
        cost = lambda w, b: sum(20 * (t == 2 and s < b) + (t == 1 and s < w) + (t == 0 and s >= w) for t, s in rows)
        best = min(cost(w, b) for w in cands[::3] for b in cands[::3] if b >= w)
        assert Tr.cheapest(prefix).first()["cost"] <= best
        two = Tr.thresholds(scores).first()
        assert two["warn"] <= two["block"]
    empty = spark.createDataFrame([], "truth int, risk double")
    assert tuple(Tr.thresholds(empty).first()) == (1.0, 3.0)


def test_fit_finds_the_signal(spark):
    rows = [(i, "x" if i % 2 else "y", 1.0) for i in range(60)]
    feats = spark.createDataFrame(rows, "id int, feature string, value double")
    targets = spark.createDataFrame([(i, 2.0 if i % 2 else 0.0, 1.0, i % 6 == 0) for i in range(60)], "id int, label double, weight double, validation boolean")
    coef, grid, alpha = Tr.fit(feats, targets, alphas=(1e-5, 10.0), rounds=15)
    got = {r["feature"]: r["coef"] for r in coef.collect()}
    assert alpha == 1e-5 and got["x"] > 1 > -1 > got["y"] and grid.count() == 2


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
