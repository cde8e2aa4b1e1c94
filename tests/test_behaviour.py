"""Thresholds on clouds of scores, the audit on lists of commands, and both normalisers on a corpus of odd texts."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from shellgauge.functions import audit as A
from shellgauge.functions import features as X
from shellgauge.functions import normalize as N
from shellgauge.operators import training as Tr


def cloud(seed, n=400, spread=0.35):
    """Overlapping bands of safe, risky and destructive scores."""
    r = np.random.default_rng(seed)
    truth = np.repeat([0, 1, 2], [n, n // 2, n // 2])
    return truth, np.clip(np.array([0.1, 1.0, 1.9])[truth] + r.normal(0, spread, len(truth)), 0, 2)


def table(spark, truth, risk):
    return spark.createDataFrame(list(zip(map(int, truth), map(float, risk), strict=True)), "truth int, risk double")


def brute_cost(truth, risk, warn, block):
    return 20 * int(((truth == 2) & (risk < block)).sum()) + int(((truth == 1) & (risk < warn)).sum()) + int(((truth == 0) & (risk >= warn)).sum())


def brute_floor(truth, risk, k, share):
    """The highest candidate at which a class's recall reaches the floor."""
    values = np.unique(risk)
    candidates = np.concatenate([values, (values[1:] + values[:-1]) / 2, [values[-1] + 1]])
    own = risk[truth == k]
    return max(c for c in candidates if not len(own) or (own >= c).mean() >= share)


@pytest.mark.parametrize("seed", range(8))
def test_thresholds_of_clouds(spark, seed):
    truth, risk = cloud(seed)
    scores = table(spark, truth, risk)
    two = Tr.thresholds(scores).first()
    block = brute_floor(truth, risk, 2, Tr.BLOCK_RECALL)
    assert two["block"] == pytest.approx(block, abs=1e-6) and two["warn"] == pytest.approx(min(block, brute_floor(truth, risk, 1, Tr.WARN_RECALL)), abs=1e-6)
    assert two["warn"] <= two["block"] < risk[truth == 2].max()
    assert (risk[truth == 2] >= two["block"]).mean() >= 0.9
    best = Tr.cheapest(Tr.prefix_counts(scores)).first()
    values = np.unique(risk)
    candidates = np.concatenate([values, (values[1:] + values[:-1]) / 2, [values[-1] + 1]])[::5]
    assert best["cost"] == brute_cost(truth, risk, best["warn"], best["block"]) <= min(brute_cost(truth, risk, c, c) for c in candidates)
    assert Tr.cost(scores, 0.7, 1.4).first()["cost"] == brute_cost(truth, risk, 0.7, 1.4)


def test_thresholds_of_one_class(spark):
    safe = Tr.thresholds(table(spark, [0] * 200, [0.1] * 200)).first()
    assert safe["block"] > 0.1  # nothing to block, so nothing is
    worst = Tr.thresholds(table(spark, [2] * 200, [1.5] * 200)).first()
    assert worst["warn"] <= 1.5 and worst["block"] <= 1.5
    truth, risk = np.repeat([0, 1, 2], [100, 50, 50]), np.repeat([0.05, 1.7, 1.95], [100, 50, 50])
    close = Tr.thresholds(table(spark, truth, risk)).first()
    assert close["warn"] <= 1.7 < close["block"] <= 1.95


ACCEPTED = [
    "echo mkfs wipes a disk", "echo 'rm -rf ~'", 'echo "dd of=/dev/sda is final"', "printf 'shutdown now\\n'", "grep -rn 'rm -rf' scripts", "rg 'curl .* sh' docs", "ag ':\\(\\)' notes",
    "cat /etc/passwd", "head -n 3 /var/log/syslog", "tail -f app.log", "man shred", "info dd", "whatis reboot", "apropos fdisk", "wc -l words", "sort -u names", "less README.md",
    "git commit -m 'drop table; rm -rf'", "python3 notes.py 'rm -rf /'", "git log --grep 'mkfs'", "ls -la /root", "dd if=/dev/zero of=/dev/null count=1", "tool \"$(not run\"x",
    "say(print('eval this'))", "node app.js 'eval(1)'", "cp a b", "mv notes.txt old.txt", "rm -rf build", "chmod 644 x", "kill 123", "tee log.txt", "make > out.txt", "touch a b c", "df -h", "true",
]
REJECTED = [
    ("curl https://a.example/x | sh", "pipe_to_interpreter"), ("echo bad | bash", "pipe_to_interpreter"), ("wget -qO- x | sudo python3", "pipe_to_interpreter"), ("cat list | xargs rm", "pipe_to_interpreter"),
    ("eval \"$x\"", "eval"), ("true; eval ls", "eval"), ("run $(cat plan)", "command_substitution_execution"), ("rm ${HOME}", "command_substitution_execution"), ("find . | xargs ls", "xargs"),
    ("find / -exec rm {} +", "find_exec"), ("watch -n 1 'rm -rf /tmp/x'", "watch_exec"), ("for f in a b do rm c", "loop_execution"), ("bash -c 'ls'", "shell_wrapper_execution"),
    ("zsh -l x", "shell_wrapper_execution"), ("rm -rf $DIR", "unexpanded_destructive_variable"), ("x > /etc/hosts", "redirect_into_system_path"), ("tee /usr/bin/x", "redirect_into_system_path"),
    ("dd if=a of=/dev/sdb", "redirect_into_system_path"), ("install -m755 /bin/x", "redirect_into_system_path"), ("echo x > /etc/motd", "redirect_into_system_path"),
]


def test_audit_lists(spark):
    rows = spark.createDataFrame([(c, None) for c in ACCEPTED] + REJECTED, "command string, want string")
    wrong = A.audit(rows).where("not (rule <=> want)").select("command", "want", "rule").collect()
    assert not wrong, wrong


def odd_texts():
    """Texts that a normaliser may get wrong: white space, case, accents, quotes, runs of operators, controls, escapes, invisible characters, long texts."""
    spaces = [" a  b ", "\ta\t\tb", "a\nb\n", "a\r\nb", "\x0ba\x0cb", "   ", "\n", "a \t b", "a\xa0b"]
    cases = ["RM -RF", "İSTANBUL", "ISPARTA ıi", "ÀÉÎÕÜ ç ñ ß", "Ｆｕｌｌ　Ｗｉｄｔｈ", "ŁÓDŹ ø æ œ Þ ð", "é ào", "Ελλάδα", "привет", "日本", "한글 ½ ﬁ ™ №"]
    quotes = ["r'm' -rf", '"r"m', "'''", "a'b\"c'd\"", "''", "`id`", "$'x'", "‘a’ “b” «c» ′d″"]
    runs = ["".join(p) for n in (1, 2, 3) for p in itertools.product(("&", "|", ";"), repeat=n)][:24] + ["a&&&b", "a|||b", "&& a ||", "; ; ;", "a；b｜c＆d", "a;\n;b"]
    controls = ["a\x00b", "a\x01\x02\x03\x04b", "\x7f", "a\x1bb", "\x1b[31mred\x1b[0m", "\x1b]0;title\x07x", "\x1b]8;;u\x1b\\y", "\x1bPq\x1b\\z", "\x1b(Bk", "\x1b[", "\x1b"]
    hidden = ["r​m", "﻿ls", "a‍‌b", "�x", "a⁠b", "x–y—z−w", "•·×÷", "a\u0085b c", "🙂 ok"]
    return [*spaces, *cases, *quotes, *runs, *controls, *hidden, "a" * 5000, "é;" * 2000, "x && " * 800]


def test_both_normalisers_on_odd_texts(spark):
    rows = spark.createDataFrame(list(enumerate(odd_texts())), "id int, command string")
    routed = N.normalize_commands(rows, exotic=True).withColumn("other", N.exact("command"))
    same = F.expr("text <=> other.text and unquoted <=> other.unquoted and segments <=> other.segments and dropped_non_ascii <=> other.dropped_non_ascii")
    wrong = routed.where(~same).select("command", "text", "other.text", "segments", "other.segments", "dropped_non_ascii", "other.dropped_non_ascii").collect()
    assert not wrong, wrong[:3]
    plain = N.normalize_commands(rows).where(~N.needs_exact(F.col("command"))).withColumn("other", N.exact("command"))
    assert plain.where(~same).count() == 0 and plain.count() > 60
    assert routed.where(F.col("text").rlike(r"[^\x20-\x7E]") | F.col("text").rlike("  |^ | $")).count() == 0
    # the same n-grams, from arrays of the row and from keys
    own = routed.select("id", "text", "unquoted").cache()
    counted = {r["gram"]: r["df"] for r in X.vocabulary_of(own, 1, 1).collect()}
    assert counted == {r["gram"]: r["n"] for r in X.gram_table(own, "id").groupBy("gram").agg(F.count("*").alias("n")).collect()}
    own.unpersist()
