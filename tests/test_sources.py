"""Command lists read in splits."""

from shellgauge.sources import seed as S


def test_lists_larger_than_a_split(spark, tmp_path, monkeypatch):
    heads = ["everyday work", "done by mistake", "I am afraid of these", "misc"]
    texts = {}
    for name, n in (("a", 700), ("b", 3), ("c", 250)):
        texts[name] = [f"# === {heads[i // 60 % 4]} ===" if i % 60 == 7 else "" if i % 11 == 0 else "# note" if i % 13 == 0 else f"cmd {name} {i}" + (" ||| risky" if i % 5 == 0 else "") for i in range(n)]
        (tmp_path / f"{name}.txt").write_text("\n".join(texts[name]))
    (tmp_path / "none.txt").write_text("")
    monkeypatch.setattr(S, "BLOCK", 50)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k, v in (("spark.sql.files.maxPartitionBytes", "300b"), ("spark.sql.files.openCostInBytes", "10b")):
            spark.conf.set(k, v)
        lines = S.read_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 10 or spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = S.parse_seed(lines).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = []
    for name, rows in texts.items():
        section = S.UNLABELLED
        for i, t in enumerate(rows, 1):
            if t.startswith("# ==="):
                section = {"everyday work": "routine", "done by mistake": "accident", "I am afraid of these": "feared"}.get(t[6:-4], f"other:{t[6:-4]}")
            elif t and not t.startswith("#"):
                command, _, label = t.partition(" ||| ")
                want.append((name, i, section, command, 1 if label else None))
    found = [(r["path"].rsplit("/", 1)[-1][:-4], r["line"], r["section"], r["command"], r["label"]) for r in got]
    assert sorted(map(str, found)) == sorted(map(str, want))


def test_lines_written_and_read(spark, tmp_path):
    rows = [("x", k, f"line {k}") for k in range(50)] + [("y", 0, "only")]
    S.write_lines(spark.createDataFrame(rows, "path string, line int, value string").repartition(5), str(tmp_path / "out"))
    got = S.read_lines(spark, str(tmp_path / "out")).collect()
    assert sorted((r["path"].split("path=")[1][0], r["line"] - 1, r["value"]) for r in got) == sorted(rows)
