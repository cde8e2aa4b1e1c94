"""Recall against exact definitions and held-out labels."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shellgauge.llm import neardup, quality, toxicity

SF, LABELLED = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def test_near_duplicates_found_by_the_exact_definition(spark):
    """Copies with 0.5 to 3 % of their words changed: found if the alignment of five-word shingles, over the whole texts, reaches 0.8."""
    r = random.Random(11)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows, limit = [], []
    for k in range(160):
        words = [r.choice(vocabulary) for _ in range(r.choice([60, 120, 300, 900]))]
        copy = list(words)
        for i in r.sample(range(len(words)), max(1, round(len(words) * r.choice([0.005, 0.01, 0.015, 0.02, 0.03])))):
            kind = r.random()
            copy[i] = r.choice(vocabulary) if kind < 0.6 else "" if kind < 0.8 else copy[i] + " more"
        texts = [" ".join(words), " ".join(x for x in copy if x)]
        rows += [(2 * k, texts[0]), (2 * k + 1, texts[1])]
        a, b = (neardup.shingles(neardup.words(t)) for t in texts)
        m = neardup.matches(a, b, len(a) + len(b))
        limit.append(m / (len(a) + len(b) - m))
    got = {x["doc_id"]: x["class_id"] for x in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    found = [got[2 * k] == got[2 * k + 1] for k in range(160)]
    similar = [k for k in range(160) if limit[k] >= 0.8]
    assert len(similar) > 60 and sum(found[k] for k in similar) >= 0.99 * len(similar)
    assert not any(found[k] for k in range(160) if limit[k] < 0.8)


def test_toxicity_on_held_out_labels(spark):
    labels = spark.read.parquet(f"{LABELLED}/labels.parquet").select("doc_id", "toxic")
    rows = toxicity.op3_bigru(spark, LABELLED).where("held_out").join(labels, "doc_id").groupBy("toxic").agg(F.avg(F.col("predicted").cast("double")).alias("share"), F.count("*").alias("n")).collect()
    share = {r["toxic"]: r["share"] for r in rows}
    assert share[1] >= 0.8 and share[0] <= 0.03


def test_quality_references_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text", F.when(F.col("doc_id") % 50 > 0, F.col("lang")).alias("lang"))
    got = quality.references(docs.repartition(5))
    words, classes = defaultdict(Counter), defaultdict(lambda: np.zeros(quality.N_CLASSES))
    for r in docs.where("lang is not null").collect():
        text = r["text"] or ""
        words[r["lang"]].update("".join(c.lower() if c.isascii() else c for c in text).encode().split())
        for c in text + "\n":  # texts of a slice are joined by line ends
            classes[r["lang"]][next((i for i, s in enumerate(quality.CLASSES) if c in s), len(quality.CLASSES) + (0 if c.isascii() else 1))] += 1
    assert got.keys() == {k for k, c in words.items() if sum(c.values()) >= quality.COMMON} and len(got) >= 3
    for k, (hist, common) in got.items():
        total = sum(words[k].values())
        assert common == {w: n / total for w, n in sorted(words[k].items()) if n >= total / quality.COMMON}
        assert hist == pytest.approx(classes[k] / classes[k].sum(), abs=1e-4)


def test_one_row_stays_of_repeated_and_null_keys(spark):
    one, two = (" ".join(f"{w}{i}" for i in range(40)) for w in ("oak", "elm"))
    rows = [(7, one, 1), (7, one, 2), (7, two, 3), (3, two, 4), (None, two + " end", 5), (9, None, 6), (9, None, 7), (8, "", 8), (8, " ", 9), (5, "alone", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_ int")
    kept = neardup.keep_one(docs).collect()
    found = [(r["doc_id"], r["text"]) for r in kept]
    assert sorted(found, key=str) == sorted([(7, one), (None, two + " end"), (9, None), (9, None), (8, found[[k for k, _ in found].index(8)][1]), (5, "alone")], key=str)
    once = neardup.keep_one(docs.where("row_ in (2, 3, 4)").withColumn("doc_id", docs["doc_id"] + docs["row_"]))
    assert sorted(r["row_"] for r in once.collect()) == [2, 4]
    assert neardup.keep_one(docs.limit(0)).count() == 0


def test_word_distances_of_sparse_references():
    rng = np.random.default_rng(3)
    refs = {}
    for k in range(12):
        words = rng.choice(60, 20, replace=False)
        refs[f"l{k}"] = (np.ones(quality.N_CLASSES) / quality.N_CLASSES, {b"w%d" % w: s for w, s in zip(words, rng.dirichlet(np.ones(21))[:20], strict=True)})
    refs["none"] = (np.ones(quality.N_CLASSES) / quality.N_CLASSES, {})
    judge = quality.Judge(refs)
    for n in (0, 1, 30):
        used = rng.choice([w for w in judge.words if w.islower()], n, replace=False).tolist() if n else []
        counts = rng.integers(1, 4, n).tolist()
        total, share = 100, dict(zip(used, counts, strict=True))
        best = min(
            quality.js_distances(np.array([*(share.get(w, 0) / total for w in common), 1 - sum(share.get(w, 0) for w in common) / total]), np.array([[*common.values(), 1 - sum(common.values())]]))[0]
            for _, common in refs.values()
        )
        assert judge.distances(np.zeros(quality.N_CLASSES), 0, [judge.words[w] for w in used], counts, total)[1] == pytest.approx(best, abs=1e-9)
