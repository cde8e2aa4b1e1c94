"""Pieces that are encoded together, and trees that learn from all spans."""

from __future__ import annotations

import random

import numpy as np
import pytest

from shellgauge.llm import bpe, pii


def vocabulary(r: random.Random) -> dict[bytes, int]:
    """Bytes a to d and tokens of two earlier ones; some are reached by no merges."""
    tokens = [b"a", b"b", b"c", b"d"]
    for _ in range(r.randrange(80)):
        if len(t := r.choice(tokens) + r.choice(tokens)) < 12 and t not in tokens:
            tokens.append(t)
    return {t: i for i, t in enumerate(tokens)}


def outcome(f):
    try:
        return f()
    except ValueError:
        return None


def test_pieces_together_are_as_by_themselves(monkeypatch):
    monkeypatch.setattr(bpe, "PAIR_PLACES", 8)  # pairs push each other out
    r = random.Random(4)
    same = 0
    for _ in range(60):
        vocab = bpe.Ranks(vocabulary(r))
        arrays = bpe.Tokenizer(vocab, ".+").arrays
        pieces = [bytes(r.choice(b"abcd") for _ in range(r.randrange(1, 30))) for _ in range(100)]
        want = {p: ids for p in pieces if (ids := outcome(lambda: bpe.PrefixEncoding(vocab, p).ids())) is not None}  # noqa: B023
        assert {p: np.frombuffer(x, "<u4").tolist() for p, x in zip(want, arrays.encode(list(want)), strict=True)} == want
        assert all(outcome(lambda: arrays.encode([p])) is None for p in pieces if p not in want)  # noqa: B023
        same += len(want)
    assert same > 3000 and arrays.encode([]) == []
    with pytest.raises(ValueError):
        arrays.encode([b"ab", b"aeb"])


def test_new_pieces_are_encoded_together(monkeypatch):
    path, pattern = bpe.public_vocabulary()
    tok = bpe.Tokenizer(bpe.Ranks.from_file(path), pattern)
    r = random.Random(5)
    texts = [" ".join("".join(r.choice("aehnorstß漢") for _ in range(r.randrange(1, 70))) for _ in range(50)) for _ in range(40)] + ["", "x" * 3000]
    want = [tok.encode(t) for t in texts]
    calls, encode = [], tok.arrays.encode
    monkeypatch.setattr(tok.arrays, "encode", lambda pieces: calls.append(len(pieces)) or encode(pieces))
    for memory, run in ((bpe.PIECE_MEMORY, bpe.RUN_PIECES), (2000, 7)):
        monkeypatch.setattr(bpe, "PIECE_MEMORY", memory)
        monkeypatch.setattr(bpe, "RUN_PIECES", run)
        tok.cache, tok.older, tok.held = {}, {}, 0
        calls.clear()
        assert tok.encode_all(texts) == want and [tok.decode(x).decode() for x in want] == texts
        if run > 7:
            assert len(calls) == 1 and calls[0] > 1000


def test_trees_learn_from_every_span(spark, monkeypatch):
    texts = [" ".join(f"a{i}b{j}@c{j % 7}.org tel 1.{i}.{j}.9 +1 555 {1000000 + i * j} on 20{10 + j % 9}-11-0{1 + i % 9} 12{i:02d}.{j:03d}.9{j:02d}.001" for j in range(1, 91)) for i in range(40)]
    texts += [None, "", "no data", "x" * 300 + "@" + "y" * 1200 + ".org"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = {}
    for t in texts:
        base = pii.base_spans(t or "")
        for (a, k, b), y in [(s, 1) for s in base] + [(s, 0) for s in pii._apart(pii.proposals(t or ""), base)]:
            span, left, right = pii._context(t, a, b)
            for s, lf, label, again in [(span, left, y, False)] + [(s, lf, z, True) for s, lf, z in (pii.rewritten(k, span, left, right) if y else ())]:
                one = (label, again, *map(int, pii.features(k, s, lf, right)))
                want[one] = want.get(one, 0) + 1
    got = {}
    rows = pii.counted(docs).toArrow()
    for label, again, x, n in zip(*(rows[c].to_pylist() for c in ("label", "rewritten")), pii._unpacked(rows["x"]).tolist(), rows["n"].to_pylist(), strict=True):
        got[label, again, *x] = got.get((label, again, *x), 0) + n
    assert got == want and sum(want.values()) > 20_000
    x = np.array([k[2:] for k, n in want.items() for _ in range(n)])
    edges = pii.edges_of(pii.value_counts(pii.counted(docs)), pii.BINS)
    for f, e in enumerate(edges):
        assert np.array_equal(e, np.unique(np.quantile(x[:, f], np.linspace(0, 1, pii.BINS + 1)[1:-1], method="lower")))
    cells = pii.cells(pii.counted(docs), edges).agg({"n": "sum", "halves": "sum"}).first()
    assert (cells["sum(n)"], cells["sum(halves)"]) == (sum(want.values()), sum(n if k[1] else 2 * n for k, n in want.items()))
    text = "mail a.b@c.example.com, john (at) doe.org"
    spans = pii.learn(docs).find(text)[0]
    monkeypatch.setattr(pii, "CELLS", 60)
    few = pii.learn(docs)
    assert few.find(text)[0] == spans and few.trees is not None and max(map(len, few.trees.edges)) < pii.BINS // 2
