"""Seekable token files, Merkle manifests and conversation repair against brute force."""

import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from shellgauge.llm import manifest, repair, seekzst
from shellgauge.llm.common import fresh_path, ranked

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
RNG = random.Random(7)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_BPE)
    return lambda text: [*t.encode(text, add_special_tokens=False).ids]


def test_encoder_equals_library(library):
    encoder = seekzst.Encoder(WORD_BPE)
    texts = ["", " \n", "It's WE'LL 'tis a_b 12³ --x--", "ΑΣ Σ ΟΔΟΣ İstanbul ŉ é don’t", "a <|endoftext|> b<|startoftext|>c <|", "日本語 テスト　x\xa0y", "x" * 300 + " " + "é" * 200]
    texts += [f"ab {chr(c)} cD{chr(c)}'s x{chr(c)}é" for c in [*range(0x250), *range(0x300, 0x30000, 37)] if not 0xD800 <= c < 0xE000]
    for t in texts:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == library(t), repr(t)


def docs_for(spark):
    rows = [(i, " ".join(RNG.choice(["Étude", "word", "x-y", "don't", "1,000", "—"]) for _ in range(RNG.randrange(0, 60)))) for i in range(300)]
    rows += [(5, "again"), (5, "again"), (None, "no key"), (None, None), (9, None), (10**12, "far " * 30_000)]
    return spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("key", F.lit(1)).withColumn("hash", F.lit("x"))


def test_token_files_against_brute_force(spark, library):
    docs, folder = docs_for(spark), fresh_path(spark, "tokens")
    files = seekzst.write_tokens(docs, folder, WORD_BPE, file_bytes=1500)
    assert files.count() > 3
    got = sorted(seekzst.read_tokens(files, folder).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in docs.collect()), key=lambda k: (k is not None, k))
    want, start = sorted((r["doc_id"] if r["doc_id"] is not None else -1, tuple(library(r["text"] or "") + [1])) for r in docs.collect()), 0
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got) == want
    some = {r["start"]: r for r in seekzst.read_tokens(files, folder, wanted=[5, 17, 10**12, 777_777]).collect()}
    assert len(some) == 5 and all(some[r["start"]] == r for r in got if r["doc_id"] in (5, 17, 10**12))
    assert seekzst.read_tokens(files, folder, wanted=[]).count() == 0
    none = seekzst.write_tokens(docs.where("false"), fresh_path(spark, "tokens"), WORD_BPE)
    assert none.count() == 0 and seekzst.read_tokens(none, folder).count() == 0


class Counted(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        got = super().read(n)
        self.taken += len(got)
        return got

    def size(self):
        return len(self.getvalue())


def test_reader_takes_requested_frames_only_and_verifies():
    import zstandard

    out = io.BytesIO()
    w = seekzst.Writer(out)
    texts = [np.arange(k, k + 4000, dtype="<u4").tobytes() for k in range(50)] + [b""]
    for k, t in enumerate(texts):
        w.add(k if k != 3 else None, t)
    w.close()
    assert w.bytes == len(out.getvalue())
    r = seekzst.Reader(Counted(out.getvalue()))
    tables = r.stream.taken
    assert r.document(7) == texts[7]
    assert r.stream.taken - tables == int(r.table["packed"][7])  # one frame's bytes
    assert list(r) == texts and r.keys()[3] is None
    # any decoder reads the frames one after another and skips the tables
    d = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True)
    assert d.read() == b"".join(texts)
    begin = int(r.starts[20])
    broken = bytearray(out.getvalue())
    broken[begin + 12] ^= 1
    bad = seekzst.Reader(Counted(bytes(broken)))
    assert bad.document(7) == texts[7]
    with pytest.raises(seekzst.SeekError):
        bad.document(20)
    for cut in (1, 9, 400):
        with pytest.raises(seekzst.SeekError):
            seekzst.Reader(Counted(out.getvalue()[:-cut]))
    # a wrong entry of the seek table is found by its own checksum
    at = len(out.getvalue()) - 9 - 12 * (len(r.table) - 20) + 8
    broken = bytearray(out.getvalue())
    broken[at] ^= 1
    with pytest.raises(seekzst.SeekError):
        seekzst.Reader(Counted(bytes(broken))).document(20)


def test_long_documents_take_several_frames(monkeypatch):
    monkeypatch.setattr(seekzst, "FRAME_IDS", 100)
    out = io.BytesIO()
    w = seekzst.Writer(out)
    texts = [np.arange(n, dtype="<u4").tobytes() for n in (0, 99, 100, 101, 1000)]
    for k, t in enumerate(texts):
        w.add(k, t)
    w.close()
    r = seekzst.Reader(Counted(out.getvalue()))
    assert len(r.table) == 1 + 1 + 1 + 2 + 10 + 1 and [r.document(k) for k in range(5)] == texts == list(r)


# Manifest.


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """Levels of a Merkle tree, from the leaves up."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def way(levels, i):
    """(before, after) of a leaf's node at each level."""
    out = []
    for level in levels[:-1]:
        run = i // 3 * 3
        out.append((level[run:i], level[i + 1 : run + 3]))
        i //= 3
    return out


def brute_manifest(rows, cut):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha(*map(field, r))
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {g: tree([leaf(r) for r in groups[g]]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            path = way(trees[g], i) + way(top, k)
            d = leaf(cut(r))
            for a, b in path:
                d = sha(*a, d, *b)
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], sha(*[x for a, b in path for x in a + b]), d, d == top[-1][0]))
    return out


def cut_lines(r):
    even = zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 2 == 0
    return (*r[:4], r[4].replace("\n", "") if even and r[4] is not None else r[4])


@pytest.mark.parametrize("sizes", [{"one": 1}, {"b": 1, "a": 2, None: 3, "Z": 4, "é": 10, "": 28, "hot": 200}, {f"g{k}": k % 5 + 1 for k in range(40)}])
def test_manifest_against_brute_force(spark, sizes):
    rows, at = [], 0
    for g, n in sizes.items():
        for _ in range(n):
            at += 1
            rows.append((at if at % 11 else None, g, RNG.choice([None, "en"]), RNG.choice([None, 12]), RNG.choice([None, "", f"a\nb{at}", "é\n" * 50])))
    rows += [rows[0], rows[0], (7, "other", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").repartition(3)
    extra = df.withColumn("rank", F.lit(0)).withColumn("grp", F.lit("x")).withColumn("path", F.lit(None).cast("string"))
    cut = F.when(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    got = manifest.manifest(extra, {"text": cut}).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    order = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=order) == sorted(brute_manifest(rows, cut_lines), key=order)


def test_manifest_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, source string, lang string, n_chars bigint, text string")
    assert manifest.manifest(df, {}).count() == 0


def test_ranked_numbers_each_group_without_gaps(spark, monkeypatch):
    import shellgauge.llm.common as common

    monkeypatch.setattr(common, "RANK_ROWS", 50)
    df = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"), F.when(F.col("id") % 5 > 0, F.col("id") % 50).alias("v"))
    got = ranked(df, "g", ["v"]).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["g"], []).append(r)
    assert len(got) == 1000 and len(groups) == 8
    for own in groups.values():
        own.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(len(own))) and {r["n"] for r in own} == {len(own)}
        assert [r["v"] for r in own] == sorted((r["v"] for r in own), key=lambda v: (v is not None, v or 0))


# Conversations.


def brute_repair(rows):
    """Cost, edits and repaired turns of rows (role, text): a forward programme that keeps each state's least (cost, edits)."""
    after = {0: 2, 1: 2, 2: 3, 3: 2}
    names = {2: "user", 3: "assistant"}

    def inserted(best):
        best = dict(best)
        for _ in range(4):
            for s, (c, e, t) in list(best.items()):
                n = after[s]
                if n not in best or (c + 3, e + "I") < best[n][:2]:
                    best[n] = (c + 3, e + "I", [*t, f"{names[n]}:"])
        return best

    best, seen = {0: (0, "", [])}, []
    for role, text in rows:
        shown = text.rstrip(" \t\n\v\f\r")
        bad, extra = not shown or (role, text) in seen, 0 if shown.endswith((".", "!", "?")) else 3
        seen.append((role, text))
        new = {}
        for s, (c, e, t) in inserted(best).items():
            to = [(c + 4, e + "D", t, s)]
            if not bad:
                kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((s, role[:1]))
                to += [(c + extra, e + "K", [*t, f"{role}:{text}"], kept)] if kept else []
                to.append((c + 3 + extra, e + "R", [*t, f"{names[after[s]]}:{text}"], after[s]))
            for cost, edits, turns, n in to:
                if n not in new or (cost, edits) < new[n][:2]:
                    new[n] = (cost, edits, turns)
        best = new
    return min(v for s, v in inserted(best).items() if s in (0, 3))


ROLES, TEXTS = ["user", "assistant", "system", "tool", " ", "user", "assistant", "", "update"], ["", "a.", "b.", "c", "d.", "e", "f.", "g. ", "h!", "i?\n", "j", " \n"]


@pytest.mark.parametrize("block", [1, 4, 48])
def test_auction_against_brute_force(monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    for n in range(500):
        rows = [(RNG.choice(ROLES), RNG.choice(TEXTS)) for _ in range(n % 24)]
        got = repair._repaired_one([(None, *r) for r in rows])
        cost, edits, turns = brute_repair(rows)
        assert got[5:] == (cost, edits, hashlib.sha256("\n".join(turns).encode()).hexdigest()), rows


def test_auction_of_hard_rows_is_quick():
    assert repair.Repair("?" * 5000).edits()[0].count("D") + repair.Repair("x" * 5000).edits()[0].count("D") >= 5000


def test_long_conversations_equal_short_ones(spark, monkeypatch):
    rows = []
    for conv in (None, 1, 2, 3, 4):
        for k in range({2: 1, 4: 70}.get(conv, 40)):
            rows.append((conv, None if k % 13 == 0 else k * (1 + k % 3), RNG.choice(ROLES), f"{RNG.choice(TEXTS)}" if k % 2 else f"x{k}{RNG.choice('.!?,')}", False))
    rows += [(5, None, "user", "never.", True), (6, None, "user", " ", False), (6, None, "user", " ", False)]
    df = spark.createDataFrame(rows, "conv bigint, turn bigint, role string, text string, gone boolean")
    short = {r["conv"]: r for r in repair.repair(df).collect()}
    monkeypatch.setattr(repair, "LONG_ROWS", 1)
    monkeypatch.setattr(repair, "PIECE", 7)
    long = {r["conv"]: r for r in repair.repair(df).collect()}
    assert short == long and len(long) == 7
    assert long[5]["audit"] == "" and long[5]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()


def test_damage_and_nulls(spark):
    rows = [(c, t, r, x) for c in (None, *range(40)) for t, r, x in ((0, "system", "Be."), (1, None, "Hi!"), (None, "assistant", None), (3, "assistant", "Yes. No?"))]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    kinds = set()
    for r in repair.damaged(df).collect():
        d = zlib.crc32(f"{' ' if r['conv'] is None else r['conv']}:{' ' if r['turn'] is None else r['turn']}".encode()) % 20
        kinds.add(d)
        assert r["gone"] == (d == 0) and (d != 1 or r["text"] == "") and (d != 4 or r["role"] == "user") and (d != 2 or not set(r["text"]) & set(".!?"))
    assert kinds >= {0, 1, 2, 3, 4}
    extra = df.withColumn("conv", F.lit("x")).withColumn("gone", F.lit(True)).withColumn("copy_", F.lit(0))
    assert repair.repair(repair.damaged(extra)).count() == 41
    assert repair.repair(repair.damaged(df.where("false"))).count() == 0
