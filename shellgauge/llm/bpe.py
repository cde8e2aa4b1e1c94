"""Byte-level BPE by prefix dynamic programming.

For a byte string b and each i, exactly one token can end the BPE encoding of b[:i]. The encoder
stores that token for every prefix. It is found among the tokens that are suffixes of b[:i]: a
token t of length n fits if the pair (last token of b[:i-n], t) encodes to itself, which
``pair_holds`` decides by undoing the merges along the seam. The encoding of the whole string
follows by walking back from its end. As every entry depends on the entries before it only, bytes
can be appended exactly (``PrefixEncoding.append``), and an edit keeps all entries before the edit
and stops as soon as the entries after it agree again (``PrefixEncoding.replace``).

Text is first cut into pieces by the tokenizer's pattern; each piece is encoded separately. Pieces that a
worker doesn't remember are encoded together, by the same recurrence over arrays (``PieceArrays``).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import AT_END, REMEMBERED, map_slices

#: Memory, in bytes, for what a Python worker remembers: encoded pieces and pairs of tokens. Pieces that fill their
#: memory become the older half, and what is met again in that moves back. Results don't depend on it.
PIECE_MEMORY, PAIR_MEMORY = 48 << 20, 4 << 20
#: Longest piece that is remembered and encoded with others; longer ones are encoded by themselves.
PIECE_CACHE_BYTES = 48
#: Pieces that are looked up together, bytes of pieces that are encoded together, and places for pairs of tokens in that.
RUN_PIECES, BATCH_BYTES, PAIR_PLACES = 300_000, 1 << 19, 1 << 18
#: About what one entry takes in a dictionary: slot, key and value objects (a piece's own bytes come on top), and a pair of tokens.
ENTRY, PAIR_ENTRY = 210, 120


class Ranks:
    """A vocabulary: bytes -> rank, and for every token the two tokens whose merge makes it."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=1)
        #: last four bytes of tokens -> length of the longest token that ends so
        self.ending: dict[bytes, int] = {}
        for t in ranks:
            if len(t) > self.ending.get(t[-4:], 3):
                self.ending[t[-4:]] = len(t)
        self._pairs: dict[int, bool] = {}
        self.token = {r: t for t, r in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for rank, token in sorted(self.token.items()):
            if len(token) > 1 and (two := self._two(token, rank)):
                self.halves[rank] = two
                self.merged[two] = rank

    def _two(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """Merge the bytes of a token with lower ranks only; two parts remain for a reachable token."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = rank, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1], rank)
                if r < best:
                    best, at = r, i
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        a, b = self.ranks.get(parts[0]), self.ranks.get(parts[1])
        return None if a is None or b is None else (a, b)

    @classmethod
    def from_file(cls, path: str) -> Ranks:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def pair_holds(self, left: int, right: int) -> bool:
        pair = left << 32 | right
        holds = self._pairs.get(pair)
        if holds is None:
            if len(self._pairs) * PAIR_ENTRY >= PAIR_MEMORY:
                self._pairs.clear()
            holds = self._pairs[pair] = self._pair_holds(left, right)
        return holds

    def last_token(self, data: bytes, i: int, last: list[int]) -> int:
        """The last token of data[:i], given those of all shorter prefixes; -1: there is none."""
        get, pairs = self.ranks.get, self._pairs
        for start in range(max(0, i - self.ending.get(data[i - 4 if i > 4 else 0 : i], 3)), i):
            t = get(data[start:i])
            if t is None:
                continue
            if start == 0:
                if i == 1 or t in self.halves:  # else a token that no merges reach
                    return t
            elif (before := last[start]) >= 0:
                holds = pairs.get(before << 32 | t)
                if holds or (holds is None and self.pair_holds(before, t)):
                    return t
        return -1

    def _pair_holds(self, left: int, right: int) -> bool:
        """Whether the bytes of two tokens, joined, encode to just these two tokens.

        Undo the latest merge on either side of the seam step by step; if a pair that meets at
        the seam would have been merged before the merge just undone, the two don't hold.
        """
        merged, halves = self.merged, self.halves
        before = 1 << 62
        while True:
            joined = merged.get((left, right))
            if joined is not None and joined < before:
                return False
            a, b = halves.get(left), halves.get(right)
            if a is None and b is None:
                return True
            # the later of the two merges is undone first; of two merges of one rank the left one is made first
            if b is None or (a is not None and left > right):
                before, left = left, a[1]
            else:
                before, right = right + 1, b[0]


class PrefixEncoding:
    """The last tokens of all prefixes of one piece."""

    __slots__ = ("data", "last", "size", "vocab")

    def __init__(self, vocab: Ranks, data: bytes = b""):
        self.vocab, self.data = vocab, b""
        self.last: list[int] = [-1]
        self.size: list[int] = [0]
        if data:
            self.append(data)

    def _find(self, i: int) -> tuple[int, int]:
        t = self.vocab.last_token(self.data, i, self.last)
        return t, len(self.vocab.token[t]) if t >= 0 else 0

    def append(self, more: bytes) -> PrefixEncoding:
        begin = len(self.data)
        self.data += more
        for i in range(begin + 1, len(self.data) + 1):
            t, n = self._find(i)
            self.last.append(t)
            self.size.append(n)
        return self

    def replace(self, start: int, end: int, new: bytes) -> PrefixEncoding:
        """Replace bytes start to end. Entries up to start stay; entries after the edit are made
        anew until as many entries in a row as the longest token has bytes agree with the old
        ones, as from there on all entries depend on equal ones only."""
        old_last, old_size, tail = self.last, self.size, self.data[end:]
        self.data = self.data[:start] + new + tail
        self.last, self.size = old_last[: start + 1], old_size[: start + 1]
        edited, agree, shift = start + len(new), 0, start + len(new) - end
        for i in range(start + 1, len(self.data) + 1):
            if agree >= self.vocab.longest:
                self.last += old_last[i - shift :]
                self.size += old_size[i - shift :]
                break
            t, n = self._find(i)
            self.last.append(t)
            self.size.append(n)
            same = i > edited and (old_last[i - shift], old_size[i - shift]) == (t, n)
            agree = agree + 1 if same else 0
        return self

    def ids(self) -> list[int]:
        out, i = [], len(self.data)
        while i:
            if self.last[i] < 0:
                raise ValueError("the vocabulary lacks a byte of this text")
            out.append(self.last[i])
            i -= self.size[i]
        return out[::-1]


def _looked_up(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the wanted numbers in sorted keys, and whether they are there."""
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


class PieceArrays:
    """The recurrence of PrefixEncoding for many pieces at once, a byte of all of them a step.

    A trie over the tokens gives the longest token that ends at each byte; shorter candidates are its suffixes that are tokens."""

    def __init__(self, vocab: Ranks, widths: np.ndarray):
        self.widths, top = widths, len(widths)
        self.reached = np.zeros(top, bool)
        self.shorter, self.left_half, self.right_half = np.full((3, top), -1, np.int64)
        edges: dict[int, int] = {}
        token = [-1]
        for t, r in vocab.ranks.items():
            self.reached[r] = len(t) == 1 or r in vocab.halves
            self.left_half[r], self.right_half[r] = vocab.halves.get(r, (-1, -1))
            self.shorter[r] = next((s for k in range(1, len(t)) if (s := vocab.ranks.get(t[k:])) is not None), -1)
            node = 0
            for b in t:
                if (child := edges.get(node << 8 | b)) is None:
                    child = edges[node << 8 | b] = len(token)
                    token.append(-1)
                node = child
            token[node] = r
        self.token = np.array(token)
        self.edges, self.children = np.array(sorted(edges.items()), np.int64).reshape(-1, 2).T.copy()
        self.merged, self.merges = np.array(sorted((a * top + b, r) for (a, b), r in vocab.merged.items()), np.int64).reshape(-1, 2).T.copy()
        #: twice a pair's number, plus 1 if it holds; a pair that takes another's place is worked out again
        self.known = np.full(PAIR_PLACES, -1, np.int64)

    def holds(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left * len(self.widths) + right
        place = ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - len(self.known).bit_length())).astype(np.int64)
        known = self.known[place]
        new = np.flatnonzero(known >> 1 != pair)
        if len(new):
            known[new] = pair[new] << 1 | self._holds(left[new], right[new])
            self.known[place[new]] = known[new]
        return known & 1 == 1

    def _holds(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks._pair_holds for each pair."""
        out, row, before = np.ones(len(left), bool), np.arange(len(left)), np.full(len(left), 1 << 62)
        while len(row):
            at, joined = _looked_up(self.merged, left * len(self.widths) + right)
            if len(self.merges):
                joined &= self.merges[at] < before
            out[row[joined]] = False
            a, b = self.right_half[left], self.left_half[right]
            go = ~joined & ((a >= 0) | (b >= 0))
            row, left, right, a, b = row[go], left[go], right[go], a[go], b[go]
            of_left = (b < 0) | ((a >= 0) & (left > right))
            before = np.where(of_left, left, right + 1)
            left, right = np.where(of_left, a, left), np.where(of_left, right, b)
        return out

    def _longest(self, data: np.ndarray, room: np.ndarray) -> np.ndarray:
        """The longest token that ends at each byte within its piece; room: bytes up to the piece's end."""
        out, at, node, n = np.full(len(data), -1, np.int64), np.arange(len(data)), np.zeros(len(data), np.int64), 0
        while len(at):
            edge, there = _looked_up(self.edges, node << 8 | data[at + n])
            at, node = at[there], self.children[edge[there]]
            token = self.token[node]
            out[at[token >= 0] + n] = token[token >= 0]
            n += 1
            more = room[at] > n
            at, node = at[more], node[more]
        return out

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of each piece; no piece is empty."""
        size = np.array([len(p) for p in pieces], np.int64)
        begin = np.cumsum(size) - size
        data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        longest = self._longest(data, np.repeat(begin + size, size) - np.arange(len(data)))
        last = np.full(len(data), -1, np.int64)
        active = begin[np.argsort(-size, kind="stable")]
        reach = np.searchsorted(np.sort(size), np.arange(1, size.max(initial=0) + 1))
        for i, shorter in enumerate(reach):
            at = active[: len(active) - shorter] + i
            token = longest[at]
            at, token = at[token >= 0], token[token >= 0]
            while len(at):
                width = self.widths[token]
                before = last[at - width]
                fits = self.reached[token] & (width == i + 1)
                seam = np.flatnonzero((width <= i) & (before >= 0))
                fits[seam] = self.holds(before[seam], token[seam])
                last[at[fits]] = token[fits]
                at, token = at[~fits], self.shorter[token[~fits]]
                at, token = at[token >= 0], token[token >= 0]
        # back from the ends
        piece, left, steps = np.arange(len(pieces)), size, []
        while len(piece):
            token = last[begin[piece] + left - 1]
            if token.min() < 0:
                raise ValueError("the vocabulary lacks a byte of this text")
            steps.append((piece, token))
            left = left - self.widths[token]
            piece, left = piece[left > 0], left[left > 0]
        if not steps:
            return []
        owner, ids = (np.concatenate(x[::-1]) for x in zip(*steps, strict=True))
        packed = ids[np.argsort(owner, kind="stable")].astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(owner, minlength=len(pieces)))).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class Tokenizer:
    """Encodes whole texts and decodes ids; remembers pieces."""

    def __init__(self, vocab: Ranks, pattern: str):
        import regex

        self.vocab = vocab
        self.split = regex.compile(pattern).findall
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0  # bytes of the cache, about
        top = max(vocab.token, default=-1) + 1
        self.widths = np.zeros(top, np.int64)
        for r, t in vocab.token.items():
            self.widths[r] = len(t)
        self.starts = np.concatenate([[0], np.cumsum(self.widths)])
        self.flat = np.frombuffer(b"".join(vocab.token.get(r, b"") for r in range(top)), np.uint8)
        self.arrays = PieceArrays(vocab, self.widths)

    def forget(self) -> None:
        """Drops the older half of what is remembered; the newer one and the vocabulary stay for the next task."""
        self.older.clear()

    def _packed(self, pieces: list[str]) -> list[bytes]:
        """The packed ids of each piece. Those not remembered are encoded together, each once."""
        if self.held >= PIECE_MEMORY // 2:
            self.older, self.cache, self.held = self.cache, {}, 0
        cache, older, ranks = self.cache, self.older, self.vocab.ranks
        large: dict[str, bytes] = {}
        names: list[str] = []
        waiting: list[bytes] = []
        held = 0

        def put(piece: str, size: int, packed: bytes) -> None:
            cache[piece] = packed
            self.held += ENTRY + size + len(packed)

        def flush() -> None:
            for piece, data, packed in zip(names, waiting, self.arrays.encode(waiting), strict=True):
                put(piece, len(data), packed)
            names.clear()
            waiting.clear()

        for piece in {p for p in pieces if p not in cache}:
            data = piece.encode()
            if (packed := older.get(piece)) is not None:
                put(piece, len(data), packed)
            elif len(data) > PIECE_CACHE_BYTES:
                whole = ranks.get(data)
                large[piece] = np.array(PrefixEncoding(self.vocab, data).ids() if whole is None else [whole], "<u4").tobytes()
            elif (whole := ranks.get(data)) is not None:
                put(piece, len(data), whole.to_bytes(4, "little"))
            else:
                names.append(piece)
                waiting.append(data)
                held += len(data)
                if held >= BATCH_BYTES:
                    flush()
                    held = 0
        flush()
        return [cache.get(p) or large[p] for p in pieces]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        pieces: list[str] = []
        ends = [0]
        for t in texts:
            pieces += self.split(t)
            ends.append(len(pieces))
        packed: list[bytes] = []
        for i in range(0, len(pieces), RUN_PIECES):
            packed += self._packed(pieces[i : i + RUN_PIECES])
        return [b"".join(packed[a:b]) for a, b in zip(ends, ends[1:], strict=False)]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, "<u4").astype(np.int64)
        widths = self.widths[ids]
        ends = np.cumsum(widths)
        at = np.repeat(self.starts[ids] - (ends - widths), widths) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.flat[at].tobytes()


_tokenizers: dict[tuple[str, str], Tokenizer] = {}
REMEMBERED["bpe"] = _tokenizers.clear
AT_END["bpe"] = lambda: [t.forget() for t in _tokenizers.values()]


def tokenizer(path: str, pattern: str) -> Tokenizer:
    """One tokenizer for each vocabulary file and Python worker, kept between tasks."""
    if (path, pattern) not in _tokenizers:
        _tokenizers[path, pattern] = Tokenizer(Ranks.from_file(path), pattern)
    return _tokenizers[path, pattern]


def encode_texts(df: DataFrame, path: str, pattern: str, text: str = "text", keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """Adds ``ids`` (binary, little-endian unsigned 32-bit) to the kept columns.

    Null texts count as empty and give no ids. Rows are kept one by one, repeated ones too; other
    columns pass only if named in ``keep``. The vocabulary file has to lie at ``path`` on every
    executor (it comes with an installed package).
    """

    def make():
        tok = tokenizer(path, pattern)

        def fn(part):
            texts = part.column(part.schema.get_field_index(text)).to_pylist()
            return {"ids": pa.array(tok.encode_all([t or "" for t in texts]), pa.binary())}

        return fn

    return map_slices(df.select(*dict.fromkeys([*keep, text])), make, "ids binary", keep, text, remembers="bpe")


def round_trip_digests(df: DataFrame, path: str, pattern: str, text: str = "text", keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """Encodes each text, decodes the ids again, and returns digests of both with the kept columns:
    n_tokens, ids_sha256, decoded_sha256. Null texts count as empty."""

    def make():
        tok = tokenizer(path, pattern)

        def fn(part):
            n, a, b = [], [], []
            for ids in tok.encode_all([t or "" for t in part.column(part.schema.get_field_index(text)).to_pylist()]):
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(tok.decode(ids)).hexdigest())
            return {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": a, "decoded_sha256": b}

        return fn

    return map_slices(df.select(*dict.fromkeys([*keep, text])), make, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", keep, text, remembers="bpe")


def public_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), *public_vocabulary())


QUERIES = {"op7_bpe": op7_bpe}
SQL: dict[str, str] = {}
