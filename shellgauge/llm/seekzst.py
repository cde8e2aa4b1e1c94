"""Token ids in files of independent zstandard frames with a trailing seek table.

A file holds documents in ascending key order. Each document is a frame of its own (several, if it has more than
FRAME_IDS ids): its ids as little-endian unsigned 32-bit integers, with zstandard's content checksum. After
the documents comes a skippable frame with the documents' keys, numbers of frames and of ids, and at the end the seek table in the
public seekable format: a skippable frame with compressed size, size and checksum (low 32 bits of XXH64) of every frame
before it, and a footer. Any zstandard decoder can read the whole file; a reader that wants some documents
reads the two tables at the end, then only these documents' bytes, and decompresses only their frames.

Documents are ordered by a range partitioning of key, hash of the text and a random number, so that rows of one key or
equal rows can be parted; a task writes its range to files of about FILE_BYTES with unique names, and the table of files is
written by Spark's committer, so files of lost or repeated tasks are never read. Positions over all documents follow
from the files' sums: a window over one row a file.

Texts are encoded by the tokenizers library, word by word between white space, which the tokenizer drops; a worker remembers words.
Words in which each character is known to be treated alone (SAFE) are lower-cased and cut by the tokenizer's own pattern, and
its model is asked for each piece; the library encodes each other word whole.

Null texts are empty and have the end id only. Null keys come first. Rows of one key are ordered by their text's hash; repeated
rows are kept, each as a document. Other columns are not read. An empty table gives no files and no rows.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import REMEMBERED, fresh_path, slices, tidy

FILE_BYTES = 64 << 20
FRAME_IDS = 1 << 24
#: Bytes that a reader of whole files takes at once, about.
STEP = 4 << 20
END_ID = 1
# The seekable format's magic numbers; the skippable frame of documents takes the first free one.
SEEK_TABLE, SEEKABLE, DOCUMENTS = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
CHECKSUMS = 0x80
_entry, _document = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")]), np.dtype([("key", "<i8"), ("known", "u1"), ("frames", "<u4"), ("ids", "<u8")])

#: Memory, in bytes, for the words that a worker remembers, and about what one takes. Longer words than LONG_WORD aren't remembered.
WORD_MEMORY, ENTRY, LONG_WORD = 240 << 20, 220, 100
#: Characters that the tokenizer treats alone and as Python does: printable ASCII, Latin letters with one lower case, and white space.
SAFE = r"[\x20-\x7E\n\r\t\xC0-\xFFĀ-įĲ-ňŊ-ž]*"


class SeekError(ValueError):
    pass


class Encoder:
    """Ids of whole texts, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        pattern = made["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern).findall
        self.words = regex.compile(r"[^ \t\n\r]+").findall
        self.safe = regex.compile(SAFE).fullmatch
        self.marks = sorted({t["content"][:2] for t in made["added_tokens"]})
        self.alphabet = self._alphabet()
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _alphabet(self) -> list[str]:
        """The character that the tokenizer's model has for each byte, asked from the library's byte-level step."""
        from tokenizers.pre_tokenizers import ByteLevel

        step, of = ByteLevel(add_prefix_space=False, use_regex=False), [""] * 256
        for code in [*range(0x21, 0x7F), *range(0xC0, 0x180)]:
            data, shown = chr(code).encode(), step.pre_tokenize_str(chr(code))[0][0]
            for b, c in zip(data, shown, strict=True):
                of[b] = c
        return of

    def is_safe(self, text: str) -> bool:
        return self.safe(text) is not None and not any(m in text for m in self.marks)

    def _kept(self, key: str, packed: bytes) -> bytes:
        if len(self.cache) * ENTRY >= WORD_MEMORY // 2:
            self.older, self.cache = self.cache, {}
        self.cache[key] = packed
        return packed

    def plain(self, word: str) -> bytes:
        """Ids of a lower-cased word of safe characters that isn't in the cache: those of its pieces."""
        packed = self.older.get(word)
        if packed is None:
            parts = self.pieces(word)
            packed = b"".join([self.cache.get(p) or self.plain(p) for p in parts]) if len(parts) > 1 else self._asked(word)
        return self._kept(word, packed) if len(word) <= LONG_WORD else packed

    def _asked(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else "".join([self.alphabet[b] for b in piece.encode()])
        ids = [t.id for t in self.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def word(self, word: str) -> bytes:
        """Ids of a word between white space with other characters; remembered under a key that no piece has."""
        key = " " + word
        packed = self.cache.get(key)
        if packed is not None:
            return packed
        packed = self.older.get(key)
        if packed is None:
            packed = np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        return self._kept(key, packed) if len(word) <= LONG_WORD else packed

    def _plain_text(self, text: str) -> bytes:
        # no word has empty ids, as each of its characters is in some piece
        return b"".join([self.cache.get(w) or self.plain(w) for w in text.lower().split()])

    def encode(self, text: str) -> bytes:
        if self.is_safe(text):
            return self._plain_text(text)
        return b"".join([self._plain_text(w) if self.is_safe(w) else self.word(w) for w in self.words(text)])


_encoders: dict[str, Encoder] = {}
REMEMBERED["seekzst"] = _encoders.clear


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def checksum(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class Writer:
    """One file. stream has write(bytes)."""

    def __init__(self, stream, level: int = 1):
        import zstandard

        self.stream = stream
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.frames, self.documents = bytearray(), bytearray()
        self.bytes = self.ids = self.n = 0

    def _entry(self, packed: int, size: int, check: int) -> None:
        self.frames += struct.pack("<3I", packed, size, check)
        self.bytes += packed

    def add(self, key: int | None, ids: bytes) -> None:
        step = 4 * FRAME_IDS
        parts = [ids[i : i + step] for i in range(0, len(ids), step)] or [b""]
        for part in parts:
            packed = self.packer.compress(part)
            self.stream.write(packed)
            self._entry(len(packed), len(part), checksum(part))
        self.documents += struct.pack("<qBIQ", key or 0, key is not None, len(parts), len(ids) // 4)
        self.ids += len(ids) // 4
        self.n += 1

    def close(self) -> None:
        self.stream.write(struct.pack("<2I", DOCUMENTS, len(self.documents)) + self.documents)
        self._entry(8 + len(self.documents), 0, checksum(b""))
        table = bytes(self.frames) + struct.pack("<IBI", len(self.frames) // 12, CHECKSUMS, SEEKABLE)
        self.stream.write(struct.pack("<2I", SEEK_TABLE, len(table)) + table)
        self.bytes += 8 + len(table)


class Reader:
    """One file. stream has seek(n), read(n) and size()."""

    def __init__(self, stream, name: str = ""):
        import zstandard

        self.stream, self.name = stream, name
        self.unpacker = zstandard.ZstdDecompressor()
        size = stream.size()
        foot = self._read(size - 9, 9) if size >= 17 else b""
        if len(foot) < 9 or foot[5:] != struct.pack("<I", SEEKABLE) or foot[4] != CHECKSUMS:
            self._fail("no seek table with checksums at its end")
        n = int.from_bytes(foot[:4], "little")
        begin = size - 9 - 12 * n - 8
        if n < 1 or begin < 0 or self._read(begin, 8) != struct.pack("<2I", SEEK_TABLE, 12 * n + 9):
            self._fail("a damaged seek table")
        self.table = np.frombuffer(self._read(begin + 8, 12 * n), _entry)
        self.starts = np.concatenate([[0], np.cumsum(self.table["packed"].astype(np.int64))])
        if self.starts[-1] != begin:
            self._fail("frames that don't fill it up to its seek table")
        last = self._read(int(self.starts[-2]), int(self.table["packed"][-1]))
        if last[:8] != struct.pack("<2I", DOCUMENTS, len(last) - 8):
            self._fail("no table of documents")
        self.documents = np.frombuffer(last[8:], _document)
        self.first = np.concatenate([[0], np.cumsum(self.documents["frames"].astype(np.int64))])
        if self.first[-1] != n - 1:
            self._fail("a table of documents that doesn't fit its frames")

    def _fail(self, why: str):
        raise SeekError(f"{self.name}: {why}")

    def _read(self, at: int, n: int) -> bytes:
        self.stream.seek(at)
        got = self.stream.read(n)
        if len(got) != n:
            self._fail("it ends too early")
        return got

    def keys(self) -> list[int | None]:
        return [int(d["key"]) if d["known"] else None for d in self.documents]

    def _unpacked(self, i: int, data: bytes, at: int, end: int) -> bytes:
        """The ids of document i, whose frames lie in data from ``at``."""
        import zstandard

        out = []
        for k in range(self.first[i], self.first[i + 1]):
            packed, size, check = (int(x) for x in self.table[k])
            try:
                part = self.unpacker.decompress(data[at : at + packed], max_output_size=size)
            except zstandard.ZstdError as e:
                self._fail(f"frame {k}: {e}")
            if len(part) != size or checksum(part) != check:
                self._fail(f"frame {k}: its size or checksum differs")
            out.append(part)
            at += packed
        ids = b"".join(out)
        if at != end or len(ids) != 4 * int(self.documents["ids"][i]):
            self._fail(f"document {i}: its length differs")
        return ids

    def document(self, i: int) -> bytes:
        """The ids of one document; nothing else of the file is read."""
        begin, end = (int(self.starts[self.first[k]]) for k in (i, i + 1))
        return self._unpacked(i, self._read(begin, end - begin), 0, end - begin)

    def __iter__(self) -> Iterator[bytes]:
        """The ids of all documents in order, read in steps."""
        i, n = 0, len(self.documents)
        ends = self.starts[self.first]
        while i < n:
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + STEP, "right")) - 1)
            begin = int(ends[i])
            data = self._read(begin, int(ends[j]) - begin)
            for k in range(i, j):
                yield self._unpacked(k, data, int(ends[k]) - begin, int(ends[k + 1]) - begin)
            i = j


FILES = "part int, seq int, file string, documents bigint, ids bigint, bytes bigint, first_key bigint, last_key bigint"


def write_tokens(df: DataFrame, folder: str, path: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encodes all texts and writes their files; returns the table of files in order, with ``before``: the ids of all files before."""
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("r", F.rand(11))
    ordered = rows.repartitionByRange(F.col("key").asc_nulls_first(), "hash", "r").sortWithinPartitions(F.col("key").asc_nulls_first(), "hash").select("key", "text")
    end = struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part, tok = TaskContext.get().partitionId(), encoder(path)
        out = stream = name = first = last = None
        done: list[tuple] = []

        def close():
            out.close()
            stream.close()
            done.append((part, len(done), name, out.n, out.ids, out.bytes, first, last))

        for batch in batches:
            for some in slices(batch, 1, STEP):
                for k, t in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    if out is None or out.bytes >= file_bytes:
                        if out is not None:
                            close()
                        name, first = f"{uuid.uuid4().hex}.zst", k
                        stream = store.open_output_stream(f"{root}/{name}", compression=None)
                        out = Writer(stream)
                    out.add(k, tok.encode(t) + end)
                    last = k
        if out is not None:
            close()
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        cols = list(zip(*done, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in FILES.split(", ")])

    place = fresh_path(spark, "token-files")
    ordered.mapInArrow(tidy(write, "seekzst"), FILES).write.parquet(place)
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.schema(FILES).parquet(place).withColumn("before", F.coalesce(F.sum("ids").over(before), F.lit(0)))


DOCUMENT = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary"


def read_tokens(files: DataFrame, folder: str, ids: bool = True, wanted: Iterable[int] | None = None) -> DataFrame:
    """Documents of the files with their place among all ids and a checksum; without ``ids``, that column is null.

    ``wanted`` names keys (a request, not a table): then only files whose range has one of them are opened, and of these only the
    tables and the documents asked for are read.
    """
    ask = None if wanted is None else sorted(set(wanted))
    names, kinds = [c.split()[0] for c in DOCUMENT.split(", ")], (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for some in batches:
            for name, before in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{name}") as stream:
                    file = Reader(stream, name)
                    keys = file.keys()
                    starts = before + np.concatenate([[0], np.cumsum(file.documents["ids"].astype(np.int64))])
                    if ask is None:
                        found = enumerate(file)
                    else:
                        asked = frozenset(ask)
                        found = ((i, file.document(i)) for i, k in enumerate(keys) if k in asked)
                    rows, held = [], 0
                    for i, data in found:
                        rows.append((keys[i], int(starts[i]), len(data) // 4, zlib.crc32(data), data if ids else None))
                        held += len(data) if ids else 100
                        if held > STEP:
                            yield batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch(rows)

    spark = files.sparkSession
    if ask is not None:
        # the range of a file may begin with null keys; those are never asked for
        files = files.where(F.exists(F.array(*[F.lit(k) for k in ask]), lambda k: (F.coalesce("first_key", F.lit(-(1 << 63))) <= k) & (F.col("last_key") >= k))) if ask else files.where("false")
    number = max(1, files.count())
    return files.select("file", "before").repartition(min(number, 16 * spark.sparkContext.defaultParallelism), "file").mapInArrow(read, DOCUMENT)


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op11_seekable_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "tokens")
    files = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_vocabulary())
    return read_tokens(files, folder, ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES = {"op11_seekable_zstd": op11_seekable_zstd}
SQL: dict[str, str] = {}
