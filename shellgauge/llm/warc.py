"""WARC archives: writing pages with revisit records, and a sequential reader.

Every page becomes one record, and every record one gzip member. Of pages with equal payloads of at
least ``min_revisit`` bytes, the one with the largest page id (of equal ids, the largest row key) is stored as a response,
the others as revisits that refer to it and have no payload. Groups of equal payloads are found by
digest: page ids are summed up map-side, so a payload that a third of all pages have makes no large
group. Only digests that several pages have are joined back to the pages: by broadcast if they are at most
BROADCAST_DIGESTS, else by a shuffle whose skewed partitions Spark splits.

Each task writes its records to files of its own (about FILE_BYTES each) with unique names in the shared folder
and returns their names; the names are written as a table by Spark's committer, so files of lost or
repeated tasks are never read.

The reader takes one file after another: it decompresses member by member in small steps, parses
the header, takes exactly Content-Length bytes as block, checks that the member ends after it, and verifies
block and payload digests. A damaged archive raises WarcError with the file's name.

Null payloads are empty payloads, null page ids stay null and count as the smallest, null urls have no
target. Repeated rows give a record each. An empty table gives no files and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, slices

FILE_BYTES = 64 << 20
BROADCAST_DIGESTS = 200_000
STEP = 1 << 16
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    pass


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _line(value: str) -> str:
    """A header value: percent-encodes what would end the line."""
    return "".join(c if c not in "\r\n%" else f"%{ord(c):02X}" for c in value)


def _unline(value: str) -> str:
    return value.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")


def record_id(name, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name} {payload_digest}')}>"


def record(kind: str, page_id, url: str | None, payload: bytes, payload_digest: str, payload_bytes: int, refers_to=None, date: str = DATE) -> bytes:
    """One record as a gzip member. A revisit's block ends with the HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    own = record_id(page_id, payload_digest) if kind == "response" else record_id(f"{page_id} {url} revisit", payload_digest)
    fields = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", date)]
    fields += [("WARC-Target-URI", _line(url))] if url is not None else []
    fields += [("WARC-Page-ID", str(page_id))] if page_id is not None else []
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, payload_digest))] + ([("WARC-Refers-To-Page", str(refers_to))] if refers_to is not None else [])
    fields += [("WARC-Payload-Digest", f"sha1:{payload_digest}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(head.encode() + block + b"\r\n\r\n") + c.flush()


class Reader:
    """Records of one archive: (fields, block). stream has read(n)."""

    def __init__(self, stream, name: str = ""):
        self.stream, self.name = stream, name
        self.raw = b""

    def _fail(self, why: str):
        raise WarcError(f"{self.name}: {why}")

    def _member(self) -> Iterator[bytes]:
        """The decompressed parts of the member that begins here, at most STEP bytes each."""
        d = zlib.decompressobj(31)
        while not d.eof:
            if not self.raw:
                self.raw = self.stream.read(STEP)
                if not self.raw:
                    self._fail("it ends within a gzip member")
            try:
                part = d.decompress(self.raw, STEP)
            except zlib.error as e:
                self._fail(f"not a gzip member ({e})")
            self.raw = d.unused_data if d.eof else d.unconsumed_tail
            if part:
                yield part

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        while True:
            if not self.raw:
                self.raw = self.stream.read(STEP)
                if not self.raw:
                    return
            parts = self._member()
            head = b""
            while b"\r\n\r\n" not in head:
                part = next(parts, None)
                if part is None:
                    self._fail("a record without header end")
                head += part
            head, _, rest = head.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                self._fail("a record without version line")
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            if not fields.get("content-length", "").isdigit():
                self._fail("a record without Content-Length")
            length = int(fields["content-length"])
            block, seen, sha = [], 0, hashlib.sha1()
            tail = b""
            for part in (p for source in ([rest], parts) for p in source):
                take = part[: length - seen]
                if take:
                    sha.update(take)
                    block.append(take)
                    seen += len(take)
                tail += part[len(take) :]
            if seen < length:
                self._fail("a block shorter than its Content-Length")
            if tail != b"\r\n\r\n":
                self._fail("a record with more than its Content-Length")
            told = fields.get("warc-block-digest")
            if told and told != f"sha1:{base64.b32encode(sha.digest()).decode()}":
                self._fail("a block whose digest differs")
            yield fields, b"".join(block)


def http_payload(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, payload = block.partition(b"\r\n\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}, payload


def revisits(pages: DataFrame, row_key: Column, key: str = "page_id", html: str = "html", url: str = "url", min_revisit: int = 0) -> DataFrame:
    """page_id, url, html, refers_to, is_revisit of each page. row_key tells rows with one page id apart."""
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), body.alias("html"), F.sha1(body.cast("binary")).alias("sha"), F.struct(F.col(key).alias("p"), row_key.alias("r")).alias("me"))
    large = rows.where(F.octet_length("html") >= min_revisit)
    shared = large.groupBy("sha").agg(F.max("me").alias("kept"), F.count("*").alias("n")).where("n > 1").select("sha", "kept").persist()
    small = shared.count() <= BROADCAST_DIGESTS
    out = rows.join(F.broadcast(shared) if small else shared, "sha", "left")
    revisit = F.col("kept").isNotNull() & (F.octet_length("html") >= min_revisit) & ~F.col("me").eqNullSafe(F.col("kept"))
    return out.select("page_id", "url", "html", revisit.alias("is_revisit"), F.when(revisit, F.col("kept.p")).alias("refers_to"))


def write_archives(rows: DataFrame, folder: str, file_bytes: int = FILE_BYTES, date: str = DATE) -> DataFrame:
    """Writes the result of revisits() and returns the written files: file, records, bytes."""
    spark = rows.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out = name = None
        done: list[tuple[str, int, int]] = []
        records = size = 0

        def close():
            out.close()
            done.append((name, records, size))

        for batch in batches:
            for part in slices(batch, batch.schema.get_field_index("html"), 4 << 20):
                for r in part.to_pylist():
                    if out is None or size >= file_bytes:
                        if out is not None:
                            close()
                        name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    payload = r["html"].encode()
                    made = record("revisit" if r["is_revisit"] else "response", r["page_id"], r["url"], payload, digest(payload), len(payload), r["refers_to"], date)
                    out.write(made)
                    records, size = records + 1, size + len(made)
        if out is not None:
            close()
        cols = list(zip(*done, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["file", "records", "bytes"])

    names = fresh_path(spark, "warc-files")
    rows.mapInArrow(write, "file string, records bigint, bytes bigint").write.parquet(names)
    return spark.read.schema("file string, records bigint, bytes bigint").parquet(names)


RECORDS = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


def read_archives(files: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of all files, one file after another in each task. Without payloads, that column is null."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        names = [c.split()[0] for c in RECORDS.split(", ")]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for files_ in batches:
            for name in files_.column(0).to_pylist():
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    rows, held = [], 0
                    for fields, block in Reader(stream, name):
                        http, payload = http_payload(block)
                        told = fields["warc-payload-digest"].removeprefix("sha1:")
                        kind = fields["warc-type"]
                        if kind == "response" and (digest(payload) != told or len(payload) != int(http["content-length"])):
                            raise WarcError(f"{name}: a payload whose digest or length differs")
                        page, refers = fields.get("warc-page-id"), fields.get("warc-refers-to-page")
                        url = fields.get("warc-target-uri")
                        rows.append((None if page is None else int(page), None if url is None else _unline(url), kind, None if refers is None else int(refers), int(http["content-length"]), told, payload if payloads and kind == "response" else None))
                        held += len(block)
                        if held > 4 << 20 or len(rows) >= 5000:
                            yield batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch(rows)

    spark = files.sparkSession
    number = max(1, files.count())
    return files.select("file").repartition(min(number, 16 * spark.sparkContext.defaultParallelism), "file").mapInArrow(read, RECORDS)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    row_key = F.concat_ws(":", F.col("_metadata.file_name"), F.lpad(F.col("_metadata.row_index").cast("string"), 19, "0"))
    folder = fresh_path(spark, "warc")
    files = write_archives(revisits(pages, row_key), folder)
    return read_archives(files, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _sql() -> str:
    # base32 by five bits at a time of the hex digest
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    bits = "list_reduce(list_transform(range(1, 41), lambda i: lpad(bin(instr('0123456789abcdef', substr(sha, i, 1)) - 1), 4, '0')), lambda a, b: a || b)"
    letters = f"list_reduce(list_transform(range(0, 32), lambda k: substr('{alphabet}', list_reduce(list_transform(range(1, 6), lambda j: instr('01', substr(bits, k * 5 + j, 1)) - 1), lambda a, b: a * 2 + b)::integer + 1, 1)), lambda a, b: a || b)"
    return f"""
with h as (select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as sha from pages),
b as (select sha, bits, max_id from (select sha, max(page_id) as max_id from h group by sha), lateral (select {bits} as bits)),
d as (select sha, max_id, {letters} as payload_digest from b)
select page_id, octet_length(encode(body)) as payload_bytes, payload_digest, case when page_id = max_id then 'response' else 'revisit' end as record_type,
       case when page_id <> max_id then max_id end as refers_to
from h join d using (sha)
"""


QUERIES = {"op2_warc": op2_warc}
SQL: dict[str, str] = {"op2_warc": _sql()}
