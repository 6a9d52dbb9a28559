"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a file ends in the seekable format's skippable frame, whose
seek table lists each frame's compressed and plain size, and a second table maps record ids to frame and
frame-relative offset. So one record is read by decompressing one frame.

Records of equal payloads of at least MIN_REVISIT bytes are stored once: the largest page_id is the response, the
others are revisits that name it. Equality is that of SHA-1 and length. Pages are shuffled once, by page and
payload, evenly however many copies a payload has; what decides about copies are rows without payload, summed
before they move, and payloads with over 1 / HOT_SHARE of all rows, of which there are at most HOT_SHARE, are
joined by broadcast.

A null html is an empty payload, a null url leaves out the target header, control characters of a url are
escaped. Null page_ids are not revisited (they cannot be named) but are revisits themselves where a payload has a
named response; repeated rows are written each. Further columns are ignored; an empty table gives no records.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import common

MIN_REVISIT, HOT_SHARE = 1000, 256
FRAME_BYTES, FRAME_RECORDS, FILE_BYTES = 1 << 18, 128, 64 << 20
SKIPPABLE, SEEK_MAGIC, INDEX_MAGIC = 0x184D2A5E, 0x8F92EAB1, 0x184D2A5D
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None) -> str:
    return f"urn:page:{'none' if page_id is None else page_id}"


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 record; a revisit has no payload but keeps its digest and length."""
    head = [b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), f"WARC-Record-ID: <{record_id(page_id)}>".encode(), b"WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(b"WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url).encode())
    head += [f"WARC-Payload-Digest: sha1:{digest}".encode(), f"X-Payload-Length: {len(payload)}".encode(), b"Content-Type: application/http;msgtype=response"]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: <{record_id(refers_to)}>".encode(), f"WARC-Profile: {REVISIT}".encode()]
    head.append(f"Content-Length: {len(block)}".encode())
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at a position, and where the next begins."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    head = dict(x.split(": ", 1) for x in lines[1:])
    size = int(head["Content-Length"])
    block = data[end + 4 : end + 4 + size]
    if len(block) < size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
        raise ValueError("broken WARC record")
    return head, block, end + 8 + size


class Bundle:
    """Writes one file: frames of records, the record index and the seek table."""

    def __init__(self, stream, level: int = 3):
        self.stream, self.press = stream, zstandard.ZstdCompressor(level=level)
        self.held, self.plain, self.frames, self.index, self.sent = [], 0, [], [], 0

    def add(self, key: str, record: bytes) -> None:
        self.index.append((key, len(self.frames), self.plain))
        self.held.append(record)
        self.plain += len(record)
        if self.plain >= FRAME_BYTES or len(self.held) >= FRAME_RECORDS:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            frame = self.press.compress(b"".join(self.held))
            self.stream.write(frame)
            self.frames.append((len(frame), self.plain))
            self.sent += len(frame)
            self.held, self.plain = [], 0

    def close(self) -> None:
        self._flush()
        ids = self.press.compress("\n".join(f"{k} {f} {o}" for k, f, o in self.index).encode())
        self.stream.write(struct.pack("<2I", INDEX_MAGIC, len(ids)) + ids)
        self.frames.append((len(ids) + 8, 0))
        table = b"".join(struct.pack("<2I", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEK_MAGIC)
        self.stream.write(struct.pack("<2I", SKIPPABLE, len(table)) + table)
        self.stream.close()


class Reader:
    """Reads frames or single records of a bundle through its seek table and index."""

    def __init__(self, file):
        self.file, end = file, file.size()
        n, _, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table")
        pairs = np.frombuffer(self._at(end - 9 - 8 * n, 8 * n), "<u4").reshape(n, 2).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(pairs[:, 0])])
        self.frames = [(int(s), int(c), int(p)) for s, (c, p) in zip(starts, pairs, strict=False)][:-1]
        self.ids_at = int(starts[-2]), int(pairs[-1, 0])

    def _at(self, start: int, size: int) -> bytes:
        self.file.seek(start)
        return self.file.read(size)

    def frame(self, k: int) -> bytes:
        start, size, plain = self.frames[k]
        return zstandard.ZstdDecompressor().decompress(self._at(start, size), max_output_size=plain)

    def index(self) -> dict[str, tuple[int, int]]:
        start, size = self.ids_at
        lines = zstandard.ZstdDecompressor().decompress(self._at(start + 8, size - 8)).decode().split("\n")
        return {k: (int(f), int(o)) for k, f, o in (x.split(" ") for x in lines if x)}

    def record(self, key: str) -> tuple[dict[str, str], bytes]:
        frame, offset = self.index()[key]
        return parse_record(self.frame(frame), offset)[:2]


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        task, n, made, out, name = TaskContext.get(), 0, [], None, ""

        def close():
            out.close()
            fs.move(f"{root}/.{task.taskAttemptId()}-{name}", f"{root}/{name}")
            made.append(f"{folder}/{name}")

        for batch in batches:
            for k in range(batch.num_rows):
                page, url, digest, refers = (batch.column(i)[k].as_py() for i in (0, 1, 3, 4))
                html = batch.column(2)[k]
                if out is None:
                    name = f"part-{task.partitionId():06d}-{n:04d}.warc.zst"
                    out = Bundle(fs.open_output_stream(f"{root}/.{task.taskAttemptId()}-{name}", compression=None))
                out.add(record_id(page), build_record(page, url, html.as_buffer().to_pybytes() if html.is_valid else b"", digest, refers))
                if out.sent > FILE_BYTES:
                    close()
                    out, n = None, n + 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["path"])

    return run


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def page(text: str | None) -> int | None:
        x = text and text[len("<urn:page:") : -1]
        return int(x) if x and x != "none" else None

    for batch in batches:
        for path in batch.column(0).to_pylist():
            fs, at = pafs.FileSystem.from_uri(path)
            with fs.open_input_file(at) as f:
                bundle = Reader(f)
                for k in range(len(bundle.frames)):
                    data, pos, rows = bundle.frame(k), 0, []
                    while pos < len(data):
                        head, block, pos = parse_record(data, pos)
                        digest, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
                        if head["WARC-Type"] == "response":
                            payload = block[block.index(b"\r\n\r\n") + 4 :]
                            digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
                        rows.append((page(head["WARC-Record-ID"]), size, digest, head["WARC-Type"], page(head.get("WARC-Refers-To"))))
                    cols = list(zip(*rows, strict=True))
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def with_refers(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest and refers_to, the page that holds the payload where it is another one."""
    keyed = pages.withColumn("digest", F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")))
    # what decides about copies is read from this table, so payloads are hashed twice only: here and where they are written
    rows = common.materialize(keyed.select("page_id", "digest", F.coalesce(F.octet_length("html"), F.lit(0)).alias("size")), "payloads")
    group = rows.where(F.col("size") >= MIN_REVISIT).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies")).where("copies > 1")
    group = common.materialize(group, "copies")
    limit = rows.count() // HOT_SHARE
    hot = F.broadcast(group.where(F.col("copies") > limit).select("digest", F.col("keeper").alias("hot_keeper")))  # at most HOT_SHARE rows
    cold = group.where(F.col("copies") <= limit).select("digest", "keeper")
    light = rows.join(hot, "digest", "left")
    few = light.where("hot_keeper is null").join(cold, "digest").select("page_id", "digest", "keeper")
    many = light.where("hot_keeper is not null").select("page_id", "digest", F.col("hot_keeper").alias("keeper"))
    refers = few.unionByName(many).where(~F.col("page_id").eqNullSafe(F.col("keeper"))).distinct()
    r = refers.select(F.col("page_id").alias("r_page"), F.col("digest").alias("r_digest"), F.col("keeper").alias("refers_to"))
    return keyed.join(r, F.col("page_id").eqNullSafe(F.col("r_page")) & (F.col("digest") == F.col("r_digest")), "left").select("page_id", "url", "html", "digest", "refers_to")


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages (page_id, url, html) as bundles into folder, a URI of shared storage; returns their paths."""
    common.small_batches(pages.sparkSession, 500)
    d = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    return common.materialize(with_refers(d).mapInArrow(_writer(folder), "path string"), "warc-files")


def read_warc(files: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to; responses are hashed anew."""
    n = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return files.repartition(n, "path").mapInArrow(_reader, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op7_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_warc(write_warc(spark.read.parquet(common.table_path(sf_dir, "pages")), common.new_path(spark, "warc")))


OP7_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS keeper FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to FROM k
"""
