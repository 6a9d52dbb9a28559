"""Token-id files coded by a static range asymmetric numeral system (rANS).

One frequency table, counted over all tokens, serves all files. A file holds segments of whole documents in
ascending document order; a segment's ids are cut into independent blocks, each coded by interleaved 64-bit lanes
that renormalise by 32-bit words. A block carries its lanes' states at its start and at each checkpoint with the
place in the word stream, and a CRC-32 of the ids between checkpoints, so blocks and the runs between checkpoints
decode in parallel and are verified on their own. The table stands beside the files, so a folder can be read by
itself: whole, segment by segment in as many tasks as there are, or any stretch of ids from the checkpoint before it.

Layout, little-endian: table file = TABLE, then the zlib-packed frequencies (u32). Token file = MAGIC, crc32 of the table (u32), segments, each (SEG, head length u32, zlib head,
payload length u64, blocks). The head has, as int64, document count, first token's index, then doc_ids, null marks
and lengths. Block = tokens u32, lanes u32, checkpoints u32, words u32, per checkpoint (words before u32, crc u32,
states u64 x lanes), then the words u32. All paths are URIs that pyarrow's file systems open.

Null texts are empty documents (the end id alone); null doc_ids come first; repeated doc_ids follow one another by
text; further columns are ignored; an empty table gives no token files and an empty result.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import common, tokens

MAGIC, SEG, TABLE = b"TSRANS01", b"SEG1", b"TSRTAB01"
TABLE_NAME = "frequencies.table"
SCALE = 20
LOW = 1 << 31
LANES, STEPS, CHECK = 1024, 256, 128
SEGMENT_TOKENS = 1 << 18
END_ID = 2


class Table:
    """Frequencies of ids, scaled to sum 2**SCALE; each id that occurs keeps at least 1."""

    def __init__(self, counts: np.ndarray):
        counts = np.asarray(counts, np.float64)
        freq = np.zeros(len(counts), np.int64)
        seen = np.flatnonzero(counts)
        if len(seen):
            freq[seen] = np.maximum(1, np.floor(counts[seen] / counts.sum() * (1 << SCALE))).astype(np.int64)
            order = seen[np.argsort(-freq[seen], kind="stable")]
            spare = (1 << SCALE) - int(freq.sum())
            k = 0
            while spare:  # what rounding left goes to, or comes from, the most frequent ids
                i = order[k % len(order)]
                step = spare if spare > 0 else -min(-spare, int(freq[i]) - 1)
                freq[i] += step
                spare -= step
                k += 1
        self._set(freq)

    def _set(self, freq: np.ndarray) -> None:
        self.freq = freq.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64) if len(freq) else self.freq
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())
        self.pad = int(freq.argmax()) if len(freq) else 0

    def to_bytes(self) -> bytes:
        return TABLE + zlib.compress(self.freq.astype("<u4").tobytes())

    @classmethod
    def from_bytes(cls, data: bytes) -> Table:
        if data[: len(TABLE)] != TABLE:
            raise ValueError("not a frequency table")
        table = cls.__new__(cls)
        table._set(np.frombuffer(zlib.decompress(data[len(TABLE) :]), "<u4").astype(np.int64))
        return table


@functools.cache
def load_table(folder: str) -> Table:
    """The table of a folder of token files, once for a worker process."""
    fs, root = pafs.FileSystem.from_uri(folder)
    with fs.open_input_stream(f"{root}/{TABLE_NAME}") as f:
        return Table.from_bytes(f.read())


def encode_block(ids: np.ndarray, table: Table) -> bytes:
    """One independent block of at least one id."""
    n = len(ids)
    lanes = max(1, min(LANES, n // 64))
    steps = -(-n // lanes)
    grid = np.full(steps * lanes, table.pad, np.int64)
    grid[:n] = ids
    grid = grid.reshape(steps, lanes)
    x = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    marks: dict[int, tuple[int, np.ndarray]] = {}
    sent, shift, low32 = 0, np.uint64(SCALE), np.uint64(0xFFFFFFFF)
    for t in range(steps - 1, -1, -1):
        f, c = table.freq[grid[t]], table.cum[grid[t]]
        big = x >= (f << np.uint64(63 - SCALE))
        w = (x[big] & low32).astype(np.uint32)
        words.append(w)
        sent += len(w)
        x = np.where(big, x >> np.uint64(32), x)
        q = x // f
        x = (q << shift) + (x - q * f) + c
        if t % CHECK == 0:
            marks[t] = (sent, x.copy())
    out = [struct.pack("<4I", n, lanes, len(marks), sent)]
    raw = np.ascontiguousarray(ids, "<u4")
    for t in sorted(marks):
        behind, states = marks[t]
        out.append(struct.pack("<2I", sent - behind, zlib.crc32(raw[t * lanes : (t + CHECK) * lanes])) + states.astype("<u8").tobytes())
    out += [w.astype("<u4").tobytes() for w in reversed(words)]
    return b"".join(out)


def decode_run(states: np.ndarray, words: np.ndarray, steps: int, table: Table) -> tuple[np.ndarray, np.ndarray]:
    """The ids of steps steps from a checkpoint's states and the words that follow it, and the states then."""
    x, at, lanes = states.astype(np.uint64), 0, len(states)
    out = np.empty((steps, lanes), np.uint32)
    mask, shift, low, half = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(LOW), np.uint64(32)
    for t in range(steps):
        slot = x & mask
        s = table.symbol[slot.astype(np.int64)]
        out[t] = s
        x = table.freq[s] * (x >> shift) + slot - table.cum[s]
        need = np.flatnonzero(x < low)
        x[need] = (x[need] << half) | words[at : at + len(need)]
        at += len(need)
    return out.reshape(-1), x


def decode_block(data: memoryview, at: int, table: Table, lo: int = 0, hi: int | None = None) -> tuple[np.ndarray, int]:
    """The ids lo to hi of the block at a byte position, and where the next begins; raises on a wrong checksum.

    Only the runs that hold some of them are decoded, each from its own checkpoint.
    """
    n, lanes, marks, sent = struct.unpack_from("<4I", data, at)
    hi, at, heads = n if hi is None else min(hi, n), at + 16, []
    for _ in range(marks):
        before, crc = struct.unpack_from("<2I", data, at)
        heads.append((before, crc, np.frombuffer(data, "<u8", lanes, at + 8)))
        at += 8 + 8 * lanes
    steps, size, parts = -(-n // lanes), CHECK * lanes, []
    for k in range(lo // size, -(-hi // size)) if lo < hi else ():
        before, crc, states = heads[k]
        last = k + 1 == len(heads)
        words = np.frombuffer(data, "<u4", (sent if last else heads[k + 1][0]) - before, at + 4 * before).astype(np.uint64)
        part, then = decode_run(states, words, min(CHECK, steps - k * CHECK), table)
        part = part[: n - k * size]
        # the coder began where the decoder ends: at the next checkpoint's states, or at LOW
        if zlib.crc32(part) != crc or (then != (LOW if last else heads[k + 1][2])).any():
            raise ValueError(f"checksum of checkpoint {k} differs")
        parts.append(part[max(0, lo - k * size) : hi - k * size])
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32), at + 4 * sent


def encode_segment(doc_ids: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, start: int, ids: np.ndarray, table: Table) -> bytes:
    head = zlib.compress(np.concatenate([[len(doc_ids), start], doc_ids, nulls, lengths]).astype("<i8").tobytes(), 1)
    step = LANES * STEPS
    body = b"".join(encode_block(ids[k : k + step], table) for k in range(0, len(ids), step))
    return SEG + struct.pack("<I", len(head)) + head + struct.pack("<Q", len(body)) + body


class Segment:
    """A segment of an open token file, at a byte position; its payload is read on demand."""

    def __init__(self, f, at: int):
        f.seek(at)
        if f.read(4) != SEG:
            raise ValueError("broken segment")
        head = np.frombuffer(zlib.decompress(f.read(struct.unpack("<I", f.read(4))[0])), "<i8")
        self.f, self.size = f, struct.unpack("<Q", f.read(8))[0]
        self.body, n = f.tell(), int(head[0])
        self.start, self.doc_ids, self.nulls, self.lengths = int(head[1]), head[2 : 2 + n], head[2 + n : 2 + 2 * n], head[2 + 2 * n :]
        self.n_tokens, self.end = int(self.lengths.sum()), self.body + self.size

    def ids(self, table: Table, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Its ids lo to hi."""
        hi = self.n_tokens if hi is None else min(hi, self.n_tokens)
        self.f.seek(self.body)
        data, at, seen, parts = memoryview(self.f.read(self.size)), 0, 0, []
        while at < self.size:
            n = struct.unpack_from("<I", data, at)[0]
            part, at = decode_block(data, at, table, max(0, lo - seen), max(0, hi - seen))
            parts.append(part)
            seen += n
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def segments_of(f, table: Table) -> Iterator[tuple[int, Segment]]:
    """(byte position, segment) of an open token file, payloads unread."""
    if f.read(8) != MAGIC:
        raise ValueError("not a token file")
    if struct.unpack("<I", f.read(4))[0] != table.crc:
        raise ValueError("the file was coded with another table")
    at, size = 12, f.size()
    while at < size:
        s = Segment(f, at)
        yield at, s
        at = s.end


def read_ids(path: str, first: int, number: int, table: Table | None = None) -> np.ndarray:
    """Those of the corpus's ids first to first + number that a token file holds, decoded from the checkpoints before them."""
    table = table or load_table(path.rpartition("/")[0])
    fs, at = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(at) as f:
        near = [s.ids(table, max(0, first - s.start), first + number - s.start) for _, s in segments_of(f, table) if s.start < first + number and first < s.start + s.n_tokens]
    return np.concatenate(near) if near else np.zeros(0, np.uint32)


SEGMENTS = "pid int, seg int, start long, n_tokens long, doc_ids binary, nulls binary, lengths binary, ids binary"


def _segments(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pid, seg, start, schema = tokens.word_ids(path), TaskContext.get().partitionId(), 0, 0, None
        held: list[tuple] = []

        def flush():
            nonlocal seg, start, held
            ids, lengths = np.concatenate([h[3] for h in held]), np.concatenate([h[2] for h in held])
            row = [pid, seg, start, len(ids), np.concatenate([h[0] for h in held]).tobytes(), np.concatenate([h[1] for h in held]).tobytes(), lengths.tobytes(), ids.tobytes()]
            seg, start, held = seg + 1, start + len(ids), []
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["pid", "seg", "start", "n_tokens", "doc_ids", "nulls", "lengths", "ids"])

        size = 0
        for batch in batches:
            _, off = common.text_buffer(batch.column(1))
            for lo, hi in common.groups(off, 8 << 20):
                key = batch.column(0).slice(lo, hi - lo)
                ids, o = tokens.with_end(*enc.encode(batch.column(1).slice(lo, hi - lo)), end)
                doc, null = np.asarray(key.fill_null(0)).astype(np.int64), np.asarray(key.is_null()).astype(np.int64)
                a = 0
                while a < hi - lo:
                    z = max(a + 1, int(np.searchsorted(o, o[a] + SEGMENT_TOKENS - size, "right")) - 1)
                    held.append((doc[a:z], null[a:z], np.diff(o[a : z + 1]), ids[o[a] : o[z]].astype(np.uint32 if ids.dtype.itemsize > 2 else np.uint16)))
                    size += int(o[z] - o[a])
                    a = z
                    if size >= SEGMENT_TOKENS or a < hi - lo:
                        yield flush()
                        size = 0
        if held:
            yield flush()

    return run


def _id_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for x in batch.column(0):
            n += np.bincount(np.frombuffer(x.as_buffer(), np.uint16), minlength=1 << 16)
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at])], ["id", "n"])


def _writer(table, bases, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, base = table.value, bases.value
        fs, root = pafs.FileSystem.from_uri(folder)
        attempt = TaskContext.get().taskAttemptId()
        out, now, made = None, None, []

        def close():
            out.close()
            fs.move(f"{root}/.{attempt}-{now}", f"{root}/{now}")  # a file appears whole or not at all
            made.append(f"{folder}/{now}")

        last = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["pid"] != last:
                    if out is not None:
                        close()
                    last, now = row["pid"], f"part-{row['pid']:06d}-{row['seg']:06d}.rans"
                    out = fs.open_output_stream(f"{root}/.{attempt}-{now}")
                    out.write(MAGIC + struct.pack("<I", t.crc))
                doc, null, size = (np.frombuffer(row[k], np.int64) for k in ("doc_ids", "nulls", "lengths"))
                out.write(encode_segment(doc, null, size, base[row["pid"]] + row["start"], np.frombuffer(row["ids"], np.uint16), t))
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["path"])

    return run


def write_tokens(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", path: str | None = None, end: int = END_ID) -> DataFrame:
    """Encode texts and write rANS files and their table into folder (a URI of shared storage), ascending by doc_id; returns the files' paths.

    The texts are shuffled once, by range of doc_id; the ids wait in the shared folder until the table is counted.
    To the driver come at most 65,536 counts and one token total for each partition.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    d = d.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    segs = common.materialize(d.mapInArrow(_segments(path or tokens.default_path(), end), SEGMENTS), "tokens")
    common.small_batches(spark, 8)
    try:
        n = segs.select("ids").mapInArrow(_id_counts, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(1 << 16, np.int64)
        counts[n.column("id").to_numpy()] = n.column("n").to_numpy()
        table = Table(counts)
        base, at = {}, 0
        for r in segs.groupBy("pid").agg(F.sum("n_tokens").alias("n")).orderBy("pid").collect():
            base[r.pid] = at
            at += r.n
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{TABLE_NAME}") as f:
            f.write(table.to_bytes())
        share = spark.sparkContext.broadcast
        files = common.materialize(segs.mapInArrow(_writer(share(table), share(base), folder), "path string"), "token-files")
    finally:
        common.small_batches(spark)
    return files


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of the token files of a folder, at most one for each task that wrote."""
    fs, root = pafs.FileSystem.from_uri(folder)
    names = sorted(i.base_name for i in fs.get_file_info(pafs.FileSelector(root)) if re.fullmatch(r"part-\d+-\d+\.rans", i.base_name))
    return spark.createDataFrame([(f"{folder}/{n}",) for n in names], "path string")


def _find_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            fs, at = pafs.FileSystem.from_uri(path)
            with fs.open_input_file(at) as f:
                places = [k for k, _ in segments_of(f, load_table(path.rpartition("/")[0]))]
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(places), pa.string()), pa.array(places, pa.int64())], ["path", "place"])


def _read_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            fs, at = pafs.FileSystem.from_uri(path)
            with fs.open_input_file(at) as f:
                s = Segment(f, place)
                ids = s.ids(load_table(path.rpartition("/")[0]))
            off = np.concatenate([[0], np.cumsum(s.lengths)])
            crc = [zlib.crc32(ids[off[k] : off[k + 1]]) for k in range(len(s.lengths))]
            yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids, pa.int64(), mask=s.nulls.astype(bool)), pa.array(s.start + off[:-1]), pa.array(s.lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(files: DataFrame) -> DataFrame:
    """Per document, from the files and the table beside them: doc_id, start, n_tokens, ids_crc32; a task decodes some segments."""
    n = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    places = files.select("path").repartition(n, "path").mapInArrow(_find_segments, "path string, place long")
    return places.repartition(n, "path", "place").mapInArrow(_read_segments, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.new_path(spark, "rans")
    write_tokens(spark.read.parquet(common.table_path(sf_dir, "documents")), folder)
    return read_tokens(list_files(spark, folder))
