"""Shared helpers of the training-data operators: Arrow text buffers, word hashes, joins behind a check of size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.storage import materialize, new_path

#: Bytes of text that numpy works on at once; temporary arrays take about 60 times as much.
SLICE_BYTES = 1 << 19


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Keep Arrow batches of whole texts small enough for a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes (uint8) and offsets (int64, from 0) of a string array; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off - off[0]


def groups(off: np.ndarray, limit: int | None = None) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes each; a longer row comes alone."""
    limit = limit or SLICE_BYTES
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def seg_sum(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of x over the segments that off bounds; empty segments give 0."""
    c = np.zeros(len(x) + 1, np.float64 if x.dtype.kind == "f" else np.int64)
    np.cumsum(x, out=c[1:])
    return c[off[1:]] - c[off[:-1]]


_P, _PINV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_POW: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        both = []
        for base in (_P, _PINV):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            both.append(np.cumprod(x, dtype=np.uint64))
        _POW[:] = both
    return _POW[0], _POW[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the input moves each bit of the output."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words_of(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words `[^\\x20\\x09-\\x0D]+` of rows in one buffer."""
    if not len(b):
        z = np.zeros(0, np.int64)
        return z, z, z
    ink = ~_SPACE[b]
    head = ink.copy()
    head[1:] &= ~ink[:-1]
    cut = off[:-1][off[:-1] < off[1:]]
    head[cut] = ink[cut]
    tail = ink.copy()
    tail[:-1] &= ~ink[1:]
    last = cut[1:] - 1 if len(cut) else cut
    tail[last] = ink[last]
    starts, ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def pieces(b: np.ndarray, limit: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of about limit bytes of one long text, cut after a blank so that no word is split."""
    limit = limit or SLICE_BYTES
    lo = 0
    while lo < len(b):
        hi = min(lo + limit, len(b))
        while hi < len(b) and not _SPACE[b[hi - 1]]:
            ahead = np.flatnonzero(_SPACE[b[hi : hi + limit]])
            hi = hi + int(ahead[0]) + 1 if len(ahead) else min(hi + limit, len(b))
        yield lo, hi
        lo = hi


def hashed_words(b: np.ndarray, off: np.ndarray, trim=None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and row numbers of the words of rows in one buffer; trim(b, starts, ends) may narrow them.

    A row far over SLICE_BYTES comes alone and is hashed piece by piece, so what it takes is its words' hashes.
    """
    if len(off) == 2 and len(b) > 2 * SLICE_BYTES:
        parts = [hashed_words(b[lo:hi], np.array([0, hi - lo]), trim)[0] if hi - lo <= 2 * SLICE_BYTES else _one_piece(b[lo:hi], np.array([0, hi - lo]), trim)[0] for lo, hi in pieces(b)]
        h = np.concatenate(parts)
        return h, np.zeros(len(h), np.int64)
    return _one_piece(b, off, trim)


def _one_piece(b: np.ndarray, off: np.ndarray, trim) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, row = words_of(b, off)
    if trim is not None:
        trim(b, starts, ends)
    return word_hashes(b, starts, ends), row


def word_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of b[start:end], equal for equal bytes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(b) + 1)
    c = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=c[1:])
    h = (c[ends] - c[starts]) * down[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


#: A key with over 1 / HOT_SHARE of all rows is hot; there are at most HOT_SHARE such keys, so they may be broadcast.
HOT_SHARE = 256


def join_by_count(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Left join of rows with a table of one row per key that counts the key's rows; hot keys are not shuffled.

    rows and table are read twice each, so they should be written tables. The count column is left out.
    """
    values = [c for c in table.columns if c not in keys and c != count]
    hot = F.broadcast(table.where(F.col(count) * HOT_SHARE > total).select(*keys, *values, F.lit(True).alias("_hot")))
    marked = rows.join(hot, keys, "left")
    cold = table.where(F.col(count) * HOT_SHARE <= total).select(*keys, *values)
    left = marked.where("_hot is null").drop("_hot", *values).join(cold, keys, "left")
    return left.unionByName(marked.where("_hot is not null").drop("_hot"))


#: Tables of at most so many rows of a few numbers are broadcast; others are joined as Spark sees fit.
SMALL_ROWS = 10_000


def small_side(df: DataFrame, tag: str) -> DataFrame:
    """df as a written table, marked for broadcast if it has at most SMALL_ROWS rows."""
    df = materialize(df, tag)
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df
