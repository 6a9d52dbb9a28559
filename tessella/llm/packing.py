"""Best-fit packing of documents into token sequences by the linear grouping scheme.

Pieces of equal length are interchangeable, so the plan needs only the number of pieces of each length, at most
`capacity` numbers, whatever the corpus. Lengths over capacity / LARGE_PART are large: sorted, they are cut into
groups of equal cardinality and rounded up to the longest of their group; the few sizes left are packed by the
configuration linear program (column generation with a knapsack as pricing), rounded down; actual lengths then
take the rounded ones' places, and what is left, the small ones above all, goes best-fit into the room that remains.
Spark ranks the pieces of each length and each piece reads its place off the plan.

Null texts are empty (the end id alone, one piece); null or repeated doc_ids are kept as they are, each row is
packed; pieces of equal length are interchangeable, so their order among themselves is any; long texts are cut into
pieces of `capacity`; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm import common, tokens

CAPACITY, END_ID = 2048, 0
#: Lengths over capacity / LARGE_PART are large and come in at most GROUPS groups.
LARGE_PART, GROUPS, ROUNDS = 3, 64, 1500


def configurations(sizes: np.ndarray, need: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[np.ndarray, float]]:
    """A basic solution of min sum(x) with sum(x * pattern) = need: (pattern, x) pairs; optimal unless rounds run out."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse, x = np.diag(1 / np.diag(basis)), need / np.diag(basis)
    best, pick = np.zeros(2 * capacity + 1), np.zeros(capacity + 1, np.int64)
    for _ in range(rounds):
        y = inverse.sum(axis=0)
        best[:capacity] = -np.inf
        best[capacity:] = 0
        for c in range(int(sizes.min()), capacity + 1):
            v = best[capacity + c - sizes] + y
            g = int(v.argmax())
            if v[g] > best[capacity + c - 1] + 1e-12:
                best[capacity + c], pick[c] = v[g], g
            else:
                best[capacity + c], pick[c] = best[capacity + c - 1], -1
        if best[2 * capacity] <= 1 + 1e-9:
            break
        a, c = np.zeros(k), capacity
        while c >= sizes.min():
            if pick[c] < 0:
                c -= 1
                continue
            a[pick[c]] += 1
            c -= int(sizes[pick[c]])
        d = inverse @ a
        ratio = np.where(d > 1e-10, x / np.where(d > 1e-10, d, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        x = np.maximum(x - step * d, 0)
        x[out] = step
        basis[:, out] = a
        row = inverse[out] / d[out]
        inverse -= np.outer(d, row)
        inverse[out] = row
    return [(basis[:, j].astype(np.int64), float(x[j])) for j in range(k)]


def plan(counts: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS, large_part: int = LARGE_PART) -> np.ndarray:
    """Rows (length, first rank, number, first sequence, offset), by length and rank: where the pieces of each length go.

    counts[n] is the number of pieces of length n. Pieces first rank + i go to sequence first sequence + i.
    """
    counts = np.asarray(counts, np.int64)
    left, rank, rows, n_seq = counts.copy(), np.zeros(capacity + 1, np.int64), [], 0
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> runs (number, first sequence)
    free: list[int] = []  # its keys, ascending

    def put(length: int, number: int, seq: int, offset: int) -> None:
        rows.append((length, int(rank[length]), number, seq, offset))
        rank[length] += number
        left[length] -= number

    def leave(space: int, number: int, seq: int) -> None:
        if number and space:
            if space not in room:
                room[space] = []
                insort(free, space)
            room[space].append((number, seq))

    if left[capacity]:
        put(capacity, int(left[capacity]), 0, 0)
        n_seq = int(counts[capacity])
    large = [n for n in range(capacity - 1, capacity // large_part, -1) if left[n]]
    total = int(left[large].sum()) if large else 0
    if total:
        # the c-th longest large piece is in group c * groups // total; a group's size is that of its longest
        edge = np.cumsum(left[large])
        first = np.searchsorted(edge, -(-np.arange(groups) * total // groups), "right")
        sizes = np.array(large)[np.unique(first[first < len(large)])][::-1]
        sizes = -np.sort(-np.unique(sizes))
        need = np.zeros(len(sizes))
        np.add.at(need, np.searchsorted(-sizes, -np.array(large), "right") - 1, left[large])
        stock = sorted(large)  # lengths still there, ascending
        found = [(p, int(x + 1e-6)) for p, x in configurations(sizes, need, capacity)]
        for pattern, m in sorted(found, key=lambda f: tuple(-f[0])):
            if not m:
                continue
            bins, n_seq = [(m, n_seq, 0)], n_seq + m
            slots = np.repeat(sizes, pattern)
            for j, size in enumerate(slots):
                after = []
                for number, seq, used in bins:
                    # the last place takes the longest piece that fits, the others one up to their rounded size
                    top = capacity - used if j == len(slots) - 1 else int(size)
                    while number:
                        k = bisect_left(stock, top + 1) - 1
                        if k < 0:
                            after.append((number, seq, used))
                            break
                        n = stock[k]
                        t = min(number, int(left[n]))
                        put(n, t, seq, used)
                        after.append((t, seq, used + n))
                        number, seq = number - t, seq + t
                        if not left[n]:
                            stock.pop(k)
                bins = after
            for number, seq, used in bins:
                leave(capacity - used, number, seq)
    for n in range(capacity - 1, 0, -1):
        while left[n]:
            k = bisect_left(free, n)
            if k == len(free):
                fit = capacity // n
                fresh = max(1, int(left[n]) // fit)
                leave(capacity, fresh, n_seq)
                n_seq += fresh
                continue
            space = free[k]
            number, seq = room[space].pop()
            fit = space // n
            full = min(number, int(left[n]) // fit)
            if full:
                for j in range(fit):
                    put(n, full, seq, capacity - space + j * n)
                leave(space - fit * n, full, seq)
            else:  # fewer are left than one sequence takes
                few, full = int(left[n]), 1
                for j in range(few):
                    put(n, 1, seq, capacity - space + j * n)
                leave(space - few * n, 1, seq)
            if number > full:
                room[space].append((number - full, seq + full))
            if not room[space]:
                del room[space]
                free.pop(bisect_left(free, space))
    out = np.array(rows, np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def _pieces(path: str, end: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pid, seen = tokens.word_ids(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            _, off = common.text_buffer(batch.column(1))
            for lo, hi in common.groups(off, 8 << 20):
                ids, o = tokens.with_end(*enc.encode(batch.column(1).slice(lo, hi - lo)), end)
                ids = ids.astype("<u4")
                size = np.diff(o)
                n = -(-size // capacity)
                doc = np.repeat(np.arange(hi - lo), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(size[doc] - start, capacity)
                at = o[:-1][doc] + start
                crc = [zlib.crc32(ids[a:z]) for a, z in zip(at.tolist(), (at + length).tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                s = length[order]
                nth = np.arange(len(s)) - np.searchsorted(s, s)
                rank = np.empty(len(s), np.int64)
                rank[order] = nth + seen[s]
                seen += np.bincount(length, minlength=capacity + 1)
                cols = [pa.array(np.full(len(doc), pid), pa.int32()), batch.column(0).slice(lo, hi - lo).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(rank)]
                yield pa.RecordBatch.from_arrays(cols, ["pid", "doc_id", "piece", "start", "length", "ids_crc32", "nth"])

    return run


def _placer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        key = (p[:, 0] << 48) | p[:, 1]
        for batch in batches:
            length, rank = np.asarray(batch.column("length")), np.asarray(batch.column("rank"))
            at = np.searchsorted(key, (length << 48) | rank, "right") - 1
            seq = p[at, 3] + rank - p[at, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(seq), pa.array(p[at, 4])], [*batch.schema.names[:-1], "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str | None = None, end: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Texts are read once and not shuffled; the pieces, without ids, are written to the shared folder, because ranks
    must not change between the plan and its use. The driver gets `capacity` counts and broadcasts the plan, whose
    rows depend on the number of lengths and groups, not on that of documents.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(d.dtypes)["doc_id"]
    schema = f"pid int, doc_id {kind}, piece int, start long, length long, ids_crc32 long, nth long"
    pieces = common.materialize(d.mapInArrow(_pieces(path or tokens.default_path(), end, capacity), schema), "pieces")
    by = pieces.groupBy("pid", "length").agg(F.count("*").alias("n"))
    total = by.groupBy("length").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(capacity + 1, np.int64)
    counts[total.column("length").to_numpy()] = total.column("n").to_numpy()
    shared = spark.sparkContext.broadcast(plan(counts, capacity))
    base = by.select("pid", "length", (F.sum("n").over(W.partitionBy("length").orderBy("pid")) - F.col("n")).alias("base"))
    ranked = pieces.join(base, ["pid", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(_placer(shared), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op8_linear_grouping_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(common.table_path(sf_dir, "documents")))
