"""MinHash near-duplicates by a multi-index Hamming join.

A document's set of word shingles gives a Shape's parts of minima, each kept in some bits; two documents' distance is
the number of differing symbols. The signature is cut into chunks of some symbols. By the pigeonhole principle two
signatures at a distance of at most 2 * chunks - 1 agree in some chunk but for one symbol, so with each chunk's
deletions of a symbol as keys every such pair shares a key. The shape follows from the least similarity: a pair at it
exceeds that distance in about 2 of 10**7 cases (0.85: 21 chunks of 6; 0.8: 26 of 5). Sets that share keys form clusters, and inside these links are confirmed on whole sets.

Equal sets are one class from the start, so exact copies never meet pairwise. Keys are counted with partial sums,
and each row of a shared key is tied to the key's smallest member only; where a key has two members, the tie stands
for its pair alone and goes if the signatures' distance exceeds the limit. A cluster small enough is linked in one
task, most documents being reached from one of them; in a larger one the ties are confirmed first, and what they
leave apart is compared, by shared keys, with the rest.

Null and empty texts have an empty set and no links; texts below SHINGLE words are one shingle; null doc_ids are
left out of links and keep themselves; each row is a document of its own, also where rows share a doc_id: the result
has a row for each, and rows of one id with different texts are linked by their own texts only; further columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import common
from tessella.llm.components import components

SHINGLE, PERCENT = 5, 85
#: Symbols of a signature, about; bits of a key's symbols together; the share of pairs that may exceed the distance.
ABOUT, KEY_BITS, MISSED = 126, 52, 2.5e-7


class Shape(NamedTuple):
    """A signature's chunks, the symbols of each and the bits of a symbol."""

    chunks: int
    symbols: int
    bits: int

    @property
    def parts(self) -> int:
        return self.chunks * self.symbols

    @property
    def limit(self) -> int:
        return 2 * self.chunks - 1

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(np.uint8 if self.bits <= 8 else np.uint16 if self.bits <= 16 else np.uint32)

    def missed(self, percent: int) -> float:
        """Share of the pairs at just this similarity whose distance exceeds the limit."""
        p = (1 - percent / 100) * (1 - 0.5**self.bits)
        return sum(math.comb(self.parts, k) * p**k * (1 - p) ** (self.parts - k) for k in range(self.limit + 1, self.parts + 1))


@functools.cache
def shape(percent: int) -> Shape:
    """The longest chunks that miss too few pairs at this similarity to count."""
    for symbols in (6, 5, 4, 3):
        found = Shape(-(-ABOUT // symbols), symbols, -(-KEY_BITS // (symbols - 1)))
        if found.missed(percent) <= MISSED:
            return found
    raise ValueError(f"no signature for a similarity of {percent} percent")


CHUNKS, SYMBOLS, _ = shape(PERCENT)
PARTS, LIMIT = shape(PERCENT).parts, shape(PERCENT).limit
#: A cluster is linked in one task while documents * shingles and shingles stay below these.
LOCAL_WORK, LOCAL_SHINGLES = 2_000_000_000, 4_000_000


@functools.cache
def _hashes(parts: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    flip = rng.integers(0, 1 << 32, parts, dtype=np.uint32)
    return flip, rng.integers(0, 1 << 32, parts, dtype=np.uint32) | np.uint32(1)


def shingle_sets(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, row after row and ascending within a row, and the rows' offsets."""
    low = np.where((b >= 65) & (b <= 90), b | 32, b).astype(np.uint8)
    (h, row), n = common.hashed_words(low, off), len(off) - 1
    words = np.bincount(row, minlength=n)
    x = np.zeros(max(0, len(h) - SHINGLE + 1), np.uint64)
    for j in range(SHINGLE):
        x = x * np.uint64(0x9E3779B97F4A7C15) + h[j : len(x) + j] + np.uint64(j + 1)
    inside = row[: len(x)] == row[SHINGLE - 1 :]
    x, own = common.mix(x[inside]), row[: len(x)][inside]
    short = np.flatnonzero((words > 0) & (words < SHINGLE))
    first = np.searchsorted(row, short)
    y = words[short].astype(np.uint64)
    for j in range(SHINGLE - 1):
        more = j < words[short]
        y = np.where(more, common.mix(y * np.uint64(0xD6E8FEB86659FD93) + h[np.minimum(first + j, max(len(h) - 1, 0))]) if len(h) else y, y)
    x, own = np.concatenate([x, y]), np.concatenate([own, short])
    order = np.lexsort((x, own))
    x, own = x[order], own[order]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != x[:-1]) | (own[1:] != own[:-1])
    x, own = x[keep], own[keep]
    return x, np.searchsorted(own, np.arange(n + 1))


def signatures(x: np.ndarray, at: np.ndarray, form: Shape = shape(PERCENT)) -> np.ndarray:
    """(rows, parts) symbols of the sets x[at[i]:at[i + 1]]; rows with empty sets are zero."""
    n = len(at) - 1
    out = np.zeros((n, form.parts), form.dtype)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        h = (x >> np.uint64(32)).astype(np.uint32) ^ x.astype(np.uint32)
        v = np.empty_like(h)
        flip, times = _hashes(form.parts)
        for j in range(form.parts):
            np.bitwise_xor(h, flip[j], out=v)
            v *= times[j]
            m = np.minimum.reduceat(v, at[full])
            out[full, j] = ((m ^ (m >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - form.bits)
    return out


def set_names(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums of the hashes of each set's members, which name the set together with its size."""
    out = []
    for salt in (1, 2):
        c = np.concatenate([[np.uint64(0)], np.cumsum(common.mix(x + np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))), dtype=np.uint64)])
        out.append((c[at[1:]] - c[at[:-1]]).view(np.int64))
    return out[0], out[1]


SIGNED = "doc_id long, n_shingles long, k1 long, k2 long, sig binary"


def _sign(batches: Iterator[pa.RecordBatch], form: Shape = shape(PERCENT)) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        b, off = common.text_buffer(batch.column(1))
        for lo, hi in common.groups(off):
            x, at = shingle_sets(b[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            sig = signatures(x, at, form)
            sums = [pa.array(k) for k in set_names(x, at)]
            data = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((np.arange(hi - lo + 1) * form.parts * form.dtype.itemsize).astype(np.int32)), pa.py_buffer(sig.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(at)), *sums, data], ["doc_id", "n_shingles", "k1", "k2", "sig"])


def _keys(batches: Iterator[pa.RecordBatch], form: Shape = shape(PERCENT)) -> Iterator[pa.RecordBatch]:
    """Each signature's keys: a chunk's symbols but one, with the chunk's and the symbol's number, in at most 62 bits."""
    for batch in batches:
        ids = np.asarray(batch.column(0))
        sig = np.frombuffer(b"".join(x.as_py() for x in batch.column(1)), form.dtype).reshape(len(ids), form.chunks, form.symbols).astype(np.int64)
        keys = []
        for c in range(form.chunks):
            for j in range(form.symbols):
                k = np.full(len(ids), c * form.symbols + j, np.int64)
                for i in range(form.symbols):
                    if i != j:
                        k = (k << form.bits) | sig[:, c, i]
                keys.append(k)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.tile(ids, form.parts))], ["key", "id"])


def _texts(it: Iterator[pa.RecordBatch], text: int, *others: int):
    """Shingle sets of batches of rows, a few MB of text at a time, with the other columns' values."""
    for batch in it:
        b, off = common.text_buffer(batch.column(text))
        for lo, hi in common.groups(off):
            x, at = shingle_sets(b[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            yield x, at, lo, *(np.asarray(batch.column(k).slice(lo, hi - lo)) for k in others)


#: Members of clusters with a text that has their doc_id; it is theirs if its set has their name.
MEMBERS = "cluster long, id long, k1 long, k2 long, n_shingles long, text string"


def _own(batches: Iterator[pa.RecordBatch]):
    """(cluster, id, sets, their offsets, rows) of rows of MEMBERS whose text is their own, a few MB of text at a time."""
    for batch in batches:
        for x, at, lo, *cols in _texts(iter([batch]), 5, 0, 1, 2, 3, 4):
            cluster, ids, k1, k2, n = cols
            own = set_names(x, at)
            ok = np.flatnonzero((own[0] == k1) & (own[1] == k2) & (np.diff(at) == n))
            yield cluster[ok], ids[ok], [x[at[i] : at[i + 1]] for i in ok], batch.slice(lo, len(n)).take(pa.array(ok))


def _own_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, _, _, rows in _own(batches):
        yield rows.select(["id", "cluster", "text"])


def link(ids: np.ndarray, x: np.ndarray, at: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Component (smallest id) of each set under 100 * intersection >= percent * union, each set met once.

    A search from one set at a time: it is compared with all sets not reached yet, and those it reaches leave them.
    """
    n, size = len(ids), np.diff(at)
    _, h = np.unique(x, return_inverse=True)
    own = np.repeat(np.arange(n), size)
    mark = np.zeros(h.max() + 1 if len(h) else 1, bool)
    comp, waiting = np.full(n, -1), np.ones(n, bool)
    live_h, live_own = h, own  # the members of the sets still waiting
    for seed in np.argsort(ids, kind="stable"):
        if not waiting[seed]:
            continue
        comp[seed], waiting[seed], todo, gone = seed, False, [seed], True
        while todo:
            if gone:
                left = waiting[live_own]
                live_h, live_own = live_h[left], live_own[left]
            if not len(live_h):
                break
            i = todo.pop()
            mine = h[at[i] : at[i + 1]]
            mark[mine] = True
            both = np.bincount(live_own[mark[live_h]], minlength=n)
            mark[mine] = False
            hit = np.flatnonzero(waiting & (100 * both >= percent * (size[i] + size - both)))
            gone = len(hit) > 0
            waiting[hit], comp[hit] = False, seed
            todo += hit.tolist()
    return ids[comp]


def _link_clusters(percent: int):
    """Rows of MEMBERS, sorted by cluster, to (id, component)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        now = None

        def done():
            ids = np.array(list(held), np.int64)
            comp = link(ids, np.concatenate(list(held.values())), np.concatenate([[0], np.cumsum([len(x) for x in held.values()])]), percent)
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(comp)], ["id", "component"])

        for clusters, ids, sets, _ in _own(batches):
            for cluster, i, x in zip(clusters.tolist(), ids.tolist(), sets, strict=True):
                if held and cluster != now:
                    yield done()
                    held = {}
                now, held[i] = cluster, x
        if held:
            yield done()

    return run


def _confirm(percent: int):
    """Rows (a, a's text, b, b's text) to the pairs (a, b) whose whole sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (list(_texts(iter([batch]), k)) for k in (1, 3))
            sets = [[x[at[i] : at[i + 1]] for x, at, _ in part for i in range(len(at) - 1)] for part in (one, two)]
            both = np.array([len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(*sets, strict=True)], np.int64)
            size = np.array([len(p) + len(q) for p, q in zip(*sets, strict=True)], np.int64)
            ok = pa.array(100 * both >= percent * (size - both))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(2).filter(ok)], ["a", "b"])

    return run


def _block_links(percent: int):
    """Groups of a pair of blocks to links across components, enough of them to join what is linked."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        b, off = common.text_buffer(t.column("text"))
        x, at = shingle_sets(b, off)
        ids, comp, rest = (t.column(k).to_numpy() for k in ("id", "component", "rest"))
        left, right = t.column("side").to_numpy() <= 0, t.column("side").to_numpy() >= 0
        n, size = len(ids), np.diff(at)
        _, h = np.unique(x, return_inverse=True)
        own, mark, links = np.repeat(np.arange(n), size), np.zeros(h.max() + 1 if len(h) else 1, bool), []
        for here, there in ((left, right), (right, left)):
            for i in np.flatnonzero(here & (rest > 0)):
                mine = h[at[i] : at[i + 1]]
                mark[mine] = True
                both = np.bincount(own[mark[h]], minlength=n)
                mark[mine] = False
                hit = np.flatnonzero(there & (comp != comp[i]) & (100 * both >= percent * (size[i] + size - both)))
                _, first = np.unique(comp[hit], return_index=True)
                links += [(ids[i], ids[j]) for j in hit[first]]
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return run


def _near_ties(ties: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """(id, m, distance) of the ties within the distance that the shape guarantees to find."""
    s = sigs.select(F.col("id").alias("s_id"), "sig")
    tied = ties.join(s.withColumnsRenamed({"s_id": "id", "sig": "sig_a"}), "id").join(s.withColumnsRenamed({"s_id": "m", "sig": "sig_b"}), "m")
    found = tied.select("id", "m", "sig_a", "sig_b").mapInArrow(functools.partial(_distances, form=shape(percent)), "id long, m long, distance int")
    return found.where(F.col("distance") <= shape(percent).limit)


def _link_large(members: DataFrame, ties: DataFrame, sigs: DataFrame, docs: DataFrame, percent: int, block: int = 1000) -> DataFrame:
    """(id, component) of clusters too large for one task.

    First each member is confirmed against that of its ties whose signature is nearest. Then, in a cluster still
    apart, members outside its largest component meet all members of a like size, block by block: sizes within a
    factor of percent / 100 fall in the same or the next power of it.
    """
    spark = docs.sparkSession
    text = common.materialize(_with_texts(docs, members).mapInArrow(_own_texts, "id long, cluster long, text string"), "large")
    near = _near_ties(ties.join(members.select("id"), "id"), sigs, percent).groupBy("id").agg(F.min_by("m", F.struct("distance", "m")).alias("m"))
    t = text.select("id", "text")
    pairs = near.join(t, "id").select(F.col("id").alias("a"), F.col("text").alias("ta"), F.col("m").alias("b")).join(t.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").select("a", "ta", "b", "tb")
    common.small_batches(spark, 200)
    first = common.materialize(pairs.mapInArrow(_confirm(percent), "a long, b long"), "links")
    common.small_batches(spark)
    state = members.select("id", "cluster").join(components(first), "id", "left").withColumn("component", F.coalesce("component", "id"))
    state = common.materialize(state.join(sigs.select("id", "n_shingles"), "id"), "state")
    sizes = state.groupBy("cluster", "component").agg(F.count("*").alias("n"))
    top = sizes.groupBy("cluster").agg(F.max_by("component", F.struct("n", "component")).alias("top"), F.count("*").alias("parts"))
    state = state.join(top.where("parts > 1"), "cluster").withColumn("rest", (F.col("component") != F.col("top")).cast("int"))
    # a little wider than percent, so that rounding never puts similar sizes two powers apart
    state = state.withColumn("s", F.floor(F.log("n_shingles") / (np.log(100 / percent) * (1 + 1e-9))))
    blocks = state.groupBy("cluster", "s").agg(F.ceil(F.count("*") / block).cast("int").alias("k"))
    state = state.join(blocks, ["cluster", "s"]).withColumn("h", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    nxt = blocks.select("cluster", (F.col("s") - 1).alias("s"), F.col("k").alias("k_next"))
    prv = blocks.select("cluster", (F.col("s") + 1).alias("s"), F.col("k").alias("k_prev"))
    state = state.join(nxt, ["cluster", "s"], "left").join(prv, ["cluster", "s"], "left").na.fill(0, ["k_next", "k_prev"])
    to = lambda k: F.sequence(F.lit(0), F.col(k) - 1)
    within = F.transform(to("k"), lambda j: F.struct(F.col("s").alias("s"), F.least(j, F.col("h")).alias("h1"), F.greatest(j, F.col("h")).alias("h2"), F.when(j == F.col("h"), 0).when(F.col("h") < j, -1).otherwise(1).alias("side"), F.lit(False).alias("up")))
    above = F.when(F.col("k_next") > 0, F.transform(to("k_next"), lambda j: F.struct(F.col("s").alias("s"), F.col("h").alias("h1"), j.alias("h2"), F.lit(-1).alias("side"), F.lit(True).alias("up")))).otherwise(F.array().cast("array<struct<s:bigint,h1:int,h2:int,side:int,up:boolean>>"))
    below = F.when(F.col("k_prev") > 0, F.transform(to("k_prev"), lambda j: F.struct((F.col("s") - 1).alias("s"), j.alias("h1"), F.col("h").alias("h2"), F.lit(1).alias("side"), F.lit(True).alias("up")))).otherwise(F.array().cast("array<struct<s:bigint,h1:int,h2:int,side:int,up:boolean>>"))
    kind = "array<struct<s:bigint,h1:int,h2:int,side:int,up:boolean>>"
    spread = state.select("cluster", "id", "component", "rest", F.explode(F.concat(within.cast(kind), above.cast(kind), below.cast(kind))).alias("p")).select("cluster", "id", "component", "rest", "p.*")
    key = ["cluster", "s", "h1", "h2", "up"]
    busy = spread.groupBy(*key).agg(F.max("rest").alias("busy")).where("busy = 1").drop("busy")
    met = spread.join(busy, key).join(text.select("id", "text"), "id")
    more = met.groupBy(*key).applyInArrow(_block_links(percent), "a long, b long")
    edges = first.unionByName(common.materialize(more, "links"))
    return members.select("id").join(components(edges), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _distances(batches: Iterator[pa.RecordBatch], form: Shape) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        one, two = (np.frombuffer(b"".join(x.as_py() for x in batch.column(k)), form.dtype).reshape(-1, form.parts) for k in ("sig_a", "sig_b"))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("m"), pa.array((one != two).sum(axis=1).astype(np.int32))], ["id", "m", "distance"])


def _with_texts(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of MEMBERS: each member with every text of its doc_id."""
    m = members.select("cluster", "id", "k1", "k2", "n_shingles", F.col("rep").alias("m_doc_id"))
    return docs.join(m, docs["doc_id"] == m["m_doc_id"]).select("cluster", "id", "k1", "k2", "n_shingles", "text")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, local_work: int = LOCAL_WORK, local_shingles: int = LOCAL_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id of the row's component) and kept of every row."""
    spark = docs.sparkSession
    common.small_batches(spark)
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = d.mapInArrow(functools.partial(_sign, form=shape(percent)), SIGNED).withColumn("row", F.monotonically_increasing_id())
    signed = common.materialize(signed, "signed")  # the row numbers hold from here on
    known = signed.where("doc_id is not null and n_shingles > 0")
    names = ["k1", "k2", "n_shingles"]
    # a class is known by its smallest row number, as doc_ids may be shared by rows of different sets
    classes = common.materialize(known.groupBy(*names).agg(F.min("row").alias("id"), F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("sig").alias("sig")), "classes")
    # a signature of 126 symbols or so becomes as many rows, so their number, not the table's size, says how many tasks are due
    keys = classes.select("id", "sig").repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(functools.partial(_keys, form=shape(percent)), "key long, id long")
    shared = common.materialize(keys.groupBy("key").agg(F.min("id").alias("m"), F.count("*").alias("n")).where("n > 1"), "shared")
    ties = common.materialize(keys.join(shared, "key").where("id <> m").groupBy("id", "m").agg(F.max("n").alias("n")), "ties")
    ties = ties.where("n > 2").select("id", "m").unionByName(_near_ties(ties.where("n = 2"), classes, percent).select("id", "m"))
    ties = common.materialize(ties, "near")
    clusters = components(ties, "id", "m").withColumnRenamed("component", "cluster").join(classes.select("id", "rep", *names), "id")
    clusters = common.materialize(clusters, "clusters")
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("work"))
    small = (F.col("n") * F.col("work") <= local_work) & (F.col("work") <= local_shingles)
    sizes = common.materialize(sizes.withColumn("small", small), "sizes")
    members = clusters.join(sizes.where("small").select("cluster"), "cluster")
    rows = _with_texts(d, members)
    linked = rows.repartition("cluster").sortWithinPartitions("cluster", "id").mapInArrow(_link_clusters(percent), "id long, component long")
    if not sizes.where("not small").isEmpty():
        large = common.materialize(clusters.join(sizes.where("not small").select("cluster"), "cluster"), "members")
        linked = linked.unionByName(_link_large(large, ties, classes, d, percent))
    linked = common.materialize(linked.join(classes.select("id", "rep"), "id"), "linked")
    least = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    found = classes.select("id", *names, "copies", "rep").join(linked.select("id", "component").join(least, "component").select("id", "component_id"), "id", "left")
    found = common.materialize(found.select(*names, "copies", F.coalesce("component_id", "rep").alias("component_id")), "components")
    total = signed.count()
    out = common.join_by_count(known.select("doc_id", *names), found, names, "copies", total).select("doc_id", "n_shingles", "component_id")
    alone = signed.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op10_minhash_hamming_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(common.table_path(sf_dir, "documents")))


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
h AS (SELECT doc_id, hash(sh) AS h FROM s),
f AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
c AS (SELECT h.doc_id, h.h FROM h JOIN f USING (h)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM c a JOIN c b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS u FROM documents UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.u)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.u AS component_id, d.doc_id = m.u AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT v, min(u) AS u FROM r GROUP BY v) m ON m.v = d.doc_id
"""
