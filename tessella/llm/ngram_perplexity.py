"""Quality rules by n-gram perplexity: a modified Kneser-Ney model over the code points of all texts.

Spark counts every n-gram of ORDER code points of the distinct texts (a text that stands in many rows counts once, so a
group of copies does not teach the model itself) and smooths all orders with joins and aggregations over written
tables. An n-gram is two longs of three 21-bit symbols each, exact for every script; what is counted grows with the
corpus and is never pruned. For scoring, each order becomes an array of sorted 64-bit hashes with log probabilities
and backoff weights. Up to MODEL_ROWS entries the arrays are broadcast; a larger model stays a table, each block of
texts gets the part of it that its own n-grams need, and the scores are the same. Each language has a lower and an upper
perplexity band from the quartiles of all its distinct texts; texts outside are rejected.

Null texts have no words and fail the base rules; null languages form a language of their own; repeated rows
are scored alike; very long texts are taken piece by piece; further columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm import common

ORDER, BITS = 5, 21
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
#: A text of n bytes deviates from its language's median log perplexity by t / sqrt(n); the bands are the quartiles
#: of t over all distinct texts of the language, SPREAD times their distance, or NARROWEST if that is less, further out,
#: and TOLERANCE beyond that. So a group of copies, however large, counts once and cannot narrow the band to itself.
SPREAD, NARROWEST, TOLERANCE = 4.0, 0.5, 0.01
#: Models of at most so many n-grams and contexts are broadcast: 12 bytes each, 14 on their way through the driver.
MODEL_ROWS = 1 << 23
#: At most so many repeated text hashes are broadcast to find the rows that hold them; more are joined as Spark sees fit.
REPEATED_ROWS = 1 << 20
#: Bytes of text in a block that is scored with its own part of a model too large to broadcast.
BLOCK_BYTES = 1 << 24
#: Distinct n-grams that a counting task holds before it hands them on.
HELD = 1 << 20

_SYMBOL = (1 << BITS) - 1


def symbols(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points plus 1 (0 pads) of UTF-8 rows in one buffer, and the rows' offsets in them."""
    x = np.frombuffer(b.tobytes().decode().encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    at = np.zeros(len(b) + 1, np.int64)
    np.cumsum((b & 0xC0) != 0x80, out=at[1:])
    return x, at[off]


def grams(x: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): the n-gram that ends at each symbol, its last three symbols in b; what precedes a row is padding."""
    a, b = np.zeros(len(x), np.uint64), x.copy()
    size = np.diff(off)
    for j in range(1, ORDER):
        prev = np.zeros(len(x), np.uint64)
        prev[j:] = x[:-j]
        for k in range(j):
            prev[off[:-1][size > k] + k] = 0
        if j < 3:
            b |= prev << np.uint64(BITS * j)
        else:
            a |= prev << np.uint64(BITS * (j - 3))
    return a, b


def gram_parts(b: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """grams and symbol offsets of rows in one buffer, of a long text part by part."""
    step = 2 * common.SLICE_BYTES
    if len(off) > 2 or len(b) <= step:
        x, o = symbols(b, off)
        yield *grams(x, o), o
        return
    before, lo = np.zeros(0, np.uint64), 0
    while lo < len(b):
        hi = min(lo + step, len(b))
        while hi < len(b) and b[hi] & 0xC0 == 0x80:
            hi += 1
        x, _ = symbols(b[lo:hi], np.array([0, hi - lo]))
        x = np.concatenate([before, x])
        g, h = grams(x, np.array([0, len(x)]))
        yield g[len(before) :], h[len(before) :], np.array([0, len(x) - len(before)])
        before, lo = x[-(ORDER - 1) :], hi


def gram_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of n-grams; those of different lengths differ by their padding or their order's own array."""
    return common.mix(a * np.uint64(0x9E3779B97F4A7C15) ^ common.mix(b + np.uint64(0xD6E8FEB86659FD93)))


def _distinct(a: np.ndarray, b: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if n is None:
        _, at, n = np.unique(gram_hash(a, b), return_index=True, return_counts=True)
        return a[at], b[at], n
    _, at, inv = np.unique(gram_hash(a, b), return_index=True, return_inverse=True)
    return a[at], b[at], np.bincount(inv, n, len(at)).astype(np.int64)


def _gram_batch(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b, n = _distinct(*(np.concatenate([p[k] for p in parts]) for k in range(3))) if parts else [np.zeros(0, np.int64)] * 3
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (a, b, n)], ["a", "b", "n"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0
    for batch in batches:
        b, off = common.text_buffer(batch.column(0))
        for lo, hi in common.groups(off):
            for x, y, _ in gram_parts(b[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]):
                parts.append(_distinct(x, y))
                held += len(parts[-1][0])
                if held > HELD:
                    parts = [_distinct(*(np.concatenate([p[k] for p in parts]) for k in range(3)))]
                    held = len(parts[0][0])
                    if held > HELD // 2:
                        yield _gram_batch(parts)
                        parts, held = [], 0
    yield _gram_batch(parts)


def distinct_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per distinct text; only texts that are repeated are moved, after each task has dropped its own copies."""
    d = docs.select(F.col(text).alias("text")).where("text <> ''").withColumn("text_key", F.xxhash64("text"))
    again = common.materialize(d.groupBy("text_key").count().where("count > 1").select("text_key", F.lit(True).alias("again")), "repeated")
    d = d.join(F.broadcast(again) if again.count() <= REPEATED_ROWS else again, "text_key", "left")
    once = d.where("again is null").select("text")
    return once.unionByName(d.where("again").groupBy("text_key").agg(F.min("text").alias("text")).select("text"))


def count_ngrams(docs: DataFrame, text: str = "text") -> DataFrame:
    """(a, b, n): each distinct n-gram of all distinct texts with its count; counted within tasks, summed by Spark."""
    common.small_batches(docs.sparkSession)
    return distinct_texts(docs, text).mapInArrow(_count, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _context() -> list[Column]:
    """The n-gram without its last symbol."""
    return [F.shiftright("a", BITS).alias("ca"), F.shiftleft(F.col("a").bitwiseAND(_SYMBOL), 2 * BITS).bitwiseOR(F.shiftright("b", BITS)).alias("cb")]


def _suffix(m: int) -> list[Column]:
    """The last m symbols of an n-gram."""
    high, low = (1 << BITS * max(m - 3, 0)) - 1, (1 << BITS * min(m, 3)) - 1
    return [F.col("a").bitwiseAND(F.lit(high)).alias("sa"), F.col("b").bitwiseAND(F.lit(low)).alias("sb")]


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """D for counts 0, 1, 2 and 3 or more, from the counts of counts; 0.5, or 0.5, 1, 1.5, where these are degenerate."""
    if not n1 or not n2 or not n3:
        return [0, 0.5, 1.0, 1.5] if n1 else [0, 0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    d = [0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.clip(d, [0, 0.05, 0.05, 0.05], [0, 0.95, 1.95, 2.95]).tolist()


def smooth(counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1, its n-grams' probabilities (a, b, p) and its contexts' backoff weights (ca, cb, gamma).

    Interpolated modified Kneser-Ney: below the top order an n-gram counts the distinct symbols to its left. No group
    here has more rows than there are code points. Lower orders are written tables, so that no plan holds all orders:
    what the driver keeps of a plan and its tasks' metrics grows with the plan and is sent again after each stage.
    """
    types = {ORDER: common.materialize(counts, "ngrams")}
    for m in range(ORDER - 1, 0, -1):
        t = types[m + 1].select(*_suffix(m)).groupBy(F.col("sa").alias("a"), F.col("sb").alias("b")).agg(F.count("*").alias("n"))
        types[m] = common.materialize(t, "ngrams")
    out = []
    for m in range(1, ORDER + 1):
        of = types[m].agg(*[F.count_if(F.col("n") == k) for k in (1, 2, 3, 4)], F.count("*")).first()
        d = discounts(*of[:4])
        cut = F.when(F.col("n") == 1, d[1]).when(F.col("n") == 2, d[2]).otherwise(d[3])
        t = types[m].select("a", "b", "n", cut.alias("cut"), *_context(), *_suffix(m - 1))
        freed = d[1] * F.count_if(F.col("n") == 1) + d[2] * F.count_if(F.col("n") == 2) + d[3] * F.count_if(F.col("n") > 2)
        c = t.groupBy("ca", "cb").agg(F.sum("n").alias("total"), (freed / F.sum("n")).alias("gamma"))
        t = t.join(c, ["ca", "cb"])
        if m == 1:
            t = t.withColumn("lower", F.lit(1.0 / (of[4] + 1)))
        else:
            t = t.join(out[-1][0].select(F.col("a").alias("sa"), F.col("b").alias("sb"), F.col("p").alias("lower")), ["sa", "sb"])
        p = t.select("a", "b", ((F.col("n") - F.col("cut")) / F.col("total") + F.col("gamma") * F.col("lower")).alias("p"))
        out.append((common.materialize(p, "smoothed") if m < ORDER else p, c.select("ca", "cb", "gamma")))
    return out


def _top(levels: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    return levels[-1][0].select(F.lit(ORDER).cast("tinyint").alias("m"), F.lit(0).cast("tinyint").alias("kind"), "a", "b", F.ln("p").alias("v"))


_HASHED = pa.schema([("m", pa.int8()), ("kind", pa.int8()), ("key", pa.int64()), ("v", pa.float32())])


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        key = gram_hash(*(x.column(c).to_numpy().astype(np.uint64) for c in ("a", "b")))
        yield pa.RecordBatch.from_arrays([x.column("m"), x.column("kind"), pa.array(key.view(np.int64)), x.column("v").cast(pa.float32())], schema=_HASHED)


class KneserNey:
    """The smoothed model as sorted hash arrays, those of log p and of backoff weights for each order."""

    def __init__(self, rows: pa.Table):
        m, kind, keys, values = (rows.column(c).to_numpy() for c in ("m", "kind", "key", "v"))
        self.levels = []
        for k in range(1, ORDER + 1):
            both = []
            for of in (0, 1):
                at = np.flatnonzero((m == k) & (kind == of))
                at = at[np.argsort(keys[at].view(np.uint64))]
                both += [keys[at].view(np.uint64), values[at]]
            self.levels.append(both)
        self.floor = np.float32(-np.log(len(self.levels[0][0]) + 1))

    @classmethod
    def collect(cls, model: DataFrame) -> KneserNey:
        """The arrays of a model's table; 14 bytes an entry on their way through the driver."""
        rows = model.mapInArrow(_hash, "m tinyint, kind tinyint, key long, v float").toArrow()
        out = cls(rows)
        del rows
        pa.default_memory_pool().release_unused()
        return out

    @staticmethod
    def _find(keys: np.ndarray, values: np.ndarray, h: np.ndarray) -> np.ndarray:
        """values of h by key, nan where there is none."""
        if not len(keys):
            return np.full(len(h), np.nan, np.float32)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, values[at], np.float32(np.nan))

    def score(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """log p of the last symbol of each n-gram; unseen ones back off."""
        u, inv = np.unique(gram_hash(a, b), return_inverse=True)
        out = self._find(*self.levels[-1][:2], u)[inv]
        left, weight = np.flatnonzero(np.isnan(out)), 0
        for m in range(ORDER, 0, -1):
            if not len(left):
                return out
            x, y = self._last(a[left], b[left], m)
            if m < ORDER:
                p = self._find(*self.levels[m - 1][:2], gram_hash(x, y))
                out[left] = p + weight
                weight, left, x, y = (v[np.isnan(p)] for v in (weight, left, x, y))
            ca, cb = x >> np.uint64(BITS), (x & np.uint64(_SYMBOL)) << np.uint64(2 * BITS) | y >> np.uint64(BITS)
            weight = weight + np.nan_to_num(self._find(*self.levels[m - 1][2:], gram_hash(ca, cb)))
        out[left] = self.floor + weight
        return out

    @staticmethod
    def _last(a: np.ndarray, b: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        return a & np.uint64((1 << BITS * max(m - 3, 0)) - 1), b & np.uint64((1 << BITS * min(m, 3)) - 1)


def fit(docs: DataFrame, text: str = "text") -> DataFrame:
    """(m, kind, a, b, v), a written table: for each order m, log p of the n-grams of all distinct texts (kind 0) and log
    backoff weights of their contexts (kind 1).
    """
    levels = smooth(count_ngrams(docs, text))
    out = _top(levels)
    for m, (p, c) in enumerate(levels, 1):
        if m < ORDER:
            out = out.union(p.select(F.lit(m).cast("tinyint"), F.lit(0).cast("tinyint"), "a", "b", F.ln("p")))
        out = out.union(c.select(F.lit(m).cast("tinyint"), F.lit(1).cast("tinyint"), "ca", "cb", F.ln("gamma")))
    return common.materialize(out, "model")


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the blocks of about BLOCK_BYTES that the rows of a task fill; a longer text is a block of its own."""
    from pyspark import TaskContext

    number, held = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        size = np.diff(common.text_buffer(batch.column(batch.num_columns - 1))[1])
        of = np.zeros(len(size), np.int64)
        for i, n in enumerate(size.tolist()):
            if held and held + n > BLOCK_BYTES:
                number, held = number + 1, 0
            held += n
            of[i] = number
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of)], [*batch.schema.names, "block"])


def _needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, a, b): the distinct n-grams of the rows of a block in a batch."""
    for batch in batches:
        block = batch.column(1).to_numpy()
        for k in np.unique(block):
            b, off = common.text_buffer(batch.column(0).filter(pa.array(block == k)))
            for lo, hi in common.groups(off):
                for x, y, _ in gram_parts(b[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]):
                    x, y, _ = _distinct(x, y)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), k, np.int64)), pa.array(x.astype(np.int64)), pa.array(y.astype(np.int64))], ["block", "a", "b"])


def _score_by_blocks(d: DataFrame, model: DataFrame, keep: list[str], schema: str) -> DataFrame:
    """Score texts with a model that is too large to broadcast: the model counted them, so all their n-grams are in it."""
    kinds = ", ".join(f"{c} {t}" for c, t in d.dtypes)
    rows = common.materialize(d.mapInArrow(_block, f"{kinds}, block long"), "blocks")
    need = rows.select("text", "block").mapInArrow(_needs, "block long, a long, b long").distinct()
    part = need.join(model, ["a", "b"])

    def run(texts: pa.Table, model: pa.Table) -> pa.Table:
        kn = KneserNey(pa.Table.from_batches(_hash(iter(model.to_batches())), _HASHED))
        out = list(_scored(kn, keep, texts.select([*keep, "text"]).to_batches(max_chunksize=2000)))
        return pa.Table.from_batches(out, out[0].schema)

    return rows.groupBy("block").cogroup(part.groupBy("block")).applyInArrow(run, schema)


_SYM = np.zeros(256, np.int64)
_SYM[list(SYMBOLS)] = 1


def base_stats(b: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_repeat_words of each row of a buffer."""
    n = len(off) - 1
    h, row = common.hashed_words(b, off)
    chars, marks = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n == 1:
        for lo in range(0, len(b), common.SLICE_BYTES):
            part = b[lo : lo + common.SLICE_BYTES]
            chars[0] += int((~common._SPACE[part] & ((part & 0xC0) != 0x80)).sum())
            marks[0] += int(_SYM[part].sum())
    else:
        chars, marks = common.seg_sum(~common._SPACE[b] & ((b & 0xC0) != 0x80), off), common.seg_sum(_SYM[b], off)
    out = {"n_words": np.bincount(row, minlength=n), "word_chars": chars, "n_symbols": marks, "n_repeat_words": np.zeros(n, np.int64)}
    if len(h) >= WINDOW:
        w = h[: len(h) - WINDOW + 1].copy()
        for j in range(1, WINDOW):
            w = w * np.uint64(0x9E3779B97F4A7C15 + 2 * j) + h[j : len(h) - WINDOW + 1 + j]
        w = common.mix(w ^ common.mix(row[: len(w)].astype(np.uint64) + np.uint64(1)))
        inside = row[: len(w)] == row[WINDOW - 1 :]
        own = w[inside]
        s = np.sort(own)
        twice = np.unique(s[1:][s[1:] == s[:-1]])
        if len(twice):
            at = np.flatnonzero(inside & np.isin(w, twice))
            d = np.zeros(len(h) + 1, np.int64)
            d[at] += 1
            np.subtract.at(d, at + WINDOW, 1)
            out["n_repeat_words"] = np.bincount(row[np.cumsum(d[:-1]) > 0], minlength=n)
    return out


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split("\n")
    if len(set(lines)) == len(lines):
        return 0
    seen, n = set(), 0
    for x in lines:
        if x in seen:
            n += bool(x.strip(" \t\n\v\f\r"))
        seen.add(x)
    return n


def _scored(kn: KneserNey, keep: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("n_words", "word_chars", "n_symbols", "n_repeat_words", "loglik", "n_bytes", "n_chars")
    for batch in batches:
        col = batch.column(len(keep))
        b, off = common.text_buffer(col)
        parts = []
        for lo, hi in common.groups(off):
            x, o = b[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            s = base_stats(x, o)
            sums = [(common.seg_sum(kn.score(p, q).astype(np.float64), at), np.diff(at)) for p, q, at in gram_parts(x, o)]
            s["loglik"], s["n_chars"], s["n_bytes"] = sum(v for v, _ in sums), sum(n for _, n in sums), np.diff(o)
            parts.append(s)
        cat = {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in names}
        dup = np.array([duplicate_lines(t) if t else 0 for t in col.to_pylist()], np.int64)
        ints = [pa.array(cat[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols")]
        logppl = -cat["loglik"] / np.maximum(cat["n_chars"], 1)
        yield pa.RecordBatch.from_arrays(
            [batch.column(i) for i in range(len(keep))] + [*ints, pa.array(dup), pa.array(cat["n_repeat_words"].astype(np.int64)), pa.array(cat["n_bytes"].astype(np.int64)), pa.array(logppl.astype(np.float64))],
            [*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bytes", "log_perplexity"],
        )


def _scorer(model, keep: list[str]):
    return lambda batches: _scored(model.value, keep, batches)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _quantiles(df: DataFrame, value: Column, step: float, at: dict[str, float]) -> DataFrame:
    """Exact quantiles, to step, of value by lang_key: counts by bin, then running sums over the bins."""
    n = df.groupBy("lang_key", F.floor(value / step).alias("bin")).agg(F.count("*").alias("n"))
    w = W.partitionBy("lang_key")
    c = n.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("total", F.sum("n").over(w))
    return c.groupBy("lang_key").agg(*[((F.min(F.when(F.col("upto") >= p * F.col("total"), F.col("bin"))) + 0.5) * step).alias(a) for a, p in at.items()])


def bands(scored: DataFrame) -> DataFrame:
    """(lang_key, mid, low_t, high_t): each language's median log perplexity and bounds of its scaled deviations.

    scored holds text_key, a hash of the text; equal texts of a language count once.
    """
    good = scored.where(~F.col("base_failed")).groupBy("lang_key", "text_key", "n_bytes").agg(F.min("log_perplexity").alias("log_perplexity"))
    good = common.materialize(good, "distinct")
    mid = common.small_side(_quantiles(good, F.col("log_perplexity"), 0.001, {"mid": 0.5}), "medians")
    t = (F.col("log_perplexity") - F.col("mid")) * F.sqrt("n_bytes")
    q = _quantiles(good.join(mid, "lang_key"), t, 0.01, {"q1": 0.25, "q3": 0.75})
    wide = SPREAD * F.greatest(F.col("q3") - F.col("q1"), F.lit(NARROWEST))
    return mid.join(q, "lang_key").select("lang_key", "mid", (F.col("q1") - wide).alias("low_t"), (F.col("q3") + wide).alias("high_t"))


def score_quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", model: KneserNey | None = None) -> DataFrame:
    """One row per document: counts, perplexity, its language's bands, base_failed and kept.

    The model counts every distinct text unless one is given, fitted on other rows. The scored rows, without texts,
    are written to the shared folder once, as the bands need all of them before any verdict.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.xxhash64(F.col(text)).alias("text_key"), F.col(text).alias("text"))
    kinds, keep = dict(d.dtypes), ["doc_id", "lang", "text_key"]
    schema = f"doc_id {kinds['doc_id']}, lang {kinds['lang']}, text_key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_bytes long, log_perplexity double"
    kn = None
    if model is None:  # all n-grams of the texts are in the top order, so no other is needed
        top = common.materialize(_top(smooth(count_ngrams(d))), "model")
        model = KneserNey.collect(top) if top.count() <= MODEL_ROWS else None
    if model is None:
        rows = _score_by_blocks(d, top, keep, schema)
    else:
        kn = spark.sparkContext.broadcast(model)
        rows = d.mapInArrow(_scorer(kn, keep), schema)
    rows = rows.withColumn("base_failed", base_failed()).withColumn("lang_key", F.coalesce(F.col("lang").cast("string"), F.lit("")))
    rows = common.materialize(rows, "perplexity")
    if kn is not None:
        kn.destroy()
    root = F.sqrt(F.greatest(F.col("n_bytes"), F.lit(1)))
    out = rows.join(common.small_side(bands(rows), "bands"), "lang_key", "left").withColumn("low", F.exp(F.col("mid") + F.col("low_t") / root - TOLERANCE)).withColumn("high", F.exp(F.col("mid") + F.col("high_t") / root + TOLERANCE))
    inside = F.exp("log_perplexity").between(F.col("low"), F.col("high"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"), F.exp("log_perplexity").alias("perplexity"), "low", "high",
    )


def op1_ngram_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(spark.read.parquet(common.table_path(sf_dir, "documents")))
