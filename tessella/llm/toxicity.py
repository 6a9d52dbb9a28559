"""Toxicity by class-conditional Kneser-Ney models.

A bigram model of all labelled texts, with an absolute discount, backs off to continuation counts: the distinct words
that a word follows. Each class has its own continuation counts, and its bigrams are joined by PAIR_BACKOFF counts (its
words by BACKOFF) dealt out as in both classes together, so rare ones say little; all bigrams and words count. Each window of some words has the
difference of the two length-normalised log-likelihoods; a text takes its highest window, so a short passage in a long text counts as in a short text. A
logistic curve over the highest windows of WIDTHS words, fitted on labelled rows of their own fold, gives the score.

Labels come from rows whose crc32(doc_id as text) mod 5 is not 0: folds 1 to 3 give the counts, fold 4 the curve;
at most FIT_ROWS rows of each class and purpose, those of the smallest xxhash64(doc_id), are used, a bound on the
classifier's sample. Every text is scored whole. Null and empty texts get the score of no evidence; null labels
are left out; without labels of both classes all scores are 0; repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import common

FOLDS, FIT_ROWS = 5, 5000
#: Words in a row over which log-likelihoods are normalised; a text shorter than a width counts as padded.
WIDTHS = (1, 4, 16)
#: Absolute discount of the bigrams, and the shared backoff counts that each class's words and bigrams are smoothed with.
DISCOUNT, BACKOFF, PAIR_BACKOFF = 0.75, 2.0, 50.0

_STRIP = np.zeros(256, bool)
_STRIP[list(b".,;:!?\"'()[]{}*#$%&|<>-_~`^/\\+=")] = True


def _trim(low: np.ndarray, s: np.ndarray, e: np.ndarray) -> None:
    """Leave out up to four marks at either end of each word."""
    for _ in range(4):
        at = np.flatnonzero((s < e - 1) & _STRIP[low[s]])
        s[at] += 1
        at = np.flatnonzero((s < e - 1) & _STRIP[low[e - 1]])
        e[at] -= 1


def word_keys(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and row numbers of the words, ASCII letters lowered, marks at either end left out."""
    return common.hashed_words(np.where((b >= 65) & (b <= 90), b | 32, b).astype(np.uint8), off, _trim)


def pair_keys(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Bigram hashes of each word with the one before; a row's first word follows nothing."""
    before = np.zeros_like(h)
    if len(h):
        before[1:] = np.where(row[1:] == row[:-1], h[:-1], np.uint64(0))
    return common.mix(before * np.uint64(0x9E3779B97F4A7C15) + h)


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(order, key, before, word, toxic, n) counts of each batch."""
    for batch in batches:
        b, off = common.text_buffer(batch.column(0))
        toxic = np.asarray(batch.column(1)).astype(np.int64)
        for lo, hi in common.groups(off):
            h, row = word_keys(b[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            if not len(h):
                continue
            before = np.zeros_like(h)
            before[1:] = np.where(row[1:] == row[:-1], h[:-1], np.uint64(0))
            side = toxic[lo:hi][row]
            for c in (0, 1):
                k = pair_keys(h, row)[side == c]
                u, at, n = np.unique(k, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (u, before[side == c][at], h[side == c][at])] + [pa.array(np.full(len(u), c)), pa.array(n)], ["key", "before", "word", "toxic", "n"])


class LowerOrder:
    """Either class's continuation probability of each word, and what follows it, by sorted word hashes."""

    def __init__(self, t: pa.Table):
        """t: word and, for either class, c (distinct words before) and s (tokens after); c and k, distinct words before and after in any class."""
        order = np.argsort(t.column("word").to_numpy())
        col = lambda k: t.column(k).to_numpy()[order].astype(float)
        self.words = t.column("word").to_numpy()[order]
        p0 = col("c") / max(col("c").sum(), 1)
        total = [col(f"c{c}").sum() for c in (0, 1)]
        self.p0, self.kinds = p0, col("k")
        known = p0 > 0  # not so what only stands for the start of a row
        self.p = np.array([p0 * (col(f"c{c}") + BACKOFF) / (p0 * total[c] + BACKOFF) for c in (0, 1)])
        self.gap = np.zeros(len(p0), np.float32)
        self.gap[known] = np.log(self.p[1][known] / self.p[0][known])
        self.s = np.array([col(f"s{c}") for c in (0, 1)])

    def pair_gaps(self, before: np.ndarray, word: np.ndarray, n: list[np.ndarray]) -> np.ndarray:
        """log p_toxic - log p_ordinary of bigrams met n[c] times in either class."""
        at, ctx = np.searchsorted(self.words, word), np.searchsorted(self.words, before)
        shared = (np.maximum(n[0] + n[1] - DISCOUNT, 0) + DISCOUNT * self.kinds[ctx] * self.p0[at]) / self.s[:, ctx].sum(axis=0)
        log_p = []
        for c in (0, 1):
            p = shared * self.p[c][at] / self.p0[at]
            log_p.append(np.log(p * (n[c] + PAIR_BACKOFF) / (p * self.s[c][ctx] + PAIR_BACKOFF)))
        return (log_p[1] - log_p[0]).astype(np.float32)


class ClassModels:
    """Differences of the classes' log p(word | before) as sorted arrays of word and bigram hashes."""

    def __init__(self, lower: LowerOrder, pairs: pa.Table):
        """pairs: key and gap of each bigram."""
        self.words, self.uni_gap = lower.words, lower.gap
        key = pairs.column("key").to_numpy()
        order = np.argsort(key)
        self.pairs, self.pair_gap = key[order], pairs.column("gap").to_numpy()[order]

    def word_gaps(self, h: np.ndarray, row: np.ndarray) -> np.ndarray:
        """log p_toxic - log p_ordinary of each word; words of neither class count nothing."""
        out = np.zeros(len(h), np.float32)
        if len(self.words) and len(h):
            w = h.view(np.int64)
            at = np.minimum(np.searchsorted(self.words, w), len(self.words) - 1)
            known = self.words[at] == w
            out[known] = self.uni_gap[at[known]]
            if len(self.pairs):
                k = pair_keys(h, row).view(np.int64)
                at = np.minimum(np.searchsorted(self.pairs, k), len(self.pairs) - 1)
                hit = self.pairs[at] == k
                out[hit] = self.pair_gap[at[hit]]
        return out

    def evidence(self, b: np.ndarray, off: np.ndarray) -> np.ndarray:
        """A column for each of WIDTHS: a row's highest mean gap over so many words on end; 0 for no words."""
        h, row = word_keys(b, off)
        n = len(off) - 1
        out = np.zeros((n, len(WIDTHS)))
        if not len(h):
            return out
        c = np.concatenate([[0], np.cumsum(self.word_gaps(h, row).astype(np.float64))])
        first, last = np.searchsorted(row, np.arange(n)), np.searchsorted(row, np.arange(n), "right")
        for j, width in enumerate(WIDTHS):
            out[:, j] = (c[last] - c[first]) / width
            if len(h) >= width:
                mean = (c[width:] - c[:-width]) / width
                ok = row[: len(mean)] == row[width - 1 :]
                top = np.full(n, -np.inf)
                np.maximum.at(top, row[: len(mean)][ok], mean[ok])
                out[:, j] = np.where(last - first >= width, top, out[:, j])
        return out


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """a, b of 1 / (1 + exp(-(x a + b))) by Newton's method with a small ridge."""
    m, s = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - m) / s, np.ones(len(x))])
    t, ridge = np.zeros(z.shape[1]), np.diag([0.1] * x.shape[1] + [1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ t, -30, 30)))
        hess = (z * (p * (1 - p))[:, None]).T @ z + ridge
        t = t - np.clip(np.linalg.solve(hess, z.T @ (p - y) + ridge @ t), -2, 2)
    return t[:-1] / s, float(t[-1] - (t[:-1] / s) @ m)


class Scorer:
    def __init__(self, models: ClassModels | None, a=0.0, b: float = 0.0):
        self.models, self.a, self.b = models, a, b

    def score(self, b: np.ndarray, off: np.ndarray) -> np.ndarray:
        if self.models is None:
            return np.zeros(len(off) - 1)
        return 1 / (1 + np.exp(-np.clip(self.models.evidence(b, off) @ self.a + self.b, -500, 500)))


def fold(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame) -> Scorer:
    """Models and curve from labelled rows outside fold 0; at most 4 * FIT_ROWS texts in all."""
    spark = docs.sparkSession
    y = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    y = y.withColumn("fold", fold(F.col("doc_id"))).where("fold <> 0").withColumn("curve", F.col("fold") == FOLDS - 1)
    parts = [y.where((F.col("toxic") == c) & (F.col("curve") == v)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS) for c in (0, 1) for v in (False, True)]
    chosen = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).select("doc_id", "toxic", "curve")
    texts = common.materialize(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic", "curve"), "labelled")  # 4 * FIT_ROWS rows at most
    counts = texts.where("not curve").select("text", F.col("toxic").cast("long")).mapInArrow(_counter, "key long, before long, word long, toxic long, n long")
    counts = common.materialize(counts.groupBy("key", "before", "word", "toxic").agg(F.sum("n").alias("n")), "bigrams")
    n = [F.coalesce(F.sum(F.when(F.col("toxic") == c, F.col("n"))), F.lit(0)).alias(f"n{c}") for c in (0, 1)]
    pairs = common.materialize(counts.groupBy("key", "before", "word").agg(*n), "pairs")
    onto = pairs.groupBy("word").agg(*[F.sum((F.col(f"n{c}") > 0).cast("long")).alias(f"c{c}") for c in (0, 1)], F.count("*").alias("c"))
    after = pairs.groupBy(F.col("before").alias("word")).agg(*[F.sum(f"n{c}").alias(f"s{c}") for c in (0, 1)], F.count("*").alias("k"))
    t = onto.join(after, "word", "full").na.fill(0).toArrow()  # the vocabulary of a bounded sample
    if not all(np.asarray(t.column(f"c{c}")).any() for c in (0, 1)):
        return Scorer(None)
    lower = LowerOrder(t)
    given = spark.sparkContext.broadcast(lower)

    def gaps(batches):
        for batch in batches:
            key, before, word, *n = (np.asarray(batch.column(k)) for k in ("key", "before", "word", "n0", "n1"))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(given.value.pair_gaps(before, word, n))], ["key", "gap"])

    models = ClassModels(lower, pairs.mapInArrow(gaps, "key long, gap float").toArrow())
    given.destroy()
    shared = spark.sparkContext.broadcast(Scorer(models))

    def evidence(batches):
        for batch in batches:
            b, off = common.text_buffer(batch.column(0))
            for lo, hi in common.groups(off):
                yield pa.RecordBatch.from_arrays([pa.array(list(shared.value.models.evidence(b[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])), pa.list_(pa.float64())), batch.column(1).slice(lo, hi - lo)], ["x", "toxic"])

    e = texts.where("curve").select("text", F.col("toxic").cast("long")).mapInArrow(evidence, "x array<double>, toxic long").toArrow()
    shared.destroy()
    x, c = np.array(e.column("x").to_pylist()), e.column("toxic").to_numpy()
    if len(np.unique(c)) < 2:  # too few labels for a curve: a plain mean of the widths
        return Scorer(models, np.full(len(WIDTHS), 4.0 / len(WIDTHS)), -4.0)
    return Scorer(models, *_logistic(x, c.astype(float)))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    spark = docs.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(fit(docs, labels))

    def run(batches):
        for batch in batches:
            b, off = common.text_buffer(batch.column(1))
            s = [shared.value.score(b[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]) for lo, hi in common.groups(off)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(s) if s else np.zeros(0))], ["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """docs without those that score 0.5 or more; all columns as they are, no shuffle."""
    spark = docs.sparkSession
    common.small_batches(spark)
    shared, at = spark.sparkContext.broadcast(fit(docs, labels)), docs.columns.index(text)

    def run(batches):
        for batch in batches:
            b, off = common.text_buffer(batch.column(at))
            s = [shared.value.score(b[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]) for lo, hi in common.groups(off)]
            yield batch.filter(pa.array(np.concatenate(s) < 0.5 if s else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)


def op9_class_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(spark.read.parquet(common.table_path(sf_dir, "documents")), spark.read.parquet(common.table_path(sf_dir, "labels")))
