"""Document fingerprints by winnowing, by DataFrame functions only.

Every K code points in a row are hashed; in each window of WINDOW hashes the smallest is chosen, of equal ones the
rightmost; chosen hashes keep their positions. Two texts that share K + WINDOW - 1 code points on end share a
fingerprint. Windows are taken in blocks of BLOCK, so what a long text needs at once is bounded; a window's
minimum comes from doubled spans, log2(WINDOW) steps for all windows of a block together.

A text below K code points is one gram; a null or empty text has an empty fingerprint; equal texts have equal
fingerprints. Likeness is the Jaccard similarity of the distinct hashes, 1 for two empty fingerprints.
Null doc_ids come first, repeated ones are ordered by a hash of the text; the only document follows itself; further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm import common

K, WINDOW, BLOCK = 16, 64, 4096
SPAN = K + WINDOW - 1
#: A hash keeps HASH_BITS bits; the rest of a 63-bit key is the place in the block, so that of equal hashes the right one is less.
PLACE_BITS = 13
HASH_BITS = 63 - PLACE_BITS
_LAST = (1 << PLACE_BITS) - 1
#: Ranges of doc_id for each shuffle partition, more than one so that hashing evens them out.
RANGES = 4


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def _block_minima(code: Column, n: Column, windows: Column, lo: Column) -> Column:
    """The distinct keys chosen by the windows from lo on, at most BLOCK of them; code is UTF-32."""
    hi = F.least(windows, lo + BLOCK)  # windows lo to hi - 1
    grams = F.greatest(n - K + 1, F.lit(1))
    last = F.least(grams, hi + WINDOW - 1) - 1
    k = F.lit(4 * K)

    def key(i: Column) -> Column:
        h = F.xxhash64(F.substring(code, (4 * i + 1).cast("int"), k))
        return F.shiftleft(F.shiftrightunsigned(h, 64 - HASH_BITS), PLACE_BITS) + (F.lit(_LAST) - (i - lo))

    keys = F.transform(F.sequence(lo, last), key)

    def doubled(step: int) -> Callable[[Column], Column]:
        return lambda m: F.zip_with(m, F.slice(m, step + 1, F.greatest(F.size(m) - step, F.lit(0))), lambda a, b: F.least(a, b))

    span = 1
    while span < WINDOW:
        step = min(span, WINDOW - span)
        keys = let(keys, doubled(step))
        span += step
    return F.array_distinct(F.slice(keys, 1, (hi - lo).cast("int")))


def _distinct_places(entries: Column) -> Column:
    """Without entries at the place of the one before."""
    return let(entries, lambda e: F.filter(e, lambda x, i: (i == 0) | (x["pos"] != F.get(e, i - 1)["pos"])))


def winnow(text: Column) -> Column:
    """array<struct<pos, hash>>, ascending by pos, of a string column."""

    def whole(code: Column) -> Column:
        n = (F.length(code) / 4).cast("long")
        windows = F.greatest(n - SPAN + 1, F.lit(1).cast("long"))

        def block(b: Column) -> Column:
            lo = b * BLOCK
            return F.transform(_block_minima(code, n, windows, lo), lambda x: F.struct((lo + (F.lit(_LAST) - x.bitwiseAND(F.lit(_LAST)))).alias("pos"), F.shiftright(x, PLACE_BITS).alias("hash")))

        blocks = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((windows - 1) / BLOCK)), block)
        return F.when(n > 0, _distinct_places(F.flatten(blocks))).otherwise(F.array().cast("array<struct<pos:bigint,hash:bigint>>"))

    return let(F.encode(F.coalesce(text, F.lit("")), "UTF-32"), whole)


def within(entries: Column, size: Column) -> Column:
    """Those entries chosen by a window that ends inside the first size code points.

    The first window that chooses an entry begins after the entry before, or, if this one is no larger than that,
    where this one comes in.
    """

    def inside(x: Column, i: Column) -> Column:
        before = F.get(entries, i - 1)
        first = F.when(i == 0, F.lit(0)).when(x["hash"] <= before["hash"], x["pos"] - (WINDOW - 1)).otherwise(before["pos"] + 1)
        return first + SPAN <= size

    return F.filter(entries, inside)


def spliced(head: Column, head_print: Column, head_size: Column, tail: Column, tail_print: Column, tail_size: Column) -> Column:
    """winnow(left(head, head_size) || left(tail, tail_size)) from the whole texts' fingerprints.

    Windows on either side of the seam are theirs; only those across it are hashed anew.
    """
    size = head_size + tail_size
    lo = F.greatest(head_size - (SPAN - 1), F.lit(0))
    seam = F.concat(F.substring(head, (lo + 1).cast("int"), (head_size - lo).cast("int")), F.left(tail, F.least(tail_size, F.lit(SPAN - 1)).cast("int")))
    move = lambda e, by: F.transform(e, lambda x: F.struct((x["pos"] + by).alias("pos"), x["hash"].alias("hash")))
    none = F.array().cast("array<struct<pos:bigint,hash:bigint>>")
    across = F.when((size < SPAN) | (F.length(seam) >= SPAN), move(winnow(seam), lo)).otherwise(none)
    return _distinct_places(F.concat(within(head_print, head_size), across, move(within(tail_print, tail_size), head_size)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the distinct hashes."""
    x, y = a["hash"], b["hash"]
    both, all_ = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return F.when(all_ == 0, F.lit(1.0)).otherwise(both / all_).cast("double")


def said(entries: Column) -> Column:
    """pos:hash, the hash in hexadecimal digits, with blanks between."""
    return F.array_join(F.transform(entries, lambda x: F.concat(x["pos"].cast("string"), F.lit(":"), F.lower(F.hex(x["hash"])))), " ")


def with_next(docs: DataFrame, body: Callable[[DataFrame], DataFrame], columns: list[str]) -> DataFrame:
    """body(docs with doc_id, text), with next_<c> of the document after it, in ascending doc_id, for each of columns.

    Documents are dealt out by ranges of doc_id with one shuffle of the texts; each range also gets the first
    documents of the next one, the last those of the first. To the driver comes the least doc_id of each range.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("at", F.coalesce("doc_id", F.lit(-(1 << 63))))
    n_ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = d.select("at").repartitionByRange(n_ranges, "at").groupBy(F.spark_partition_id().alias("p")).agg(F.min("at").alias("least"))
    bounds = sorted({r.least for r in ranges.collect()}) or [0]
    # a range is found in two steps of about sqrt(ranges) comparisons, by arrays in a single broadcast row
    step = max(1, round(len(bounds) ** 0.5))
    parts = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    table = F.broadcast(spark.createDataFrame([([p[0] for p in parts], parts)], "heads array<bigint>, parts array<array<bigint>>"))
    at_most = lambda values: F.size(F.filter(values, lambda v: v <= F.col("at"))) - 1
    own = d.crossJoin(table).withColumn("part", at_most(F.col("heads"))).withColumn("own", F.get("parts", F.col("part"))).withColumn("nth", at_most(F.col("own")))
    own = own.select("doc_id", "text", "at", (F.col("part") * step + F.col("nth")).alias("block"), F.get("own", F.col("nth")).alias("low"))
    n = len(bounds)
    place = lambda block, turn, copy: F.struct(block.alias("block"), F.lit(turn).alias("turn"), F.lit(copy).alias("copy"))
    edge = F.col("at") == F.col("low")
    places = F.filter(F.array(place(F.col("block"), 0, False), F.when(edge & (F.col("block") > 0), place(F.col("block") - 1, 0, True)), F.when(edge & (F.col("block") == 0), place(F.lit(n - 1), 1, True))), lambda x: x.isNotNull())
    dealt = own.select("doc_id", "text", "at", F.explode(places).alias("x")).select("doc_id", "text", "at", "x.*").repartition("block")
    rows = body(dealt)
    w = W.partitionBy("block").orderBy("turn", "at", F.xxhash64("text"), "copy")
    return rows.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns}).where(~F.col("copy"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""

    def body(d: DataFrame) -> DataFrame:
        return d.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("print", winnow(F.col("text")))

    d = with_next(docs, body, ["text", "print"])
    n = F.length("text").cast("long")
    d = d.withColumn("n_chars", n).withColumn("n_head", n - F.floor(n / 2)).withColumn("n_tail", F.least(F.floor(n / 2), F.length("next_text").cast("long")))
    edited = F.concat(F.left("text", F.col("n_head").cast("int")), F.left("next_text", F.col("n_tail").cast("int")))
    d = d.withColumn("edited", spliced(F.col("text"), F.col("print"), F.col("n_head"), F.col("next_text"), F.col("next_print"), F.col("n_tail")))
    return d.select(
        "doc_id", "n_chars", F.sha2(edited.cast("binary"), 256).alias("edited_sha256"), said(F.col("print")).alias("fingerprint"), said(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(spark.read.parquet(common.table_path(sf_dir, "documents")))
