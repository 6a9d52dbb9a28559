"""Secret scans: pattern kinds, and strings whose novelty a dictionary-primed Zstandard coder measures.

Kinds assign, access and hex are patterns. A candidate of kind novel is a run of token characters of MIN_TOKEN or more
with a sensitive word near it, before or after; it (of both cases or with digits) is compressed after the text around
it, by a coder primed with common identifiers and with the corpus's own commonest ones, and reported if it takes over
so many bits a character more than the text alone: MIN_BITS, or LOW_BITS if it has no capitals but digits as random
strings have, whose common characters cost less. Keys and random strings do, words and common identifiers do not,
nor what is half made of them. Its
other occurrences around are left out, so that a key shown twice is as new as one shown once. In a run with names in
it, NAME=VALUE or sk_..., each value is measured for itself with its name as context; if none is novel, the run is
measured as a whole. Patterns' spans stay as they are; novel ones that overlap them are left out. Whole texts are
scanned as bytes; spans count code points, ends exclusive.

Null and empty texts have no spans; long texts take time in proportion; repeated rows are scanned alike, and copies
count for the corpus's identifiers; ties among these go by name; further columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import common

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")  # on lowered ASCII
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
MIN_VALUE, MIN_HEX = 6, 24
#: Words that make the bytes before a candidate a sensitive context.
SENSITIVE = re.compile(rb"secret|token|passw|api_?key|access|auth|bearer|credential|private|signature|session|cookie|login|sk_|pk_|key")
MIN_TOKEN, NEAR, AROUND, MIN_BITS, MIN_LETTERS = 16, 48, 512, 6.8, 4
#: An identifier of the corpus: a run of token characters without digits, too short for a candidate, so no part of a key is one.
IDENTIFIER = re.compile(rb"(?<![A-Za-z0-9+/_=.-])[A-Za-z_]{4,%d}(?![A-Za-z0-9+/_=-])" % (MIN_TOKEN - 1))
PARTS = re.compile(rb"[A-Z]?[a-z]{3,}|[A-Z]{4,}|(?<![A-Za-z0-9])[A-Za-z]{1,3}(?![A-Za-z0-9])")
#: So many of the corpus's identifiers prime the coder, the commonest last, where they cost least; a top-k by feature.
COMMONEST = 2000
#: Bits a character of candidates without capitals, one in SOME_DIGITS or more of whose characters is a digit.
LOW_BITS, SOME_DIGITS = 5.4, 8
#: What may stand at either end of a key but is no part of it, such as a full stop.
ENDS = b"=._-/+"
VALUES = re.compile(rb"[A-Za-z0-9+/_.-]{%d,}" % MIN_TOKEN)
#: A prefix that names a key.
PREFIX = re.compile(rb"(?<![A-Za-z0-9])(?:sk|pk)[_-](?:(?:live|test|prod)[_-])?")
#: An equals sign between a name and a value; those at a value's end are its padding.
NAMES = re.compile(rb"(?<=[^=])=(?=[^=])")
#: What code and configuration commonly say; a coder primed with it finds nothing new in it.
IDENTIFIERS = (
    "import from return function class public private static void string integer boolean const default export async await "
    "username password secret access_token refresh_token api_key client_id client_secret authorization bearer content-type "
    "application/json https://www.example.com/api/v1/users config settings environment variable localhost database connection "
    "timeout version package module request response header cookie session login logout signature certificate begin end "
    "private_key public_key aws_access_key_id aws_secret_access_key region bucket endpoint hostname port user email address "
    "created_at updated_at identifier description enabled disabled true false null none undefined error exception message"
)
#: Plain prose before the text around, so that a coder with little of that still expects ordinary letters.
PROSE = (
    b"The house stood by the river, and every morning the people of the village came down to the water with their boats. "
    b"Some of them went to work in the fields; others stayed to mend what the wind had broken during the night. In winter "
    b"there was little to do, so they told each other stories about the old days, and the children listened until it was dark. "
)

_TOKEN = np.zeros(256, bool)
_TOKEN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-")] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True


def runs(mask: np.ndarray, off: np.ndarray, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Starts and ends of runs of at least so many bytes, not across rows."""
    edge = np.zeros(len(mask) + 1, np.int8)
    edge[:-1] = mask
    edge[1:] -= mask
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    inner = off[1:-1]
    cut = inner[(inner > 0) & (inner < len(mask))]
    cut = np.unique(cut[mask[cut] & mask[cut - 1]]) if len(cut) else cut
    starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    ok = ends - starts >= least
    return starts[ok], ends[ok]


def _count_identifiers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of the texts of a task, handed on whenever a million have gathered."""

    def out(n: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in n], pa.string()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    n: Counter = Counter()
    for batch in batches:
        b, off = common.text_buffer(batch.column(0))
        for lo, hi in common.groups(off):  # no word goes on over a line end, so rows are joined by one
            n.update(IDENTIFIER.findall(b"\n".join(b[off[i] : off[i + 1]].tobytes() for i in range(lo, hi))))
            if len(n) > 1_000_000:
                yield out(n)
                n = Counter()
    yield out(n)


def common_identifiers(docs: DataFrame, text: str = "text", most: int = COMMONEST) -> list[str]:
    """The corpus's commonest identifiers, the commonest last; all texts are counted."""
    common.small_batches(docs.sparkSession)
    counts = docs.select(F.col(text)).mapInArrow(_count_identifiers, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in reversed(counts.orderBy(F.desc("n"), "word").limit(most).collect())]


class Novelty:
    """Marginal compressed size of a string after its surroundings."""

    def __init__(self, identifiers: list[str] | None = None):
        known = " ".join([*(identifiers or []), IDENTIFIERS, IDENTIFIERS.upper()]).encode()
        dictionary = zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(level=3)
        self.known = frozenset(w for w in re.findall(rb"[a-z]+", known.lower()) if len(w) >= 4)
        self.press = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False)

    def composed(self, text: bytes) -> bool:
        """Half of the letters and digits or more are words of the dictionary or short ones between marks."""
        words = sum(len(w) for w in PARTS.findall(text) if len(w) < 4 or w.lower() in self.known)
        return 2 * words >= len(re.findall(rb"[A-Za-z0-9]", text))

    def bits(self, before: bytes, text: bytes, after: bytes) -> float:
        """Bits a character that text adds to before and after."""
        plain = PROSE + before + after
        return 8 * (len(self.press.compress(plain + text)) - len(self.press.compress(plain))) / len(text)


def around(text: bytes, s: int, e: int) -> tuple[bytes, bytes]:
    """AROUND bytes before and after a candidate without its other occurrences, whole or in part of MIN_TOKEN or more."""
    core = text[s:e].strip(ENDS) or text[s:e]
    alone = lambda m: b" " if m[0].strip(ENDS) in core else m[0]
    reach = AROUND + len(core)
    before, after = (VALUES.sub(alone, x.replace(core, b" ")) for x in (text[max(0, s - reach) : s], text[e : e + reach]))
    return before[-AROUND:], after[:AROUND]


def least_bits(value: bytes) -> float:
    """Bits a character over which a candidate is novel, by its alphabet."""
    return LOW_BITS if value == value.lower() and SOME_DIGITS * len(re.findall(rb"[0-9]", value)) >= len(value) else MIN_BITS


def parts(text: bytes, s: int, e: int) -> list[tuple[int, int, int]]:
    """(start of the name, start, end) of the values of MIN_TOKEN or more in a run with a name or a prefix in it.

    A part before the first name has none and starts where it does.
    """
    cuts = [s, *(m.end() for m in NAMES.finditer(text, s, e))]
    out = []
    for k, at in enumerate(cuts):
        end, name = cuts[k + 1] - 1 if k + 1 < len(cuts) else e, cuts[max(k - 1, 0)]
        m = PREFIX.search(text[at:end])
        if m and end - at - m.end() >= MIN_TOKEN:
            out += [(name, at, at + m.start()), (at + m.start(), at + m.end(), end)]
        else:
            out.append((name, at, end))
    return [x for x in out if x[2] - x[1] >= MIN_TOKEN]


class Covered:
    """Ranges that spans cover, joined where they overlap."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts, self.ends = [], []
        for s, _, e in spans:  # ascending
            if self.ends and s <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meets(self, s: int, e: int) -> bool:
        k = bisect_left(self.starts, e) - 1  # the last range that begins before e
        return k >= 0 and self.ends[k] > s


def sensitive(low: bytes, name: int, s: int, e: int) -> bool:
    """A sensitive word within NEAR bytes before a candidate, or in its name, or within NEAR bytes after it."""
    return bool(SENSITIVE.search(low, max(0, min(name, s - NEAR)), s) or SENSITIVE.search(low, e, e + NEAR))


def scan(text: bytes, hex_runs: list[tuple[int, int]], token_runs: list[tuple[int, int]], novelty: Novelty) -> list[tuple[int, int, int]]:
    """(start, kind, end) byte spans of a text, ascending."""
    low = text.lower()
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(low) if m.end(2) - m.start(2) >= MIN_VALUE] if b":" in low or b"=" in low else []
    if b"AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(s, 2, e) for s, e in hex_runs]
    base = Covered(sorted(found))

    def novel(s: int, e: int) -> bool:
        letters = re.sub(rb"[^A-Za-z]", b"", text[s:e])
        if len(letters) < MIN_LETTERS or (letters == letters.lower() or letters == letters.upper()) and not re.search(rb"[0-9]", text[s:e]):
            return False  # a number, a date or a plain word
        if novelty.composed(text[s:e]):
            return False
        before, after = around(text, s, e)
        return novelty.bits(before, text[s:e], after) > least_bits(text[s:e])

    for s, e in token_runs:  # a run without names is its only part
        own = parts(text, s, e)
        values = [(v, z) for at, v, z in own if not base.meets(v, z) and sensitive(low, at, v, z) and novel(v, z)]
        if values:
            found += [(v, 3, z) for v, z in values]
        elif own != [(s, s, e)] and not base.meets(s, e) and sensitive(low, s, s, e) and novel(s, e):
            found.append((s, 3, e))
    return sorted(found)


def _rows(b: np.ndarray, off: np.ndarray, novelty: Novelty) -> Iterator[tuple[bytes, list[tuple[int, int, int]]]]:
    raw = b.tobytes()
    hexes, tokens = runs(_HEX[b], off, MIN_HEX), runs(_TOKEN[b], off, MIN_TOKEN)
    at = [np.searchsorted(s, off) for s, _ in (hexes, tokens)]
    for i in range(len(off) - 1):
        lo, hi = int(off[i]), int(off[i + 1])
        own = [[(int(s) - lo, int(e) - lo) for s, e in zip(r[0][p[i] : p[i + 1]], r[1][p[i] : p[i + 1]], strict=True)] for r, p in zip((hexes, tokens), at, strict=True)]
        text = raw[lo:hi]
        yield text, scan(text, *own, novelty)


def points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans in code points."""
    if text.isascii() or not spans:
        return spans
    b = np.frombuffer(text, np.uint8)
    c = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
    return [(int(c[s]), k, int(c[e])) for s, k, e in spans]


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan_batches(batches: Iterator[pa.RecordBatch], identifiers: list[str]) -> Iterator[pa.RecordBatch]:
    novelty = Novelty(identifiers)
    for batch in batches:
        b, off = common.text_buffer(batch.column(1))
        out: list[tuple] = []
        for lo, hi in common.groups(off):
            for text, found in _rows(b[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], novelty):
                spans = points(text, found)
                base = [x for x in spans if x[1] < 3]
                out.append((*(sum(x[1] == k for x in spans) for k in range(4)), hashlib.sha256(_said(base).encode()).hexdigest(), _said(spans)))
        cols = list(zip(*out, strict=True)) or [()] * 6
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"])


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_novel, base_sha256 and spans of every document; texts are not shuffled."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    known = common_identifiers(d)
    return d.mapInArrow(lambda it: _scan_batches(it, known), f"doc_id {dict(d.dtypes)['doc_id']}, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with each span of text, joined with those it overlaps, replaced by mask; other columns as they are."""
    at, known = docs.columns.index(text), common_identifiers(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(known)
        for batch in batches:
            col = batch.column(at)
            b, off = common.text_buffer(col)
            out: list[bytes] = []
            for lo, hi in common.groups(off):
                for raw, found in _rows(b[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], novelty):
                    parts, end = [], 0
                    for s, _, e in found:
                        if s >= end:
                            parts += [raw[end:s], mask.encode()]
                        end = max(end, e)
                    out.append(b"".join(parts) + raw[end:])
            new = pa.array([None if not v else x.decode() for v, x in zip(np.asarray(col.is_valid()), out, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([new if k == at else c for k, c in enumerate(batch.columns)], batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op3_zstd_novelty_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(common.table_path(sf_dir, "documents")))
