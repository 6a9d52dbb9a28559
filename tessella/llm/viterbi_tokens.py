"""SentencePiece encoding and decoding by batched numpy Viterbi.

The vocabulary file is read as it is; a text is the sequence of pieces of the largest total score. As no piece goes
on from a letter to the blank mark, the best path splits at blanks, so each word is solved once for a worker's memory of words.
Words of equal length advance together: at each end, the hashes of all substrings that end there are looked up in
the sorted piece hashes, and the best start is a vectorised maximum; scores are summed in 64 bits. A word over LONG
code points, such as a text without blanks, advances alone: all its substrings of one length are looked up at once,
STRETCH ends at a time, so it takes a few bytes a code point. A code point outside the vocabulary costs the lowest
score less UNKNOWN and is spelled by byte pieces, or is the unknown id where the file has none.

Blanks: each U+0020 becomes the mark U+2581, one mark is put before the text; nothing else is normalised. Decoding
takes pieces and bytes back and drops the first mark. Null and empty texts have no ids; repeated rows are encoded
alike, ties take the longer last piece; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import common
from tessella.llm.tokens import MEMO, WordMemo

MARK, UNKNOWN = 0x2581, 10.0
LONG, STRETCH = 64, 1 << 14
NORMAL, UNK, CONTROL, BYTE = 1, 2, 3, 6
_BASE = np.uint64(0x9E3779B97F4A7C15)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes) -> Iterator[tuple[int, int, bytes | int]]:
    """(number, wire type, value) of the fields of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, 0, varint()
        elif tag & 7 == 2:
            size = varint()
            yield tag >> 3, 2, data[at : at + size]
            at += size
        else:
            size = 4 if tag & 7 == 5 else 8
            yield tag >> 3, tag & 7, data[at : at + size]
            at += size


def read_pieces(data: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, type) of a model file."""
    out = []
    for number, _, value in _fields(data):
        if number == 1:
            f = {n: v for n, _, v in _fields(value)}
            out.append((f.get(1, b"").decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
    return out


class Vocabulary(WordMemo):
    def __init__(self, path: str, memo: int = MEMO):
        super().__init__(memo)
        with open(path, "rb") as f:
            pieces = read_pieces(f.read())
        normal = [(p, s, i) for i, (p, s, t) in enumerate(pieces) if t == NORMAL]
        self.longest = max(len(p) for p, _, _ in normal)
        self.lines_alone = not any("\n" in p for p, _, _ in normal)
        if any(a != "▁" and b == "▁" for p, _, _ in normal for a, b in zip(p, p[1:], strict=False)):
            raise ValueError("a piece goes on over a blank")
        keys = np.array([self._hash(np.array([ord(c) for c in p], np.uint64)) for p, _, _ in normal], np.uint64)
        order = np.argsort(keys)
        self.keys, self.piece_ids = keys[order], np.array([i for _, _, i in normal], np.int64)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.scores = np.array([s for _, s, _ in normal], np.float64)[order]
        self.unknown_score = self.scores.min() - UNKNOWN
        self.unknown = next((i for i, (_, _, t) in enumerate(pieces) if t == UNK), 0)
        self.bytes = np.full(256, -1, np.int64)
        for i, (p, _, t) in enumerate(pieces):
            if t == BYTE:
                self.bytes[int(p[3:5], 16)] = i
        said = [bytes([int(p[3:5], 16)]) if t == BYTE else p.encode() if t == NORMAL else " ⁇ ".encode() if t == UNK else b"" for p, _, t in pieces]
        self.said = np.frombuffer(b"".join(said), np.uint8)
        self.said_at = np.concatenate([[0], np.cumsum([len(x) for x in said])])

    @staticmethod
    def _hash(points: np.ndarray) -> np.uint64:
        with np.errstate(over="ignore"):
            h = np.uint64(0)
            for c in points:
                h = h * _BASE + c + np.uint64(1)
        return h

    def best(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best pieces of words of equal length, a row of code points each: flat ids and the words' offsets."""
        n, size = words.shape
        best, back = np.full((size + 1, n), -np.inf), np.zeros((size + 1, n), np.int32)
        piece = np.full((size + 1, n), -1, np.int64)
        best[0] = 0
        points = words.astype(np.uint64) + np.uint64(1)
        rows = np.arange(n)
        power = np.uint64(1)
        for end in range(1, size + 1):
            spans = min(end, self.longest)
            h, power = np.zeros(n, np.uint64), np.uint64(1)
            value, entry = np.empty((spans, n)), np.empty((spans, n), np.int64)
            for length in range(1, spans + 1):
                h = h + points[:, end - length] * power
                with np.errstate(over="ignore"):
                    power = power * _BASE
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                hit = self.keys[at] == h
                value[-length] = np.where(hit, best[end - length] + self.scores[at], -np.inf)
                entry[-length] = np.where(hit, self.piece_ids[at], -1)
            lone = np.where(entry[-1] < 0, best[end - 1] + self.unknown_score, -np.inf)
            value[-1] = np.maximum(value[-1], lone)
            pick = value.argmax(axis=0)  # of equal ones the longest, as it comes first
            best[end], back[end], piece[end] = value[pick, rows], spans - pick, entry[pick, rows]
        ids, owner, place = [], [], []
        at = np.full(n, size)
        step = 0
        while (live := np.flatnonzero(at > 0)).size:  # from the ends to the starts
            p = piece[at[live], live]
            ids.append(np.where(p >= 0, p, -2 - words[live, at[live] - 1].astype(np.int64)))
            owner.append(live)
            place.append(np.full(len(live), -step))
            at[live] -= back[at[live], live]
            step += 1
        ids, owner, place = np.concatenate(ids), np.concatenate(owner), np.concatenate(place)
        order = np.lexsort((place, owner))
        ids, owner = ids[order], owner[order]
        ids, size = self._spelled(ids)
        owner = np.repeat(owner, size)
        return ids, np.searchsorted(owner, np.arange(n + 1))

    def best_alone(self, word: np.ndarray) -> np.ndarray:
        """Best pieces of one long word of code points, as best finds them."""
        n, most = len(word), self.longest
        points = np.concatenate([np.zeros(most, np.uint64), word.astype(np.uint64) + np.uint64(1)])
        best = np.full(most + n + 1, -np.inf)  # best[most + e] is that of the first e code points
        best[most] = 0
        back, piece = np.empty(n + 1, np.int32), np.empty(n + 1, np.int64)
        lengths = np.arange(most, 0, -1)
        for lo in range(0, n, STRETCH):
            ends = np.arange(lo + 1, min(lo + STRETCH, n) + 1)
            value, entry = np.full((len(ends), most), -np.inf), np.full((len(ends), most), -1)
            h, power = np.zeros(len(ends), np.uint64), np.uint64(1)
            with np.errstate(over="ignore"):
                for length in range(1, most + 1):
                    h = h + points[most + ends - length] * power
                    power = power * _BASE
                    at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                    hit = (self.keys[at] == h) & (ends >= length)
                    value[hit, -length] = self.scores[at[hit]]
                    entry[hit, -length] = self.piece_ids[at[hit]]
            value[entry[:, -1] < 0, -1] = self.unknown_score
            for e, v, p in zip(ends.tolist(), value, entry, strict=True):
                total = best[e : e + most] + v
                k = int(total.argmax())  # of equal ones the longest, as it comes first
                best[most + e], back[e], piece[e] = total[k], lengths[k], p[k]
        ids, at = [], n
        while at:
            ids.append(piece[at] if piece[at] >= 0 else -2 - int(word[at - 1]))
            at -= back[at]
        return self._spelled(np.array(ids[::-1], np.int64))[0]

    def _spelled(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids with the lost code points, -2 - point, spelled out, and how many each has become."""
        size, lost = np.ones(len(ids), np.int64), np.flatnonzero(ids < 0)
        if not len(lost):
            return ids, size
        spelled = [self._spell(int(-2 - ids[k])) for k in lost]
        size[lost] = [len(x) for x in spelled]
        out, starts = np.repeat(ids, size), np.cumsum(size) - size
        for k, x in zip(lost, spelled, strict=True):
            out[starts[k] : starts[k] + len(x)] = x
        return out, size

    def _spell(self, point: int) -> list[int]:
        got = self.bytes[list(chr(point).encode())]
        return [self.unknown] if (got < 0).any() else got.tolist()

    def solve(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        by_size: dict[int, list[str]] = {}
        for w in words:
            by_size.setdefault(len(w), []).append(w)
        out, flat, sizes = [], [], []
        for length, members in by_size.items():
            if length > LONG:
                for w in members:
                    out.append(w)
                    flat.append(self.best_alone(np.frombuffer(w.encode("utf-32-le"), np.uint32)))
                    sizes.append(np.array([len(flat[-1])]))
                continue
            step = max(1, (1 << 20) // max(1, length))
            for lo in range(0, len(members), step):
                part = members[lo : lo + step]
                out += part
                if length:
                    ids, off = self.best(np.frombuffer("".join(part).encode("utf-32-le"), np.uint32).reshape(len(part), length))
                else:
                    ids, off = np.zeros(0, np.int64), np.zeros(len(part) + 1, np.int64)
                flat.append(ids)
                sizes.append(np.diff(off))
        return out, np.concatenate(flat), np.concatenate(sizes)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and offsets of an array of texts."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not len(texts):
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        cut = "\x01"  # words begin at blanks, and line ends, which are in no piece, stand alone
        if pc.any(pc.match_substring(texts, cut)).as_py() or not self.lines_alone:
            lists = [re.findall("▁*[^▁\n]+|▁+|\n" if self.lines_alone else "▁*[^▁]+|▁+", f"▁{t.replace(' ', '▁')}") if t else [] for t in texts.to_pylist()]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            flat = pa.array([w for x in lists for w in x], pa.large_string())
        else:
            none, mark = (pa.scalar(x, pa.large_string()) for x in ("", "▁"))
            t = pc.if_else(pc.equal(texts, none), none, pc.binary_join_element_wise(mark, pc.replace_substring(texts, " ", "▁"), none))
            t = pc.replace_substring(pc.replace_substring_regex(t, "(▁+)", cut + "\\1"), "\n", f"{cut}\n{cut}")
            split = pc.split_pattern(t, cut)
            bounds = np.asarray(split.offsets).astype(np.int64)
            flat = split.values.slice(bounds[0], bounds[-1] - bounds[0])
            bounds -= bounds[0]
        ids, ends = self.lookup(flat)
        return ids.astype(np.int64), ends[bounds]

    def decode(self, ids: np.ndarray, off: np.ndarray) -> list[str]:
        """Texts of flat ids: pieces side by side, marks as blanks, the first dropped."""
        size = (self.said_at[1:] - self.said_at[:-1])[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        data = self.said[np.repeat(self.said_at[ids] - ends[:-1], size) + np.arange(ends[-1])].tobytes()
        cuts = ends[off]
        out = []
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            t = data[a:z].decode("utf-8", "replace").replace("▁", " ")
            out.append(t[1:] if t.startswith(" ") else t)
        return out


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary for a worker process."""
    return Vocabulary(path)


def _coder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            _, at = common.text_buffer(batch.column(1))
            for lo, hi in common.groups(at, 8 << 20):
                col = batch.column(1).slice(lo, hi - lo)
                ids, off = v.encode(col)
                back = v.decode(ids, off)
                raw = ids.astype("<u4")
                crc = [zlib.crc32(raw[a:z]) for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                sha = [hashlib.sha256(t.encode()).hexdigest() for t in back]
                same = [(t or "").replace("▁", " ") == b for t, b in zip(col.to_pylist(), back, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(off)), pa.array(crc, pa.int64()), pa.array(sha), pa.array(same)], ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip"])

    return run


def encode_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id and ids (array) of every document."""
    common.small_batches(docs.sparkSession)
    where = path or default_path()

    def run(batches):
        for batch in batches:
            ids, off = vocabulary(where).encode(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return d.mapInArrow(run, f"doc_id {dict(d.dtypes)['doc_id']}, ids array<int>")


def decode_ids(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows of encode_texts."""
    where = path or default_path()

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            off = np.asarray(lists.offsets).astype(np.int64)
            texts = vocabulary(where).decode(np.asarray(lists.values).astype(np.int64)[off[0] : off[-1]], off - off[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts)], ["doc_id", "text"])

    return encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")


def check_round_trip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, decoded_sha256 and round_trip of every document; no shuffle."""
    common.small_batches(docs.sparkSession)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return d.mapInArrow(_coder(path or default_path()), f"doc_id {dict(d.dtypes)['doc_id']}, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean")


def op5_batched_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_round_trip(spark.read.parquet(common.table_path(sf_dir, "documents")))
