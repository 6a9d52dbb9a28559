"""Word-wise use of a tokenizers vocabulary that drops white space: each distinct word is encoded once.

Such a vocabulary (its normaliser and splitter never look across white space) gives a text the ids of its words
in order, so a batch of texts needs the library only for words not met before. What is met is kept in the worker
up to MEMO words and those of one batch; then the half not met for longest goes, which costs time but changes nothing.
"""

from __future__ import annotations

import functools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MEMO = 250_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _csr(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places start[i], start[i] + 1, ... of size[i] each, one run after another, and the runs' offsets."""
    ends = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=ends[1:])
    return np.repeat(start - ends[:-1], size) + np.arange(ends[-1]), ends


class WordMemo:
    """Ids of words, kept in the worker; solve() gives those of new ones."""

    def __init__(self, memo: int = MEMO):
        self.memo, self.turn = memo, 0
        self.words, self.ids, self.start, self.used = pa.array([], pa.large_string()), np.zeros(0, np.uint16), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def solve(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The words in some order, their flat ids and numbers of ids."""
        raise NotImplementedError

    def _learn(self, new: pa.Array) -> None:
        if len(self.words) > self.memo:  # the half that was met last stays, and all that this batch has met
            keep = np.sort(np.argsort(self.used, kind="stable")[len(self.words) // 2 :])
            keep = np.union1d(keep, np.flatnonzero(self.used == self.turn))
            take, start = _csr(self.start[keep], np.diff(self.start)[keep])
            self.words, self.ids, self.start, self.used = self.words.take(pa.array(keep)), self.ids[take], start, self.used[keep]
        words, flat, size = self.solve(new.to_numpy(zero_copy_only=False).tolist())
        if len(flat) and flat.max() > 0xFFFF:
            raise ValueError("ids over 65535 need a wider memo")
        self.words = pa.concat_arrays([self.words, pa.array(words, pa.large_string())])
        self.ids = np.concatenate([self.ids, flat.astype(np.uint16)])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(size)])
        self.used = np.concatenate([self.used, np.full(len(words), self.turn, np.int64)])

    def lookup(self, flat: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and offsets of words one after another."""
        self.turn += 1
        entry = pc.index_in(flat, value_set=self.words)
        if entry.null_count:
            self.used[np.asarray(entry.drop_null()).astype(np.int64)] = self.turn
            self._learn(flat.filter(entry.is_null()).unique())
            entry = pc.index_in(flat, value_set=self.words)
        of_word = np.asarray(entry).astype(np.int64)
        self.used[of_word] = self.turn
        take, ends = _csr(self.start[of_word], self.start[of_word + 1] - self.start[of_word])
        return self.ids[take], ends


class WordIds(WordMemo):
    """Encodes Arrow string arrays; ids equal those of the library on the whole texts."""

    def __init__(self, path: str, memo: int = MEMO):
        super().__init__(memo)
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.ends_word = np.zeros(1 << 16, bool)
        self.ends_word[[i for t, i in self.lib.get_vocab().items() if t.endswith("</w>") and i < 1 << 16]] = True

    def solve(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        plain = [w for w in words if w.isalpha()]  # one token group each, whose last id ends a word
        other = [w for w in words if not w.isalpha()]
        ids, size = [], []
        for lo in range(0, len(plain), 64 * 512):
            parts = [plain[k : k + 512] for k in range(lo, min(lo + 64 * 512, len(plain)), 512)]
            for part, x in zip(parts, self.lib.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
                got = np.array(x.ids, np.int64)
                ends = np.flatnonzero(self.ends_word[got])
                if len(ends) != len(part):
                    each = [y.ids for y in self.lib.encode_batch_fast(part, add_special_tokens=False)]
                    got, n = np.array(sum(each, []), np.int64), [len(y) for y in each]
                else:
                    n = np.diff(ends, prepend=-1)
                ids.append(got)
                size.append(np.asarray(n, np.int64))
        for lo in range(0, len(other), 4096):
            each = [y.ids for y in self.lib.encode_batch_fast(other[lo : lo + 4096], add_special_tokens=False)]
            ids.append(np.array([i for y in each for i in y], np.int64))
            size.append(np.array([len(y) for y in each], np.int64))
        return plain + other, np.concatenate(ids), np.concatenate(size)

    def _encode(self, texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
        # a mark alone between a letter and a blank is a token of its own in any case; × and ÷ are no letters
        texts = pc.replace_substring_regex(texts, r"([A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}])([,.])(\s)", r"\1 \2\3")
        if lower:  # as the vocabulary's normaliser does
            texts = pc.ascii_lower(texts)
        split = pc.ascii_split_whitespace(texts)
        bounds = np.asarray(split.offsets).astype(np.int64)
        flat = split.values.slice(bounds[0], bounds[-1] - bounds[0])
        ids, ends = self.lookup(flat)
        return ids, ends[bounds - bounds[0]]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids (uint16) and offsets by text; nulls are empty texts."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not len(texts):
            return np.zeros(0, np.uint16), np.zeros(1, np.int64)
        # ASCII letters may be lowered first unless a special token or an accent of its own (U+0300 to U+036F) may follow
        odd = pc.match_substring_regex(texts, r"<\||[\x{300}-\x{36F}]")
        if not odd.true_count:
            return self._encode(texts, True)
        odd = np.asarray(odd)
        a, ao = self._encode(texts.filter(pa.array(~odd)), True) if not odd.all() else (np.zeros(0, np.uint16), np.zeros(1, np.int64))
        b, bo = self._encode(texts.filter(pa.array(odd)), False)
        start, size = np.empty(len(odd), np.int64), np.empty(len(odd), np.int64)
        start[~odd], size[~odd], start[odd], size[odd] = ao[:-1], np.diff(ao), bo[:-1] + len(a), np.diff(bo)
        take, off = _csr(start, size)
        return np.concatenate([a, b])[take], off


@functools.cache
def word_ids(path: str) -> WordIds:
    """One encoder for a worker process."""
    return WordIds(path)


def with_end(ids: np.ndarray, off: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The id end after each text's ids."""
    n = len(off) - 1
    return np.insert(ids, off[1:], np.full(n, end, ids.dtype)), off + np.arange(n + 1)
