"""Whole-text encoding with public tokenizer files, inside Spark tasks."""

from __future__ import annotations

import base64
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from tokenizers import Tokenizer

from codeweft.llm import kernels

#: Bytes of the memo in which one Python worker remembers words' ids; it starts anew when it is full.
MEMO_BYTES = 24 << 20

# The pre-token patterns of the two vocabularies.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@lru_cache(maxsize=4)
def byte_encoding(path: str) -> tiktoken.Encoding:
    """A byte-level vocabulary from a file of ranks; control strings in a text are ordinary text."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})


def _byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabulary files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class WordEncoder:
    """Encodes with a vocabulary that drops white space, word by word, with a memo of words.

    No token of such a vocabulary reaches over white space, so each word is encoded once and looked up after
    that.  New words are encoded together, by a byte pair encoder that takes a NUL for the vocabulary's
    end-of-word mark; words with characters outside the Latin blocks, control characters or ``<|`` go through
    the tokenizer itself.  The memo is keyed by 64-bit word hashes and holds a second hash of each word; a word whose
    second hash isn't that of its key is encoded apart.
    """

    END, CUT = "\x00", "\x01"

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]
        suffix = vocabulary.get("end_of_word_suffix")
        if not suffix:
            raise ValueError("the vocabulary has no end-of-word mark")
        alphabet, ranks = _byte_alphabet(), {}
        for token, number in vocabulary["vocab"].items():
            ended = token.endswith(suffix)
            body = token[: -len(suffix)] if ended else token
            if body and all(c in alphabet for c in body) and not token.startswith("<|"):
                ranks[bytes(alphabet[c] for c in body) + self.END.encode() * ended] = number
        ranks = {k: v for k, v in ranks.items() if k.count(b"\x00") <= 1 or len(k) == 2}
        self.merger = tiktoken.Encoding("words", pat_str="[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        self.cut_id = ranks[(self.CUT + self.END).encode()]
        self.pattern = regex.compile(WORD_PATTERN)
        self.plain = regex.compile("[\x21-\x7e\xa1-įı-ɏ]+")
        self._reset()

    @classmethod
    @lru_cache(maxsize=2)
    def cached(cls, path: str) -> "WordEncoder":
        return cls(path)

    def _reset(self) -> None:
        self.keys, self.seconds = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def memo_bytes(self) -> int:
        return self.keys.nbytes + self.seconds.nbytes + self.begin.nbytes + self.count.nbytes + self.pool.nbytes

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids in a row, and how many each has."""
        simple = [w for w in words if self.plain.fullmatch(w) and "<|" not in w]
        text = unicodedata.normalize("NFC", f" {self.CUT} ".join([*simple, ""])).lower()
        ids = self.merger.encode_to_numpy(self.END.join([*self.pattern.findall(text), ""]))
        cuts = np.flatnonzero(ids == self.cut_id)
        counts = np.diff(cuts, prepend=-1) - 1
        ids = ids[ids != self.cut_id]
        if len(simple) == len(words):
            return ids, counts
        parts, out = iter(np.split(ids, np.cumsum(counts)[:-1])), []
        for w in words:
            if self.plain.fullmatch(w) and "<|" not in w:
                out.append(next(parts))
            else:
                out.append(np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, np.uint32))
        return np.concatenate(out), np.array([len(x) for x in out])

    def _encode_ranges(self, part: kernels.Slice, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = part.data
        return self.encode_words([raw[a:b].tobytes().decode("utf-8") for a, b in zip(starts, ends, strict=True)])

    def _learn(self, part: kernels.Slice, keys: np.ndarray, seconds: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        ids, counts = self._encode_ranges(part, starts, ends)
        begin = len(self.pool) + np.cumsum(counts) - counts
        self.pool = np.concatenate([self.pool, ids.astype(np.uint32)])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.seconds = np.insert(self.keys, at, keys), np.insert(self.seconds, at, seconds)
        self.begin, self.count = np.insert(self.begin, at, begin), np.insert(self.count, at, counts)

    def encode(self, part: kernels.Slice) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a slice's texts in a row, and each text's offset in them."""
        hashes, owner, starts, ends = kernels.word_hashes(part)
        seconds = kernels.RangeHash(part.data, 1)(starts, ends)
        keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        known = self._find(keys)[1]
        if not known.all():
            new = first[~known]
            if self.memo_bytes() > MEMO_BYTES:
                self._reset()
                new = first
            self._learn(part, hashes[new], seconds[new], starts[new], ends[new])
        at = self._find(keys)[0][inverse]
        begin, counts, pool = self.begin[at], self.count[at], self.pool
        apart = np.flatnonzero(self.seconds[at] != seconds) if len(at) else at
        if len(apart):
            extra, sizes = self._encode_ranges(part, starts[apart], ends[apart])
            begin[apart], counts[apart] = len(pool) + np.cumsum(sizes) - sizes, sizes
            pool = np.concatenate([pool, extra.astype(np.uint32)])
        ends_at = np.cumsum(counts)
        ids = pool[np.repeat(begin - (ends_at - counts), counts) + np.arange(ends_at[-1] if len(counts) else 0)]
        offsets = np.zeros(len(part) + 1, np.int64)
        np.cumsum(kernels.per_text(owner, len(part), counts).astype(np.int64), out=offsets[1:])
        return ids, offsets

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, keys)
        inside = np.minimum(at, max(len(self.keys) - 1, 0))
        return inside, (self.keys[inside] == keys) if len(self.keys) else np.zeros(len(keys), bool)

    def encode_text(self, text: str | None) -> np.ndarray:
        return self.encode(next(kernels.slices(pa.array([text], pa.string()))))[0]
