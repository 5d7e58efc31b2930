"""Word shingles as 64-bit hashes, computed in numpy over many texts at once.

Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return,
with A-Z lower-cased; bytes above 0x7F are part of words. A word's hash is a polynomial over random
64-bit values of its bytes, a shingle's hash mixes those of its words. Two different shingles of a pair
of texts share a hash with a probability of about 2**-64.
"""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.default_rng(20240607)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_FOLD = bytes(32 if i in b" \t\n\v\f\r" else i + 32 if 65 <= i <= 90 else i for i in range(256))
#: Bytes hashed at once.
SLICE = 1 << 20
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        size = max(n, SLICE + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            _tables[name] = np.multiply.accumulate(t)
    return _tables["up"], _tables["down"]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fold(text: bytes) -> bytes:
    """Lower-case A-Z and turn the six white-space bytes into spaces."""
    return text.translate(_FOLD)


def _slices(folded: bytes):
    """Pieces of about SLICE bytes that end between words; a longer word is a piece of its own."""
    at = 0
    while at < len(folded):
        end = at + SLICE
        if end < len(folded):
            end = folded.rfind(b" ", at, end) + 1 or folded.find(b" ", end) + 1 or len(folded)
        yield folded[at:end]
        at = end


def word_hashes(folded: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word."""
    starts, hashes, at = [], [], 0
    for piece in _slices(folded):
        a = np.frombuffer(piece, np.uint8)
        word = np.concatenate([[False], a != 32, [False]])
        edge = np.flatnonzero(word[1:] != word[:-1])
        s, e = edge[::2], edge[1::2]
        up, down = _powers(len(a) + 1)
        total = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(_BYTE[a] * up[: len(a)], out=total[1:])
        starts.append(s + at)
        hashes.append(mix((total[e] - total[s]) * down[s]))
        at += len(piece)
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def _join(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word shingles of a row of words."""
    size = len(words) - n + 1
    h = np.full(size, n, np.uint64)
    for k in range(n):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + words[k : k + size])
    return h


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """For each text its distinct n-word shingles, as sorted hashes.

    A text of fewer words, but not none, has its whole sequence of words as its one shingle.
    """
    joined = b" ".join(map(fold, texts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    starts, words = word_hashes(joined)
    bound = np.concatenate([[0], np.searchsorted(starts, ends)])
    out = []
    for a, b in zip(bound[:-1], bound[1:]):
        own = words[a:b]
        out.append(np.unique(_join(own, min(n, len(own)))) if b > a else np.zeros(0, np.uint64))
    return out
