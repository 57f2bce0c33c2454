"""Word shingles of whole texts as weighted sets of 54-bit numbers, computed for a batch of texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS_PER_SHINGLE = 5
#: Texts of a batch: the upper 10 bits of a cell hold the text's place in it.
MAX_TEXTS, MAX_BYTES = 1 << 10, 1 << 20
HASH_BITS = 54

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 0 for c in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
with np.errstate(over="ignore"):
    _INVERSE = _BASE  # Newton's iteration for the inverse modulo 2^64
    for _ in range(6):
        _INVERSE = _INVERSE * (np.uint64(2) - _BASE * _INVERSE)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(kind: str, n: int) -> np.ndarray:
    if kind not in _powers or len(_powers[kind]) < n:
        steps = np.full(max(n, 1 << 16), _BASE if kind == "base" else _INVERSE, dtype=np.uint64)
        steps[0] = 1
        _powers[kind] = np.multiply.accumulate(steps)
    return _powers[kind][:n]


def batches(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that are handled together."""
    start, size = 0, 0
    for k, text in enumerate(texts):
        if k > start and (size + len(text) > MAX_BYTES or k - start >= MAX_TEXTS):
            yield start, k
            start, size = k, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def cells(texts: list[bytes], width: int = WORDS_PER_SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shingles of the texts of one batch: text number, hash (54 bits), count; by text and hash.

    Words are runs of ASCII letters and digits and of bytes from 128, with A-Z lowered. A text of fewer than `width` words,
    but at least one, has one shingle of all its words; a text without words has none.
    """
    data = np.frombuffer(b"\0".join(texts).translate(_TABLE) + b"\0", dtype=np.uint8)
    inside = data != 0
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(data * _power("base", len(data)), out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * _power("inverse", len(data))[starts])
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    owner = np.searchsorted(offsets, starts, side="right") - 1
    per_text = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(per_text) - per_text
    if len(words) >= width:
        whole = owner[width - 1 :] == owner[: len(owner) - width + 1]
        total = np.zeros(len(whole), dtype=np.uint64)
        for k in range(width):
            total = (total + words[k : len(words) - width + 1 + k]) * np.uint64(0xD6E8FEB86659FD93)
        hashes, of = mix(total[whole]), owner[: len(whole)][whole]
    else:
        hashes, of = np.empty(0, np.uint64), np.empty(0, np.int64)
    short = np.flatnonzero((per_text > 0) & (per_text < width))
    extra = []
    for t in short:
        total = int(per_text[t])
        for w in words[first[t] : first[t] + per_text[t]].tolist():
            total = (total + w) * 0xA0761D6478BD642F & (1 << 64) - 1
        extra.append(total)
    if extra:
        hashes, of = np.concatenate([hashes, mix(np.array(extra, dtype=np.uint64))]), np.concatenate([of, short])
    keyed, count = np.unique((of.astype(np.uint64) << np.uint64(HASH_BITS)) | (hashes >> np.uint64(64 - HASH_BITS)), return_counts=True)
    return (keyed >> np.uint64(HASH_BITS)).astype(np.int64), keyed & np.uint64((1 << HASH_BITS) - 1), count


def weighted_jaccard(pairs: int, owner: np.ndarray, hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Similarity of texts 2k and 2k+1 of one batch, for each k; 0 where either has no shingle."""
    pair = owner // 2
    order = np.lexsort((hashes, pair))
    p, h, c = pair[order], hashes[order], count[order]
    same = np.flatnonzero((p[1:] == p[:-1]) & (h[1:] == h[:-1]))
    both = np.bincount(p[same], weights=np.minimum(c[same], c[same + 1]), minlength=pairs)
    total = np.bincount(p, weights=c, minlength=pairs)
    return np.divide(both, total - both, out=np.zeros(pairs), where=total > both)
