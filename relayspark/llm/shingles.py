"""Word shingles of many texts at once, as arrays of 64-bit hashes (numpy on the UTF-8 bytes)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_MASK = (1 << 64) - 1


def _constants(seed: int, n: int) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers from a seed (splitmix)."""
    out, x = [], seed
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) & _MASK
        z = x
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & _MASK
        z = (z ^ z >> 27) * 0x94D049BB133111EB & _MASK
        out.append((z ^ z >> 31) | 1)
    return np.asarray(out, dtype=np.uint64)


_BYTE = _constants(1, 256)
_BASE = _constants(2, 1)[0]
_STEP = _constants(3, 1)[0]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of text that are hashed at once; a longer text is hashed on its own.
CHUNK_BYTES = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the hash's base."""
    global _POWERS
    if len(_POWERS) < n:
        more = np.full(max(n, 1 << 12), _BASE, dtype=np.uint64)
        more[0] = 1
        _POWERS = np.multiply.accumulate(more)
    return _POWERS[:n]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word (`[^\\x20\\x09-\\x0D]+`) of UTF-8 bytes, A-Z lower-cased."""
    data = _LOWER[data]
    inside = ~_SPACE[data]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, np.zeros(0, dtype=np.uint64)
    # Each byte counts times a power of the base by its place in its word: equal words, equal sums.
    lengths = ends - starts
    longest = int(lengths.max())
    chars = data[inside]
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(len(chars)) - np.repeat(first, lengths)
    sums = np.add.reduceat(_BYTE[chars] * _powers(longest)[place], first)
    return starts, mix64(sums + lengths.astype(np.uint64))


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in order. A text of fewer words than ``width``, but
    not none, has one shingle of them all; null and wordless texts have an empty set."""
    at = 0
    while at < len(texts):
        size, end, raw = 0, at, []
        while end < len(texts) and (size < CHUNK_BYTES or end == at):
            raw.append((texts[end] or "").encode("utf-8", "surrogatepass"))
            size += len(raw[-1]) + 1
            end += 1
        yield from _sets_of(raw, width)
        at = end


def _sets_of(raw: list[bytes], width: int) -> Iterator[np.ndarray]:
    data = np.frombuffer(b"\n".join(raw), dtype=np.uint8)
    begin = np.cumsum([0] + [len(x) + 1 for x in raw])
    starts, words = word_hashes(data)
    bounds = np.searchsorted(starts, begin)
    grams = np.zeros(0, dtype=np.uint64)
    if len(words) >= width:
        grams = words[: len(words) - width + 1].copy()
        for k in range(1, width):
            grams = mix64(grams * _STEP + words[k : len(words) - width + 1 + k])
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(grams[a : b - width + 1])
        elif b > a:
            one = words[a : a + 1].copy()
            for k in range(a + 1, b):
                one = mix64(one * _STEP + words[k : k + 1])
            yield mix64(one + np.uint64(b - a))
        else:
            yield words[:0]
