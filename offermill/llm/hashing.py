"""Vectorised hashing of bytes, words and word shingles (numpy, inside tasks).

Every function works on a list of byte strings at once and is independent of
where a text stands in the list, so the same word or shingle has the same
64-bit hash in every task and run. 64-bit hashes stand for the strings
themselves: two different shingles meet by chance once in 1.8e19 pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
#: Bytes of text that are hashed at once; a longer text is taken alone.
BLOCK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def stream(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit integers that depend on the seed alone."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(seed << 20)) * U64(0x9E3779B97F4A7C15))


_BYTE = stream(256, 1)
_BASE, _INVERSE = U64(0x5851F42D4C957F2D), U64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_powers = (np.ones(1, U64), np.ones(1, U64))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 2 * BLOCK_BYTES)
        with np.errstate(over="ignore"):
            _powers = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(size - 1, b, U64)])) for b in (_BASE, _INVERSE))
    return _powers


def blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BLOCK_BYTES together."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BLOCK_BYTES:
            yield begin, i
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, and where each text's begin.

    The second array has one entry more than there are texts: text i has the
    words from its entry up to the next one.
    """
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[raw]
    before = np.concatenate([[True], space[:-1]])
    begin, end = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    power, inverse = _tables(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.empty(len(raw) + 1, U64)
        total[0] = 0
        np.cumsum(_BYTE[_LOWER[raw]] * power[: len(raw)], out=total[1:])
        found = mix((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(U64))
    place = np.zeros(len(texts) + 1, np.int64)
    place[1:] = np.cumsum([len(t) + 1 for t in texts])
    return found, np.searchsorted(begin, place)


_TURN = stream(64, 2) | U64(1)


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """For each text its sorted distinct hashes of `width` words in a row.

    A text of fewer words has its whole sequence as one; one without words none.
    """
    out: list[np.ndarray] = []
    for a, b in blocks(texts):
        words, at = word_hashes(texts[a:b])
        with np.errstate(over="ignore"):
            n = max(0, len(words) - width + 1)
            sums = np.zeros(n, U64)
            for j in range(width):
                sums += words[j : j + n] * _TURN[j]
            sums = mix(sums)
            for p, q in zip(at[:-1].tolist(), at[1:].tolist()):
                if q - p >= width:
                    out.append(np.unique(sums[p : q - width + 1]))
                elif q > p:
                    out.append(mix(np.array([(words[p:q] * _TURN[: q - p]).sum() + _TURN[width + q - p]], U64)))
                else:
                    out.append(np.empty(0, U64))
    return out
