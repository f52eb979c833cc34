"""Words and word shingles of texts as 64-bit hashes, many texts at a time.

Two different words or shingles get one hash with probability 2**-64; the operators that use the hashes take equal
hashes for equal words, and say so. Texts go through in blocks of about ``BLOCK`` bytes, longer ones in parts cut
between words, so memory does not follow the length of a text but for 8 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 21
U = np.uint64
_rng = np.random.default_rng(20240501)
LETTER = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)
STEP = U(0x9E3779B97F4A7C15)
#: Bytes that belong to words: all but ASCII white space; or ASCII letters and digits, and all of other characters.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    while len(_powers) < n:
        _powers = np.concatenate([_powers, _powers * (STEP ** U(len(_powers)) if len(_powers) > 1 else STEP)])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def hash_words(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes and hashes of the words in ``data``."""
    inside = is_word[data]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, lengths = edge[::2], edge[1::2] - edge[::2]
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    h = np.add.reduceat(LETTER[data[inside]] * powers(int(lengths.max()))[place], first)
    return starts, mix(h + lengths.astype(np.uint64))


def word_blocks(texts: list[bytes | None], is_word: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, where each text's words begin and the last's end, hashes), block by block."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j] or b"") < BLOCK):
            size += len(texts[j] or b"") + 1
            j += 1
        if j == i + 1 and size > BLOCK + 1:
            parts, text, at = [], texts[i], 0
            while at < len(text):
                end = min(len(text), at + BLOCK)
                while end < len(text) and is_word[text[end]]:
                    end += 1
                parts.append(hash_words(np.frombuffer(text[at:end], np.uint8), is_word)[1])
                at = end
            h = np.concatenate(parts)
            yield i, np.array([0, len(h)]), h
        else:
            data = np.frombuffer(b"\n".join(t or b"" for t in texts[i:j]), np.uint8)
            begin = np.cumsum([0] + [len(t or b"") + 1 for t in texts[i:j]])
            starts, h = hash_words(data, is_word)
            yield i, np.searchsorted(starts, begin), h
        i = j


def windows(h: np.ndarray, k: int, kept: tuple[int, ...] | None = None) -> np.ndarray:
    """A hash for each run of k words (of those at ``kept`` places, if given)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, U(k))
    for at in kept or range(k):
        out += h[at : at + n] * PLACE[at % 64]
    return mix(out)


def shingle_sets(texts: list[bytes | None], k: int = 5) -> Iterator[np.ndarray]:
    """Each text's distinct k-word shingles, ascending; the whole sequence as one if it has fewer words; or none."""
    for _, bounds, h in word_blocks([t.lower() if t else t for t in texts], SPACED):
        every = windows(h, k)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(every[a : b - k + 1])
            elif b > a:
                yield mix((h[a:b] * PLACE[: b - a]).sum(keepdims=True) + PLACE[32 + b - a])
            else:
                yield h[:0]
