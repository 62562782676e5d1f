"""Word shingles of many texts at once, as sorted sets of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_CHUNK = 1 << 20  # bytes worked on at a time, a longer text alone


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the text it is in."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    word = ~_BLANK[joined]
    edges = np.flatnonzero(np.diff(word, prepend=False))
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum((joined + np.uint64(1)) * _powers(_BASE, len(joined)), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _powers(_INVERSE, len(joined))[starts]
    hashes = mix(hashes ^ (ends - starts).astype(np.uint64))
    begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    return hashes, np.searchsorted(begins, starts, side="right") - 1


def shingle_sets(texts: list[str | None], words: int) -> Iterator[np.ndarray]:
    """The set of each text, in order: distinct sequences of ``words`` words.

    A-Z are lower-cased; words end at a space or at the bytes 9 to 13.  A text of fewer words
    is one sequence, which equals no longer or shorter one; without words the set is empty.
    """
    part: list[bytes] = []
    held = 0
    for t in texts:
        part.append((t or "").encode("utf-8", "surrogatepass").lower())
        held += len(part[-1])
        if held >= _CHUNK:
            yield from _sets(part, words)
            part, held = [], 0
    if part:
        yield from _sets(part, words)


def _sets(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    hashes, of = _word_hashes(texts)
    counts = np.bincount(of, minlength=len(texts))
    starts = np.cumsum(counts) - counts
    size = max(0, len(hashes) - words + 1)
    chain = np.full(size, words, np.uint64)
    for j in range(words):
        chain = mix(chain * _BASE + hashes[j : j + size])
    for start, n in zip(starts, counts, strict=True):
        if n >= words:
            yield np.unique(chain[start : start + n - words + 1])
        elif n:
            one = np.full(1, n, np.uint64)
            for j in range(n):
                one = mix(one * _BASE + hashes[start + j : start + j + 1])
            yield one
        else:
            yield np.zeros(0, np.uint64)
