"""Words and word shingles of many texts at once, as 64-bit hashes in flat arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: What separates words; A-Z are lower-cased, nothing else.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def slices(texts: list[bytes | None], limit: int = 1_000_000) -> Iterator[list[bytes | None]]:
    """Consecutive runs of texts of bounded size together; a text over the limit comes alone."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t or b"") > limit:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t or b"")
    if run:
        yield run


def word_hashes(texts: list[bytes | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, text after text, and where each text's words start (one entry more than texts)."""
    parts = [(t or b"") + b" " for t in texts]
    data = np.frombuffer(b" " + b"".join(parts), np.uint8)
    space = _SPACE[data]
    edge = np.diff(space.astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
    bounds = np.searchsorted(starts, np.cumsum([1, *[len(p) for p in parts]]))
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    lengths = ends - starts
    at = np.flatnonzero(~space)
    offset = np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    value = mix((_LOWER[data] if lower else data)[at].astype(np.uint64) | offset.astype(np.uint64) << np.uint64(8))
    return mix(np.add.reduceat(value, np.cumsum(lengths) - lengths) + lengths.astype(np.uint64)), bounds


def shingles(texts: list[bytes | None], n: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles; of a text with fewer words, one hash of all of them."""
    words, bounds = word_hashes(texts)
    whole = words[: max(0, len(words) - n + 1)].copy()
    for i in range(1, n):
        whole = mix(whole * _M2 + words[i : i + len(whole)])
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= n:
            yield np.unique(whole[a : b - n + 1])
        elif b > a:
            one = words[a]
            for w in words[a + 1 : b]:
                one = mix(np.array([one]) * _M2 + w)[0]
            yield np.array([one ^ np.uint64(b - a) * np.uint64(n != b - a)], np.uint64)
        else:
            yield np.zeros(0, np.uint64)
