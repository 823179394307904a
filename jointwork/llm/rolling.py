"""Hashes of many substrings at once, with numpy."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, "u8"), np.ones(1, "u8")]
WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, n of each."""
    if len(_powers[0]) < n:
        for i, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, 2 * len(_powers[i])), b, "u8")
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums over the bytes times powers of the base; ``spans`` cuts hashes out of them."""
    up, _ = powers(len(data))
    sums = np.zeros(len(data) + 1, "u8")
    np.cumsum((data.astype("u8") + np.uint64(1)) * up, out=sums[1:])
    return sums


def spans(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes begin..end of each span: equal bytes, equal hash, wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[begin]) * down[begin])


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the white-space separated words of all texts, and the number of the text of each."""
    data = np.frombuffer(b" ".join(texts), "u1")
    if not len(data):
        return np.zeros(0, "u8"), np.zeros(0, "i8")
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~WHITE[data]
    begin, end = np.flatnonzero(~inside[:-1] & inside[1:]), np.flatnonzero(inside[:-1] & ~inside[1:])
    starts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    return spans(prefix_sums(data), begin, end), np.searchsorted(starts, begin, "right") - 1


def shingle_sets(texts: list[bytes], size: int = 5, at_once: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle hash), distinct and sorted.  A text of fewer words is one shingle; no words, none.

    Some ``at_once`` bytes are worked on together, as the work needs many bytes per byte of text.
    """
    out, lo, held = [], 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= at_once or i == len(texts) - 1:
            owners, hashes = _shingle_sets(texts[lo : i + 1], size)
            out.append((owners + lo, hashes))
            lo, held = i + 1, 0
    if not out:
        return np.zeros(0, "i8"), np.zeros(0, "u8")
    return np.concatenate([o for o, _ in out]), np.concatenate([h for _, h in out])


def _shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    words, owner = word_hashes([t.lower() for t in texts])
    if not len(words):
        return np.zeros(0, "i8"), np.zeros(0, "u8")
    up, _ = powers(size + 1)
    n = len(words) - size + 1
    full = np.zeros(0, "u8")
    keep = np.zeros(0, bool)
    if n > 0:
        full = sum((words[i : i + n] * up[i + 1] for i in range(size)), np.zeros(n, "u8"))
        keep = owner[:n] == owner[size - 1 :]
    counts = np.bincount(owner, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    short = np.flatnonzero((counts > 0) & (counts < size))
    whole = [np.uint64(int((words[first[i] : first[i] + counts[i]] * up[1 : counts[i] + 1]).sum()) ^ int(counts[i])) for i in short]
    owners = np.concatenate([owner[: max(n, 0)][keep], short])
    hashes = mix(np.concatenate([full[keep], np.array(whole, "u8")]))
    order = np.lexsort((hashes, owners))
    owners, hashes = owners[order], hashes[order]
    fresh = np.ones(len(owners), bool)
    fresh[1:] = (owners[1:] != owners[:-1]) | (hashes[1:] != hashes[:-1])
    return owners[fresh], hashes[fresh]
