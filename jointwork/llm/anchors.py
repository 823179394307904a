"""Anchors: positions of a text chosen by its content, one in each window of bytes.

A window of ``window`` bytes is anchored at the leftmost of its ``gram``-byte
strings with the smallest hash.  Equal windows are anchored at the same place,
so repeated windows can be found among the suffixes that start at anchors, a
few hundredths of all suffixes.  Windows that follow each other and have one
anchor form a run.
"""

from __future__ import annotations

import numpy as np

from jointwork.llm.rolling import mix, prefix_sums, spans

WINDOW = 200
GRAM = 64
_LOW = np.uint64((1 << 24) - 1)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` consecutive values."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo("u8").max, "u8")
    padded[:n] = values
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def runs(texts: list[bytes], window: int = WINDOW, gram: int = GRAM):
    """Runs of all texts together: text number, anchor, first and last window start (in the text), and hashes.

    ``key``: the anchor's gram; ``variant``: all bytes that windows of the run
    cover and where the anchor lies in them; ``head``: the suffix's first 8 bytes.
    Less than 16 MB of texts at a time.
    """
    data = np.frombuffer(b"".join(texts), "u1")
    lengths = np.array([len(t) for t in texts], "i8")
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(texts) else np.zeros(0, "i8")
    none = np.zeros(0, "i8")
    if len(data) < window:
        return none, none, none, none, none.astype("u8"), none.astype("u8"), none.astype("u8"), None
    sums = prefix_sums(data)
    at = np.arange(len(data) - gram + 1)
    grams = spans(sums, at, at + gram)
    best = sliding_min((grams & ~_LOW) | at.astype("u8"), window - gram + 1)
    anchor = (best & _LOW).astype("i8")
    owner = np.repeat(np.arange(len(texts)), lengths)
    inside = owner[: len(anchor)] == owner[window - 1 :]
    change = np.ones(len(anchor), bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(change)
    last = np.append(first[1:], len(anchor)) - 1
    first, last = first[inside[first]], last[inside[first]]
    a = anchor[first]
    key = grams[a]
    shape = ((a - first).astype("u8") << np.uint64(16)) | (last - first).astype("u8")
    variant = mix(spans(sums, first, last + window) ^ mix(shape + np.uint64(1)))
    head = np.zeros(len(a), "u8")
    for j in range(8):
        head = (head << np.uint64(8)) | data[a + j]
    who = owner[first]
    base = starts[who]
    return who, a - base, first - base, last - base, key, variant, head, (sums, starts)
