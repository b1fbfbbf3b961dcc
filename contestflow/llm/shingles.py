"""Multisets of word shingles as hashes, for many texts at once."""

from __future__ import annotations

import numpy as np

from .rolling import Rolling, mix

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def shingles(texts: list[str | None], words: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count): the distinct shingles of each text, sorted by text and hash.

    A text of fewer words has one shingle of all of them; one without words has none.
    """
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    inside = ~_SEPARATOR[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, stops = edge[::2], edge[1::2]
    if not starts.size:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    word, text = Rolling(data).of(starts, stops), np.searchsorted(ends, starts, "right")
    n = np.bincount(text, minlength=len(raw))
    first = np.cumsum(n) - n
    total = np.zeros(word.size, np.uint64)
    for k in range(words):
        value = mix(word + np.uint64((k + 1) * 0xA0761D6478BD642F % 2**64))
        same = text[k:] == text[: word.size - k]
        total[: word.size - k] += np.where(same, value[k:], np.uint64(0))
    place = np.arange(word.size) - first[text]
    whole = (place + words <= n[text]) | ((place == 0) & (n[text] < words))
    text, total = text[whole], mix(total[whole])
    order = np.lexsort((total, text))
    text, total = text[order], total[order]
    new = np.ones(text.size, bool)
    new[1:] = (text[1:] != text[:-1]) | (total[1:] != total[:-1])
    at = np.flatnonzero(new)
    return text[at], total[at], np.diff(np.append(at, text.size))
