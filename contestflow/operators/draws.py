"""Digests of many short texts at once, and the numbers of times that they draw a row."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np

#: Texts of a pass: enough to make calls cheap, few enough for the processor's cache.
PASS = 32_768
#: Bytes of a text that one block of md5 holds.
BLOCK = 55
_TURNS = [(7, 12, 17, 22)] * 4 + [(5, 9, 14, 20)] * 4 + [(4, 11, 16, 23)] * 4 + [(6, 10, 15, 21)] * 4
_SHIFTS = [s for four in _TURNS for s in four]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_WORDS = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _md5(words: list[np.ndarray | int], n: int) -> list[np.ndarray]:
    """The four words of ``n`` digests of one block each; a word that all blocks share is a number."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.bitwise_not(d, out=f)
            f |= b
            f ^= c
        f += a
        word, s = words[_WORDS[i]], _SHIFTS[i]
        if isinstance(word, int):
            f += np.uint32((_SINES[i] + word) & 0xFFFFFFFF)
        else:
            f += np.uint32(_SINES[i])
            f += word
        np.left_shift(f, np.uint32(s), out=t)
        f >>= np.uint32(32 - s)
        f |= t
        f += b
        a, d, c, b, f = d, c, b, f, a
    return [x + np.uint32(s) for x, s in zip((a, b, c, d), _START, strict=True)]


def digests(prefixes: list[str], keys: list[str]) -> tuple[np.ndarray, Iterator[np.ndarray]]:
    """An order of the keys and, of each prefix in turn, the md5 of prefix + key of all keys in that
    order: four rows of the numbers that its 32 hexadecimal digits give by eights."""
    raw = [k.encode() for k in keys]
    sizes = np.array([len(k) for k in raw], dtype=int)
    order = np.argsort(sizes, kind="stable")
    found, starts = np.unique(sizes[order], return_index=True)
    runs = [(size, a, [raw[k] for k in order[a:b].tolist()]) for size, a, b in zip(found.tolist(), starts.tolist(), [*starts.tolist()[1:], len(raw)], strict=True)]

    def every():
        blocks: dict[tuple[int, int], list] = {}
        for head in (p.encode() for p in prefixes):
            out = np.empty((4, len(raw)), np.uint32)
            for size, a, texts in runs:
                if len(head) + size > BLOCK:
                    for k, text in enumerate(texts, a):
                        out[:, k] = np.frombuffer(hashlib.md5(head + text).digest(), ">u4")
                    continue
                if (size, len(head)) not in blocks:
                    blocks[size, len(head)] = _block(len(head), size, texts)
                words = list(blocks[size, len(head)])
                padded = head + bytes(-len(head) % 4)
                for j in range(len(padded) // 4):
                    word = int.from_bytes(padded[4 * j : 4 * j + 4], "little")
                    words[j] = words[j] | (word if isinstance(words[j], int) else np.uint32(word))
                for k, x in enumerate(_md5(words, len(texts))):
                    x.byteswap(inplace=True)
                    out[k, a : a + len(texts)] = x
            yield out

    return order, every()


def _block(start: int, size: int, texts: list[bytes]) -> list[np.ndarray | int]:
    """The 16 words of blocks that hold texts of one size after ``start`` bytes of zero."""
    block = np.zeros((len(texts), 64), np.uint8)
    block[:, start : start + size] = np.frombuffer(b"".join(texts), np.uint8).reshape(len(texts), size)
    block[:, start + size] = 0x80
    words = block.view("<u4").T.copy()
    return [words[j] if 4 * j + 4 > start and 4 * j < start + size else int(words[j][0]) for j in range(14)] + [8 * (start + size), 0]


class Times:
    """How many of the sorted ``steps`` are at most a number of 32 bits: by a table over its upper
    half, and by search where a step lies within the lower one."""

    def __init__(self, steps: list[int]):
        self.steps = np.array(steps, np.uint32)
        low = np.arange(2**16, dtype=np.uint32) << np.uint32(16)
        count = np.searchsorted(self.steps, low, side="right")
        end = np.searchsorted(self.steps, low | np.uint32(0xFFFF), side="right")
        self.table = np.where(count == end, count, 255).astype(np.uint8)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.take(self.table, x >> np.uint32(16), mode="wrap")
        open_ = np.flatnonzero(out.ravel() == 255)
        if len(open_):
            out.ravel()[open_] = np.searchsorted(self.steps, x.ravel()[open_], side="right")
        return out
