"""Whole-text encoding with the tokenizers library, piece by piece with a bounded cache.

Both pre-tokenizers in use never join text across the start of a white-space run, so a text's
ids are the concatenation of the ids of its pieces (white space plus the run after it). Pieces
repeat; new ones are encoded together in one call, told apart by a byte that no merge contains.
Inside a chunk of texts equal pieces are matched by a 64-bit hash of their bytes and length. What
earlier chunks have encoded lies in flat arrays, since as many Python objects took the larger part
of a worker's memory.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array
from itertools import chain

import numpy as np
import pandas as pd

from .rolling import Rolling

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
#: Bytes of the texts that are encoded together; more of them share pieces and take more memory.
ENCODE_BYTES = 1 << 20
_find = re.compile(r"\s*\S+|\s+").findall
_BREAK = "\x00"
#: Words that the model gets in one string where a character can part them.
CHAINED = 64
#: White space beyond ASCII's six; the joint path knows those only.
_spaces = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search
_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Characters beyond which a text is encoded by itself.
LONG = 1 << 21
#: A word of Latin letters and the punctuation after it. Both splits in use part them, and such
#: letters have no other composed form, so the vocabulary's model can be asked for the word alone.
_latin = re.compile("( ?)([A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f]+)([!-/:-@\\[-`{-~]*)").fullmatch
#: The splits for which that holds.
_SPLITS = ("'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+", None)  # words; the byte level's own
#: Outside these, lower() and split() of a text agree with the vocabulary's own normalizer.
_unusual = re.compile("[\x1c-\x1f\x85\xa0\u0130-\U0010ffff]").search


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; a path is returned as it is."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Every position of the ranges, range by range."""
    upto = np.cumsum(sizes)
    return np.repeat(starts - (upto - sizes), sizes) + np.arange(upto[-1] if sizes.size else 0)


class Known:
    """Ids of pieces by a hash of their bytes, in some 40 bytes a piece.

    A hash only finds the place: the bytes are compared, so pieces that share one get their own ids.
    """

    def __init__(self, dtype: str):
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # sorted by key
        self.texts, self.ids = np.zeros(0, np.uint8), np.zeros(0, dtype)
        self.text_ends, self.id_ends, self.used = np.zeros(1, np.int32), np.zeros(1, np.int32), np.zeros(0, bool)

    def find(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Slots of the pieces of ``data``; -1 for new ones."""
        if not self.keys.size:
            return np.full(keys.size, -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), self.keys.size - 1)
        slots = self.slots[at].astype(np.int64)
        begins = self.text_ends[slots]
        hit = (self.keys[at] == keys) & (self.text_ends[slots + 1] - begins == sizes)
        rows = np.flatnonzero(hit)
        other = self.texts[_spans(begins[rows], sizes[rows])] != data[_spans(starts[rows], sizes[rows])]
        if other.any():
            hit[np.repeat(rows, sizes[rows])[other]] = False
        self.used[slots[hit]] = True
        return np.where(hit, slots, -1)

    def add(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, found: list[bytes]) -> np.ndarray:
        """Slots of new pieces and their ids."""
        slots = self.used.size + np.arange(keys.size)
        counts = np.fromiter(map(len, found), np.int64, len(found)) // self.ids.itemsize
        self.texts = np.concatenate([self.texts, data[_spans(starts, sizes)]])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(found), self.ids.dtype)])
        self.text_ends = np.concatenate([self.text_ends, (self.text_ends[-1] + np.cumsum(sizes)).astype(np.int32)])
        self.id_ends = np.concatenate([self.id_ends, (self.id_ends[-1] + np.cumsum(counts)).astype(np.int32)])
        self.used = np.concatenate([self.used, np.zeros(keys.size, bool)])
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        free = np.append(self.keys, np.uint64(0))[at] != keys[order]  # else another piece has the key
        free |= at == self.keys.size
        order, at = order[free], at[free]
        self.keys, self.slots = np.insert(self.keys, at, keys[order]), np.insert(self.slots, at, slots[order].astype(np.int32))
        return slots

    def trim(self, most: int) -> None:
        """Keep pieces that were found again since the last call, or none if those are more than ``most``."""
        kept = np.flatnonzero(self.used[self.slots])
        if kept.size > most:
            kept = kept[:0]
        slots, old = self.slots[kept].astype(np.int64), self.__dict__.copy()
        self.__init__(self.ids.dtype)
        for values, ends in (("texts", "text_ends"), ("ids", "id_ends")):
            sizes = np.diff(old[ends])[slots]
            setattr(self, values, old[values][_spans(old[ends][slots], sizes)])
            setattr(self, ends, np.append(0, np.cumsum(sizes)).astype(np.int32))
        self.keys, self.slots, self.used = old["keys"][kept], np.arange(kept.size, dtype=np.int32), np.zeros(kept.size, bool)


class Encoder:
    """ids of whole texts as little-endian unsigned integers of ``width`` bytes.

    A null text is an empty one. ``cache_pieces`` bounds the memory of what is known from earlier
    texts; it never changes results. Where the separating byte is not one id of its own, whole
    texts are encoded.
    """

    def __init__(self, path: str, cache_pieces: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = f"<u{self.width}"
        self.limit, self.known, self.listed, self.tails = cache_pieces, Known(self.dtype), {}, {}
        self.words = bool(self.tokenizer.model.end_of_word_suffix)  # lower case, white space dropped
        self.joint = f" {_BREAK} " if self.words else _BREAK
        self.mark = self._ids([_BREAK])[0]
        self.model, self.chain = self.tokenizer.model, None
        self.alone = self._splits_words()
        self.pieces = self.mark.size == 1 and self._ids([f"a,{self.joint} b"])[0].tolist().count(int(self.mark[0])) == 1

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _splits_words(self) -> bool:
        """Whether words of Latin letters are split off, mapped by bytes and given to the model alone."""
        known = json.loads(self.tokenizer.to_str())
        steps = known["pre_tokenizer"] or {}
        steps = steps.get("pretokenizers", [steps])
        split = steps[0]["pattern"].get("Regex") if steps[0].get("type") == "Split" else None
        last, model = steps[-1], known["model"]
        level = last.get("type") == "ByteLevel" and not last["add_prefix_space"] and last["use_regex"] == (split is None)
        alone = level and len(steps) == 1 + (split is not None) and split == _SPLITS[0 if self.words else 1] and model["type"] == "BPE"
        if alone and not any(model.get(k) for k in ("end_of_word_suffix", "continuing_subword_prefix", "ignore_merges", "dropout")):
            mark = _byte_letters()[0]
            if self.mark.size == 1 and [i for t, i in model["vocab"].items() if mark in t] == self.mark.tolist():  # no merge goes across it
                from tokenizers import Tokenizer

                self.chain = Tokenizer(self.model)
        return alone

    def _stems(self, words: list[str]) -> list[bytes]:
        """Ids of words of Latin letters, with a space before them or not."""
        letters, w = _byte_letters(), self.width
        seen = [x.replace(" ", letters[0x20]) if x.isascii() else "".join(map(letters.__getitem__, x.encode())) for x in words]
        if self.chain is None:
            return [array("H" if w == 2 else "I", [t.id for t in self.model.tokenize(x)]).tobytes() for x in seen]
        chained = [letters[0].join([*seen[k : k + CHAINED], ""]) for k in range(0, len(seen), CHAINED)]
        ids = np.fromiter(chain.from_iterable(e.ids for e in self.chain.encode_batch_fast(chained, add_special_tokens=False)), self.dtype)
        raw, ends = ids.tobytes(), (np.flatnonzero(ids == self.mark[0]) * w).tolist()
        return [raw[a:b] for a, b in zip([0, *(e + w for e in ends)], ends, strict=False)]

    def _learn(self, new: list[str]) -> list[bytes]:
        """Ids of each of distinct pieces."""
        found: dict[str, bytes] = {}
        left = new
        if self.alone:
            left, latin = [], []
            for x in new:
                if (m := _latin(x)) and not (self.words and (x[0] == " " or x != x.lower())):
                    latin.append((x, x[: m.start(3)], m[3]))
                else:
                    left.append(x)
            stems = list(dict.fromkeys(stem for _, stem, _ in latin))
            ids = dict(zip(stems, self._stems(stems), strict=True))
            if len(self.tails) > self.limit:
                self.tails = {}
            tails = [x for x in {tail for _, _, tail in latin} if x not in self.tails]
            self.tails.update((x, i.tobytes()) for x, i in zip(tails, self._ids(tails), strict=True))
            self.tails[""] = b""
            found.update((x, ids[stem] + self.tails[tail]) for x, stem, tail in latin)
        plain = [x for x in left if _BREAK not in x and x[0] != "'" and not x.isspace()]
        if len(plain) < len(left):  # after the separating byte, 's and the like would not be split off
            odd = [x for x in left if _BREAK in x or x[0] == "'" or x.isspace()]
            found.update((x, i.tobytes()) for x, i in zip(odd, self._ids(odd), strict=True))
        for k in range(0, len(plain), 512):
            part = plain[k : k + 512]
            ids = self._ids([self.joint.join(part)])[0]
            ends = np.append(np.flatnonzero(ids == self.mark[0]), ids.size)
            if ends.size != len(part):
                found.update((x, i.tobytes()) for x, i in zip(part, self._ids(part), strict=True))
                continue
            raw, w, start = ids.tobytes(), self.width, 0
            for x, end in zip(part, ends.tolist(), strict=True):
                found[x] = raw[start * w : end * w]
                start = end + 1
        return list(map(found.__getitem__, new))

    def split(self, text: str) -> list[str]:
        return text.lower().split() if self.words and not _unusual(text) else _find(text)

    def _listed(self, text: str) -> bytes:
        """Ids of one text by its list of pieces; any white space, any length."""
        pieces = self.split(text)
        new = [p for p in dict.fromkeys(pieces) if p not in self.listed]
        if new:
            self.listed.update(zip(new, self._learn(new), strict=True))
        return b"".join(map(self.listed.__getitem__, pieces))

    def encode(self, texts: list[str | None], end_id: int) -> list[bytes]:
        """Ids of each text and then ``end_id``."""
        if not texts:
            return []
        end = np.array([end_id], self.dtype)
        if not self.pieces:
            return [i.tobytes() + end.tobytes() for i in self._ids([t or "" for t in texts])]
        if self.known.keys.size > self.limit:
            self.known.trim(self.limit // 2)
        odd = {k for k, t in enumerate(texts) if t and (len(t) > LONG or (_unusual if self.words else _spaces)(t))}
        plain = ["" if k in odd else t or "" for k, t in enumerate(texts)]
        out = self._joined(plain, end)
        for k in sorted(odd):
            if len(self.listed) > self.limit // 4:
                self.listed = {}
            out[k] = self._listed(texts[k]) + end.tobytes()
        return out

    def _joined(self, texts: list[str], end: np.ndarray) -> list[bytes]:
        """Many texts at once: pieces are found and matched by hash, only distinct ones looked up."""
        raw = [(t.lower() if self.words else t).encode() for t in texts]
        joined = b"\n".join([*raw, b""])
        data, stops = np.frombuffer(joined, np.uint8), np.cumsum([len(r) + 1 for r in raw]) - 1
        inside = ~_ASCII_SPACE[data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        edge = np.concatenate([[0] * bool(inside[:1].any()), edge]).astype(np.int64)
        starts, ends = edge[::2], edge[1::2]  # runs of other characters; the last byte is a space
        text = np.searchsorted(stops, starts, "right")
        begins = np.concatenate([[0], stops[:-1] + 1])
        if not self.words:  # a piece has the white space before it; what is left at the end is a piece
            n = np.bincount(text, minlength=len(raw))
            last = np.where(n > 0, ends[np.cumsum(n) - 1] if ends.size else 0, begins)
            rest = np.flatnonzero(last < stops)
            starts = np.where(np.concatenate([[True], text[1:] != text[:-1]])[: text.size], begins[text], np.concatenate([[0], ends[:-1]])[: text.size]) if text.size else starts
            starts, ends, text = np.concatenate([starts, last[rest]]), np.concatenate([ends, stops[rest]]), np.concatenate([text, rest])
            order = np.argsort(starts, kind="stable")
            starts, ends, text = starts[order], ends[order], text[order]
        codes, distinct = pd.factorize(Rolling(data).of(starts, ends))
        first = np.zeros(distinct.size, np.int64)
        first[codes[::-1]] = np.arange(codes.size)[::-1]
        at, sizes, known = starts[first], (ends - starts)[first], self.known
        slots = known.find(distinct, data, at, sizes)
        new = np.flatnonzero(slots < 0)
        if new.size:
            words = [joined[a:b].decode() for a, b in zip(at[new].tolist(), (at + sizes)[new].tolist(), strict=True)]
            slots[new] = known.add(distinct[new], data, at[new], sizes[new], self._learn(words))
        begins = known.id_ends[slots]
        size_of = (known.id_ends[slots + 1] - begins)[codes]
        ids, upto = known.ids[_spans(begins[codes], size_of)], np.cumsum(size_of)
        cuts = np.concatenate([[0], upto])[np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(raw)))])].tolist()
        return [ids[a:b].tobytes() + end.tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@functools.cache
def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where printable, else the next one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


@functools.cache
def encoder(name: str) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    return Encoder(vocabulary(name))
