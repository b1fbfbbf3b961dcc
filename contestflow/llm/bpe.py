"""BPE encoding and decoding of whole texts, with tree concatenation of what is long.

A text of ordinary length is encoded where it lies. A long one is cut: before white space wherever
there is some, for no piece of either split reaches across the start of a white-space run, and
inside a run without white space into halves, halves of halves and so on, of the letters that the
vocabulary's merges work on. The parts are encoded in parallel, as rows of their own, and come
together again per document. Halves of one word are joined by encoding a window of tokens around
the join anew; the window grows until its first token is the left half's and its last token the
right half's at the same places. That is exact: merges go by rank, then from the left, so what
happens on one side of a boundary that survives does not depend on the other side, and a sequence
of tokens is the encoding of its text if every two neighbours are the encoding of theirs.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, table, text_chunks, whole_groups
from .tokens import ENCODE_BYTES, WORD_BPE, _byte_letters, encoder, vocabulary

#: Characters beyond which a text is cut, and letters of a part.
SPLIT, LEAF = 1 << 15, 1 << 13
#: Tokens on either side of a join that are encoded anew at first.
WINDOW = 8
#: Kinds of parts: text, words of letters parted by line feeds, a piece inside a long word, its last piece, an added token.
TEXT, WORDS, INNER, LAST, ADDED = "text", "words", "inner", "last", "added"
#: The start of a white-space run.
_run = re.compile(r"(?<=\S)[ \t\n\v\f\r]")


class Joiner:
    """Encodings of pieces of one word, put together. ``inner`` encodes letters that do not end the
    word, ``last`` letters that do; both give lists of ids. ``letters[i]`` are those of id i."""

    def __init__(self, inner, last, letters: dict[int, str]):
        self.inner, self.last, self.letters = inner, last, letters

    def join(self, left: list[int], right: list[int], ends: bool) -> list[int]:
        """Ids of both pieces as one; ``ends``: the right piece ends the word."""
        before = after = WINDOW
        while True:
            a, b = max(len(left) - before, 0), min(after, len(right))
            window = "".join(self.letters[i] for i in (*left[a:], *right[:b]))
            new = self.last(window) if ends and b == len(right) else self.inner(window)
            agrees_left = a == 0 or new[0] == left[a]
            agrees_right = b == len(right) or new[-1] == right[b - 1]
            if agrees_left and agrees_right:
                return [*left[:a], *new, *right[b:]]
            before, after = before * (1 if agrees_left else 2), after * (1 if agrees_right else 2)

    def tree(self, pieces: list[list[int]]) -> list[int]:
        """Ids of a whole word of its pieces, halves by halves."""
        while len(pieces) > 1:
            ends = len(pieces) - 2
            pieces = [self.join(*pieces[k : k + 2], k >= ends) if k + 1 < len(pieces) else pieces[k] for k in range(0, len(pieces), 2)]
        return pieces[0]


def halves(letters: str, leaf: int) -> list[str]:
    """The text cut in half until no part is longer than ``leaf``; the number of parts is a power of two."""
    n = 1
    while len(letters) > n * leaf:
        n *= 2
    edges = [k * len(letters) // n for k in range(n + 1)]
    return [letters[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def cuts(text: str, leaf: int) -> Iterator[str]:
    """Parts of about ``leaf`` characters, each but the first starting with the first character of
    a white-space run; a longer run without white space stays whole."""
    start = 0
    while len(text) - start > leaf:
        inside = [m.start() for m in _run.finditer(text, start + 1, start + leaf)]
        after = None if inside else _run.search(text, start + leaf)
        if not inside and after is None:
            break
        stop = inside[-1] if inside else after.start()
        yield text[start:stop]
        start = stop
    yield text[start:]


class Codec:
    """Whole-text encoding, in parts, as the tokenizers library does with a vocabulary."""

    def __init__(self, name: str):
        self.path, self.encoder = name, encoder(name)
        added = self.encoder.tokenizer.get_added_tokens_decoder()
        self.added = {t.content: i for i, t in added.items()}
        usual = not any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in added.values())
        longest = sorted(self.added, key=len, reverse=True)
        self.find_added = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if added else None
        self.splits_added = usual and bool(added)
        self.byte_level = self.encoder.alone
        self.words: dict[str, list[int]] = {}

    @functools.cached_property
    def joiner(self) -> Joiner:
        """Built when a long word comes: a model without the end of words beside the vocabulary's own."""
        from tokenizers import models

        model = self.encoder.tokenizer.model
        suffix = model.end_of_word_suffix or ""
        with open(self.path) as f:
            known = json.load(f)["model"]
        inner = models.BPE(vocab=known["vocab"], merges=[tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in known["merges"]]) if suffix else model
        letters = {i: t.removesuffix(suffix) if suffix else t for t, i in known["vocab"].items()}
        return Joiner(lambda x: [t.id for t in inner.tokenize(x)], lambda x: [t.id for t in model.tokenize(x)], letters)

    def plain(self, texts: list[str]) -> list[bytes]:
        """Ids (little-endian unsigned, of the encoder's width) of texts without added tokens."""
        w = self.encoder.width
        return [x[:-w] for x in self.encoder.encode(texts, 0)]

    def parts(self, text: str, leaf: int) -> list[tuple[str, str]]:
        """(kind, payload) of a text, in order, at least one; encoding each and joining gives the text's ids."""
        return list(self._parts(text, leaf)) or [(TEXT, "")]

    def _parts(self, text: str, leaf: int) -> Iterator[tuple[str, str]]:
        if self.find_added and not self.splits_added and self.find_added.search(text):
            raise ValueError("added tokens that take white space or whole words with them are not supported in texts")
        for k, stretch in enumerate(self.find_added.split(text) if self.find_added else [text]):
            if k % 2:
                yield ADDED, stretch
                continue
            for part in cuts(stretch, leaf):
                if len(part) <= 2 * leaf or not self.byte_level:
                    if part:
                        yield TEXT, part
                    continue
                yield from self._unsplit(part, leaf)

    def _unsplit(self, run: str, leaf: int) -> Iterator[tuple[str, str]]:
        tokenizer = self.encoder.tokenizer
        run = tokenizer.normalizer.normalize_str(run) if tokenizer.normalizer else run
        short, size = [], 0
        for letters, _ in tokenizer.pre_tokenizer.pre_tokenize_str(run):
            if len(letters) <= leaf:
                short.append(letters)
                size += len(letters)
            if short and (size > leaf or len(letters) > leaf):
                yield WORDS, "\n".join(short)
                short, size = [], 0
            if len(letters) > leaf:
                *inner, last = halves(letters, leaf)
                yield from ((INNER, x) for x in inner)
                yield LAST, last
        if short:
            yield WORDS, "\n".join(short)

    def encode_parts(self, kinds: list[str], payloads: list[str]) -> list[bytes]:
        """Ids of each part by itself."""
        out: list[bytes] = [b""] * len(kinds)
        texts = [k for k, kind in enumerate(kinds) if kind == TEXT]
        for k, ids in zip(texts, self.plain([payloads[k] for k in texts]), strict=True):
            out[k] = ids
        for k, (kind, x) in enumerate(zip(kinds, payloads, strict=True)):
            if kind == WORDS:
                if len(self.words) > 100_000:
                    self.words = {}
                ids = []
                for word in x.split("\n"):
                    if word not in self.words:
                        self.words[word] = self.joiner.last(word)
                    ids += self.words[word]
                out[k] = self._pack(ids)
            elif kind in (INNER, LAST):
                out[k] = self._pack(self.joiner.inner(x) if kind == INNER else self.joiner.last(x))
            elif kind == ADDED:
                out[k] = self._pack([self.added[x]])
        return out

    def assemble(self, kinds: list[str], ids: list[bytes]) -> bytes:
        """Ids of the whole text from those of its parts, in order."""
        out, held = [], []
        for kind, x in zip(kinds, ids, strict=True):
            if kind in (INNER, LAST):
                held.append(np.frombuffer(x, self.encoder.dtype).tolist())
                if kind == LAST:
                    out.append(self._pack(self.joiner.tree(held)))
                    held = []
            else:
                out.append(x)
        return b"".join(out)

    def encode(self, texts: list[str], leaf: int = LEAF) -> list[bytes]:
        """Ids of whole texts in this process: parts and joins where a text needs them."""
        cut = [k for k, t in enumerate(texts) if len(t) > SPLIT or (self.find_added and self.find_added.search(t))]
        odd = set(cut)
        out = self.plain(["" if k in odd else t for k, t in enumerate(texts)])
        for k in cut:
            kinds, payloads = zip(*self.parts(texts[k], leaf), strict=True)
            out[k] = self.assemble(kinds, self.encode_parts(kinds, payloads))
        return out

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.encoder.dtype).tobytes()


class Decoder:
    """Texts of ids, as the library's decode gives them with special tokens kept."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        self.tokens = [self.tokenizer.id_to_token(i) for i in range(size)]
        self.decimal = [str(i) for i in range(size)]
        self.kind = type(self.tokenizer.decoder).__name__ if self.tokenizer.decoder else None
        self.bytes = self._token_bytes() if self.kind == "ByteLevel" else []

    def _token_bytes(self) -> list[bytes]:
        byte = {c: b for b, c in enumerate(_byte_letters())}
        return [b"" if t is None else bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in self.tokens]

    def decode(self, ids: list[int]) -> str:
        """The text; ids of the vocabulary's range that name no token say nothing."""
        if self.kind is None:
            return " ".join(t for t in map(self.tokens.__getitem__, ids) if t is not None)
        if self.bytes:
            return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")
        return self.tokenizer.decode(ids, skip_special_tokens=False)

    def decimals(self, ids: list[int]) -> str:
        return " ".join(map(self.decimal.__getitem__, ids))


@functools.cache
def codec(name: str) -> Codec:
    """One per Python worker and vocabulary."""
    return Codec(vocabulary(name))


@functools.cache
def decoder(name: str) -> Decoder:
    return Decoder(vocabulary(name))


ENCODED = "doc_id long, n_tokens long, ids binary"


def _encoded(keys: pa.Array, ids: list[bytes], c: Codec) -> pa.RecordBatch:
    wide = ids if c.encoder.width == 4 else [np.frombuffer(x, c.encoder.dtype).astype("<u4").tobytes() for x in ids]
    return pa.RecordBatch.from_arrays([keys, pa.array([len(x) // 4 for x in wide], pa.int64()), pa.array(wide, pa.binary())], ["doc_id", "n_tokens", "ids"])


def encode(docs: DataFrame, vocabulary: str = WORD_BPE, split: int = SPLIT, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) of every row's whole text.

    Strings of added tokens in a text are those tokens, as the library has it; no others are added.
    A null or empty text has no ids. Repeated rows and rows without doc_id are encoded like any
    other; nothing depends on order. Texts of more than ``split`` characters are cut into parts of
    about ``leaf`` and encoded as rows of their own, so a long text is the work of many tasks; only
    its ids meet in one. Other columns are ignored, whatever their names. No rows give no rows.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    is_long = F.char_length("text") > split

    def whole(batch):
        c = codec(vocabulary)
        for start, stop in text_chunks(batch, "text", ENCODE_BYTES):
            part = batch.slice(start, stop - start)
            yield _encoded(part.column("doc_id"), c.encode(part.column("text").to_pylist(), leaf), c)

    def cut(batch):
        c = codec(vocabulary)
        for row, key, text in zip(*(batch.column(n).to_pylist() for n in ("row", "doc_id", "text")), strict=True):
            kinds, payloads = zip(*c.parts(text, leaf), strict=True)
            for k in range(0, len(kinds), 64):
                n = len(kinds[k : k + 64])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * n), pa.array([key] * n, pa.int64()), pa.array(range(k, k + n), pa.int64()), pa.array(kinds[k : k + 64]), pa.array(payloads[k : k + 64])],
                    ["row", "doc_id", "seq", "kind", "payload"],
                )

    def part(batch):
        c = codec(vocabulary)
        for start, stop in text_chunks(batch, "payload", ENCODE_BYTES):
            b = batch.slice(start, stop - start)
            ids = c.encode_parts(b.column("kind").to_pylist(), b.column("payload").to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("row", "doc_id", "seq", "kind")), pa.array(ids, pa.binary())], ["row", "doc_id", "seq", "kind", "ids"])

    def assemble(batches):
        c = codec(vocabulary)
        for held, edges in whole_groups(batches, ["row"], 256):
            kinds, ids = held.column("kind").to_pylist(), held.column("ids").to_pylist()
            joined = [c.assemble(kinds[a:b], ids[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            yield _encoded(held.column("doc_id").combine_chunks().take(pa.array(edges[:-1])), joined, c)

    here = map_rows(rows.filter(~is_long), whole, ENCODED)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = rows.filter(is_long).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    parts = map_rows(numbered, cut, "row long, doc_id long, seq long, kind string, payload string").repartition(n, "row", "seq")
    encoded = map_rows(parts, part, "row long, doc_id long, seq long, kind string, ids binary")
    there = encoded.repartition(n, "row").sortWithinPartitions("row", "seq").mapInArrow(assemble, ENCODED)
    return here.unionByName(there)


def decode(encoded: DataFrame, vocabulary: str = WORD_BPE) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by a space), text: as the library
    decodes with special tokens kept. A null list of ids is an empty one; other columns are ignored."""

    def run(batch):
        c = decoder(vocabulary)
        for start, stop in text_chunks(batch, "ids", ENCODE_BYTES):
            b = batch.slice(start, stop - start)
            lists = [np.frombuffer(x or b"", "<u4").tolist() for x in b.column("ids").to_pylist()]
            digests = [hashlib.sha256(c.decimals(x).encode()).hexdigest() for x in lists]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_tokens"), pa.array(digests), pa.array([c.decode(x) for x in lists], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "text"])

    return map_rows(encoded.select("doc_id", "n_tokens", "ids"), run, "doc_id long, n_tokens long, ids_sha256 string, text string")


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decode(encode(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))
