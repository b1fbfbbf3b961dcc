"""Token-id shards with keyed access.

A shard is a payload of raw ids, an index and a list of its keys. The index maps document keys by
a minimal perfect hash to slots; a slot holds the key's fingerprint and where its documents
start, so keyed access takes constant time and unknown keys are refused. The manifest holds the
range of keys of each shard, by which keys are routed. The list of keys is there to go through a
shard; keyed access never opens it.
"""

from __future__ import annotations

import functools
import io
import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, shared_dir, table, text_chunks
from .tokens import BYTE_BPE, ENCODE_BYTES, encoder

MAGIC = b"IDSHARD2"
#: Bytes of texts in a shard; its index (some 30 bytes a document) is held in memory when read.
SHARD_BYTES = 256 << 20
#: Ids and documents that one ranged read takes at most (one document at least).
READ_IDS, READ_DOCS = 2 << 20, 4096


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit mixing of int64 keys."""
    x = keys.astype(np.int64).view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct int64 keys: levels of bits and their ranks.

    At each level the keys that hash alone set a bit; the others go to the next level. The slot
    of a key is the number of bits set before its own.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # arrays of 0/1 bytes
        self.ranks, base = [], 0
        for bits in levels:
            self.ranks.append(base + np.cumsum(bits, dtype=np.int64) - bits)
            base += int(bits.sum())

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 1.5) -> PerfectHash:
        levels = []
        while keys.size:
            size = max(2, int(gamma * keys.size))
            at = (mixed(keys, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone.astype(np.uint8))
            keys = keys[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slots of the keys; -1 where no level has a bit (the key is unknown)."""
        out, left = np.full(keys.size, -1, np.int64), np.arange(keys.size)
        for seed, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = (mixed(keys[left], seed) % np.uint64(bits.size)).astype(np.int64)
            hit = bits[at] == 1
            out[left[hit]] = ranks[at[hit]]
            left = left[~hit]
        return out


class ShardIndex:
    """Keys of one shard -> (first document, number of documents); documents -> offsets."""

    def __init__(self, hashed: PerfectHash, prints: np.ndarray, first: np.ndarray, count: np.ndarray, nulls: int, ends: np.ndarray, width: int):
        self.hashed, self.prints, self.first, self.count = hashed, prints, first, count
        self.nulls, self.ends, self.width = nulls, ends, width

    @classmethod
    def build(cls, keys: np.ndarray, nulls: int, lengths: np.ndarray, width: int) -> ShardIndex:
        """keys: of the documents in order, after ``nulls`` documents without key."""
        distinct, first, count = np.unique(keys, return_index=True, return_counts=True)
        hashed = PerfectHash.build(distinct)
        slot = hashed.slots(distinct)
        placed = [np.empty(distinct.size, t) for t in (np.uint32, np.int64, np.int64)]
        for out, value in zip(placed, (mixed(distinct, 99) >> np.uint64(32), first + nulls, count), strict=True):
            out[slot] = value
        return cls(hashed, *placed, nulls, np.cumsum(lengths), width)

    def lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First document and number of documents of each key; 0 documents for unknown keys."""
        slot = self.hashed.slots(keys)
        known = slot >= 0
        known[known] = self.prints[slot[known]] == (mixed(keys[known], 99) >> np.uint64(32)).astype(np.uint32)
        slot = np.where(known, slot, 0)
        if not self.prints.size:
            return np.zeros(keys.size, np.int64), np.zeros(keys.size, np.int64)
        return np.where(known, self.first[slot], 0), np.where(known, self.count[slot], 0)

    def to_bytes(self) -> bytes:
        parts = [self.prints, self.first, self.count, self.ends.astype(np.int64)]
        parts += [np.packbits(b) for b in self.hashed.levels]
        head = {"width": self.width, "nulls": self.nulls, "arrays": [[p.dtype.str, p.size] for p in parts], "levels": [b.size for b in self.hashed.levels]}
        text, out = json.dumps(head).encode(), io.BytesIO()
        out.write(MAGIC + len(text).to_bytes(4, "little") + text)
        for p in parts:
            out.write(p.tobytes())
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> ShardIndex:
        assert raw[:8] == MAGIC, "not a shard index"
        at = 12 + int.from_bytes(raw[8:12], "little")
        head, arrays = json.loads(raw[12:at]), []
        for kind, n in head["arrays"]:
            arrays.append(np.frombuffer(raw, kind, n, at))
            at += arrays[-1].nbytes
        levels = [np.unpackbits(a, count=n) for a, n in zip(arrays[4:], head["levels"], strict=True)]
        return cls(PerfectHash(levels), *arrays[:3], head["nulls"], arrays[3], head["width"])


MANIFEST = "shard long, name string, n_docs long, n_tokens long, nulls long, least long, most long"


def write_shards(docs: DataFrame, path: str, vocabulary: str = BYTE_BPE, end_id: int = 0, shards: int | None = None) -> DataFrame:
    """Write all documents in ascending doc_id order; the manifest has one row per shard.

    Null keys come first; rows of one key follow the hash of their text, so a key with very many
    rows may span shards, and rows that tie in both are equal. A null text is an empty one and has
    the end id alone; a long text is encoded whole. Columns besides doc_id and text are ignored,
    whatever their names. No rows give an empty manifest. The number of shards follows the bytes of
    the texts. Files carry a fresh name per attempt: only those that the manifest (written by
    Spark's committer) names count.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not shards:
        total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // SHARD_BYTES)
    order = ["doc_id", "_hash"]
    ranged = docs.withColumn("_hash", F.xxhash64("text")).repartitionByRange(shards, *order).sortWithinPartitions(*order)

    def run(batches):
        keys, nulls, lengths, out, name, enc = [], 0, [], None, f"{path}/{uuid.uuid4().hex}", None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                enc, (store, base) = encoder(vocabulary), pafs.FileSystem.from_uri(name)
                store.create_dir(base.rpartition("/")[0], recursive=True)
                out = store.open_output_stream(f"{base}.ids")
            column = batch.column("doc_id")
            nulls += column.null_count
            keys.append(column.drop_null().to_numpy(zero_copy_only=False))
            for start, stop in text_chunks(batch, "text", ENCODE_BYTES):
                ids = enc.encode(batch.column("text").slice(start, stop - start).to_pylist(), end_id)
                lengths.append(np.array([len(x) // enc.width for x in ids], np.int64))
                out.write(b"".join(ids))
        if out is not None:
            out.close()
            n, held = np.concatenate(lengths), np.concatenate(keys).astype("<i8")
            for ending, body in (("index", ShardIndex.build(held, nulls, n, enc.width).to_bytes()), ("keys", held.tobytes())):
                with store.open_output_stream(f"{base}.{ending}") as f:
                    f.write(body)
            row = [TaskContext.get().partitionId(), name, n.size, int(n.sum()), nulls, *((int(held[0]), int(held[-1])) if held.size else (None, None))]
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.string() if c == "name" else pa.int64()) for v, c in zip(row, _MANIFEST, strict=True)], _MANIFEST)

    return materialize(ranged.mapInArrow(run, MANIFEST), "manifest")


_MANIFEST = [c.split()[0] for c in MANIFEST.split(", ")]
_ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


@functools.lru_cache(maxsize=2)
def _open(name: str):
    store, file = pafs.FileSystem.from_uri(name)
    with store.open_input_stream(f"{file}.index") as f:
        return store, file, ShardIndex.from_bytes(f.read())


def _fetch(name: str, base: int, keys: np.ndarray, with_ids: bool, nulls: bool = False):
    """Batches of the documents that have the keys (ascending) in this shard, and on request those
    without key; documents that follow each other share a ranged read."""
    store, file, index = _open(name)
    first, count = index.lookup(keys)
    docs = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
    found = np.repeat(keys, count).tolist()
    if nulls:
        docs, found = np.concatenate([np.arange(index.nulls), docs]), [None] * index.nulls + found
    starts = np.concatenate([[0], index.ends[:-1]])[docs] if docs.size else docs
    ends = index.ends[docs] if docs.size else docs
    with store.open_input_file(f"{file}.ids") as f:
        at = 0
        while at < docs.size:
            stop = at + 1
            while stop < docs.size and stop - at < READ_DOCS and docs[stop] == docs[stop - 1] + 1 and ends[stop] - starts[at] <= READ_IDS:
                stop += 1
            block = f.read_at(int(ends[stop - 1] - starts[at]) * index.width, int(starts[at]) * index.width)
            ids = np.frombuffer(block, f"<u{index.width}").astype("<u4").tobytes()
            cuts = 4 * (np.append(starts[at:stop], ends[stop - 1]) - starts[at])
            texts = [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            arrays = [pa.array(found[at:stop], pa.int64()), pa.array(starts[at:stop] + base), pa.array(ends[at:stop] - starts[at:stop]), pa.array([zlib.crc32(x) for x in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(texts, pa.binary())] * with_ids, ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)
            at = stop


def _placed(manifest: DataFrame) -> DataFrame:
    """The manifest with ``base``, the number of ids in earlier shards (one row per shard)."""
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return manifest.select("shard", "name", "nulls", "least", "most", before.alias("base"))


def read_shards(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """Every document of the shards by keyed access: doc_id, start, n_tokens, ids_crc32 and,
    on request, ids (little-endian unsigned 32-bit). Each shard looks all its keys up."""
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                store, file, index = _open(row["name"])
                with store.open_input_stream(f"{file}.keys") as f:
                    keys = np.unique(np.frombuffer(f.read(), "<i8"))
                known = index.lookup(keys)[1]
                assert int(known.sum()) + index.nulls == index.ends.size, f"{row['name']}: the index has lost keys"
                yield from _fetch(row["name"], row["base"], keys, with_ids, nulls=True)

    return _placed(manifest).repartition(tasks, "shard").mapInArrow(run, _ROWS + ", ids binary" * with_ids)


def get(manifest: DataFrame, keys: DataFrame, key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """The documents of the asked keys, as ``read_shards`` gives them; unknown and null keys give no
    rows, repeated ones are asked once, a key of several rows (also across shards) gives them all.

    Tasks route keys by the shards' ranges (16 bytes per shard of ``SHARD_BYTES`` go to them), and
    each shard asked opens its index once and reads the documents' own ranges of the payload.
    """
    shards = _placed(manifest).filter("least is not null").orderBy("shard").select("shard", "name", "base", "least", "most")
    ranges = np.array([(r.shard, r.least, r.most) for r in shards.select("shard", "least", "most").collect()], np.int64).reshape(-1, 3)
    number, least, most = (ranges[:, k].copy() for k in range(3))

    def route(batches):
        for batch in batches:
            asked = batch.column("key").to_numpy()
            lo, hi = np.searchsorted(most, asked, "left"), np.searchsorted(least, asked, "right")
            n = np.maximum(hi - lo, 0)
            shard = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked, n)), pa.array(number[shard])], ["key", "shard"])

    asked = keys.select(F.col(key).cast("long").alias("key")).filter("key is not null").distinct()
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    routed = asked.mapInArrow(route, "key long, shard long").join(shards.select("shard", "name", "base"), "shard")
    dealt = routed.repartition(tasks, "shard").sortWithinPartitions("shard", "key")

    def run(batches):
        for batch in batches:
            wanted, bases = batch.column("key").to_numpy(), batch.column("base").to_pylist()
            names = batch.column("name").dictionary_encode()
            code = names.indices.to_numpy()
            edges = np.flatnonzero(np.diff(code, prepend=-1, append=-1))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                yield from _fetch(names.dictionary[int(code[a])].as_py(), bases[a], wanted[a:b], with_ids)

    return dealt.select("name", "base", "key").mapInArrow(run, _ROWS + ", ids binary" * with_ids)


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_shards(table(spark, sf_dir, "documents"), shared_dir(spark, "shards"))
    return read_shards(manifest, with_ids=False)
