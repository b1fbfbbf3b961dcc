"""Mixing, packing, token shards and archives: invariants, round trips and plain recounts."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import zstandard
from pyarrow import fs as pafs

from contestflow.llm import mixing, packing, shards, tokens, warc

ODD = [(None, "no key"), (5, None), (6, ""), (7, " \t\n "), (8, "a\x00b  c\x00"), (9, "tab\tand\nline\r\n end "), (10, "é☃ 漢字 🙂 \u00a0x\u2003y"), (11, "x" * 3000), (12, "Mixed CASE Words, and-punctuation! 12345"), (13, "Hello World, 漢字 Éa it's ÀÉ''s don't''t a_b x²y ªº ŉ ß.. end"), (15, "'d start"), (14, "Hello, é.è it's ʼn Ǆ")]


def counted(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def level_targets(sizes, weights, share, epochs):
    """Plain water filling: cap, share the excess by weight, repeat."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: float(weights[k % len(weights)]) for k, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        per = left / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * per >= epochs * sizes[s]}
        if not over:
            return out | {s: w[s] * per for s in open_}
        for s in over:
            out[s] = float(epochs * sizes[s])
            left -= out[s]
        open_ -= over
    return out


@pytest.mark.parametrize("hot", [0, 300])
def test_mix_meets_targets(documents, prose, hot):
    rows = [(k, prose(k, 20 + k % 60), f"s{k % 5}" if k % 11 else None) for k in range(400)] + [(1000 + k, prose(k, 40), "s1") for k in range(hot)]
    rows += [(2000, None, "s1"), (2001, "", "empty"), (3, prose(3, 23), "s3")]
    sizes, source = defaultdict(int), {}
    for d, t, s in rows:
        sizes[s] += counted(t)
        source[d] = s
    goal = level_targets(sizes, (3, 1, 2), 1.5, 2)
    out = mixing.mix(documents(rows)).collect()
    assert sorted(r.doc_id for r in out) == sorted(r[0] for r in rows)
    taken = defaultdict(int)
    for r in out:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(goal[s], rel=1e-9) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert sum(taken.values()) == int(1.5 * sum(sizes.values()))
    assert all(abs(taken[s] - goal[s]) <= 2 * max(r.size for r in out) for s in sizes)
    assert sorted(map(tuple, out)) == sorted(map(tuple, mixing.mix(documents(rows[::-1]).repartition(7)).collect()))


def test_mix_odd_tables(documents):
    assert mixing.mix(documents([])).collect() == []
    assert [r.taken for r in mixing.mix(documents([(1, None), (2, "")])).collect()] == [0, 0]


def plain_ids(name, text, end):
    from tokenizers import Tokenizer

    t = plain_ids.__dict__.setdefault(name, Tokenizer.from_file(tokens.vocabulary(name)))
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, end]


@pytest.mark.parametrize("name", [tokens.BYTE_BPE, tokens.WORD_BPE])
def test_encoder_equals_the_library(prose, name, spark):
    texts = [t for _, t in ODD] + [prose(k, 50 * k) for k in range(6)] + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    enc = tokens.Encoder(tokens.vocabulary(name), cache_pieces=50)  # the bound never changes results
    got = [np.frombuffer(x, enc.dtype).tolist() for k in range(0, len(texts), 7) for x in enc.encode(texts[k : k + 7], 0)]
    assert got == [plain_ids(name, t, 0) for t in texts]


@pytest.mark.parametrize("name", [tokens.BYTE_BPE, tokens.WORD_BPE])
def test_long_texts_are_encoded_whole(prose, name, monkeypatch):
    monkeypatch.setattr(tokens, "LONG", 200)
    texts = [prose(1, 500), "short", prose(2, 5) + "\u2003" + prose(3, 300), " " * 1000, "x" * 5000]
    enc = tokens.Encoder(tokens.vocabulary(name))
    assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts, 7)] == [plain_ids(name, t, 7) for t in texts]


def test_packing_round_trip(documents, prose):
    rows = ODD + [(100 + k, prose(k, 300 + 10 * k)) for k in range(20)] + [(500, prose(1, 30000)), (100, prose(0, 300))]
    pieces = packing.pack(documents(rows).repartition(5)).collect()
    by_sequence = defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4")
        assert ids.size == p.length > 0 and zlib.crc32(p.ids) == p.ids_crc32
        by_sequence[p.sequence_id].append(p)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    stream = []
    for s in range(len(by_sequence)):
        at = 0
        for p in sorted(by_sequence[s], key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
            stream.append(p)
        assert at <= 2048 and (at == 2048 or s == len(by_sequence) - 1) and {p.sequence_length for p in by_sequence[s]} == {2048 if at & (at - 1) else at}
    docs, now = [], []
    for p in stream:
        assert p.start == len(now) % max(1, p.doc_tokens)
        now += np.frombuffer(p.ids, "<u4").tolist()
        if len(now) == p.doc_tokens:
            docs.append((p.doc_id, now))
            now = []
    assert not now and sorted(docs, key=str) == sorted(((d, plain_ids(tokens.WORD_BPE, t, 1)) for d, t in rows), key=str)
    assert packing.pack(documents([])).collect() == []


def test_shards_round_trip(spark, documents, prose, tmp_path):
    rows = ODD + [(k, prose(k, k)) for k in range(40, 90)] + [(50, "again"), (None, None)]
    manifest = shards.write_shards(documents(rows).repartition(3), f"file://{tmp_path}/shards", shards=4)
    out = shards.read_shards(manifest).collect()
    assert len(out) == len(rows)
    out.sort(key=lambda r: r.start)
    keys = [r.doc_id for r in out]
    assert keys == sorted(keys, key=lambda d: (d is not None, d or 0))
    total, want = 0, defaultdict(list)
    for d, t in rows:
        want[d].append(plain_ids(tokens.BYTE_BPE, t, 0))
    for r in out:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == total and r.n_tokens == len(ids) and zlib.crc32(r.ids) == r.ids_crc32
        total += len(ids)
        want[r.doc_id].remove(ids)
    assert not any(want.values())
    by_key = {}
    for r in out:
        by_key.setdefault(r.doc_id, []).append(tuple(r))
    asked = spark.createDataFrame([(k,) for k in (50, 41, 7, 7, 14, None, 10**12, -5, 12)], "k long")
    got = sorted(tuple(r) for r in shards.get(manifest, asked, "k").collect())
    assert got == sorted(r for k in (50, 41, 7, 14, 12) for r in by_key[k]) and len(by_key[50]) == 2
    assert shards.get(manifest, asked.limit(0), "k").collect() == []
    none = shards.write_shards(documents([]), f"file://{tmp_path}/none")
    assert shards.read_shards(none).collect() == [] and shards.get(none, asked, "k").collect() == []


def test_shards_of_one_key_in_many_rows(spark, documents, prose, tmp_path):
    rows = [(3, prose(k, 30)) for k in range(60)] + [(k, "x") for k in range(10)]
    manifest = shards.write_shards(documents(rows), f"file://{tmp_path}/shards", shards=5)
    got = shards.get(manifest, spark.createDataFrame([(3,), (4,)], "doc_id long")).collect()
    assert sorted(r.doc_id for r in got) == [3] * 61 + [4] and len({r.start for r in got}) == 62
    assert manifest.filter("least <= 3 and most >= 3").count() > 1


def test_perfect_hash_is_minimal_and_refuses_unknown_keys():
    keys = np.unique(np.random.default_rng(1).integers(-(2**60), 2**60, 5000))
    index = shards.ShardIndex.from_bytes(shards.ShardIndex.build(np.sort(np.append(keys, keys[:5])), 2, np.ones(keys.size + 7, np.int64), 2).to_bytes())
    assert sorted(index.hashed.slots(keys)) == list(range(keys.size))
    first, count = index.lookup(keys)
    assert count.tolist() == [2] * 5 + [1] * (keys.size - 5) and first[0] == 2
    assert (index.lookup(keys + 1)[1] > 0).mean() < 0.01
    assert index.lookup(np.array([1, 2]))[1].tolist() == [0, 0] and shards.ShardIndex.build(keys[:0], 0, keys[:0], 2).lookup(keys)[1].sum() == 0


def test_archives_round_trip(spark, prose, tmp_path):
    rows = [(k, f"https://x.org/{k}", f"<p>{prose(k % 40, 60)}</p>") for k in range(120)]
    rows += [(200, None, None), (201, "a\r\nb", ""), (202, "u", "é" * 5000), (None, "u", "<p>only</p>"), (None, "u", rows[3][2]), (7, "same key", rows[7][2])]
    rows += [(300, "long", "".join(random.Random(1).choices("abc <>é", k=3_000_000)))]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, first int").repartition(4)
    manifest = warc.write_archives(warc.classify(pages), f"file://{tmp_path}/warc")
    out = warc.read_archives(manifest).collect()
    assert len(out) == len(rows)
    least = {}
    for p, _, h in rows:
        h = h or ""
        least[h] = min((x for x in (p, least.get(h)) if x is not None), default=None)
    seen = {(r.page_id, r.url): r for r in out}
    for p, u, h in rows:
        r = seen[p, u and u.replace("\r", "%0D").replace("\n", "%0A")] if p is not None else next(x for x in out if x.page_id is None and x.payload_bytes == len(h))
        again = least[h or ""] is not None and (p is None or p > least[h or ""])
        assert (r.payload_bytes, r.record_type, r.refers_to) == (len((h or "").encode()), "revisit" if again else "response", least[h or ""] if again else None)
        assert r.payload == (b"" if again else (h or "").encode()) and re.fullmatch("[A-Z2-7]{32}", r.payload_digest)
    name = manifest.first()["name"]
    store, file = pafs.FileSystem.from_uri(name)
    raw = store.open_input_stream(file).read()
    size = int.from_bytes(raw[4:8], "little")
    assert int.from_bytes(raw[:4], "little") == warc.DICTIONARY_FRAME and raw[8 + size : 12 + size] == b"\x28\xb5\x2f\xfd"
    assert zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size])).decompressobj().decompress(raw[8 + size :]).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
    short = {r.page_id: r.record_type for r in warc.classify(pages, min_bytes=200000).collect()}
    assert set(short.values()) == {"response"}
    assert warc.read_archives(warc.write_archives(warc.classify(pages.limit(0)), f"file://{tmp_path}/none")).collect() == []
