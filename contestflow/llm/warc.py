"""WARC archives of individually compressed records with an embedded dictionary.

Each task writes one archive: it trains a Zstandard dictionary on the first records, stores it
in a leading skippable frame and compresses every record as a frame of its own.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir, table

DICTIONARY_FRAME = 0x184D2A5D  # fixed value: skippable frame that holds a dictionary
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the format
#: The dictionary is trained on at most this many first records and bytes of an archive.
TRAIN_RECORDS, TRAIN_BYTES, DICTIONARY_BYTES = 400, 2 << 20, 64 << 10


def classify(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Add ``record_type`` and ``refers_to`` by payload.

    Of records with equal payloads of ``min_bytes`` or more, the smallest page_id is the
    response and others revisit it (rows that repeat that page_id are responses, too; rows
    without page_id revisit if any equal row has one). Groups are pre-aggregated to
    one row per digest; only repeated digests are joined, which AQE splits where one is hot.
    """
    payload = F.coalesce("html", F.lit(""))
    p = pages.select("page_id", "url", "html", F.sha2(payload, 256).alias("digest"))
    groups = pages.select("page_id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("bytes")).groupBy("digest")
    repeated = groups.agg(F.min("page_id").alias("first"), F.count("*").alias("n"), F.max("bytes").alias("bytes")).filter((F.col("n") > 1) & (F.col("bytes") >= min_bytes))
    joined = p.join(repeated.select("digest", "first"), "digest", "left")
    again = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    return joined.select("page_id", "url", "html", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def _info(name: str, date: str) -> bytes:
    """The record that opens an archive and describes it."""
    block = b"software: contestflow\r\nformat: WARC File Format 1.1\r\n"
    file = name.rpartition("/")[2]
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, file)}>", f"WARC-Filename: {file}", f"WARC-Date: {date}"]
    return "\r\n".join([*lines, "Content-Type: application/warc-fields", f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def _record(row: dict, date: str, place: str) -> bytes:
    """A record; ``place`` (archive and number) names it where the row has no page_id."""
    payload = (row["html"] or "").encode()
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if row["record_type"] == "revisit" else http + payload
    own = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, place)}" if row["page_id"] is None else f"urn:page:{row['page_id']}"
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{own}>", f"WARC-Date: {date}"]
    if row["url"] is not None:
        lines.append("WARC-Target-URI: " + row["url"].replace("\r", "%0D").replace("\n", "%0A"))
    if row["record_type"] == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{row['refers_to']}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def dictionary_of(records: list[bytes]) -> bytes:
    """A trained dictionary, or the records' own start where there are too few to train on."""
    if not records:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records, k=512, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[: DICTIONARY_BYTES // 4]


def write_archives(pages: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z", level: int = 3) -> DataFrame:
    """One archive per non-empty partition of classified pages; returns the manifest.

    A null html is an empty payload, a null url is left out. Rows that repeat a page_id share its
    record id; rows without one are named by archive and number. A long payload is one record and
    has to fit in a task, and no other is held with it. Columns besides those of ``classify`` are
    ignored. No rows give no archives. Names are fresh per attempt; only
    archives that the manifest (written by Spark's committer) names count.
    """

    def run(batches):
        name, out, pack, early, size, n = f"{path}/{uuid.uuid4().hex}.warc.zst", None, None, [], 0, 0

        def begin():
            store, file = pafs.FileSystem.from_uri(name)
            store.create_dir(file.rpartition("/")[0], recursive=True)
            f, words = store.open_output_stream(file), dictionary_of(early)
            f.write(DICTIONARY_FRAME.to_bytes(4, "little") + len(words).to_bytes(4, "little") + words)
            learnt = zstandard.ZstdCompressionDict(words)
            learnt.precompute_compress(level=level)
            squeeze = zstandard.ZstdCompressor(level=level, dict_data=learnt, write_checksum=True)
            for record in (_info(name, date), *early):
                f.write(squeeze.compress(record))
            early.clear()
            return f, squeeze

        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                for row in batch.slice(k, 64).to_pylist():
                    record, n = _record(row, date, f"{name}/{n}"), n + 1
                    if out is None:
                        early.append(record)
                        size += len(record)
                        if len(early) >= TRAIN_RECORDS or size >= TRAIN_BYTES:
                            out, pack = begin()
                    else:
                        out.write(pack.compress(record))
        if n:
            out = out or begin()[0]
            out.close()
            yield pa.RecordBatch.from_pydict({"name": [name], "records": [n]})

    return materialize(pages.mapInArrow(run, "name string, records long"), "archives")


def read_records(stream):
    """(headers, block) of every page's record of an open archive; one record is held at a time."""
    head = stream.read(8)
    assert int.from_bytes(head[:4], "little") == DICTIONARY_FRAME, "no dictionary frame"
    words = zstandard.ZstdCompressionDict(stream.read(int.from_bytes(head[4:], "little")))
    frames = zstandard.ZstdDecompressor(dict_data=words).stream_reader(stream, read_across_frames=True)
    text = io.BufferedReader(frames, 1 << 16)
    while line := text.readline():
        assert line == b"WARC/1.1\r\n", "not a record"
        headers = {}
        while (line := text.readline()) != b"\r\n":
            key, _, value = line.decode().rstrip("\r\n").partition(": ")
            headers[key] = value
        block = text.read(int(headers["Content-Length"]))
        assert text.read(4) == b"\r\n\r\n"
        if headers["WARC-Type"] != "warcinfo":
            yield headers, block


def _page(urn: str) -> int | None:
    return int(urn.removeprefix("<urn:page:").removesuffix(">")) if urn.startswith("<urn:page:") else None


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * with_payload

    def run(batches):
        for batch in batches:
            for name in batch.column("name").to_pylist():
                store, file = pafs.FileSystem.from_uri(name)
                rows, held = [], 0
                with store.open_input_stream(file) as f:
                    for headers, block in read_records(f):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = int(http.rpartition(b"Content-Length: ")[2])
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        revisit = headers["WARC-Type"] == "revisit"
                        if not revisit:
                            assert length == len(payload) and digest == base64.b32encode(hashlib.sha1(payload).digest()).decode(), "damaged record"
                        refers = _page(headers["WARC-Refers-To"]) if revisit else None
                        rows.append((_page(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), length, digest, headers["WARC-Type"], refers, payload)[: len(names)])
                        held += len(payload) * with_payload + 200
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(tasks, "name").mapInArrow(run, schema + ", payload binary" * with_payload)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = classify(table(spark, sf_dir, "pages"))
    return read_archives(write_archives(pages, shared_dir(spark, "warc")), with_payload=False).drop("url")
