"""Packing by concatenate and cut.

Pass one encodes every document where it lies and writes its ids with the partition and its
place there. Prefix sums over the partitions' totals give global offsets, so pass two cuts
fixed windows without any shuffle: each document is split at the window boundaries inside it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shared_dir, table, text_chunks
from .tokens import ENCODE_BYTES, WORD_BPE, encoder

#: One offset per partition is broadcast up to this many partitions (16 bytes each), joined beyond.
BROADCAST_PARTITIONS = 500_000


def encode_documents(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """(part, place, doc_id, n_tokens, ids) of every row, written once to the shared folder.

    ids: little-endian unsigned 32-bit; ``place`` is the number of ids before the row in its
    partition. The written table fixes the order: a lost task writes its whole file again.
    """

    def run(batches):
        part, place, enc = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            enc = enc or encoder(vocabulary)
            for start, stop in text_chunks(batch, "text", ENCODE_BYTES):
                rows = batch.slice(start, stop - start)
                ids = enc.encode(rows.column("text").to_pylist(), end_id)
                n = np.array([len(x) // enc.width for x in ids], np.int64)
                places = place + np.cumsum(n) - n
                place += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), part)), pa.array(places), rows.column("doc_id"), pa.array(n), pa.array(np.full(len(ids), enc.width, np.int32)), pa.array(ids, pa.binary())],
                    ["part", "place", "doc_id", "n_tokens", "width", "ids"],
                )

    path, spark = shared_dir(docs.sparkSession, "packing"), docs.sparkSession
    out = docs.select("doc_id", "text").mapInArrow(run, "part long, place long, doc_id long, n_tokens long, width int, ids binary")
    out.write.option("compression", "snappy").parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def cut(encoded: DataFrame, window: int = 2048, with_ids: bool = True) -> DataFrame:
    """Pieces of the concatenated documents in windows of ``window`` ids."""
    totals = encoded.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select("part", before.alias("base"), F.sum("total").over(Window.partitionBy()).alias("all_tokens"))
    small = totals.count() <= BROADCAST_PARTITIONS  # the rows that would be broadcast
    placed = encoded.join(F.broadcast(offsets) if small else offsets, "part").select(
        "doc_id", (F.col("base") + F.col("place")).alias("at"), "n_tokens", "all_tokens", "width", "ids"
    )

    def run(batches):
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length"] + ["ids"] * with_ids
        for batch in batches:
            cols, docs = [[] for _ in range(7 + with_ids)], []
            ats, ns, alls, widths = (batch.column(c).to_pylist() for c in ("at", "n_tokens", "all_tokens", "width"))
            for row, raw in enumerate(batch.column("ids")):
                ids = np.frombuffer(raw.as_buffer(), f"<u{widths[row]}").astype("<u4").tobytes()
                at, n, last = ats[row], ns[row], alls[row] // window
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, window)
                    length = min(n - start, window - offset)
                    piece = ids[4 * start : 4 * (start + length)]
                    rest = alls[row] % window
                    full = window if sequence < last or rest & (rest - 1) else rest
                    for col, value in zip(cols, (start, length, zlib.crc32(piece), n, sequence, offset, full, piece), strict=False):
                        col.append(value)
                    docs.append(row)
                    start += length
            arrays = [batch.column("doc_id").take(pa.array(docs, pa.int64()))] + [pa.array(c, pa.int64()) for c in cols[:7]]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(c, pa.binary()) for c in cols[7:]], names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"
    return placed.mapInArrow(run, schema + ", ids binary" * with_ids)


def pack(docs: DataFrame, vocabulary: str = WORD_BPE, end_id: int = 1, window: int = 2048, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    sequence_length and, on request, ids (little-endian unsigned 32-bit).

    Every document ends with ``end_id``. Sequences are full but for the last one, which is
    padded to ``window`` unless its fill is a power of two. A null or empty text is the end id
    alone. Rows with a null or repeated doc_id are packed like any other; order follows the
    input's partitions, so ties cannot arise. A long text is cut into as many pieces as it needs. No
    rows give no pieces. Other columns are ignored, whatever their names.
    """
    return cut(encode_documents(docs, vocabulary, end_id), window, with_ids)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False)
