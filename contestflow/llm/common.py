"""Helpers that the text operators share: reading, shared folders, Arrow tasks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: space, tab, line feed, vertical tab, form feed, carriage return.
SEPARATORS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders that this process has asked for and not yet discarded.
_folders: list[str] = []


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is absent a local session (tests) gets a temporary folder; on several
    hosts there is no folder that all of them see, so the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    _folders.append(f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}")
    return _folders[-1]


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it again; this cuts lineage.

    A lost executor costs the tasks of one stage; nothing before the table runs again.
    """
    path = shared_dir(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _folders.remove(path)


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read again (what used them is written itself)."""
    for df in tables:
        _delete(df.sparkSession, df.folder)


def clean(spark: SparkSession) -> None:
    """Delete every folder that is left; to be called once the results of all queries are stored."""
    for path in list(_folders):
        _delete(spark, path)


def map_rows(df: DataFrame, step: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from step(batch)

    return df.mapInArrow(run, schema)


def whole_groups(batches, keys: list[str], rows: int = 4096):
    """(table, edges) of whole groups of rows that are sorted by ``keys``, about ``rows`` rows at a
    time; edges are where groups begin, and the end. Many small groups share one call this way,
    and no more than one unfinished group is held."""
    import numpy as np

    held = None
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            part = pa.Table.from_batches([batch.slice(k, rows)])
            held = pa.concat_tables([held, part]) if held is not None else part
            new = np.zeros(held.num_rows, bool)
            new[0] = True
            for c in keys:
                v = held.column(c).to_numpy()
                new[1:] |= v[1:] != v[:-1]
            edges = np.flatnonzero(new)
            if edges.size > 1:
                yield held.slice(0, edges[-1]).combine_chunks(), edges
                held, edges = held.slice(edges[-1]), np.zeros(1, np.int64)
    if held is not None:
        yield held.combine_chunks(), np.append(edges, held.num_rows)


def text_chunks(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose texts have about ``limit`` bytes together (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield start, stop
        start = stop


def words_of(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
