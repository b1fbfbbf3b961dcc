"""Readers and writers: declared schemas, several paths, partitioned datasets, artifacts."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One row per participant or team, game and side, as the CSV source gives it.
RAW_SCHEMA = (
    "gameid string, date string, league string, datacompleteness string, patch string, side string, position string, "
    "playername string, teamname string, result int, gamelength double, kills double, deaths double, assists double, dpm double, "
    "cspm double, vspm double, `earned gpm` double, damageshare double, golddiffat15 double, firsttower double, firstdragon double, "
    "firstbaron double, visionscore double"
)


def read_raw(spark: SparkSession, paths: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Yearly CSV files as one frame: a declared schema, no inference; bad dates become null."""
    df = spark.read.option("header", True).option("enforceSchema", False).schema(RAW_SCHEMA).csv(list(paths))
    df = df.withColumns({"date": F.try_to_timestamp("date"), "patch": F.col("patch").try_cast("double")})
    return df.select(*columns) if columns else df


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out, *rest = frames
    for df in rest:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def write_by_year(df: DataFrame, path: str, date: str = "date") -> None:
    df.withColumn("year", F.year(date)).write.mode("overwrite").partitionBy("year").parquet(path)


def read_years(spark: SparkSession, path: str, years: Sequence[int]) -> DataFrame:
    """A year subset; the filter prunes folders."""
    return spark.read.parquet(path).filter(F.col("year").isin(*years))


def save_state(state: DataFrame, path: str) -> None:
    state.write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str) -> DataFrame:
    """Saved ratings; a missing path raises the reader's PATH_NOT_FOUND error."""
    return spark.read.parquet(path)


#: Folders written by this process and not yet deleted.
_folders: list[str] = []


def shared(spark: SparkSession) -> str:
    """The folder for written tables that driver and executors share.

    Where ``spark.checkpoint.dir`` is unset, a local session takes a folder of its warehouse; on
    several hosts there is none that all of them see, so the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/tables"
    return base.rstrip("/")


def folder(spark: SparkSession, what: str) -> str:
    """A new name below the shared folder, deleted by ``clean`` at the latest."""
    _folders.append(f"{shared(spark)}/{what}-{uuid.uuid4().hex}")
    return _folders[-1]


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once to a new shared folder and read again: lost executors cost one stage."""
    path = folder(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    if path in _folders:
        _folders.remove(path)


def drop(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read again."""
    for df in tables:
        delete(df.sparkSession, df.folder)


def clean(spark: SparkSession) -> None:
    """Delete all that ``written`` left; to be called once the results of all queries are stored."""
    for path in list(_folders):
        delete(spark, path)


def as_json(df: DataFrame, into: str = "json") -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias(into))
