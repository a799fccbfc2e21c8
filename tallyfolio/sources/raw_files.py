"""Raw files by stored key: put, get one, get many, compact."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfolio.functions.naming import data_url
from tallyfolio.schemas import RAW_FILES, checked_load
from tallyfolio.workspace import lookup_join, remove, written_in


def shard_of(file_path: Column, digits: int) -> Column:
    """First hex digits of the id a key starts with; ids are hashes, so shards are of equal size."""
    return F.substring(file_path, 1, digits)


_LOAD = "load_id="
# Folder names are declared as text: inferred, those of digits only would become numbers.
_STORED = T.StructType([*RAW_FILES.fields, T.StructField("load_id", T.StringType()), T.StructField("shard", T.StringType())])


def _write(rows: DataFrame, folder: str) -> None:
    (rows.hint("rebalance", "shard")
     .sortWithinPartitions("shard", "file_path")
     .write.mode("overwrite").partitionBy("shard")
     .option("parquet.bloom.filter.enabled#file_path", "true")
     .parquet(folder))


def put_raw(files: DataFrame, path: str, load_id: str, digits: int = 2) -> None:
    """Store ``(file_path, content)`` rows; putting a load again replaces all that it had put, and no other load.

    A load is a folder with ``16 ** digits`` shard folders by key prefix, sorted by key in each file; with the bloom
    filter of the key column a get reads one shard of each load and, in it, few row groups. Adaptive execution splits and
    joins the write tasks by the bytes they really hold. Few digits keep the files of small loads few.
    """
    rows = files.select("file_path", "content").withColumn("shard", shard_of(F.col("file_path"), digits))
    _write(rows, f"{path}/{_LOAD}{checked_load(load_id)}")


def _loads(spark: SparkSession, path: str) -> list[str]:
    """Loads that lie in folders of their own."""
    return [name.removeprefix(_LOAD) for name in written_in(spark, path) if name.startswith(_LOAD)]


def _compacted(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(name) for name in written_in(spark, f"{path}_compacted"))


def _read(spark: SparkSession, base: str, folder: str) -> DataFrame:
    """Rows of a folder pattern; none if nothing matches it."""
    try:
        return spark.read.schema(_STORED).option("basePath", base).parquet(f"{base}/{folder}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _STORED)


def _stored(spark: SparkSession, path: str, shard: str = "") -> DataFrame:
    """All stored rows, or those of one shard: of the finished loads, and of the compacted ones that were not put again since."""
    loads = _loads(spark, path)
    inner = f"/shard={shard}" if shard else ""
    found = _read(spark, path, f"{_LOAD}{{{','.join(loads)}}}{inner}") if loads else spark.createDataFrame([], _STORED)
    for number in _compacted(spark, path)[-1:]:
        found = found.unionByName(_read(spark, f"{path}_compacted/{number}", f"shard={shard}" if shard else "").filter(~F.col("load_id").isin(loads)))
    return found


def compact_raw(spark: SparkSession, path: str) -> None:
    """Bring the loads put so far into one table, so that a get opens a bounded number of files however many loads there were.

    A load counts from its own folder as long as that is whole, then from the compacted table: whenever this ends or is
    broken off, each file is found once. A load that is put again later replaces its compacted rows. One writer at a time.
    """
    loads, numbers = _loads(spark, path), _compacted(spark, path)
    if not loads:
        return
    _write(_stored(spark, path), f"{path}_compacted/{(numbers or [0])[-1] + 1}")
    for load in loads:
        remove(spark, f"{path}/{_LOAD}{load}")
    for number in numbers:
        remove(spark, f"{path}_compacted/{number}")


def get_raw(spark: SparkSession, path: str, key: str, digits: int = 2) -> DataFrame:
    """The file stored under a key; no row if there is none. Only the shard folders of the key are looked at."""
    return _stored(spark, path, key[:digits]).filter(F.col("file_path") == key).select("file_path", "content")


def get_data_url(spark: SparkSession, path: str, key: str, digits: int = 2) -> DataFrame:
    """The file stored under a key as ``pdf_url``."""
    return get_raw(spark, path, key, digits).select(data_url(F.col("content")).alias("pdf_url"))


def get_raw_many(spark: SparkSession, path: str, keys: DataFrame, digits: int = 2) -> DataFrame:
    """The files of a frame of keys ``(file_path)``; only the shards of the keys are read when they are few."""
    wanted = keys.select("file_path").distinct().withColumn("shard", shard_of(F.col("file_path"), digits))
    stored = _stored(spark, path)
    return lookup_join(stored, wanted, ["shard", "file_path"], "inner").select("file_path", "content")
