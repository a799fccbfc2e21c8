"""Shared working folder, size-checked broadcasts and the spread of small inputs."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)      # tables of the innermost scratch
_switched: list[str] = []       # what the setting was, once for each scratch that is open
_switch = threading.Lock()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir`` of the session.

    Where it is unset a local session gets a temporary folder; a cluster session is refused, because
    a folder of one machine would be lost with that machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))
    return spark.sparkContext.getCheckpointDir()


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/tallyfolio/{label}-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, path: str):
    """File system and path as Spark itself reaches them."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` has been finished."""
    system, place = _hadoop(spark, f"{path}/_SUCCESS")
    return system.exists(place)


def written_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder whose write has been finished."""
    system, place = _hadoop(spark, f"{path}/*/_SUCCESS")
    return sorted(found.getPath().getParent().getName() for found in system.globStatus(place) or [])


def folders_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, finished or not."""
    system, place = _hadoop(spark, f"{path}/*")
    return sorted(found.getPath().getName() for found in system.globStatus(place) or [] if found.isDirectory())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written folder; first its mark, so that nobody takes the rest for whole."""
    system, place = _hadoop(spark, path)
    system.delete(_hadoop(spark, f"{path}/_SUCCESS")[1], False)
    system.delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialized inside are removed at the end; shuffle files go as soon as the query that made them is done.

    For work that writes down what it comes to: no frame made inside may be read after it. While any scratch is open, the
    setting holds for the session; it changes no result, and a frame that is evaluated again makes its shuffle files anew.
    """
    with _switch:
        _switched.append(spark.conf.get(SHUFFLE_CLEANUP, "false") if not _switched else _switched[0])
        spark.conf.set(SHUFFLE_CLEANUP, "true")
    token = _made.set([])
    try:
        yield
    finally:
        paths = _made.get()
        _made.reset(token)
        with _switch:
            before = _switched.pop()
            if not _switched:
                spark.conf.set(SHUFFLE_CLEANUP, before)
        for path in paths:
            remove(spark, path)


def written(df: DataFrame, path: str) -> DataFrame:
    """``df``, written to a new folder and read back."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a second evaluation would repeat a model call or a decode. The written table, unlike
    cached blocks, survives the loss of an executor.
    """
    path = new_folder(df.sparkSession, label)
    if (made := _made.get()) is not None:
        made.append(path)
    return written(df, path)


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True when ``df`` is counted to hold at most ``max_rows`` rows and ``max_bytes`` bytes.

    The rows are counted first (from file footers where ``df`` is a written table); their bytes are added up
    only if there are few. Write an expensive ``df`` down before probing it.
    """
    rows = df.count()
    if not 0 < rows <= max_rows:
        return rows == 0
    width = F.octet_length(F.to_json(F.struct("*")))
    return (df.agg(F.sum(width).alias("b")).first().b or 0) <= max_bytes


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of ``df``; used to choose a strategy, never to prove a bound."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def lookup_join(wide: DataFrame, narrow: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join wide rows with a narrow side that is unique in ``on``.

    A narrow side that a probe shows to be small is broadcast and the wide rows stay where they are. Beyond
    that Spark chooses: a forced hash table could not spill if the narrow side carries texts.
    """
    side = F.broadcast(narrow) if fits_broadcast(narrow) else narrow
    return wide.join(side, on, how)


def salted_join(big: DataFrame, small: DataFrame, on: list[str], salt_on: list[str],
                salts: int = 32, how: str = "left") -> DataFrame:
    """Equi-join that splits every key of ``big`` over ``salts`` tasks.

    The salt is a hash of ``salt_on`` (not a random number), so a retried task sends each row to the
    same place. ``small`` is repeated ``salts`` times; each row of ``big`` still meets one copy.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*salt_on), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def spread_small(df: DataFrame, key: str) -> DataFrame:
    """Spread an input that has fewer file splits than the cluster has cores.

    A small file (one row group) would run CPU-heavy column work in one task. The shuffle is added
    only while the input is below one regular split per core, so a large table is never reshuffled.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if estimated_bytes(df) >= cores * (128 << 20):
        return df
    return df.repartition(cores, key)
