"""Rows that the micro-batches of a stream leave behind for the ones after them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyfolio.workspace import is_written, remove, written_in

FOLD_AFTER = 100


class Ledger:
    """A written table with a part for each micro-batch, folded into one from time to time.

    A micro-batch that is repeated reads what the ones before it wrote and replaces its own part, so it comes to the same
    result. Parts are folded by the first micro-batch after ``fold_after`` more of them: by then none of these can be repeated.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, fold_after: int = FOLD_AFTER):
        self.spark, self.path, self.schema, self.fold_after = spark, path.rstrip("/"), schema, fold_after

    def _read(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def _numbers(self, kind: str) -> list[int]:
        """Numbers of the finished parts of a kind, ascending."""
        return sorted(int(name) for name in written_in(self.spark, f"{self.path}/{kind}"))

    def before(self, number: int) -> DataFrame:
        """All rows that the micro-batches before this one wrote."""
        folds = [n for n in self._numbers("folded") if n < number]
        after = folds[-1] if folds else -1
        parts = [n for n in self._numbers("parts") if after < n < number]
        return self._read([f"{self.path}/folded/{n}" for n in folds[-1:]] + [f"{self.path}/parts/{n}" for n in parts])

    def part(self, number: int) -> DataFrame | None:
        """What this micro-batch wrote, if it got so far."""
        path = f"{self.path}/parts/{number}"
        return self._read([path]) if is_written(self.spark, path) else None

    def write(self, number: int, rows: DataFrame) -> DataFrame:
        path = f"{self.path}/parts/{number}"
        rows.write.mode("overwrite").parquet(path)
        return self._read([path])

    def fold(self, number: int, rows: DataFrame) -> None:
        """Let ``rows`` stand for all parts before ``number``, once there are enough of them."""
        parts = [n for n in self._numbers("parts") if n < number]
        if len(parts) < self.fold_after:
            return
        rows.write.mode("overwrite").parquet(f"{self.path}/folded/{parts[-1]}")
        for n in parts:
            remove(self.spark, f"{self.path}/parts/{n}")
        for n in self._numbers("folded")[:-1]:
            remove(self.spark, f"{self.path}/folded/{n}")
