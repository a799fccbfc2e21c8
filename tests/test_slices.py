from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from tallyfolio.slices import all_slices, column_slices, slices
from tallyfolio.sources.decoders import decode_with


def test_slices_hold_all_rows_in_order():
    sizes = [0, 5, 400, 3, 3, 90, 0, 0, 1, 2, 100]
    batch = pa.RecordBatch.from_pydict({"n": list(range(11)), "t": ["x" * s for s in sizes], "b": [None if s == 3 else b"y" * s for s in sizes]})
    for most, rows in ((1, 100), (200, 100), (200, 2), (10**6, 4), (10**6, 100)):
        parts = list(slices(batch, most, rows))
        assert [n for part in parts for n in part["n"].to_pylist()] == list(range(11))
        assert all(part.num_rows <= rows for part in parts)
        assert all(part.num_rows == 1 or sum(len(t) + len(b or b"") for t, b in zip(part["t"].to_pylist(), part["b"].to_pylist())) <= most for part in parts)
    assert list(slices(batch.slice(0, 0))) == []
    some = batch.slice(3, 5)        # a slice of a slice
    assert [n for part in all_slices([some, batch.slice(0, 0), some], 4, 3) for n in part["n"].to_pylist()] == [3, 4, 5, 6, 7] * 2
    assert [row for a, b in column_slices([(some["n"], some["t"])], 4) for row in zip(a, b)] == list(zip(some["n"].to_pylist(), some["t"].to_pylist()))


def test_helper_holds_no_batch_of_its_task(spark):
    def own_kilobytes(_: bytes) -> str:
        with open("/proc/self/smaps_rollup") as sizes:
            return next(line.split()[1] for line in sizes if line.startswith("Anonymous:"))

    def largest(size: int) -> int:
        rows = spark.range(0, 1000, 1, 1).select(F.lit("t").alias("route"), F.repeat(F.lit("0123456789"), size).cast("binary").alias("content"))
        kilobytes = rows.select(decode_with(F.col("route"), F.col("content"), {"t": own_kilobytes})["text"].cast("long").alias("n"))
        return kilobytes.agg(F.max("n")).first()[0]

    small = largest(1)
    assert largest(5000) < small + 30_000       # the batch is 50 MB
