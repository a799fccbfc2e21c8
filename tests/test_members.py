from __future__ import annotations

import pyarrow as pa

from tallyfolio.sources import archives


def test_members_leave_in_small_batches():
    held = archives._Held(pa.RecordBatch.from_pydict({"id": [7, None]}), ["id"])
    out = [batch for i in range(9) for batch in held.add(i % 2, "a", i, f"m{i}", b"x" * (3 << 20), None)] + list(held.out())
    assert [row for batch in out for row in zip(batch["id"].to_pylist(), batch["member"].to_pylist())] == [(None if i % 2 else 7, i) for i in range(9)]
    assert max(batch["content"].nbytes for batch in out) <= archives.CHUNK + 1000 and not list(held.out())
