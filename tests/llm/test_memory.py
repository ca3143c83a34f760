"""What executors and their Python workers hold at once."""

from __future__ import annotations

from types import SimpleNamespace

import pyarrow as pa
import pytest

from keyloom.llm import common

BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_freed_batches_go_back_to_the_system(monkeypatch):
    freed = []
    monkeypatch.setattr(common.pa, "default_memory_pool", lambda: SimpleNamespace(release_unused=lambda: freed.append(1)))
    batch = pa.RecordBatch.from_arrays([pa.array(["a b", None, ""])], ["text"])
    assert [texts for _, texts in common.text_batches(iter([batch, batch.slice(0, 0), batch]), "text")] == [["a b", None, ""]] * 2
    assert len(freed) == 3


@pytest.mark.parametrize("said", [None, str(common.ARROW_BYTES // 2)])
def test_python_tasks_get_small_batches(spark, said):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["rows", "bytes"])

    try:
        if said:
            spark.conf.set(BYTES, said)
        texts = spark.range(0, 6000, 1, 1).selectExpr("id", "repeat('word ', 1000) text")
        seen = common.keep(texts.mapInArrow(sizes, "rows long, bytes long"), "sizes").collect()
        assert spark.conf.get(BYTES, None) == said
    finally:
        spark.conf.unset(BYTES)
    assert sum(r["rows"] for r in seen) == 6000
    assert max(r["bytes"] for r in seen) <= int(said or common.ARROW_BYTES) * 1.5
