"""Shards whose tasks run again, and an order that depends on the documents alone."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from zstandard import ZstdCompressor

from ledgerlight.llm import shards


def batch(m, slots):
    rows = [np.full(m.length, s, "<u2").tobytes() for s in slots]
    names = ["slot", "length", "docs", "ids"]
    return pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array([m.length] * len(slots), pa.int32()), pa.array([[]] * len(slots), shards.PLACES), pa.array([ZstdCompressor().compress(r) for r in rows], pa.binary())], names=names)


def attempt(monkeypatch, number):
    monkeypatch.setattr(shards, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(taskAttemptId=lambda: number)))


def test_a_task_may_be_lost_and_run_again_at_any_step(tmp_path, monkeypatch):
    m = shards.Manifest(f"file://{tmp_path}", 5, 4, 2, 1, 3)
    attempt(monkeypatch, 7)
    lost = shards.write(iter([batch(m, [0]), batch(m, [1, 2])]), m)
    next(lost)
    lost.close()  # the executor goes in the middle of a shard
    attempt(monkeypatch, 8)
    kept = [r for b in shards.write(iter([batch(m, [0, 1, 2, 3, 4])]), m) for r in b.to_pylist()]
    attempt(monkeypatch, 9)
    list(shards.write(iter([batch(m, [0, 1, 2, 3, 4])]), m))  # a second copy of the task, not kept
    assert [(r["slot"], r["shard"], r["row"], r["attempt"]) for r in kept] == [(0, 0, 0, 8), (1, 0, 1, 8), (2, 0, 2, 8), (3, 1, 0, 8), (4, 1, 1, 8)]
    moves = pa.record_batch({"shard": [0, 1], "attempt": [8, 8], "records": [3, 2]})
    for _ in range(2):  # the step that settles them is repeated
        assert [b.to_pydict() for b in shards.settled(iter([moves]), m)] == [{"shard": [0, 1]}]
    assert [(s, ids.tolist()) for s, ids in shards.read(m)] == [(s, [s] * 4) for s in range(5)]
    with pytest.raises(OSError):
        list(shards.settled(iter([pa.record_batch({"shard": [2], "attempt": [8], "records": [1]})]), m))


def test_an_order_by_data_does_not_depend_on_the_split(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "PART_CHARS", 1 << 14)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = []
    for k, split in enumerate((docs.coalesce(1), docs.repartition(5, "lang"))):
        m, table = shards.materialise(split, root=f"file://{tmp_path}/{k}", length=256, shard_bytes=1 << 16, order="data")
        found.append((m.sequences, [ids.tobytes() for _, ids in shards.read(m)], sorted((r.slot, str(r.docs)) for r in table.select("slot", "docs").collect())))
        assert m.shards > 1 and sorted(p.name for p in (tmp_path / str(k)).iterdir() if not p.name.startswith(".")) == ["manifest.json", *(f"shard-{i:06d}.bin" for i in range(m.shards))]
    assert found[0] == found[1]
