"""Binary files from rows of bytes: feeds and captures as other tools write them, one file to a task."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def files_of(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    """Sorted (file, part) rows to files below ``root``; (path, bytes) of each. A name that ends in .gz is compressed."""
    from pyarrow.fs import FileSystem

    store, folder = FileSystem.from_uri(root)
    store.create_dir(folder, recursive=True)
    name, out, raw, size, done = None, None, None, 0, []

    def finish() -> None:
        if out is not None:
            out.close()
            if raw is not out:
                raw.close()
            done.append((f"{root}/{name}", size))

    for batch in batches:
        for file, part in zip(batch.column("file").to_pylist(), batch.column("part").to_pylist(), strict=True):
            if file != name:
                finish()
                name, size, raw = file, 0, store.open_output_stream(f"{folder}/{file}", compression=None)
                out = gzip.open(raw, "wb", compresslevel=1) if file.endswith(".gz") else raw
            out.write(part)
            size += len(part)
    finish()
    yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["path", "bytes"])


def land(parts: DataFrame, root: str) -> int:
    """Write (file, seq, part) as files below ``root``, the parts of each in the order of seq; their bytes in all.

    A file is written whole by one task, from its start if the task runs again.
    """
    dealt = parts.select("file", "seq", "part").repartition("file").sortWithinPartitions("file", "seq").select("file", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return files_of(batches, root)

    return sum(r.bytes for r in dealt.mapInArrow(run, "path string, bytes bigint").collect())
