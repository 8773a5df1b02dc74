"""Labelled rows for fitting: a bounded sample of them, with the features of their whole texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.features import blocks, indicators

#: Labelled rows to fit on, at most; those of the least hashes of doc_id, so that reruns agree.
MAX_ROWS = 8_000
FOLDS, HELD = 4, 2


def held_out(doc_id: Column) -> Column:
    """Whether a row's label is for testing alone; a null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def featured(batches: Iterator[pa.RecordBatch], heads: bool) -> Iterator[pa.RecordBatch]:
    """(doc_id, label, text) to (doc_id, label, sorted features as bytes)."""
    for batch in batches:
        found: list[bytes] = []
        for _, texts in blocks(batch.column(2)):
            row, feature = indicators(texts, heads=heads)
            ends = np.searchsorted(row, np.arange(1, len(texts)))
            found += [part.tobytes() for part in np.split(feature, ends)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["doc_id", "label", "features"])


def training(docs: DataFrame, labels: DataFrame, label: str, max_rows: int = MAX_ROWS, heads: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
    """Labels and features of at most ``max_rows`` labelled documents that aren't held out, in the order of doc_id.

    Rows without doc_id or label are left out; of rows that repeat a doc_id one counts.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")
    got = rows.mapInArrow(partial(featured, heads=heads), "doc_id long, label int, features binary").toArrow()
    doc, label, found = got.column(0).to_pylist(), got.column(1).to_pylist(), got.column(2)
    seen, y, x = set(), [], []
    for i in sorted(range(len(doc)), key=lambda i: (doc[i], label[i], found[i].as_py())):
        if doc[i] not in seen:
            seen.add(doc[i])
            y.append(label[i])
            x.append(np.frombuffer(found[i].as_buffer(), np.uint32))
    return np.array(y, np.int64), x


def vocabulary(x: list[np.ndarray], least: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Features in at least ``least`` rows, and each row as places in them."""
    kept = frequent(x, least)
    out = []
    for row in x:
        at = np.minimum(np.searchsorted(kept, row), max(0, len(kept) - 1)).astype(np.int32)
        out.append(at[kept[at] == row] if len(kept) else at[:0])
    return kept, out


def frequent(x: list[np.ndarray], least: int) -> np.ndarray:
    """The features in at least ``least`` rows, counted in sixteen ranges, so that few are in memory at once."""
    found, step = [], 1 << 28
    for low in range(0, 1 << 32, step):
        part = [row[np.searchsorted(row, np.uint32(low)) : np.searchsorted(row, np.uint32(low + step - 1), "right")] for row in x]
        every, count = np.unique(np.concatenate(part) if part else np.zeros(0, np.uint32), return_counts=True)
        found.append(every[count >= least])
    return np.concatenate(found)
