"""Token ids in training order: fixed-stride binary shards.

Texts become ids and an end id, and the ids of a task's documents, one after the other, are cut into sequences of
``length`` ids; only a task's last one may be shorter. The sequences are written once to the shared folder, numbered
by task and row, and the counts of the tasks turn that into numbers from 0 to n - 1. A keyed Feistel network permutes the
numbers: it is a bijection on the next power of two, and whatever falls outside is sent through again until it falls
inside (cycle-walking). The permuted number is the sequence's slot. Slots are dealt by ranges to shards, one a
task. A record is at ``row * stride`` of its shard, so a reader may start at any slot and needs
nothing but the last slot it read.

A task that writes a shard, first or again, writes a file of its own in a folder of attempts. Spark keeps the rows of one attempt for each
task, and those name the file; so the kept files, and no others, are then moved to their places. A move that was already made is
passed over, so that step may be repeated too. The manifest comes last, and the folder of attempts goes.

``order="input"`` takes the documents as the tasks read them: the same input, settings and cluster give the same order. ``order="data"``
first deals the documents by a hash of doc_id and text to parts whose number comes from the size of the texts, and sorts
them there, so that the order depends on the documents alone; that is one more exchange, of all texts.

A record is its ids, little-endian, filled up by zeros. Which documents a sequence holds is in the table that comes with the shards: ``docs``, a
list of (doc_id, start in the document's ids, length).

Defined cases: a null or empty text is the end id alone; a text longer than a sequence goes on in the next; repeated rows come each, and
rows that tie in the order are equal; an empty table writes no shard; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.cluster import Workspace
from ledgerlight.llm.tokens import word_ids, word_tokenizer_path

LENGTH, END, KEY = 2048, 2, 20240229
SHARD_BYTES = 64 << 20
ROUNDS = 6
#: Characters of the texts in a part of ``order="data"``, about.
PART_CHARS = 64 << 20
ATTEMPTS = "_attempts"


def scramble(x: np.ndarray, key: int, bits: int) -> np.ndarray:
    """The Feistel network on numbers of ``bits`` bits, two at least: halves may differ by one bit and swap each round."""
    left, right = bits // 2, bits - bits // 2
    keys = np.random.default_rng(key).integers(1, 1 << 62, ROUNDS, dtype=np.uint64)
    for k in keys:
        high, low = x >> np.uint64(right), x & np.uint64((1 << right) - 1)
        f = (low + k) * np.uint64(0x9E3779B97F4A7C15)
        f ^= f >> np.uint64(29)
        f *= k | np.uint64(1)
        f ^= f >> np.uint64(32)
        high ^= f & np.uint64((1 << left) - 1)
        x, left, right = low << np.uint64(left) | high, right, left
    return x


def slots(number: np.ndarray, n: int, key: int) -> np.ndarray:
    """A permutation of 0 to n - 1, at these numbers."""
    bits = max(2, (n - 1).bit_length())
    out = scramble(number.astype(np.uint64), key, bits)
    outside = np.flatnonzero(out >= n)
    while len(outside):
        out[outside] = scramble(out[outside], key, bits)
        outside = outside[out[outside] >= n]
    return out.astype(np.int64)


@dataclass
class Manifest:
    root: str
    sequences: int
    length: int
    width: int
    key: int
    rows: int

    @property
    def stride(self) -> int:
        return self.length * self.width

    @property
    def shards(self) -> int:
        return -(-self.sequences // self.rows)

    def path(self, shard: int) -> str:
        return f"{self.root}/shard-{shard:06d}.bin"


PLACES = pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32())]))
SEQUENCES = "length int, docs array<struct<doc_id:bigint,start:bigint,length:int>>, ids binary"


def sequences(batches: Iterator[pa.RecordBatch], path: str, end: int, length: int, width: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to numbered sequences, their ids compressed until they are written."""
    from zstandard import ZstdCompressor

    known, last, task, number = word_ids(path, width), end.to_bytes(width, "little"), TaskContext.get().partitionId(), 0
    squeeze = ZstdCompressor(level=2).compress
    size, parts, places, have = length * width, [], [], 0
    rows: list[tuple[int, list, bytes]] = []

    def flush() -> pa.RecordBatch:
        nonlocal number, rows
        out, n, rows = rows, len(rows), []
        number += n
        columns = [pa.array(np.full(n, task, np.int32)), pa.array(np.arange(number - n, number)), pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], PLACES), pa.array([r[2] for r in out], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["task", "row", "length", "docs", "ids"])

    for batch in batches:
        texts = batch.column(1)
        for i, doc in enumerate(batch.column(0).to_pylist()):
            ids, at = known.encode(texts[i].as_py()) + last, 0
            while at < len(ids):
                part = ids[at : at + size - have]
                parts.append(part)
                places.append({"doc_id": doc, "start": at // width, "length": len(part) // width})
                at, have = at + len(part), have + len(part)
                if have == size:
                    rows.append((length, places, squeeze(b"".join(parts))))
                    parts, places, have = [], [], 0
            if len(rows) >= 256:
                yield flush()
    if have:
        rows.append((have // width, places, squeeze(b"".join(parts))))
    if rows:
        yield flush()


def slotted(batches: Iterator[pa.RecordBatch], first: dict[int, int], n: int, key: int) -> Iterator[pa.RecordBatch]:
    tasks = np.array(sorted(first), np.int64)
    offsets = np.array([first[t] for t in tasks], np.int64)
    for batch in batches:
        task, row = (batch.column(i).to_numpy() for i in (0, 1))
        number = offsets[np.searchsorted(tasks, task)] + row if batch.num_rows else row
        yield pa.RecordBatch.from_arrays([pa.array(slots(number, n, key)), *batch.columns[2:]], names=["slot", *batch.schema.names[2:]])


WRITTEN = "slot long, shard int, row long, length int, docs array<struct<doc_id:bigint,start:bigint,length:int>>, record_crc32 long"


def write(batches: Iterator[pa.RecordBatch], m: Manifest) -> Iterator[pa.RecordBatch]:
    """Sorted sequences to a file of this attempt for each shard; a row for each record, with the attempt."""
    from pyarrow.fs import FileSystem
    from zstandard import ZstdDecompressor

    store, folder = FileSystem.from_uri(m.root)
    store.create_dir(f"{folder}/{ATTEMPTS}", recursive=True)
    whole = ZstdDecompressor().decompress
    attempt, shard, out = TaskContext.get().taskAttemptId(), None, None
    try:
        for batch in batches:
            slot, ids = batch.column("slot").to_numpy(), batch.column("ids")
            at, sums = slot // m.rows, []
            for i in range(batch.num_rows):
                if at[i] != shard:
                    if out is not None:
                        out.close()
                    shard = int(at[i])
                    out = store.open_output_stream(f"{folder}/{ATTEMPTS}/{shard:06d}.{attempt}")
                record = whole(ids[i].as_py()).ljust(m.stride, b"\0")
                out.write(record)
                sums.append(crc32(record))
            arrays = [pa.array(slot), pa.array(at.astype(np.int32)), pa.array(slot % m.rows), batch.column("length"), batch.column("docs"), pa.array(sums, pa.int64()), pa.array(np.full(len(slot), attempt))]
            yield pa.RecordBatch.from_arrays(arrays, names=["slot", "shard", "row", "length", "docs", "record_crc32", "attempt"])
    finally:
        if out is not None:
            out.close()


def settled(batches: Iterator[pa.RecordBatch], m: Manifest) -> Iterator[pa.RecordBatch]:
    """Move the kept attempt of each (shard, attempt, records) to its place; a place that is already filled whole stays."""
    from pyarrow.fs import FileSystem, FileType

    store, folder = FileSystem.from_uri(m.root)
    for batch in batches:
        for shard, attempt, records in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            place, size = f"{folder}/shard-{shard:06d}.bin", records * m.stride
            if store.get_file_info(place).size != size:
                try:
                    store.move(f"{folder}/{ATTEMPTS}/{shard:06d}.{attempt}", place)
                except OSError:
                    if store.get_file_info(place).type != FileType.File:  # else a task beside this one has moved it
                        raise
            if store.get_file_info(place).size != size:
                raise OSError(f"{place} doesn't hold {records} records")
        yield batch.select([0])


def by_data(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in an order that depends on them alone: each part is a task, sorted by the hash that dealt it."""
    named = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("hash"), F.xxhash64(F.lit(1), "doc_id", "text").alias("again"))
    chars = named.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    parts = 1 << max(0, (chars // PART_CHARS).bit_length())
    part = F.pmod(F.col("hash"), F.lit(parts)).cast("int")
    return named.repartitionById(parts, part).sortWithinPartitions("hash", "again", "doc_id").select("doc_id", "text")


def materialise(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end: int = END, key: int = KEY, width: int = 2, root: str | None = None, shard_bytes: int = SHARD_BYTES, order: str = "input") -> tuple[Manifest, DataFrame]:
    """Write the shards under ``root`` (the shared folder by default). The table has a row per sequence: WRITTEN's columns."""
    if order not in ("input", "data"):
        raise ValueError("the order is by input or by data")
    spark = docs.sparkSession
    work = Workspace(spark, "shards")
    cutter = partial(sequences, path=tokenizer or word_tokenizer_path(), end=end, length=length, width=width)
    source = by_data(docs) if order == "data" else docs.select("doc_id", "text")
    staged = work.table(source.mapInArrow(cutter, f"task int, row long, {SEQUENCES}"), "sequences")
    counts = sorted((r.task, r.n) for r in staged.groupBy("task").agg(F.count("*").alias("n")).collect())
    n, first = 0, {}
    for task, rows in counts:
        first[task] = n
        n += rows
    m = Manifest(root or f"{work.root}/files", n, length, width, key, max(1, shard_bytes // (length * width)))
    placed = staged.mapInArrow(partial(slotted, first=first, n=n, key=key), f"slot long, {SEQUENCES}")
    shard = F.call_function("div", F.col("slot"), F.lit(m.rows)).cast("int")
    dealt = placed.repartitionById(max(1, m.shards), shard).sortWithinPartitions("slot")
    written = work.table(dealt.mapInArrow(partial(write, m=m), f"{WRITTEN}, attempt long"), "written")
    kept = written.groupBy("shard", "attempt").agg(F.count("*").alias("records"))
    moved = kept.mapInArrow(partial(settled, m=m), "shard int").agg(F.count("*").alias("n")).first().n
    if moved != m.shards:
        raise RuntimeError(f"{moved} of {m.shards} shards are in place")
    path = work._path(f"{m.root}/manifest.json")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = store.create(path, True)
    stream.write(bytearray(json.dumps(asdict(m)).encode()))
    stream.close()
    store.delete(work._path(f"{m.root}/{ATTEMPTS}"), True)
    return m, written.drop("attempt")


def read(m: Manifest, slot: int = 0, count: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, ids) in training order from ``slot`` on, seeking to it; a shard is read as a stream."""
    from pyarrow.fs import FileSystem

    store, folder = FileSystem.from_uri(m.root)
    stop = m.sequences if count is None else min(m.sequences, slot + count)
    while slot < stop:
        shard, row = divmod(slot, m.rows)
        with store.open_input_file(f"{folder}/shard-{shard:06d}.bin") as file:
            file.seek(row * m.stride)
            for slot in range(slot, min(stop, (shard + 1) * m.rows)):
                yield slot, np.frombuffer(file.read(m.stride), f"<u{m.width}")
        slot += 1


def op5_shards(spark, sf_dir: str) -> DataFrame:
    """All documents as sequences of 2048 ids, written in training order; a row per record."""
    return materialise(spark.read.parquet(f"{sf_dir}/documents.parquet"))[1]
