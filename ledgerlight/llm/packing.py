"""Packing token sequences into windows by minimum bin slack.

A document's ids (its tokens and an end id) are cut into full windows and a rest. The rests are
packed by their lengths alone: the longest length left opens a window, a bitset subset-sum over the multiset of
remaining lengths finds the fill closest to capacity, back-tracked to counts of each length, and the
fill is used as often as those counts allow. A length runs out with nearly every fill, so the plan is found in
about as many steps as there are lengths, whatever the number of documents. Only the histogram of lengths
(at most ``capacity`` rows) and the plan (a few rows for each length) pass through the driver; ranks within a
length, dealt out over salted parts, match documents to places.

Defined cases: a null or empty text has the end id alone; a text of any length is cut into as many windows as it fills;
repeated rows are packed each; equal rows may swap places, which changes nothing; pieces of equal length tie and are ranked by a
hash of their document; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.cluster import Workspace, running_total
from ledgerlight.llm.tokens import word_ids, word_tokenizer_path

CAPACITY = 4096
END = 2
#: Bytes of ids in a batch that leaves a Python worker.
BATCH = 4 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut(batches: Iterator[pa.RecordBatch], path: str, end: int, capacity: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to pieces of at most ``capacity`` ids, in batches of about ``BATCH`` bytes of ids."""
    known, last = word_ids(path), np.array([end], "<u4").tobytes()
    rows: list[tuple] = []
    held = 0

    def flush() -> pa.RecordBatch:
        nonlocal rows, held
        columns, rows, held = list(zip(*rows, strict=True)), [], 0
        arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(columns[5], pa.binary())] * with_ids
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(arrays)])

    for batch in batches:
        texts = batch.column(1)
        for i, doc in enumerate(batch.column(0).to_pylist()):
            ids = known.encode(texts[i].as_py()) + last
            n = len(ids) // 4
            for start in range(0, n, capacity):
                piece = ids[4 * start : 4 * (start + capacity)]
                rows.append((doc, start, len(piece) // 4, zlib.crc32(piece), n, piece if with_ids else None))
            held += len(ids)
            if held >= BATCH:
                yield flush()
    if rows:
        yield flush()


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, within ``counts``, whose sum is the largest up to ``room``.

    Bit ``s`` of ``sums`` says that some multiset of the lengths taken so far adds up to ``s``.
    """
    sums, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left and not sums >> room & 1:  # counts as sums of powers of two and a rest
            take = min(part, left)
            steps.append((length, take, sums))
            sums |= sums << length * take & mask
            left, part = left - take, 2 * part
        if sums >> room & 1:
            break
    total, fill = sums.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            fill[length] = fill.get(length, 0) + take
    return fill


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go: (length, first rank, ranks, in each window, first window, offset)."""
    left, used, places, window = dict(counts), dict.fromkeys(counts, 0), [], 0
    while left:
        longest = max(left)
        rest = left | {longest: left[longest] - 1}
        fill = best_fill({k: n for k, n in rest.items() if n}, capacity - longest)
        fill[longest] = fill.get(longest, 0) + 1
        times, offset = min(left[k] // n for k, n in fill.items()), 0
        for length, n in sorted(fill.items(), reverse=True):
            places.append((length, used[length], n * times, n, window, offset))
            used[length] += n * times
            left[length] -= n * times
            offset += n * length
            if not left[length]:
                del left[length]
        window += times
    return places


PLACES = "length long, places array<struct<first:long,each:long,window:long,offset:long>>"


def placed(ranked: DataFrame, places: list[tuple[int, int, int, int, int, int]]) -> DataFrame:
    """The rank within a length to ``sequence_id`` and ``offset``, by the plan, whose rows are a few for each length."""
    by_length: dict[int, list[tuple[int, int, int, int]]] = {}
    for length, first, _, each, window, offset in sorted(places):
        by_length.setdefault(length, []).append((first, each, window, offset))
    lookup = F.broadcast(ranked.sparkSession.createDataFrame(list(by_length.items()), PLACES))
    found = ranked.join(lookup, "length").withColumn("at", F.element_at(F.filter("places", lambda p: p["first"] <= F.col("rank")), -1)).drop("places")
    nth = F.col("rank") - F.col("at.first")
    sequence = F.col("at.window") + F.call_function("div", nth, F.col("at.each"))
    return found.withColumns({"sequence_id": sequence, "offset": F.col("at.offset") + nth % F.col("at.each") * F.col("length")}).drop("at", "rank")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, little-endian)."""
    work = Workspace(docs.sparkSession, "packing")
    schema = PIECES + ", ids binary" * with_ids
    cutter = partial(cut, path=tokenizer or word_tokenizer_path(), end=end, capacity=capacity, with_ids=with_ids)
    pieces = work.table(docs.select("doc_id", "text").mapInArrow(cutter, schema), "pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    ranked = running_total(pieces.withColumn("one", F.lit(1).cast("long")), ["length"], "one", [F.xxhash64("doc_id", "start"), F.col("doc_id"), F.col("start")], "rank")
    columns = [c.split()[0] for c in schema.split(", ")]
    return placed(ranked.select(*columns, "rank"), plan(counts, capacity)).select(*columns, "sequence_id", "offset")


def op10_pack(spark, sf_dir: str) -> DataFrame:
    """All documents, packed into windows of 4096 ids."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
