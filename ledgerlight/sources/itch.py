"""Order-by-order feed files: framing, decoding and encoding.

A file is framed in one task, as a frame's place depends on all before it; files are read in parallel. What
goes wrong stays in the rows: the last row of a file may be a defect without a message. Decoding is by
Catalyst expressions on the body, so that only the fields that a query reads are computed.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from io import BytesIO
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ledgerlight.functions.wire import big, letters, put_big, put_letters

#: Fixed by the protocol: the length of each message type.
LENGTHS = {
    "S": 12, "R": 39, "H": 25, "Y": 20, "L": 26, "V": 35, "W": 12, "K": 28, "J": 35, "h": 21, "A": 36,
    "F": 40, "E": 31, "C": 36, "X": 23, "D": 19, "U": 35, "P": 44, "Q": 40, "B": 19, "I": 50, "N": 20,
}
#: Fixed by the protocol: for each type, the fields as (name, kind, offset, width) after the common header. Kinds: u number, a text, y yes or no.
FIELDS = {
    "S": (("event_code", "a", 11, 1),),
    "R": (("stock", "a", 11, 8), ("market_category", "a", 19, 1), ("financial_status", "a", 20, 1), ("round_lot", "u", 21, 4), ("round_lots_only", "y", 25, 1), ("issue_class", "a", 26, 1), ("issue_subtype", "a", 27, 2), ("authenticity", "a", 29, 1), ("short_sale_threshold", "a", 30, 1), ("ipo_flag", "a", 31, 1), ("luld_tier", "a", 32, 1), ("etp_flag", "a", 33, 1), ("etp_leverage", "u", 34, 4), ("inverse", "y", 38, 1)),
    "H": (("stock", "a", 11, 8), ("trading_state", "a", 19, 1), ("reason", "a", 21, 4)),
    "A": (("order_ref", "u", 11, 8), ("side", "a", 19, 1), ("shares", "u", 20, 4), ("stock", "a", 24, 8), ("price", "u", 32, 4)),
    "F": (("order_ref", "u", 11, 8), ("side", "a", 19, 1), ("shares", "u", 20, 4), ("stock", "a", 24, 8), ("price", "u", 32, 4), ("attribution", "a", 36, 4)),
    "E": (("order_ref", "u", 11, 8), ("shares", "u", 19, 4), ("match_number", "u", 23, 8)),
    "C": (("order_ref", "u", 11, 8), ("shares", "u", 19, 4), ("match_number", "u", 23, 8), ("printable", "y", 31, 1), ("exec_price", "u", 32, 4)),
    "X": (("order_ref", "u", 11, 8), ("shares", "u", 19, 4)),
    "D": (("order_ref", "u", 11, 8),),
    "U": (("order_ref", "u", 11, 8), ("new_order_ref", "u", 19, 8), ("shares", "u", 27, 4), ("price", "u", 31, 4)),
    "P": (("order_ref", "u", 11, 8), ("side", "a", 19, 1), ("shares", "u", 20, 4), ("stock", "a", 24, 8), ("price", "u", 32, 4), ("match_number", "u", 36, 8)),
    "Q": (("shares", "u", 11, 8), ("stock", "a", 19, 8), ("price", "u", 27, 4), ("match_number", "u", 31, 8), ("cross_type", "a", 39, 1)),
    "B": (("match_number", "u", 11, 8),),
    "I": (("paired_shares", "u", 11, 8), ("imbalance_shares", "u", 19, 8), ("imbalance_dir", "a", 27, 1), ("stock", "a", 28, 8), ("far_price", "u", 36, 4), ("near_price", "u", 40, 4), ("ref_price", "u", 44, 4), ("cross_type", "a", 48, 1), ("variation", "a", 49, 1)),
}
FRAMES = "file string, seq bigint, msg_type string, frame_len int, body binary, defect string"


def frames(stream: BinaryIO, raw: bool = False) -> Iterator[tuple[int, str | None, int, bytes | None, str | None]]:
    """(seq, type, length, body, defect) of each frame.

    With length prefixes the frame is trusted: a length that the type should not have is marked. An empty frame, an unknown type
    without a prefix, or a cut tail end the file. A type beyond ASCII has no name but '?'.
    """
    seq = 0
    while True:
        head = stream.read(1 if raw else 2)
        if not head:
            return
        if not raw and len(head) < 2:
            yield seq, None, len(head), None, "truncated_tail"
            return
        if raw:
            size = LENGTHS.get(chr(head[0]), 0)
            if not size:
                yield seq, chr(head[0]) if head[0] < 128 else "?", 0, None, "unknown_type"
                return
            body = head + stream.read(size - 1)
        else:
            size = struct.unpack(">H", head)[0]
            if not size:
                yield seq, None, 0, None, "framing_error"
                return
            body = stream.read(size)
        if len(body) < size:
            yield seq, None, len(body) + (0 if raw else 2), None, "truncated_tail"
            return
        kind = chr(body[0]) if body[0] < 128 else "?"
        known = LENGTHS.get(kind, 0)
        yield seq, kind, size, body, None if known == size else "length_mismatch" if known else "unknown_type"
        seq += 1


def batches(file: str, stream: BinaryIO, raw: bool, size: int = 8192) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([("file", pa.string()), ("seq", pa.int64()), ("msg_type", pa.string()), ("frame_len", pa.int32()), ("body", pa.binary()), ("defect", pa.string())])
    rows: list[tuple] = []
    for row in frames(stream, raw):
        rows.append((file, *row))
        if len(rows) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def listed(path: str):
    """The store and the files at a path or below it, in order."""
    from pyarrow.fs import FileSelector, FileSystem, FileType

    store, place = FileSystem.from_uri(path if "://" in path else f"file://{path}")
    info = store.get_file_info(place)
    if info.type == FileType.Directory:
        return store, sorted(f.path for f in store.get_file_info(FileSelector(place, recursive=True)) if f.type == FileType.File and not f.base_name.startswith((".", "_")))
    if info.type == FileType.NotFound:
        raise FileNotFoundError(path)
    return store, [place]


class ItchReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.raw = options["path"], options.get("framing", "binaryfile").lower() == "raw"

    def partitions(self):
        return [File(p) for p in listed(self.path)[1]]

    def read(self, partition):
        import gzip

        store, _ = listed(partition.path if "://" in self.path and not self.path.startswith("file:") else self.path)
        with store.open_input_stream(partition.path, compression=None, buffer_size=1 << 20) as stream:
            yield from batches(partition.path, gzip.open(stream) if partition.path.endswith(".gz") else stream, self.raw)


class ItchSource(DataSource):
    """``spark.read.format("itch").option("framing", "binaryfile" | "raw").load(path)``: FRAMES' columns; streams each file, gzip or plain."""

    @classmethod
    def name(cls):
        return "itch"

    def schema(self):
        return FRAMES

    def reader(self, schema):
        return ItchReader(self.options)


def read_frames(spark: SparkSession, path: str, raw: bool = False, whole: bool = False) -> DataFrame:
    """FRAMES' columns of the files at ``path``. ``whole`` reads files below 2 GB through Spark, for stores that only Spark opens."""
    if not whole:
        spark.dataSource.register(ItchSource)
        return spark.read.format("itch").option("framing", "raw" if raw else "binaryfile").load(path)

    def framed(parts):
        for part in parts:
            for file, content in zip(*(c.to_pylist() for c in part.columns), strict=True):
                yield from batches(file, BytesIO(content), raw)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(framed, FRAMES)


def decode(messages: DataFrame) -> DataFrame:
    """Add the header and all fields; a field is null where the type has none or the frame is defective."""
    body, kind, out = F.col("body"), F.col("msg_type"), {}
    sound = F.col("body").isNotNull() & F.col("defect").isNull()
    out["locate"] = F.when(sound, big(body, 1, 2)).cast("int")
    out["ts_ns"] = F.when(sound, big(body, 5, 6))
    read = {"u": big, "a": letters, "y": lambda b, o, w: letters(b, o, w) == "Y"}
    places: dict[str, dict[tuple, list[str]]] = {}
    for name, fields in FIELDS.items():
        for field, *place in fields:
            places.setdefault(field, {}).setdefault(tuple(place), []).append(name)
    for field, variants in places.items():
        value: Column | None = None
        for (how, offset, width), names in variants.items():
            test, found = sound & kind.isin(*names), read[how](body, offset, width)
            value = F.when(test, found) if value is None else value.when(test, found)
        out[field] = value
    out["side"] = F.when(out["side"].isNotNull(), F.when(out["side"] == "B", "B").otherwise("S"))
    return messages.withColumns(out)


def parse_stats(messages: DataFrame) -> DataFrame:
    """One row for each file: messages, bytes, defects by kind."""
    n = F.col("body").isNotNull()
    count = lambda test: F.coalesce(F.sum(F.when(test, 1).otherwise(0)), F.lit(0)).cast("bigint")
    stops = F.col("defect").isin("framing_error") | ((F.col("defect") == "unknown_type") & ~n)
    return messages.groupBy("file").agg(
        count(n).alias("messages"),
        F.coalesce(F.sum(F.when(n, F.col("frame_len").cast("bigint"))), F.lit(0)).alias("bytes"),
        count(F.col("defect") == "unknown_type").alias("unknown_type"),
        count(stops).alias("framing_errors"),
        count(F.col("defect") == "length_mismatch").alias("length_mismatch"),
        F.coalesce(F.sum(F.when(F.col("defect") == "truncated_tail", F.col("frame_len").cast("bigint"))), F.lit(0)).alias("truncated_tail"),
    )


def encode(kind: str, values: dict[str, Column], prefix: bool = True) -> Column:
    """A message of ``kind`` as bytes: ``locate``, ``ts_ns`` and the type's fields; what isn't given is zero or blank."""
    parts, at = [F.lit(kind).cast("binary"), put_big(values.get("locate", F.lit(0)), 2), put_big(values.get("tracking", F.lit(0)), 2), put_big(values.get("ts_ns", F.lit(0)), 6)], 11
    for name, how, offset, width in FIELDS.get(kind, ()):  # of some kinds only the header is read
        if offset > at:
            parts.append(F.lit(b" " * (offset - at)))
        if how == "u":
            parts.append(put_big(values.get(name, F.lit(0)), width))
        elif how == "y":
            parts.append(put_letters(F.when(values.get(name, F.lit(False)), "Y").otherwise("N"), width))
        else:
            parts.append(put_letters(values.get(name, F.lit("")), width))
        at = offset + width
    size = LENGTHS[kind]
    if size > at:
        parts.append(F.lit(b"\0" * (size - at)))
    head = [F.lit(struct.pack(">H", size))] if prefix else []
    return F.concat(*head, *parts)
