"""Aggregated-depth captures: containers, packets, transport segments and messages.

A capture is read in one task as a stream; captures are read in parallel. Packets become rows, defects included;
segments and messages are exploded from them, and everything after that is Catalyst.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from io import BytesIO
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.window import Window

from ledgerlight.functions.wire import letters, little
from ledgerlight.sources.itch import File, listed

ETHERNET, RAW_IP, LINUX_SLL = 1, 101, 113
PROTOCOL = 0x8004
#: Fixed by the protocol: the length of each message type.
LENGTHS = {"S": 10, "D": 31, "H": 22, "I": 18, "O": 18, "P": 19, "E": 18, "8": 30, "5": 30, "T": 38, "X": 26, "B": 38, "A": 80}
LARGEST_BLOCK = 1 << 24
HEADER = 40
PACKETS = "file string, packet_no bigint, capture_ns bigint, linktype int, status string, truncated boolean, caplen int, payload binary"


def udp_payload(data: bytes, link: int) -> tuple[str, bytes | None]:
    """(status, payload) of a captured frame: ok, non_ip or non_udp."""
    at = 0
    if link == ETHERNET:
        if len(data) < 14:
            return "non_ip", None
        kind, at = int.from_bytes(data[12:14], "big"), 14
        while kind in (0x8100, 0x88A8) and at + 4 <= len(data):
            kind, at = int.from_bytes(data[at + 2 : at + 4], "big"), at + 4
        if kind != 0x0800:
            return "non_ip", None
    elif link == LINUX_SLL:
        if len(data) < 16 or data[14:16] != b"\x08\x00":
            return "non_ip", None
        at = 16
    if at + 20 > len(data) or data[at] >> 4 != 4:
        return "non_ip", None
    head = (data[at] & 15) * 4
    if head < 20 or at + head > len(data):
        return "non_ip", None
    if data[at + 9] != 17:
        return "non_udp", None
    at += head
    if at + 8 > len(data):
        return "non_udp", None
    size = int.from_bytes(data[at + 4 : at + 6], "big") - 8
    return "ok", data[at + 8 : at + 8 + max(0, size)]


class CaptureError(ValueError):
    """The stream is no capture that can be read."""


def packets(stream: BinaryIO) -> Iterator[tuple[int, int, str, bool, int, bytes | None]]:
    """(capture_ns, linktype, status, truncated, captured bytes, payload); status bad_block or skipped_block for other blocks."""
    magic = stream.read(4)
    if len(magic) < 4:
        raise CaptureError("the stream ends before a capture header")
    if magic == b"\x0a\x0d\x0d\x0a":
        yield from blocks(stream)
        return
    kinds = {b"\xd4\xc3\xb2\xa1": ("<", 1000), b"\xa1\xb2\xc3\xd4": (">", 1000), b"\x4d\x3c\xb2\xa1": ("<", 1), b"\xa1\xb2\x3c\x4d": (">", 1)}
    if magic not in kinds:
        raise CaptureError(f"no capture begins with {magic.hex()}")
    order, unit = kinds[magic]
    head = stream.read(20)
    if len(head) < 20:
        raise CaptureError("the capture header is cut")
    link = checked(struct.unpack(order + "I", head[16:])[0])
    while len(head := stream.read(16)) == 16:
        seconds, part, kept, whole = struct.unpack(order + "IIII", head)
        data = stream.read(kept)
        if len(data) < kept:
            return
        yield seconds * 1_000_000_000 + part * unit, link, *packet(data, link, whole > kept)


def packet(data: bytes, link: int, cut: bool) -> tuple[str, bool, int, bytes | None]:
    status, payload = udp_payload(data, link)
    return status, cut, len(data), payload


def checked(link: int) -> int:
    if link not in (ETHERNET, RAW_IP, LINUX_SLL):
        raise CaptureError(f"link type {link} is not supported")
    return link


def resolution(options: bytes, order: str, otherwise: int) -> int:
    """Ticks per second from an interface's options; 0 stands for whole ticks being nanoseconds."""
    at, out = 0, otherwise
    while at + 4 <= len(options):
        code, size = struct.unpack_from(order + "HH", options, at)
        at += 4
        if code == 0 or at + size > len(options):
            break
        if code == 9 and size:
            power = options[at] & 0x7F
            out = 2**power & (1 << 64) - 1 if options[at] & 0x80 else 10 ** min(power, 18)
        at += size + 3 & ~3
    return out


def blocks(stream: BinaryIO) -> Iterator[tuple[int, int, str, bool, int, bytes | None]]:
    """The packets of a block capture whose first block type is already read."""
    order, ticks, link, pending = "<", 1_000_000, None, b"\x0a\x0d\x0d\x0a"
    while True:
        kind = pending or stream.read(4)
        pending = b""
        if len(kind) < 4:
            if link is None:
                raise CaptureError("the capture ends before an interface")
            return
        size = stream.read(4)
        if kind == b"\x0a\x0d\x0d\x0a":
            mark = stream.read(4)
            if mark not in (b"\x4d\x3c\x2b\x1a", b"\x1a\x2b\x3c\x4d"):
                if link is None:
                    raise CaptureError(f"byte-order mark {mark.hex()}")
                return
            order = "<" if mark == b"\x4d\x3c\x2b\x1a" else ">"
            length = struct.unpack(order + "I", size)[0]
            if not 28 <= length <= LARGEST_BLOCK or len(stream.read(length - 12)) < length - 12:
                if link is None:
                    raise CaptureError("the section header is cut or too long")
                return
            link = None
            continue
        if len(size) < 4:
            return
        number, length = struct.unpack(order + "I", kind)[0], struct.unpack(order + "I", size)[0]
        if not 12 <= length <= LARGEST_BLOCK or number == 1 and length < 20:
            if link is None:
                raise CaptureError("a block length can't be right")
            yield 0, link, "bad_block", False, 0, None
            return
        body = stream.read(length - 8)
        if len(body) < length - 8:
            if link is None:
                raise CaptureError("the capture ends inside a block")
            return
        if number == 1:
            found = struct.unpack_from(order + "H", body)[0]
            link = checked(found) if link is None else found
            ticks = resolution(body[8:-4], order, ticks)
        elif link is None:
            continue
        elif number == 6:
            high, low, kept, whole = struct.unpack_from(order + "IIII", body, 4) if len(body) >= 24 else (0, 0, length, 0)
            if 28 + kept > length:
                yield 0, link, "bad_block", False, 0, None
                continue
            time = high << 32 | low
            yield time if not ticks else time // ticks * 1_000_000_000 + time % ticks * (1_000_000_000 // ticks), link, *packet(body[20 : 20 + kept], link, whole > kept)
        else:
            yield 0, link, "skipped_block", False, 0, None


def batches(file: str, stream: BinaryIO, most: int = 0, size: int = 4096) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([("file", pa.string()), ("packet_no", pa.int64()), ("capture_ns", pa.int64()), ("linktype", pa.int32()), ("status", pa.string()), ("truncated", pa.bool_()), ("caplen", pa.int32()), ("payload", pa.binary())])
    rows: list[tuple] = []
    number = 0
    for row in packets(stream):
        if not row[2].endswith("_block"):
            number += 1
            if most and number > most:
                break
        rows.append((file, number, *row))
        if len(rows) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)


class CaptureReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.most = options["path"], int(options.get("max_packets", 0))

    def partitions(self):
        return [File(p) for p in listed(self.path)[1]]

    def read(self, partition):
        import gzip

        store, _ = listed(partition.path if "://" in self.path and not self.path.startswith("file:") else self.path)
        with store.open_input_stream(partition.path, compression=None, buffer_size=1 << 20) as stream:
            yield from batches(partition.path, gzip.open(stream) if partition.path.endswith(".gz") else stream, self.most)


class CaptureSource(DataSource):
    """``spark.read.format("capture").option("max_packets", n).load(path)``: PACKETS' columns; classic and block captures, gzip or plain."""

    @classmethod
    def name(cls):
        return "capture"

    def schema(self):
        return PACKETS

    def reader(self, schema):
        return CaptureReader(self.options)


def read_packets(spark: SparkSession, path: str, max_packets: int = 0, whole: bool = False) -> DataFrame:
    """PACKETS' columns. ``whole`` reads files below 2 GB through Spark, for stores that only Spark opens."""
    if not whole:
        spark.dataSource.register(CaptureSource)
        return spark.read.format("capture").option("max_packets", str(max_packets)).load(path)

    def read(parts):
        for part in parts:
            for file, content in zip(*(c.to_pylist() for c in part.columns), strict=True):
                yield from batches(file, BytesIO(content), max_packets)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, PACKETS)


def segments(captured: DataFrame, protocol: int = PROTOCOL) -> DataFrame:
    """Transport headers of the UDP payloads that are long enough; status is ok, bad_version or wrong_protocol."""
    p = F.col("payload")
    out = captured.where((F.col("status") == "ok") & (F.length(p) >= HEADER)).select(
        "file", "packet_no", "capture_ns", F.conv(F.hex(F.substring(p, 1, 1)), 16, 10).cast("int").alias("version"),
        little(p, 2, 2).cast("int").alias("protocol_id"), little(p, 4, 4).alias("channel_id"), little(p, 8, 4).alias("session_id"),
        little(p, 12, 2).cast("int").alias("payload_length"), little(p, 14, 2).cast("int").alias("message_count"),
        little(p, 16, 8).alias("stream_offset"), little(p, 24, 8).alias("first_sequence"), little(p, 32, 8).alias("send_time"),
        F.substring(p, HEADER + 1, F.length(p)).alias("data"),
    )
    return out.withColumn("status", F.when(F.col("version") != 1, "bad_version").when(F.col("protocol_id") != protocol, "wrong_protocol").otherwise("ok"))


def continuity(found: DataFrame) -> DataFrame:
    """Mark each good segment against the sequence of its session: gap, missing, regression; heartbeats are ignored.

    A change of session starts anew. Regressed segments are marked, and still decoded.
    """
    order = Window.partitionBy("file").orderBy("packet_no")
    changed = F.coalesce((F.col("session_id") != F.lag("session_id").over(order)).cast("int"), F.lit(0))
    good = found.where(F.col("status") == "ok").withColumn("session_change", changed)
    good = good.withColumn("run", F.sum("session_change").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    beats = F.col("message_count") == 0
    end = F.when(~beats, F.col("first_sequence") + F.col("message_count"))
    expect = F.max(end).over(Window.partitionBy("file", "run").orderBy("packet_no").rowsBetween(Window.unboundedPreceding, -1))
    marked = good.withColumn("expect", F.when(~beats, expect))
    return marked.withColumns({
        "heartbeat": beats,
        "gap": F.coalesce(F.col("first_sequence") > F.col("expect"), F.lit(False)),
        "missing": F.greatest(F.coalesce(F.col("first_sequence") - F.col("expect"), F.lit(0)), F.lit(0)),
        "regression": F.coalesce(F.col("first_sequence") < F.col("expect"), F.lit(False)),
    })


MESSAGES = "file string, packet_no bigint, session_id bigint, seg_first_seq bigint, seq bigint, msg_type string, frame_len int, body binary, defect string"


def split_segments(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The messages of each segment; a last row without a body marks a payload whose length doesn't fit."""
    names = [c.split()[0] for c in MESSAGES.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.string()]
    for part in parts:
        rows: list[tuple] = []
        for file, number, session, first, promised, count, data in zip(*(c.to_pylist() for c in part.columns), strict=True):
            at, seen, end = 0, 0, min(len(data), promised)
            if end != promised:
                rows.append((file, number, session, first, first, None, 0, None, "payload_length_mismatch"))
            if not count:
                continue
            while at + 2 <= end and seen < count:
                size = int.from_bytes(data[at : at + 2], "little")
                at += 2
                if not size or at + size > end:
                    break
                kind = chr(data[at]) if data[at] < 128 else "?"
                known = LENGTHS.get(kind, 0)
                rows.append((file, number, session, first, first + seen, kind, size, data[at : at + size], None if known == size else "length_mismatch" if known else "unknown_type"))
                at, seen = at + size, seen + 1
            if seen != count:
                rows.append((file, number, session, first, first + seen, None, 0, None, "payload_length_mismatch"))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def messages(found: DataFrame) -> DataFrame:
    """MESSAGES' columns of the good segments."""
    return found.where(F.col("status") == "ok").select("file", "packet_no", "session_id", "first_sequence", "payload_length", "message_count", "data").mapInArrow(split_segments, MESSAGES)


def decode(raw: DataFrame) -> DataFrame:
    """Add the fields of every message type; null where the type has none or the message is defective."""
    b, sound = F.col("body"), F.col("body").isNotNull() & F.col("defect").isNull()
    is_ = lambda *kinds: sound & F.col("msg_type").isin(*kinds)
    flag = F.conv(F.hex(F.substring(b, 2, 1)), 16, 10).cast("int")
    char = letters(b, 1, 1)
    bit = lambda mask: flag.bitwiseAND(F.lit(mask)) != 0
    trade = is_("T", "B")
    return raw.withColumns({
        "flags": F.when(sound, flag),
        "ts_ns": F.when(sound, little(b, 2, 8)),
        "symbol": F.when(sound & (F.col("msg_type") != "S"), letters(b, 10, 8)),
        "side": F.when(is_("8"), "B").when(is_("5"), "S"),
        "size": F.when(is_("8", "5", "T", "B"), little(b, 18, 4)),
        "price": F.when(is_("8", "5", "T", "B"), little(b, 22, 8)).when(is_("X"), little(b, 18, 8)),
        "event_complete": F.when(is_("8", "5"), bit(1)),
        "trade_id": F.when(trade, little(b, 30, 8)),
        "iso": F.when(trade, bit(0x80)),
        "ext_hours": F.when(trade, bit(0x40)),
        "odd_lot": F.when(trade, bit(0x20)),
        "tt_exempt": F.when(trade, bit(0x10)),
        "cross": F.when(trade, bit(0x08)),
        "status": F.when(is_("H", "O", "I"), char),
        "short_sale_test": F.when(is_("P"), flag != 0),
        "detail": F.when(is_("P"), letters(b, 18, 1)),
        "reason": F.when(is_("H"), letters(b, 18, 4)),
        "event": F.when(is_("S", "E"), char),
        "price_type": F.when(is_("X"), char),
        "round_lot": F.when(is_("D"), little(b, 18, 4)),
        "poc_price": F.when(is_("D"), little(b, 22, 8)),
        "luld_tier": F.when(is_("D"), F.conv(F.hex(F.substring(b, 31, 1)), 16, 10).cast("int")),
        "auction_type": F.when(is_("A"), char),
        "paired_shares": F.when(is_("A"), little(b, 18, 4)),
        "ref_price": F.when(is_("A"), little(b, 22, 8)),
        "indicative_price": F.when(is_("A"), little(b, 30, 8)),
        "imbalance_shares": F.when(is_("A"), little(b, 38, 4)),
        "imbalance_side": F.when(is_("A"), letters(b, 42, 1)),
        "extension": F.when(is_("A"), F.conv(F.hex(F.substring(b, 44, 1)), 16, 10).cast("int")),
        "scheduled_s": F.when(is_("A"), little(b, 44, 4)),
        "book_clearing_price": F.when(is_("A"), little(b, 48, 8)),
        "collar_ref_price": F.when(is_("A"), little(b, 56, 8)),
        "lower_collar": F.when(is_("A"), little(b, 64, 8)),
        "upper_collar": F.when(is_("A"), little(b, 72, 8)),
    })


def transport_stats(captured: DataFrame, protocol: int = PROTOCOL) -> DataFrame:
    """One row of counters over a table of packets, with ``defects``: what should make a capture suspect."""
    count = lambda test: F.coalesce(F.sum(F.when(test, 1).otherwise(0)), F.lit(0)).cast("bigint")
    packet = ~F.col("status").endswith("_block")
    box = captured.agg(
        count(packet).alias("packets"), F.coalesce(F.sum(F.when(packet, F.col("caplen").cast("bigint"))), F.lit(0)).alias("bytes"), count(F.col("status") == "non_ip").alias("non_ip"),
        count(F.col("status") == "non_udp").alias("non_udp"), count(F.col("truncated")).alias("truncated"), count(F.col("status") == "skipped_block").alias("blocks_skipped"), count(F.col("status") == "bad_block").alias("bad_blocks"),
    )
    found = segments(captured, protocol)
    kinds = found.agg(count(F.col("status") == "bad_version").alias("bad_version"), count(F.col("status") == "wrong_protocol").alias("wrong_protocol"))
    runs = continuity(found).agg(
        F.count("*").alias("segments"), count(F.col("heartbeat")).alias("heartbeats"), count(F.col("gap")).alias("gaps"), F.coalesce(F.sum("missing"), F.lit(0)).alias("gap_messages"),
        count(F.col("regression")).alias("regressions"), count(F.col("session_change") == 1).alias("session_changes"),
    )
    sent = messages(found).agg(count(F.col("body").isNotNull()).alias("messages"), *[count(F.col("defect") == d).alias(d) for d in ("payload_length_mismatch", "unknown_type", "length_mismatch")])
    total = sum((F.col(c) for c in ("payload_length_mismatch", "unknown_type", "length_mismatch", "gaps", "regressions", "truncated", "bad_blocks")), F.col("bad_version"))
    return box.crossJoin(kinds).crossJoin(runs).crossJoin(sent).withColumn("defects", total)
