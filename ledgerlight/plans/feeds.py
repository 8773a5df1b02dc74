"""Queries through the feed sources: the driver's events are encoded, landed as feed and capture files, and read back.

Each has SQL over ``events`` that tells what must come out. A query lands files of its own in the shared folder.
"""

from __future__ import annotations

import struct
from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions import wire
from ledgerlight.plans import views
from ledgerlight.plans.market import query
from ledgerlight.session import shared_dir
from ledgerlight.sources import deep, itch
from ledgerlight.sources.landing import land

BASE = views.BASE_SQL
DAY = 86_400_000_000_000


def landed(spark, parts: DataFrame) -> str:
    root = f"{shared_dir(spark)}/feeds-{uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    land(parts, root)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return root


def file_name() -> Column:
    return F.element_at(F.split("file", "/"), -1)


# Order messages: every kind with every field

KINDS = "SRHYLVWKJhAFECXDUPQBIN"
#: For each kind of field its value as SQL that both engines read; numbers by width, letters by place.
LETTER = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST((k * 7 + {at}) % 26 + 1 AS INT), 1)"


def field_sql(name: str, how: str, at: int, width: int) -> str:
    if name == "side":
        return "CASE WHEN k % 2 = 0 THEN 'B' ELSE 'S' END"
    if name == "stock":
        return "symbol"
    if how == "y":
        return f"(k + {at}) % 3 = 0"
    if how == "u":
        return f"(seq * 1000003 + {at}) * 65537" if width == 8 else f"(price4 * 31 + {at}) % 4294967296"
    return LETTER.format(at=at) if width == 1 else f"concat({', '.join(LETTER.format(at=at + i) for i in range(width))})"


KIND_SQL = f"substr('{KINDS}', CAST(seq % {len(KINDS)} + 1 AS INT), 1)"
NAMES = list(dict.fromkeys(f[0] for fields in itch.FIELDS.values() for f in fields))


def messages_sql(kinds: str) -> str:
    """All fields of messages of some kinds, null where a kind has none."""
    out = []
    for name in NAMES:
        cases = [f"WHEN '{kind}' THEN {field_sql(*f)}" for kind in kinds for f in itch.FIELDS.get(kind, ()) if f[0] == name]
        if cases:
            out.append(f"CASE msg_type {' '.join(cases)} END AS {name}")
    lengths = " ".join(f"WHEN '{k}' THEN {itch.LENGTHS[k]}" for k in kinds)
    return f"""WITH {BASE}, typed AS (SELECT *, {KIND_SQL} AS msg_type FROM base), numbered AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY seq) - 1 AS nth FROM typed)
SELECT symbol || '.itch' AS file, CAST(nth AS BIGINT) AS seq, msg_type, CASE msg_type {lengths} END AS frame_len, CAST(k AS INT) AS locate, ts_ns % {DAY} AS ts_ns, {', '.join(out)}
FROM numbered WHERE msg_type IN ({', '.join(f"'{k}'" for k in kinds)})"""


def order_feed(spark, sf) -> DataFrame:
    """(file, seq, part): a framed message for each event, its kind by turns."""
    rows = views.base(spark, sf).withColumn("kind", F.expr(KIND_SQL))
    part = None
    for kind in KINDS:
        values = {"locate": F.col("k"), "ts_ns": F.col("ts_ns") % DAY} | {f[0]: F.expr(field_sql(*f)) for f in itch.FIELDS.get(kind, ())}
        made = itch.encode(kind, values)
        part = F.when(F.col("kind") == kind, made) if part is None else part.when(F.col("kind") == kind, made)
    return rows.select(F.concat("symbol", F.lit(".itch")).alias("file"), "seq", part.alias("part"), "symbol", "k", "kind")


def read_orders(spark, sf, kinds: str) -> DataFrame:
    got = itch.decode(itch.read_frames(spark, landed(spark, order_feed(spark, sf)))).where(F.col("msg_type").isin(*kinds))
    names = [n for n in NAMES if any(f[0] == n for k in kinds for f in itch.FIELDS.get(k, ()))]
    return got.select(file_name().alias("file"), "seq", "msg_type", "frame_len", "locate", "ts_ns", *names)


ADMIN, ORDERS = "SRHYLVWKJhQBIN", "AFECXDUP"


@query(messages_sql(ADMIN))
def itch_admin_fields(spark, sf):
    """System, directory, trading, cross, break and imbalance messages, and those of which only the header is read."""
    return read_orders(spark, sf, ADMIN)


@query(messages_sql(ORDERS))
def itch_order_fields(spark, sf):
    return read_orders(spark, sf, ORDERS)


BROKEN = f"""WITH {BASE}, typed AS (SELECT *, {KIND_SQL} AS msg_type, row_number() OVER (PARTITION BY symbol ORDER BY seq) AS nth, count(*) OVER (PARTITION BY symbol) AS n FROM base),
frames AS (SELECT *, CASE msg_type {' '.join(f"WHEN '{k}' THEN {itch.LENGTHS[k]}" for k in KINDS)} END AS len, CAST(substr(symbol, 2) AS INT) AS f FROM typed)"""


@query(f"""{BROKEN}, read_ AS (SELECT *, CASE WHEN f IN (1, 2) THEN nth < n WHEN f = 3 THEN nth <= n // 2 ELSE true END AS whole,
  CASE WHEN f = 4 AND nth % 10 = 0 THEN 'unknown' WHEN f = 5 AND nth % 10 = 0 THEN 'length' END AS odd FROM frames)
SELECT symbol || '.itch' || CASE WHEN f >= 8 THEN '.gz' ELSE '' END AS file, CAST(count(*) FILTER (WHERE whole) AS BIGINT) AS messages,
  CAST(sum(CASE WHEN whole THEN len + CASE WHEN odd = 'length' THEN 1 ELSE 0 END ELSE 0 END) AS BIGINT) AS bytes, CAST(count(*) FILTER (WHERE odd = 'unknown') AS BIGINT) AS unknown_type,
  CAST(max(CASE WHEN f = 3 THEN 1 ELSE 0 END) AS BIGINT) AS framing_errors, CAST(count(*) FILTER (WHERE odd = 'length') AS BIGINT) AS length_mismatch,
  CAST(max(CASE WHEN f = 1 AND nth = n THEN len + 2 - 3 WHEN f = 2 AND nth = n THEN 1 ELSE 0 END) AS BIGINT) AS truncated_tail FROM read_ GROUP BY symbol, f""")
def itch_file_defects(spark, sf):
    """Files with a cut tail, a cut prefix, an empty frame, unknown types and wrong lengths, plain and gzipped, through the framer and its counters."""
    from pyspark.sql.window import Window

    f, part = F.substring("symbol", 2, 9).cast("int"), F.col("part")
    by = Window.partitionBy("symbol")
    rows = order_feed(spark, sf).withColumns({"f": f, "nth": F.row_number().over(by.orderBy("seq")), "n": F.count("*").over(by)})
    last, tenth = F.col("nth") == F.col("n"), F.col("nth") % 10 == 0
    body = F.substring(part, 3, F.length(part))
    longer = F.concat(wire.put_big(F.length(part) - 1, 2), body, F.lit(b"\0"))
    stranger = F.concat(F.substring(part, 1, 2), F.lit(b"z"), F.substring(part, 4, F.length(part)))
    broken = (
        F.when((F.col("f") == 1) & last, F.substring(part, 1, F.length(part) - 3)).when((F.col("f") == 2) & last, F.substring(part, 1, 1))
        .when((F.col("f") == 3) & (F.col("nth") == F.floor(F.col("n") / 2)), F.concat(part, F.lit(b"\0\0"))).when((F.col("f") == 4) & tenth, stranger).when((F.col("f") == 5) & tenth, longer).otherwise(part)
    )
    named = F.concat("file", F.when(F.col("f") >= 8, ".gz").otherwise(""))
    return itch.parse_stats(itch.read_frames(spark, landed(spark, rows.select(named.alias("file"), "seq", broken.alias("part"))))).withColumn("file", file_name())


@query(f"""{BROKEN}, stop AS (SELECT *, CASE WHEN f % 2 = 1 THEN n // 3 ELSE n END AS upto FROM frames)
SELECT symbol || '.itch' AS file, CAST(nth - 1 AS BIGINT) AS seq, msg_type, CAST(len AS INT) AS frame_len, CAST(NULL AS VARCHAR) AS defect FROM stop WHERE nth <= upto
UNION ALL SELECT symbol || '.itch', CAST(n // 3 AS BIGINT), 'z', 0, 'unknown_type' FROM stop WHERE nth = n AND f % 2 = 1""")
def itch_raw_frames(spark, sf):
    """Messages without length prefixes: framed by their types, up to one that isn't known."""
    from pyspark.sql.window import Window

    by = Window.partitionBy("symbol")
    rows = order_feed(spark, sf).withColumns({"nth": F.row_number().over(by.orderBy("seq")), "n": F.count("*").over(by)})
    body = F.substring("part", 3, F.length("part"))
    odd = (F.substring("symbol", 2, 9).cast("int") % 2 == 1) & (F.col("nth") == F.floor(F.col("n") / 3))
    root = landed(spark, rows.select("file", "seq", F.when(odd, F.concat(body, F.lit(b"z"))).otherwise(body).alias("part")))
    return itch.read_frames(spark, root, raw=True).select(file_name().alias("file"), "seq", "msg_type", "frame_len", "defect")


# Depth captures

DEPTH_KINDS = "SDHIOPE85TXBA"
#: Of each kind, what follows the type: (field, kind of value, width); the header is flags, time and symbol. Fixed by the protocol.
NUMBERS = {
    "D": (("round_lot", 4), ("poc_price", 8), ("luld_tier", 1)), "H": (("reason", 0),), "P": (("detail", -1),), "8": (("size", 4), ("price", 8)), "5": (("size", 4), ("price", 8)),
    "T": (("size", 4), ("price", 8), ("trade_id", 8)), "B": (("size", 4), ("price", 8), ("trade_id", 8)), "X": (("price", 8),),
    "A": (("paired_shares", 4), ("ref_price", 8), ("indicative_price", 8), ("imbalance_shares", 4), ("imbalance_side", -1), ("extension", 1), ("scheduled_s", 4), ("book_clearing_price", 8), ("collar_ref_price", 8), ("lower_collar", 8), ("upper_collar", 8)),
}
DEPTH_KIND = f"substr('{DEPTH_KINDS}', CAST(seq % {len(DEPTH_KINDS)} + 1 AS INT), 1)"
FLAG = "k * 37 % 256"
CHARS = {"H": "THOP", "I": "ABCD", "O": "TNTN", "S": "OSRM", "E": "OCOC", "X": "QMQM", "A": "OCIH"}
CHAR = "substr('{c}', CAST(k % 4 + 1 AS INT), 1)"


def number_sql(at: int, width: int) -> str:
    if width == 0:
        return "'R' || CAST(k % 100 AS VARCHAR(3))"
    if width < 0:
        return CHAR.format(c="BSNA")
    return {1: f"CAST((k + {at}) % 256 AS INT)", 4: f"(price4 * 31 + {at}) % 4294967296", 8: f"price4 * 1000003 - {at} * 77777777777"}[width]


def depth_body() -> Column:
    """A message of each kind from an event, its kind by turns."""
    kind, out = F.expr(DEPTH_KIND), None
    for k in DEPTH_KINDS:
        second = wire.put_letters(F.expr(CHAR.format(c=CHARS[k])), 1) if k in CHARS else wire.put_big(F.expr(FLAG), 1)
        parts = [F.lit(k.encode()), second, wire.put_little(F.col("ts_ns"), 8)]
        if k != "S":
            parts.append(wire.put_letters(F.col("symbol"), 8))
        for at, (_, width) in enumerate(NUMBERS.get(k, ())):
            value = F.expr(number_sql(at, width))
            parts.append(wire.put_letters(value, 4 if not width else 1) if width <= 0 else wire.put_little(value, width))
        made = F.concat(*parts)
        out = F.when(kind == k, made) if out is None else out.when(kind == k, made)
    return out


#: What is odd about an event's packet: by its number of the symbol's file, so that each file has some of all.
ODD = "CASE nth % 40 WHEN 3 THEN 'non_ip' WHEN 7 THEN 'non_udp' WHEN 11 THEN 'bad_version' WHEN 13 THEN 'wrong_protocol' WHEN 17 THEN 'heartbeat' WHEN 19 THEN 'gap' WHEN 23 THEN 'regression' WHEN 29 THEN 'unknown_type' WHEN 31 THEN 'length_mismatch' WHEN 33 THEN 'payload' WHEN 37 THEN 'cut' ELSE '' END"
SHIFT = "CASE WHEN odd = 'gap' THEN 5 WHEN odd = 'regression' THEN -1 ELSE 0 END"
PACKET_SQL = f"""{BASE}, nths AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY seq) AS nth, CAST(substr(symbol, 2) AS INT) AS f FROM base), odds AS (SELECT *, {ODD} AS odd FROM nths),
packets AS (SELECT *, {DEPTH_KIND} AS kind, CASE WHEN odd = 'heartbeat' THEN 0 ELSE 1 END AS message_count, nth * 10 + {SHIFT} * 10 AS first_sequence, 7 + nth // 500 AS session FROM odds)"""
#: A capture's file: its beginning, link type and the frame before the network header, by the symbol's number.
LINKS = {0: deep.ETHERNET, 1: deep.RAW_IP, 2: deep.LINUX_SLL}


def packet_rows(spark, sf) -> DataFrame:
    """(file, seq, part, ...): captures of five makes, classic of both byte orders and units and of blocks, with defects."""
    from pyspark.sql.window import Window

    b = views.base(spark, sf).withColumn("nth", F.row_number().over(Window.partitionBy("symbol").orderBy("seq")).cast("bigint"))
    odd, n = F.col("odd"), lambda c: F.length(c)
    link, make = F.col("f") % 3, F.col("f") % 5
    tag = F.when(F.col("f") % 2 == 0, F.lit(b"\x81\0\0\5\x08\0")).otherwise(F.lit(b"\x08\0"))  # a tagged network or none
    seconds, nanos = F.call_function("div", F.col("ts_ns"), F.lit(10**9)), F.col("ts_ns") % 10**9
    put, more = wire.put_little, F.when(odd == "cut", 10).otherwise(0)
    steps = [  # each from the ones before, as columns, so that no expression is written out twice
        ("f", F.substring("symbol", 2, 9).cast("int")),
        ("odd", F.expr(ODD)),
        ("plain", depth_body()),
        ("body", F.when(odd == "unknown_type", F.concat(F.lit(b"z"), F.substring("plain", 2, 999))).when(odd == "length_mismatch", F.concat("plain", F.lit(b"\0"))).otherwise(F.col("plain"))),
        ("message", F.when(odd == "heartbeat", F.lit(b"")).otherwise(F.concat(put(n("body"), 2), F.col("body")))),
        ("load", F.concat(
            F.when(odd == "bad_version", F.lit(b"\x02\0")).otherwise(F.lit(b"\x01\0")), put(F.when(odd == "wrong_protocol", 1).otherwise(deep.PROTOCOL), 2), put(F.lit(1), 4),
            put(7 + F.call_function("div", F.col("nth"), F.lit(500)), 4), put(n("message") + F.when(odd == "payload", 4).otherwise(0), 2), put(F.when(odd == "heartbeat", 0).otherwise(1), 2),
            put(F.col("seq") * 100, 8), put(F.col("nth") * 10 + F.expr(SHIFT) * 10, 8), put(F.col("ts_ns"), 8), F.col("message"),
        )),
        ("udp", F.concat(F.lit(b"\0\1\0\2"), wire.put_big(n("load") + 8, 2), F.lit(b"\0\0"), F.col("load"))),
        ("ip", F.concat(F.when(odd == "non_ip", F.lit(b"\x65\0")).otherwise(F.lit(b"\x45\0")), wire.put_big(n("udp") + 20, 2), F.lit(b"\0\0\0\0\x40"), F.when(odd == "non_udp", F.lit(b"\x06")).otherwise(F.lit(b"\x11")), F.lit(b"\0\0" + b"\x0a\0\0\1" * 2), F.col("udp"))),
        ("frame", F.when(link == 0, F.concat(F.lit(bytes(12)), tag, F.col("ip"))).when(link == 1, F.col("ip")).otherwise(F.concat(F.lit(bytes(14)), F.lit(b"\x08\0"), F.col("ip")))),
        ("size", n("frame")),
        ("padded", (F.col("size") + 3) - (F.col("size") + 3) % 4),
        ("part", F.when(make.isin(0, 3), F.concat(put(seconds, 4), put(F.call_function("div", nanos, F.lit(1000)), 4), put(F.col("size"), 4), put(F.col("size") + more, 4), F.col("frame")))
            .when(make.isin(1, 4), F.concat(wire.put_big(seconds, 4), wire.put_big(nanos, 4), wire.put_big(F.col("size"), 4), wire.put_big(F.col("size") + more, 4), F.col("frame")))
            .otherwise(F.concat(put(F.lit(6), 4), put(F.col("padded") + 32, 4), put(F.lit(0), 4), put(F.shiftrightunsigned("ts_ns", 32), 4), put(F.col("ts_ns"), 4), put(F.col("size"), 4), put(F.col("size") + more, 4),
                F.col("frame"), F.substring(F.lit(bytes(3)), F.lit(1), (F.col("padded") - F.col("size")).cast("int")), put(F.col("padded") + 32, 4)))),
    ]
    for name, value in steps:
        b = b.withColumn(name, value)
    file = F.concat("symbol", F.when(make == 2, ".pcapng").otherwise(".pcap"), F.when(F.col("f") >= 7, ".gz").otherwise(""))
    return b.select(file.alias("file"), F.col("nth").alias("seq"), "part", "f")


def opening(f: int) -> bytes:
    """What a capture file begins with."""
    link, make = LINKS[f % 3], f % 5
    if make == 2:
        section = struct.pack("<IIIHHqI", 0x0A0D0D0A, 28, 0x1A2B3C4D, 1, 0, -1, 28)
        options = struct.pack("<HHB3xHH", 9, 1, 9, 0, 0)  # nanoseconds
        other = struct.pack("<II4sI", 0xBAD, 16, b"note", 16)  # a block of another kind
        return section + struct.pack("<IIHHI", 1, 20 + len(options), link, 0, 0) + options + struct.pack("<I", 20 + len(options)) + other
    order, unit = ("<", 0xA1B2C3D4) if make in (0, 3) else (">", 0xA1B23C4D)
    return struct.pack(order + "IHHiIII", unit, 2, 4, 0, 0, 65535, link)


def captured(spark, sf) -> DataFrame:
    rows = packet_rows(spark, sf)
    starts = F.create_map(*[x for f in range(10) for x in (F.lit(f), F.lit(opening(f)))])
    part = F.when(F.col("seq") == 1, F.concat(starts[F.col("f")], F.col("part"))).otherwise(F.col("part"))
    return deep.read_packets(spark, landed(spark, rows.select("file", "seq", part.alias("part"))))


FILE = "symbol || CASE WHEN f % 5 = 2 THEN '.pcapng' ELSE '.pcap' END || CASE WHEN f >= 7 THEN '.gz' ELSE '' END"


@query(f"""WITH {PACKET_SQL} SELECT {FILE} AS file, CAST(nth AS BIGINT) AS packet_no, CASE WHEN f % 5 IN (0, 3) THEN ts_ns // 1000 * 1000 ELSE ts_ns END AS capture_ns,
  CASE f % 3 WHEN 0 THEN 1 WHEN 1 THEN 101 ELSE 113 END AS linktype, CASE WHEN odd IN ('non_ip', 'non_udp') THEN odd ELSE 'ok' END AS status, odd = 'cut' AS truncated FROM packets
UNION ALL SELECT DISTINCT {FILE}, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CASE f % 3 WHEN 0 THEN 1 WHEN 1 THEN 101 ELSE 113 END, 'skipped_block', false FROM packets WHERE f % 5 = 2""")
def capture_packets(spark, sf):
    """Classic and block captures, plain and gzipped, of three link types, tagged networks among them."""
    return captured(spark, sf).select(file_name().alias("file"), "packet_no", "capture_ns", "linktype", "status", "truncated")


@query(f"""WITH {PACKET_SQL} SELECT {FILE} AS file, CAST(nth AS BIGINT) AS packet_no, CASE WHEN odd = 'bad_version' THEN 2 ELSE 1 END AS version, CASE WHEN odd = 'wrong_protocol' THEN 1 ELSE {deep.PROTOCOL} END AS protocol_id, CAST(1 AS BIGINT) AS channel_id,
  CAST(session AS BIGINT) AS session_id, message_count, seq * 100 AS stream_offset, CAST(first_sequence AS BIGINT) AS first_sequence, ts_ns AS send_time, CASE WHEN odd IN ('bad_version', 'wrong_protocol') THEN odd ELSE 'ok' END AS status FROM packets WHERE odd NOT IN ('non_ip', 'non_udp')""")
def capture_segments(spark, sf):
    found = deep.segments(captured(spark, sf))
    return found.select(file_name().alias("file"), "packet_no", "version", "protocol_id", "channel_id", "session_id", "message_count", "stream_offset", "first_sequence", "send_time", "status")


def depth_fields_sql() -> str:
    columns: dict[str, list[str]] = {}
    for kind, fields in NUMBERS.items():
        for at, (name, width) in enumerate(fields):
            columns.setdefault(name, []).append(f"WHEN '{kind}' THEN {number_sql(at, width)}")
    for name, kinds in {"status": "HOI", "event": "SE", "price_type": "X", "auction_type": "A"}.items():
        columns[name] = [f"WHEN '{k}' THEN {CHAR.format(c=CHARS[k])}" for k in kinds]
    for name, mask in {"iso": 128, "ext_hours": 64, "odd_lot": 32, "tt_exempt": 16, "cross": 8}.items():
        columns[f'"{name}"'] = [f"WHEN '{k}' THEN {FLAG} // {mask} % 2 = 1" for k in "TB"]
    columns["event_complete"] = [f"WHEN '{k}' THEN {FLAG} % 2 = 1" for k in "85"]
    columns["short_sale_test"] = [f"WHEN 'P' THEN {FLAG} <> 0"]
    columns["side"] = ["WHEN '8' THEN 'B'", "WHEN '5' THEN 'S'"]
    shown = ", ".join(f"CASE WHEN NOT sound THEN NULL ELSE CASE kind {' '.join(cases)} END END AS {name}" for name, cases in columns.items())
    lengths = " ".join(f"WHEN '{k}' THEN {n}" for k, n in deep.LENGTHS.items())
    return f"""WITH {PACKET_SQL}, sent AS (SELECT *, odd NOT IN ('unknown_type', 'length_mismatch') AS sound FROM packets WHERE odd NOT IN ('non_ip', 'non_udp', 'bad_version', 'wrong_protocol', 'heartbeat', 'payload'))
SELECT {FILE} AS file, CAST(nth AS BIGINT) AS packet_no, CAST(first_sequence AS BIGINT) AS seq, CASE WHEN odd = 'unknown_type' THEN 'z' ELSE kind END AS msg_type, CAST(CASE kind {lengths} END + CASE WHEN odd = 'length_mismatch' THEN 1 ELSE 0 END AS INT) AS frame_len,
  CASE WHEN NOT sound THEN odd END AS defect, CASE WHEN sound THEN ts_ns END AS ts_ns, CASE WHEN sound AND kind <> 'S' THEN symbol END AS symbol, {shown} FROM sent"""


@query(depth_fields_sql())
def capture_depth_fields(spark, sf):
    """Every depth message with every field, from packets to columns."""
    got = deep.decode(deep.messages(deep.segments(captured(spark, sf)))).where("body is not null")
    numbers = [n for n in dict.fromkeys(name for fields in NUMBERS.values() for name, _ in fields)]
    rest = ["status", "event", "price_type", "auction_type", "iso", "ext_hours", "odd_lot", "tt_exempt", "cross", "event_complete", "short_sale_test", "side"]
    payload = F.col("packet_no") % 40 == 33  # their payload is shorter than promised; the message may be whole
    return got.where(~payload).select(file_name().alias("file"), "packet_no", "seq", "msg_type", "frame_len", "defect", "ts_ns", "symbol", *numbers, *rest)


@query(f"""WITH {PACKET_SQL}, good AS (SELECT *, lag(session) OVER (PARTITION BY symbol ORDER BY nth) AS last_session FROM packets WHERE odd NOT IN ('non_ip', 'non_udp', 'bad_version', 'wrong_protocol')),
expected AS (SELECT *, CASE WHEN message_count > 0 THEN max(CASE WHEN message_count > 0 THEN first_sequence + message_count END) OVER (PARTITION BY symbol, session ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS expect FROM good),
a AS (SELECT CAST(count(*) AS BIGINT) AS packets, CAST(count(*) FILTER (WHERE odd = 'non_ip') AS BIGINT) AS non_ip, CAST(count(*) FILTER (WHERE odd = 'non_udp') AS BIGINT) AS non_udp, CAST(count(*) FILTER (WHERE odd = 'cut') AS BIGINT) AS truncated,
  CAST(count(DISTINCT symbol) FILTER (WHERE f % 5 = 2) AS BIGINT) AS blocks_skipped, CAST(0 AS BIGINT) AS bad_blocks, CAST(count(*) FILTER (WHERE odd = 'bad_version') AS BIGINT) AS bad_version, CAST(count(*) FILTER (WHERE odd = 'wrong_protocol') AS BIGINT) AS wrong_protocol,
  CAST(count(*) FILTER (WHERE odd = 'unknown_type') AS BIGINT) AS unknown_type, CAST(count(*) FILTER (WHERE odd = 'length_mismatch') AS BIGINT) AS length_mismatch, CAST(count(*) FILTER (WHERE odd = 'payload') AS BIGINT) AS payload_length_mismatch FROM packets),
b AS (SELECT CAST(count(*) AS BIGINT) AS segments, CAST(count(*) FILTER (WHERE message_count = 0) AS BIGINT) AS heartbeats, CAST(count(*) FILTER (WHERE first_sequence > expect) AS BIGINT) AS gaps, CAST(sum(greatest(coalesce(first_sequence - expect, 0), 0)) AS BIGINT) AS gap_messages,
  CAST(count(*) FILTER (WHERE first_sequence < expect) AS BIGINT) AS regressions, CAST(count(*) FILTER (WHERE session <> last_session) AS BIGINT) AS session_changes, CAST(count(*) FILTER (WHERE message_count > 0) AS BIGINT) AS messages FROM expected)
SELECT *, bad_version + payload_length_mismatch + unknown_type + length_mismatch + gaps + regressions + truncated + bad_blocks AS defects FROM a, b""")
def transport_counters(spark, sf):
    """All counters of the transport over all captures, defects of each kind among them."""
    return deep.transport_stats(captured(spark, sf)).drop("bytes")
