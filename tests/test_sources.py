import gzip
import struct
from io import BytesIO

import pytest
from feeds import framed, message
from pyspark.sql import functions as F

from ledgerlight.functions import wire
from ledgerlight.sources import deep, itch


def test_frames_with_prefixes_and_their_defects(spark, tmp_path):
    good = [message("A", 5, 3, order_ref=2**63 + 7, side="B", shares=100, stock="BRK B", price=1234500), message("D", 6, 3, order_ref=9), message("E", 7, 3, order_ref=1, shares=50, match_number=77)]
    odd = b"z" + b" " * 19
    whole = framed(good) + framed([odd, good[0][:30]]) + framed(good)[:-9]
    (tmp_path / "a.itch").write_bytes(whole)
    (tmp_path / "b.itch").write_bytes(framed(good[:1]) + b"\0\0" + framed(good))
    (tmp_path / "c.itch.gz").write_bytes(gzip.compress(framed(good)))
    (tmp_path / "d.itch").write_bytes(b"")
    for how in (False, True):
        rows = itch.read_frames(spark, f"file://{tmp_path}/{'*' if how else ''}", whole=how) if not how else itch.read_frames(spark, f"file://{tmp_path}/[ab].itch", whole=True)
        stats = {r.file.rsplit("/", 1)[-1]: r for r in itch.parse_stats(rows).collect()}
        a, b = stats["a.itch"], stats["b.itch"]
        assert (a.messages, a.unknown_type, a.length_mismatch, a.framing_errors) == (7, 1, 1, 0)
        assert a.truncated_tail == 31 - 9 + 2
        assert (b.messages, b.framing_errors) == (1, 1)
        if not how:
            assert stats["c.itch.gz"].messages == 3 and "d.itch" not in stats
    got = itch.decode(itch.read_frames(spark, f"{tmp_path}/b.itch").where("body is not null")).first()
    assert (got.locate, got.ts_ns, got.order_ref, got.side, got.shares, got.stock, got.price) == (3, 5, 7 - 2**63, "B", 100, "BRK B", 1234500)


def test_raw_frames_stop_at_an_unknown_type():
    good = [message("A", 1), message("D", 2), message("E", 3)]
    assert [f[1] for f in itch.frames(BytesIO(b"".join(good)), True)] == ["A", "D", "E"]
    rows = list(itch.frames(BytesIO(good[0] + b"z" + good[1]), True))
    assert rows[-1][1:] == ("z", 0, None, "unknown_type") and len(rows) == 2
    assert list(itch.frames(BytesIO(good[0] + good[1][:5]), True))[-1][4] == "truncated_tail"


def test_every_order_message_goes_there_and_back(spark):
    values = {"order_ref": 11, "new_order_ref": 12, "shares": 300, "price": 1_000_100, "exec_price": 999_900, "stock": "ABC", "side": "S", "match_number": 2**40, "printable": True, "attribution": "MPID", "event_code": "Q", "trading_state": "T", "reason": "LUDP", "round_lot": 100, "cross_type": "O", "paired_shares": 2**35, "imbalance_shares": 5, "imbalance_dir": "B", "far_price": 1, "near_price": 2, "ref_price": 3}
    for kind, fields in itch.FIELDS.items():
        columns = {k: F.lit(v) for k, v in values.items()} | {"ts_ns": F.lit(34_200_000_000_123), "locate": F.lit(513)}
        body = spark.range(1).select(F.lit("f").alias("file"), F.lit(0).alias("seq"), F.lit(kind).alias("msg_type"), itch.encode(kind, columns, False).alias("body"), F.lit(None).cast("string").alias("defect"))
        row = itch.decode(body).first()
        assert len(row.body) == itch.LENGTHS[kind] and (row.locate, row.ts_ns) == (513, 34_200_000_000_123)
        for name, *_ in fields:
            if name in values:
                assert row[name] == values[name], (kind, name)
        theirs = message(kind, 34_200_000_000_123, 513, **values)
        again = itch.decode(spark.createDataFrame([("f", 0, kind, bytearray(theirs), None)], "file string, seq int, msg_type string, body binary, defect string")).first()
        for name, *_ in fields:
            if name in values:
                assert again[name] == values[name], (kind, name)


GOLDEN_LEVEL = bytes.fromhex("3801ac63c02096866d145a49455854202020e4250000241d0f0000000000")
GOLDEN_TRADE = bytes.fromhex("5400c3dff705a2866d145a4945585420202064000000241d0f0000000000968f060000000000")


def decoded(spark, *bodies):
    rows = [("f", 1, i, chr(b[0]), bytearray(b), None) for i, b in enumerate(bodies)]
    return deep.decode(spark.createDataFrame(rows, "file string, packet_no bigint, seq bigint, msg_type string, body binary, defect string")).orderBy("seq").collect()


def test_depth_messages_of_the_specification(spark):
    level, trade = decoded(spark, GOLDEN_LEVEL, GOLDEN_TRADE)
    assert (level.side, level.event_complete, level.ts_ns, level.symbol, level.size, level.price) == ("B", True, 1471980632572715948, "ZIEXT", 9700, 990500)
    assert (trade.size, trade.price, trade.trade_id, trade.ts_ns, trade.iso) == (100, 990500, 429974, 1471980683662974915, False)
    flags = decoded(spark, b"\x54\xf8" + GOLDEN_TRADE[2:])[0]
    assert (flags.iso, flags.ext_hours, flags.odd_lot, flags.tt_exempt, flags.cross) == (True,) * 5
    low = decoded(spark, GOLDEN_LEVEL[:22] + struct.pack("<q", -5))[0]
    assert low.price == -5


def test_little_and_big_numbers(spark):
    row = spark.range(1).select(wire.put_little(F.lit(0x0102030405), 8).alias("l"), wire.put_big(F.lit(258), 4).alias("b"), wire.price_text(F.lit(1234567)).alias("p")).first()
    assert bytes(row.l) == (0x0102030405).to_bytes(8, "little") and bytes(row.b) == b"\0\0\1\2" and row.p == "123.4567"


def udp(payload, options=0, vlans=0):
    ip = bytes([0x45 + options // 4, 0]) + struct.pack(">H", 28 + options + len(payload)) + b"\0" * 4 + b"\x40\x11" + b"\0" * 10 + b"\1" * options
    return b"\xff" * 12 + b"\x81\x00\x00\x07" * vlans + b"\x08\x00" + ip + b"\0" * 4 + struct.pack(">H", 8 + len(payload)) + b"\0\0" + payload


def segment(messages, first, session=1, protocol=deep.PROTOCOL, version=1, count=None):
    data = b"".join(struct.pack("<H", len(m)) + m for m in messages)
    return struct.pack("<BBHIIHHqqq", version, 0, protocol, 1, session, len(data), len(messages) if count is None else count, 0, first, 0) + data


def classic(packets, order="<", magic=0xA1B2C3D4, link=1):
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, link)
    for i, p in enumerate(packets):
        out += struct.pack(order + "IIII", 10, i, len(p), len(p)) + p
    return out


def block(kind, body, order="<"):
    body += b"\0" * (-len(body) % 4)
    return struct.pack(order + "II", kind, len(body) + 12) + body + struct.pack(order + "I", len(body) + 12)


def blocks(packets, order="<", resolution=9):
    mark = struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1)
    out = block(0x0A0D0D0A, mark, order) + block(1, struct.pack(order + "HHI", 1, 0, 0) + struct.pack(order + "HHBxxxHH", 9, 1, resolution, 0, 0), order)
    for i, p in enumerate(packets):
        out += block(5, b"\0" * 8, order) + block(6, struct.pack(order + "IIIII", 0, 0, 1000 + i, len(p), len(p)) + p, order)
    return out


@pytest.mark.parametrize("options", [0, 4, 8])
@pytest.mark.parametrize("vlans", [0, 1, 2])
def test_payloads_behind_tags_and_options(options, vlans):
    assert deep.udp_payload(udp(b"hello", options, vlans), 1) == ("ok", b"hello")


def test_frames_that_are_not_udp():
    assert deep.udp_payload(b"\0" * 10, 1)[0] == "non_ip"
    tcp = bytearray(udp(b"x"))
    tcp[23] = 6
    assert deep.udp_payload(bytes(tcp), 1)[0] == "non_udp"
    assert deep.udp_payload(udp(b"abc")[14:], 101) == ("ok", b"abc")
    assert deep.udp_payload(b"\0" * 14 + b"\x08\x00" + udp(b"abc")[14:], 113) == ("ok", b"abc")


def test_containers():
    for order, magic in (("<", 0xA1B2C3D4), (">", 0xA1B2C3D4), ("<", 0xA1B23C4D), (">", 0xA1B23C4D)):
        rows = list(deep.packets(BytesIO(classic([udp(b"a"), udp(b"b")], order, magic))))
        unit = 1000 if magic == 0xA1B2C3D4 else 1
        assert [(r[0], r[5]) for r in rows] == [(10_000_000_000, b"a"), (10_000_000_000 + unit, b"b")]
    for order in "<>":
        rows = list(deep.packets(BytesIO(blocks([udp(b"a"), udp(b"b")], order))))
        assert [r[2] for r in rows] == ["skipped_block", "ok", "skipped_block", "ok"] and rows[1][0] == 1000
        two = list(deep.packets(BytesIO(blocks([udp(b"a")], "<") + blocks([udp(b"b")], ">"))))
        assert [r[5] for r in two if r[2] == "ok"] == [b"a", b"b"]
    assert list(deep.packets(BytesIO(blocks([udp(b"a")], resolution=6))))[1][0] == 1_000_000
    for bad in (b"\xef\xbe\xad\xde" + b"\0" * 30, b"", classic([], link=7), b"\x0a\x0d\x0d\x0a" + b"\0" * 20, blocks([])[:28] + block(1, b"\0\0")):
        with pytest.raises(deep.CaptureError):
            list(deep.packets(BytesIO(bad)))
    cut = struct.pack("<IIII", 10, 0, 4, 900) + b"abcd"
    assert [r[3] for r in deep.packets(BytesIO(classic([]) + cut))] == [True]


def level(symbol, side, price, size, complete=True, ts=0):
    return (b"8" if side == "B" else b"5") + bytes([complete]) + struct.pack("<q", ts) + symbol.encode().ljust(8) + struct.pack("<Iq", size, price)


def test_segments_gaps_and_defects(spark, tmp_path):
    m = level("AAA", "B", 1_000_000, 100)
    stream = [segment([m] * 1, 1), segment([m], 5), segment([m], 5), segment([], 6), segment([m], 1, session=2), segment([m], 9, protocol=0x8003), segment([m], 2, session=2, version=3), segment([m[:-1]], 2, session=2), segment([b"zz"], 3, session=2), segment([m], 4, session=2, count=2), b"short"]
    (tmp_path / "x.pcap").write_bytes(classic([udp(s) for s in stream]))
    for whole in (False, True):
        packets = deep.read_packets(spark, f"file://{tmp_path}/x.pcap", whole=whole)
        s = deep.transport_stats(packets).first()
        assert (s.packets, s.segments, s.heartbeats, s.gaps, s.gap_messages, s.regressions, s.session_changes) == (11, 8, 1, 1, 3, 1, 1)
        assert (s.bad_version, s.wrong_protocol, s.length_mismatch, s.unknown_type, s.payload_length_mismatch) == (1, 1, 1, 1, 1)
        assert s.defects == 6
    assert deep.read_packets(spark, f"{tmp_path}/x.pcap", max_packets=3).count() == 3
    sound = deep.decode(deep.messages(deep.segments(packets))).where("price is not null")
    assert sound.count() == 5
