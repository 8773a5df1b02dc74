"""Command line: ``generate`` or ``replay`` an order feed, ``fetch`` features from a capture, ``research``, ``brief`` or ``daily`` over a store."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from ledgerlight.operators import books, panel, tape
from ledgerlight.plans import brief, walk
from ledgerlight.session import session
from ledgerlight.sources import deep, itch, synthetic, tables


def replay(spark, a) -> int:
    """Report on an order feed; 1 if it is corrupt or differs from the truth."""
    frames = itch.read_frames(spark, a.feed, a.raw)
    itch.parse_stats(frames).show(truncate=False)
    mine = books.resolved(itch.decode(frames.where("body is not null")), [a.symbol], {a.symbol: a.locate} if a.locate is not None else None)
    events = books.order_book_events(mine, ["symbol"], a.tick).cache()
    found = books.diagnostics(events, ["symbol"])
    if not a.quiet:
        found.show(vertical=True)
        books.tape(events, ["symbol"]).show(truncate=False)
        books.order_levels(events, ["symbol"], a.depth).orderBy("side", "level").show(2 * a.depth, False)
    row = found.first()
    bad = row is None or row.corruption > 0
    if a.truth:
        left = books.verify(events, tables.read_truth(spark, a.truth)).groupBy("reason").count().collect()
        print("PASS" if not left and row is not None else f"FAIL {dict(left)}")
        return int(bool(left) or row is None)
    return int(bad)


def generate(a) -> int:
    print(f"{synthetic.write(a.out, a.truth, a.messages, symbols=a.symbols, seed=a.seed, symbol=a.symbol, price=a.price)} messages")
    return 0


def fetch(spark, a) -> int:
    """Features of a capture; 1 if the capture has defects, 2 if it can't be read. Nothing is downloaded."""
    try:
        packets = deep.read_packets(spark, a.pcap, a.max_packets).cache()
        stats = deep.transport_stats(packets).first()
    except Exception as e:
        if "CaptureError" not in str(e):
            raise
        print(e, file=sys.stderr)
        return 2
    print(stats.asDict())
    symbols = a.symbols.split(",")
    if any(not s or len(s) > 8 for s in symbols):
        raise SystemExit("a symbol has one to eight letters")
    decoded = deep.decode(deep.messages(deep.segments(packets)).where("body is not null")).where(F.col("symbol").isin(symbols))
    out = tape.feature_table(tape.deep_messages(decoded), ["symbol"], a.sample_ms * 1_000_000, a.tick)
    tables.write_features(out, a.out)
    tape.symbol_summary(tape.deep_messages(decoded), ["symbol"], a.tick).show(truncate=False)
    return int(stats.defects > 0)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="ledgerlight", description=__doc__)
    p.add_argument("--master", default="local[*]")
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("replay")
    r.add_argument("--feed", required=True)
    r.add_argument("--symbol", required=True)
    r.add_argument("--truth")
    r.add_argument("--raw", action="store_true")
    r.add_argument("--quiet", action="store_true")
    r.add_argument("--depth", type=int, default=5)
    r.add_argument("--tick", type=int, default=100)
    r.add_argument("--locate", type=int)
    f = sub.add_parser("fetch")
    f.add_argument("--pcap", required=True)
    f.add_argument("--symbols", required=True)
    f.add_argument("--out", required=True)
    f.add_argument("--sample-ms", type=int, default=1000)
    f.add_argument("--tick", type=int, default=100)
    f.add_argument("--max-packets", type=int, default=0)
    g = sub.add_parser("generate")
    g.add_argument("--out", required=True)
    g.add_argument("--truth")
    g.add_argument("--messages", type=int, default=100_000)
    g.add_argument("--symbols", type=int, choices=range(1, 9), default=3)
    g.add_argument("--symbol", default="SYN")
    g.add_argument("--price", type=int, default=1_000_000)
    g.add_argument("--seed", type=int, default=1)
    for name in ("research", "brief", "daily"):
        s = sub.add_parser(name)
        s.add_argument("--data", required=True)
        s.add_argument("--date", default="all")
        s.add_argument("--horizon-s", type=int, default=10)
        s.add_argument("--alpha", type=float, default=50.0)
        s.add_argument("--train-days", type=int, default=20)
        s.add_argument("--cost", type=float, default=0.5)
        s.add_argument("--rescore", action="store_true")
    a = p.parse_args(argv)
    if a.command == "generate":
        return generate(a)
    spark = session(a.master)
    if a.command in ("replay", "fetch"):
        return {"replay": replay, "fetch": fetch}[a.command](spark, a)
    cfg = panel.Config(horizon_s=a.horizon_s)
    if a.command in ("research", "daily"):
        for r in walk.walk(spark, a.data, cfg, a.date, a.alpha, a.train_days, a.cost, a.rescore):
            print(f"{r['date']}: IC {r['ic_spearman']:+.4f}  net {r['net_bps']:+.3f} bp (t {r['net_t']:+.2f})  DSR {r['deflated_sharpe']:.3f}  n {r['n']:,}")
    if a.command in ("brief", "daily"):
        print(brief.brief(spark, a.data, cfg))
    return 0


if __name__ == "__main__":
    sys.exit(main())
