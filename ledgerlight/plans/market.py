"""Queries over the driver's tables, one for each operator, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlight.functions import stats, wire
from ledgerlight.operators import books, model, panel, scoring, tape
from ledgerlight.plans import views
from ledgerlight.sources import deep, itch
from ledgerlight.sources.store import unscored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BY = ["symbol"]
E, Q, L = views.DEPTH_SQL, views.QUOTES_SQL, views.ORDERS_SQL
TICK = views.TICK
SAMPLE = 24 * 3600 * tape.SECOND


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def r6(x: Column) -> Column:
    return F.round(x, 6)


# Feeds


@query("""SELECT event_type AS msg_type, CAST(count(*) AS BIGINT) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM events GROUP BY event_type""")
def msg_mix(spark, sf):
    n = views.base(spark, sf).groupBy(F.col("event_type").alias("msg_type")).agg(F.count("*").alias("n"))
    return n.withColumn("pct", r6(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy())))


@query(f"WITH {E} SELECT symbol, seq, kind, price, size FROM depth WHERE symbol IN ('S1', 'S3', 'S5')")
def watchlist_filter(spark, sf):
    watch = spark.createDataFrame([("S1",), ("S3",), ("S5",)], "symbol string")
    return views.depth(spark, sf).join(F.broadcast(watch), "symbol", "left_semi").select("symbol", "seq", "kind", "price", "size")


@query(f"""WITH {E} SELECT symbol, seq, price, price BETWEEN 1 AND 2147483647 AS sound, price % 30000 <> 0 AS off_tick, coalesce(size, 0) = 0 AS empty
FROM depth WHERE kind IN ('level', 'trade')""")
def price_predicates(spark, sf):
    d = views.depth(spark, sf).where("kind in ('level', 'trade')")
    return d.select("symbol", "seq", "price", books.sound_price(F.col("price")).alias("sound"), (F.col("price") % 30000 != 0).alias("off_tick"), (F.coalesce("size", F.lit(0)) == 0).alias("empty"))


def segment_view(spark, sf):
    b, k = views.base(spark, sf), F.col("k")
    shift = F.when(k % 5 == 0, 3).when(k % 7 == 0, -2).otherwise(0)
    return b.select(F.col("symbol").alias("file"), F.col("seq").alias("packet_no"), F.call_function("div", F.col("seq"), F.lit(2500)).alias("session_id"), (F.col("seq") + shift).alias("first_sequence"), (k % 12).alias("message_count"), F.lit("ok").alias("status"))


SEGMENTS = f"""{views.BASE_SQL}, seg AS (
  SELECT symbol AS file, seq AS packet_no, seq // 2500 AS session_id, seq + CASE WHEN k % 5 = 0 THEN 3 WHEN k % 7 = 0 THEN -2 ELSE 0 END AS first_sequence, k % 12 AS message_count FROM base
), runs AS (
  SELECT *, coalesce(CAST(session_id <> lag(session_id) OVER (PARTITION BY file ORDER BY packet_no) AS INT), 0) AS session_change FROM seg
), numbered AS (
  SELECT *, sum(session_change) OVER (PARTITION BY file ORDER BY packet_no) AS run FROM runs
), expected AS (
  SELECT *, CASE WHEN message_count > 0 THEN max(CASE WHEN message_count > 0 THEN first_sequence + message_count END) OVER (PARTITION BY file, run ORDER BY packet_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS expect FROM numbered
)"""


@query(f"""WITH {SEGMENTS} SELECT file, packet_no, expect, coalesce(first_sequence > expect, false) AS gap, greatest(coalesce(first_sequence - expect, 0), 0) AS missing, coalesce(first_sequence < expect, false) AS regression FROM expected""")
def seq_gaps(spark, sf):
    return deep.continuity(segment_view(spark, sf)).select("file", "packet_no", "expect", "gap", "missing", "regression")


@query(f"""WITH {SEGMENTS} SELECT file, CAST(count(*) AS BIGINT) AS segments, CAST(count(*) FILTER (WHERE message_count = 0) AS BIGINT) AS heartbeats, CAST(count(*) FILTER (WHERE first_sequence > expect) AS BIGINT) AS gaps,
CAST(sum(greatest(coalesce(first_sequence - expect, 0), 0)) AS BIGINT) AS gap_messages, CAST(count(*) FILTER (WHERE first_sequence < expect) AS BIGINT) AS regressions, CAST(sum(session_change) AS BIGINT) AS session_changes FROM expected GROUP BY file""")
def transport_defects(spark, sf):
    found = deep.continuity(segment_view(spark, sf))
    return found.groupBy("file").agg(F.count("*").alias("segments"), F.count_if("heartbeat").alias("heartbeats"), F.count_if("gap").alias("gaps"), F.sum("missing").cast("bigint").alias("gap_messages"), F.count_if("regression").alias("regressions"), F.sum("session_change").cast("bigint").alias("session_changes"))


@query(f"""WITH {views.BASE_SQL} SELECT seq, price4 % 2147483647 AS price, k AS shares, seq * 4294967296 + k AS order_ref, CASE WHEN k % 2 = 0 THEN 'B' ELSE 'S' END AS side, symbol AS stock, ts_ns % 86400000000000 AS ts_ns, 36 AS frame_len FROM base""")
def wire_roundtrip(spark, sf):
    b = views.base(spark, sf)
    values = {"locate": F.lit(7), "ts_ns": F.col("ts_ns") % panel.DAY, "order_ref": F.col("seq") * 4294967296 + F.col("k"), "side": F.when(F.col("k") % 2 == 0, "B").otherwise("S"), "shares": F.col("k"), "stock": F.col("symbol"), "price": F.col("price4") % 2147483647}
    raw = b.select(F.col("seq").alias("n"), itch.encode("A", values, prefix=False).alias("body"))
    framed = raw.select(F.lit("f").alias("file"), F.col("n").alias("seq"), F.lit("A").alias("msg_type"), F.length("body").alias("frame_len"), "body", F.lit(None).cast("string").alias("defect"))
    return itch.decode(framed).select("seq", "price", "shares", "order_ref", "side", "stock", "ts_ns", "frame_len")


@query(f"""WITH {views.BASE_SQL} SELECT seq, CASE event_type WHEN 'view' THEN 'E' WHEN 'click' THEN 'U' WHEN 'purchase' THEN 'C' WHEN 'error' THEN 'P' ELSE 'Q' END AS msg_type,
CASE WHEN event_type <> 'signup' THEN seq END AS order_ref, CASE WHEN event_type = 'click' THEN seq * 3 END AS new_order_ref, k AS shares, CASE WHEN event_type IN ('click', 'error', 'signup') THEN price4 END AS price,
CASE WHEN event_type = 'purchase' THEN price4 END AS exec_price, CASE WHEN event_type = 'purchase' THEN k % 2 = 0 END AS printable, CASE WHEN event_type <> 'click' THEN seq * 1000003 END AS match_number, CASE WHEN event_type IN ('error', 'signup') THEN symbol END AS stock FROM base""")
def order_messages_roundtrip(spark, sf):
    b = views.base(spark, sf)
    values = {"order_ref": F.col("seq"), "new_order_ref": F.col("seq") * 3, "shares": F.col("k"), "price": F.col("price4"), "exec_price": F.col("price4"), "printable": F.col("k") % 2 == 0, "match_number": F.col("seq") * 1000003, "stock": F.col("symbol")}
    kinds = {"view": "E", "click": "U", "purchase": "C", "error": "P", "signup": "Q"}
    body = None
    for event, kind in kinds.items():
        test, made = F.col("event_type") == event, itch.encode(kind, values, prefix=False)
        body = F.when(test, made) if body is None else body.when(test, made)
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("event_type")]
    raw = b.select(F.lit("f").alias("file"), "seq", kind.alias("msg_type"), body.alias("body"), F.lit(None).cast("string").alias("defect"))
    return itch.decode(raw).select("seq", "msg_type", "order_ref", "new_order_ref", "shares", "price", "exec_price", "printable", "match_number", "stock")


@query(f"""WITH {views.BASE_SQL}, f AS (SELECT symbol AS file, k, CASE WHEN k % 50 = 0 THEN 'unknown_type' WHEN k % 50 = 1 THEN 'length_mismatch' WHEN k % 50 = 2 THEN 'truncated_tail' WHEN k % 50 = 3 THEN 'framing_error' END AS defect, k % 50 NOT IN (2, 3) AS whole FROM base)
SELECT file, CAST(count(*) FILTER (WHERE whole) AS BIGINT) AS messages, CAST(sum(CASE WHEN whole THEN k ELSE 0 END) AS BIGINT) AS bytes, CAST(count(*) FILTER (WHERE defect = 'unknown_type') AS BIGINT) AS unknown_type, CAST(count(*) FILTER (WHERE defect = 'framing_error') AS BIGINT) AS framing_errors,
CAST(count(*) FILTER (WHERE defect = 'length_mismatch') AS BIGINT) AS length_mismatch, CAST(sum(CASE WHEN defect = 'truncated_tail' THEN k ELSE 0 END) AS BIGINT) AS truncated_tail FROM f GROUP BY file""")
def frame_stats(spark, sf):
    b, m = views.base(spark, sf), F.col("k") % 50
    defect = F.when(m == 0, "unknown_type").when(m == 1, "length_mismatch").when(m == 2, "truncated_tail").when(m == 3, "framing_error")
    rows = b.select(F.col("symbol").alias("file"), "seq", F.lit("A").alias("msg_type"), F.col("k").cast("int").alias("frame_len"), F.when(~m.isin(2, 3), F.lit(b"x")).alias("body"), defect.alias("defect"))
    return itch.parse_stats(rows)


@query(f"""WITH {E} SELECT seq, CASE kind WHEN 'trade' THEN 'T' WHEN 'status' THEN 'H' ELSE 'X' END AS msg_type, symbol, CASE WHEN kind = 'trade' THEN size END AS size, CASE WHEN kind <> 'status' THEN price END AS price, CASE WHEN kind = 'trade' THEN iso END AS iso,
CASE WHEN kind = 'trade' THEN odd_lot END AS odd_lot, CASE WHEN kind = 'trade' THEN seq * 7 END AS trade_id, status, CASE WHEN kind = 'event' THEN 'M' END AS price_type FROM depth WHERE kind <> 'level'""")
def depth_messages_roundtrip(spark, sf):
    d, k = views.depth(spark, sf).where("kind <> 'level'"), F.col("kind")
    flags = F.when(F.col("iso"), 0x80).otherwise(0) + F.when(F.col("odd_lot"), 0x20).otherwise(0)
    head = [wire.put_little(F.col("ts_ns"), 8), wire.put_letters(F.col("symbol"), 8)]
    trade = F.concat(F.lit(b"T"), wire.put_big(flags, 1), *head, wire.put_little(F.col("size"), 4), wire.put_little(F.col("price"), 8), wire.put_little(F.col("seq") * 7, 8))
    state = F.concat(F.lit(b"H"), wire.put_letters(F.col("status"), 1), *head, wire.put_letters(F.lit("NA"), 4))
    official = F.concat(F.lit(b"XM"), *head, wire.put_little(F.col("price"), 8))
    kind = F.when(k == "trade", "T").when(k == "status", "H").otherwise("X")
    raw = d.select(F.lit("f").alias("file"), F.lit(1).cast("bigint").alias("packet_no"), "seq", kind.alias("msg_type"), F.when(k == "trade", trade).when(k == "status", state).otherwise(official).alias("body"), F.lit(None).cast("string").alias("defect"))
    return deep.decode(raw).select("seq", "msg_type", "symbol", "size", "price", "iso", "odd_lot", "trade_id", "status", "price_type")


@query(f"""WITH {E} SELECT seq, side, size, price - 5000000 AS price, complete, symbol, ts_ns FROM depth WHERE kind = 'level'""")
def depth_roundtrip(spark, sf):
    d = views.depth(spark, sf).where("kind = 'level'")
    body = F.concat(F.when(F.col("side") == "B", F.lit(b"8")).otherwise(F.lit(b"5")), F.when(F.col("complete"), F.lit(b"\x01")).otherwise(F.lit(b"\x00")), wire.put_little(F.col("ts_ns"), 8), wire.put_letters(F.col("symbol"), 8), wire.put_little(F.col("size"), 4), wire.put_little(F.col("price") - 5000000, 8))
    raw = d.select(F.lit("f").alias("file"), F.lit(1).cast("bigint").alias("packet_no"), "seq", F.when(F.col("side") == "B", "8").otherwise("5").alias("msg_type"), body.alias("body"), F.lit(None).cast("string").alias("defect"))
    return deep.decode(raw).select("seq", "side", "size", "price", F.col("event_complete").alias("complete"), "symbol", "ts_ns")


@query(f"""WITH {views.BASE_SQL}, msgs AS (SELECT symbol AS file, seq, CASE WHEN event_type = 'signup' THEN 'R' ELSE 'A' END AS msg_type, k % 8 AS locate, 'T' || CAST(k % 4 AS VARCHAR) AS stock FROM base),
named AS (SELECT *, last_value(CASE WHEN msg_type = 'R' THEN stock END IGNORE NULLS) OVER (PARTITION BY file, locate ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS symbol FROM msgs)
SELECT file, seq, msg_type, symbol FROM named WHERE symbol IN ('T1', 'T2')""")
def directory_resolve(spark, sf):
    b = views.base(spark, sf)
    rows = b.select(F.col("symbol").alias("file"), "seq", F.when(F.col("event_type") == "signup", "R").otherwise("A").alias("msg_type"), (F.col("k") % 8).cast("int").alias("locate"), F.concat(F.lit("T"), (F.col("k") % 4).cast("string")).alias("stock"))
    return books.resolved(rows, ["T1", "T2"]).select("file", "seq", "msg_type", "symbol")


@query(f"""WITH {views.BASE_SQL}, a AS (SELECT seq, price4, CAST((price4 * k + seq) * 100 + 1 AS DOUBLE) / 100.0 AS x FROM base) SELECT seq, printf('%d.%04d', price4 // 10000, price4 % 10000) AS price,
CASE WHEN x >= 1e9 THEN printf('$%.1fB', x / 1e9) WHEN x >= 1e6 THEN printf('$%.1fM', x / 1e6) WHEN x >= 1e3 THEN printf('$%.1fk', x / 1e3) ELSE printf('$%.0f', x) END AS amount FROM a""")
def text_formats(spark, sf):
    cents = (F.col("price4") * F.col("k") + F.col("seq")) * 100 + 1  # never between two texts
    return views.base(spark, sf).select("seq", wire.price_text(F.col("price4")).alias("price"), wire.money(cents.cast("double")).alias("amount"))


# Books by level


@query(f"""WITH {E}, last AS (SELECT symbol, side, price, arg_max(size, seq) AS size FROM depth WHERE kind = 'level' AND price BETWEEN 1 AND 2147483647 GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY symbol, side ORDER BY CASE WHEN side = 'B' THEN -price ELSE price END) AS INT) AS level FROM last WHERE size > 0) SELECT * FROM ranked WHERE level <= 5""")
def l2_levels_final(spark, sf):
    return books.final_levels(views.depth(spark, sf).where("kind = 'level'"), BY, 5)


@query(f"""WITH {E}, last AS (SELECT symbol, side, price, arg_max(size, seq) AS size FROM depth WHERE kind = 'level' AND price BETWEEN 1 AND 2147483647 GROUP BY ALL),
live AS (SELECT *, CASE WHEN side = 'B' THEN max(price) OVER (PARTITION BY symbol, side) ELSE min(price) OVER (PARTITION BY symbol, side) END AS best FROM last WHERE size > 0)
SELECT symbol, side, max(best) AS best, CAST(sum(size) AS BIGINT) AS depth FROM live WHERE abs(price - best) <= {4 * TICK} GROUP BY symbol, side""")
def l2_depth_within(spark, sf):
    levels = books.final_levels(views.depth(spark, sf).where("kind = 'level'"), BY)
    return books.depth_within(levels, BY, 4, TICK).withColumn("depth", F.col("depth").cast("bigint"))


@query(f"WITH {views.TOPS_SQL} SELECT symbol, seq, ts_ns, bid, bid_shares, ask, ask_shares, CAST(bid_levels AS BIGINT) AS bid_levels, CAST(ask_levels AS BIGINT) AS ask_levels, coalesce(bid > ask, false) AS crossed FROM tops")
def l2_stable_top(spark, sf):
    book = books.level_book(views.depth(spark, sf).where("kind = 'level'"), BY, TICK).where("complete")
    return book.select("symbol", "seq", "ts_ns", "bid", "bid_shares", "ask", "ask_shares", "bid_levels", "ask_levels", F.coalesce(F.col("bid") > F.col("ask"), F.lit(False)).alias("crossed"))


@query(f"""WITH {views.TOPS_SQL}, lev AS (SELECT symbol, CAST(count(*) FILTER (WHERE price BETWEEN 1 AND 2147483647) AS BIGINT) AS updates, CAST(count(*) FILTER (WHERE complete) AS BIGINT) AS transactions,
  CAST(count(*) FILTER (WHERE price BETWEEN 1 AND 2147483647 AND NOT complete) AS BIGINT) AS in_transition, CAST(count(*) FILTER (WHERE NOT price BETWEEN 1 AND 2147483647) AS BIGINT) AS bad_price FROM depth WHERE kind = 'level' GROUP BY symbol),
cr AS (SELECT symbol, CAST(count(*) FILTER (WHERE bid > ask) AS BIGINT) AS crossed FROM tops GROUP BY symbol),
tr AS (SELECT symbol, CAST(count(*) FILTER (WHERE price BETWEEN 1 AND 2147483647) AS BIGINT) AS trades FROM depth WHERE kind = 'trade' GROUP BY symbol)
SELECT symbol, updates, transactions, in_transition, bad_price, crossed, trades FROM lev JOIN cr USING (symbol) JOIN tr USING (symbol)""")
def l2_symbol_summary(spark, sf):
    return tape.symbol_summary(views.depth(spark, sf), BY, TICK).select("symbol", "updates", "transactions", "in_transition", "bad_price", "crossed", "trades")


@query(ORACLES["l2_stable_top"])
def stream_stable_top(spark, sf):
    """The same as a stream of the events' files, in one trigger, with the book in the state store. The tops go from the executors to the shared folder."""
    from ledgerlight.streaming import books as streams
    from ledgerlight.streaming.sink import landed

    streams.prepare(spark)
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    # a pattern, as a stream takes no path of a single file, and a filter by name would find no file of a table that is a folder
    updates = views.depth_of(spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]")).where("kind = 'level'")
    tops = streams.stream_level_book(updates, TICK).where("complete")
    return landed(tops.select("symbol", "seq", "ts_ns", "bid", "bid_shares", "ask", "ask_shares", "bid_levels", "ask_levels", F.coalesce(F.col("bid") > F.col("ask"), F.lit(False)).alias("crossed")))


# Tape

MERGED = f"""{views.TOPS_SQL}, merged AS (
  SELECT d.*, last_value(CASE WHEN t.seq IS NOT NULL THEN {{'bid': t.bid, 'bid_shares': t.bid_shares, 'ask': t.ask, 'ask_shares': t.ask_shares}} END IGNORE NULLS) OVER w AS stable,
    coalesce(last_value(CASE WHEN d.kind = 'status' THEN d.status END IGNORE NULLS) OVER w, '?') AS trading_status
  FROM depth d LEFT JOIN tops t ON t.symbol = d.symbol AND t.seq = d.seq WHERE d.kind <> 'trade' OR d.price BETWEEN 1 AND 2147483647
  WINDOW w AS (PARTITION BY d.symbol ORDER BY d.seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), quoted AS (
  SELECT *, stable.bid + stable.ask AS mid_x2, CASE WHEN 2 * price > stable.bid + stable.ask THEN 'buy' WHEN 2 * price < stable.bid + stable.ask THEN 'sell' ELSE 'unclassified' END AS aggressor FROM merged
)"""
SAMPLED = f"""{MERGED}, gridded AS (
  SELECT *, coalesce(CASE WHEN complete THEN ts_ns // {SAMPLE} END > max(CASE WHEN complete THEN ts_ns // {SAMPLE} END) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS grid,
    coalesce(kind = 'event' AND event IN ('O', 'C'), false) AS forced FROM quoted
), flushed AS (
  SELECT symbol, max(seq) + 1 AS seq, coalesce(arg_max(ts_ns, seq) FILTER (WHERE kind = 'trade' OR (kind = 'level' AND price BETWEEN 1 AND 2147483647)), 0) AS ts_ns, 'flush' AS kind,
    arg_max(stable, seq) AS stable, arg_max(trading_status, seq) AS trading_status FROM gridded GROUP BY symbol HAVING count(*) FILTER (WHERE complete) > 0
), sampled AS (
  SELECT symbol, seq, ts_ns, kind, price, size, odd_lot, iso, stable, trading_status, aggressor, grid, forced, grid OR forced AS sample FROM gridded
  UNION ALL BY NAME SELECT *, false AS grid, false AS forced, true AS sample FROM flushed
), numbered AS (
  SELECT *, coalesce(sum(CAST(sample AS INT)) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS interval_id FROM sampled
), sums AS (
  SELECT symbol, CAST(interval_id AS BIGINT) AS interval_id, max(CASE WHEN sample THEN seq END) AS at_seq, max(CASE WHEN sample THEN ts_ns END) AS ts_ns, any_value(stable) FILTER (WHERE sample) AS stable, any_value(trading_status) FILTER (WHERE sample) AS trading_status,
    CAST(count(*) FILTER (WHERE kind = 'trade') AS BIGINT) AS trades, CAST(coalesce(sum(size) FILTER (WHERE kind = 'trade'), 0) AS BIGINT) AS trade_shares,
    CAST(coalesce(sum(size) FILTER (WHERE kind = 'trade' AND aggressor = 'buy'), 0) AS BIGINT) AS buy_shares, CAST(coalesce(sum(size) FILTER (WHERE kind = 'trade' AND aggressor = 'sell'), 0) AS BIGINT) AS sell_shares,
    CAST(coalesce(sum(size) FILTER (WHERE kind = 'trade' AND aggressor = 'unclassified'), 0) AS BIGINT) AS unclassified_shares, CAST(coalesce(sum(price * size // 100) FILTER (WHERE kind = 'trade'), 0) AS BIGINT) AS notional_cents,
    coalesce(arg_max(price, seq) FILTER (WHERE kind = 'trade'), 0) AS last_price, CAST(count(*) FILTER (WHERE kind = 'trade' AND odd_lot) AS BIGINT) AS odd_lot_trades, CAST(count(*) FILTER (WHERE kind = 'trade' AND iso) AS BIGINT) AS sweep_trades
  FROM numbered GROUP BY symbol, interval_id HAVING bool_or(sample)
)"""


def merged_rows(spark, sf):
    return tape.merged(views.depth(spark, sf), BY, TICK)


@query(f"WITH {MERGED} SELECT symbol, seq, price, size, mid_x2, aggressor FROM quoted WHERE kind = 'trade'")
def lee_ready(spark, sf):
    return tape.classified(merged_rows(spark, sf)).select("symbol", "seq", "price", "size", "mid_x2", "aggressor")


@query(f"WITH {MERGED} SELECT symbol, seq, kind, trading_status FROM merged")
def status_ffill(spark, sf):
    return merged_rows(spark, sf).select("symbol", "seq", "kind", "trading_status")


@query(f"WITH {SAMPLED} SELECT symbol, seq, ts_ns FROM gridded WHERE grid")
def grid_samples(spark, sf):
    d = views.depth(spark, sf)
    marked = d.withColumn("grid", tape.is_grid_sample(F.col("ts_ns"), F.col("complete"), BY, SAMPLE))
    return marked.where("grid").select("symbol", "seq", "ts_ns")


@query(f"WITH {SAMPLED} SELECT symbol, seq, ts_ns, kind, forced FROM sampled WHERE forced OR kind = 'flush'")
def forced_samples(spark, sf):
    rows = tape.sampled(merged_rows(spark, sf), BY, SAMPLE)
    return rows.where("forced or kind = 'flush'").select("symbol", "seq", "ts_ns", "kind", "forced")


@query(f"""WITH {SAMPLED} SELECT symbol, interval_id, ts_ns, trades, trade_shares, buy_shares, sell_shares, unclassified_shares, notional_cents, last_price, odd_lot_trades, sweep_trades, trading_status FROM sums""")
def interval_tape(spark, sf):
    rows = tape.intervals(tape.sampled(merged_rows(spark, sf), BY, SAMPLE), BY)
    return rows.select("symbol", F.col("interval").alias("interval_id"), F.col("at.ts_ns").alias("ts_ns"), "trades", "trade_shares", "buy_shares", "sell_shares", "unclassified_shares", "notional_cents", "last_price", "odd_lot_trades", "sweep_trades", F.col("at.trading_status").alias("trading_status"))


@query(f"""WITH {SAMPLED}, near AS (
  SELECT s.symbol, s.at_seq, l.side, l.price, l.size, CASE WHEN l.side = 'B' THEN max(l.price) OVER (PARTITION BY s.symbol, s.at_seq, l.side) ELSE min(l.price) OVER (PARTITION BY s.symbol, s.at_seq, l.side) END AS best
  FROM sums s JOIN live l ON l.symbol = s.symbol AND l.seq <= s.at_seq AND (l.until IS NULL OR l.until > s.at_seq)
), book AS (
  SELECT symbol, at_seq, coalesce(sum(size) FILTER (WHERE side = 'B' AND best - price <= {4 * TICK}), 0) AS bid_depth, coalesce(sum(size) FILTER (WHERE side = 'S' AND price - best <= {4 * TICK}), 0) AS ask_depth,
    count(*) FILTER (WHERE side = 'B') AS bid_levels, count(*) FILTER (WHERE side = 'S') AS ask_levels FROM near GROUP BY ALL
) SELECT s.ts_ns, s.symbol, coalesce(stable.bid, 0) AS bid, coalesce(stable.bid_shares, 0) AS bid_shares, coalesce(stable.ask, 0) AS ask, coalesce(stable.ask_shares, 0) AS ask_shares, coalesce(stable.ask - stable.bid, -1) AS spread,
  CAST(coalesce(bid_depth, 0) AS BIGINT) AS bid_depth, CAST(coalesce(ask_depth, 0) AS BIGINT) AS ask_depth, CAST(coalesce(bid_levels, 0) AS BIGINT) AS bid_levels, CAST(coalesce(ask_levels, 0) AS BIGINT) AS ask_levels,
  trades, trade_shares, buy_shares, sell_shares, unclassified_shares, notional_cents, last_price, odd_lot_trades, sweep_trades, trading_status
FROM sums s LEFT JOIN book b ON b.symbol = s.symbol AND b.at_seq = s.at_seq""")
def feature_table(spark, sf):
    return tape.feature_table(views.depth(spark, sf), BY, SAMPLE, TICK)


@query(f"""WITH {views.BASE_SQL} SELECT symbol, arg_max(price4, seq) FILTER (WHERE k % 3 = 0 AND price4 BETWEEN 1 AND 2147483647) AS official_open, arg_max(price4, seq) FILTER (WHERE k % 3 = 1 AND price4 BETWEEN 1 AND 2147483647) AS official_close
FROM base WHERE event_type = 'signup' GROUP BY symbol""")
def official_prices(spark, sf):
    k = F.col("k")
    rows = views.base(spark, sf).where("event_type = 'signup'").select("symbol", F.lit("X").alias("msg_type"), F.lit(1).alias("packet_no"), "seq", F.col("price4").alias("price"), F.when(k % 3 == 0, "Q").when(k % 3 == 1, "M").otherwise("Z").alias("price_type"))
    return tape.official_prices(rows)


# Books by order


def order_events(spark, sf):
    return books.order_book_events(views.orders(spark, sf), BY)


@query(f"""WITH {L}, left_ AS (SELECT symbol, order_ref, any_value(own_shares) - sum(greatest(CASE WHEN unknown THEN 0 ELSE taken END, 0)) AS rest FROM outcome GROUP BY symbol, order_ref),
final AS (SELECT a.symbol, a.side, a.price, coalesce(l.rest, a.shares) AS rest FROM feed a LEFT JOIN left_ l ON l.symbol = a.symbol AND l.order_ref = a.order_ref WHERE a.msg_type = 'A'),
lev AS (SELECT symbol, side, price, CAST(sum(rest) AS BIGINT) AS shares, CAST(count(*) AS BIGINT) AS orders FROM final WHERE rest > 0 GROUP BY ALL)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY symbol, side ORDER BY CASE WHEN side = 'B' THEN -price ELSE price END) AS INT) AS level FROM lev) WHERE level <= 5""")
def l3_level_book(spark, sf):
    return books.state_levels(books.order_book_states(views.orders(spark, sf), BY), BY, 5)


@query(f"""WITH {L}, n AS (SELECT symbol, count(*) FILTER (WHERE msg_type = 'E' AND NOT unknown) AS executes, count(*) FILTER (WHERE msg_type = 'X' AND NOT unknown) AS cancels, count(*) FILTER (WHERE msg_type = 'D' AND NOT unknown) AS deletes,
  count(*) FILTER (WHERE msg_type = 'E' AND unknown) AS unknown_ref_exec, count(*) FILTER (WHERE msg_type = 'X' AND unknown) AS unknown_ref_cancel, count(*) FILTER (WHERE msg_type = 'D' AND unknown) AS unknown_ref_delete,
  count(*) FILTER (WHERE msg_type = 'E' AND NOT unknown AND taken < shares) AS overfill, count(*) FILTER (WHERE msg_type = 'X' AND NOT unknown AND taken < shares) AS overcancel,
  count(DISTINCT order_ref) FILTER (WHERE NOT unknown AND taken_before + wanted >= own_shares) AS dead FROM outcome GROUP BY symbol),
a AS (SELECT symbol, count(*) AS adds FROM feed WHERE msg_type = 'A' GROUP BY symbol)
SELECT a.symbol, adds, executes, cancels, deletes, unknown_ref_exec, unknown_ref_cancel, unknown_ref_delete, overfill, overcancel, adds - dead AS live_orders,
  unknown_ref_exec + unknown_ref_cancel + unknown_ref_delete + overfill + overcancel AS corruption FROM a JOIN n ON n.symbol = a.symbol""")
def l3_diagnostics(spark, sf):
    return books.state_diagnostics(books.order_book_states(views.orders(spark, sf), BY), BY).select("symbol", "adds", "executes", "cancels", "deletes", "unknown_ref_exec", "unknown_ref_cancel", "unknown_ref_delete", "overfill", "overcancel", "live_orders", "corruption")


@query(f"""WITH {L}, p AS (SELECT symbol, seq, shares, CASE WHEN unknown THEN 0 ELSE own_price END AS price FROM outcome WHERE msg_type = 'E')
SELECT symbol, CAST(count(*) AS BIGINT) AS trades, CAST(sum(shares) AS BIGINT) AS shares_traded, CAST(sum(shares * price // 10000) AS BIGINT) AS notional_dollars, CAST(0 AS BIGINT) AS hidden_trades, CAST(0 AS BIGINT) AS hidden_shares, arg_max(price, seq) AS last_price FROM p GROUP BY symbol""")
def l3_tape(spark, sf):
    return books.tape(order_events(spark, sf), BY)


@query(f"""WITH {L} SELECT symbol, seq, msg_type, CASE WHEN msg_type = 'A' THEN 'adds' WHEN unknown THEN 'unknown' WHEN taken < shares AND msg_type <> 'D' THEN 'clamped' ELSE 'taken' END AS outcome
FROM (SELECT symbol, seq, msg_type, NULL AS unknown, NULL AS taken, shares FROM feed WHERE msg_type = 'A' UNION ALL SELECT symbol, seq, msg_type, unknown, taken, shares FROM outcome)""")
def l3_outcomes(spark, sf):
    e = order_events(spark, sf)
    has = lambda *names: F.exists("notes", lambda n: n.isin(*names))
    kind = F.when(has("adds"), "adds").when(F.exists("notes", lambda n: n.startswith("unknown")), "unknown").when(has("overfill", "overcancel"), "clamped").otherwise("taken")
    return e.select("symbol", "seq", "msg_type", kind.alias("outcome"))


@query(f"""WITH {views.TOPS_SQL}, got AS (SELECT row_number() OVER (ORDER BY seq) AS nth, bid, ask FROM tops), want AS (
  SELECT row_number() OVER (ORDER BY seq) AS nth, CASE WHEN seq % 97 = 0 THEN bid + 1 ELSE bid END AS bid, ask FROM tops WHERE seq < (SELECT max(seq) - 50 FROM tops))
SELECT CASE WHEN want.nth IS NULL THEN 'extra' ELSE 'mismatch' END AS reason, CAST(count(*) AS BIGINT) AS n FROM got LEFT JOIN want ON want.nth = got.nth
WHERE want.nth IS NULL OR coalesce(got.bid, 0) <> coalesce(want.bid, 0) GROUP BY 1""")
def verify_outer(spark, sf):
    book = books.level_book(views.depth(spark, sf).where("kind = 'level'"), BY, TICK).where("complete").withColumn("msg_type", F.lit("L"))
    end = book.agg(F.max("seq").alias("end"))
    zero = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("bid_shares", "ask", "ask_shares")]
    bid = F.coalesce(F.when(F.col("seq") % 97 == 0, F.col("bid") + 1).otherwise(F.col("bid")), F.lit(0)).alias("bid")
    truth = book.crossJoin(F.broadcast(end)).where("seq < end - 50").select("seq", "msg_type", "ts_ns", bid, *zero)
    return books.verify(book, truth).groupBy("reason").agg(F.count("*").alias("n"))


# Panel


def two(spark, sf):
    return panel.two_sided(views.quotes(spark, sf))


KEY = ["date", "symbol"]
W = "PARTITION BY date, symbol ORDER BY ts, seq"


@query(f"WITH {Q} SELECT symbol, seq, ts, mid_x2, spread FROM two")
def quote_filter(spark, sf):
    return two(spark, sf).select("symbol", "seq", "ts", "mid_x2", "spread")


@query(f"""WITH {Q} SELECT symbol, seq, round(CASE WHEN bid_shares + ask_shares > 0 THEN (bid_shares - ask_shares) / (bid_shares + ask_shares) ELSE 0 END, 6) AS queue_imbalance,
round(CASE WHEN bid_depth + ask_depth > 0 THEN (bid_depth - ask_depth) / (bid_depth + ask_depth) ELSE 0 END, 6) AS depth_imbalance,
round(CASE WHEN buy_shares + sell_shares > 0 THEN (buy_shares - sell_shares) / (buy_shares + sell_shares) ELSE 0 END, 6) AS flow_imbalance FROM two""")
def feat_imbalance(spark, sf):
    out = panel.with_features(two(spark, sf), KEY)
    return out.select("symbol", "seq", *[r6(F.col(c)).alias(c) for c in ("queue_imbalance", "depth_imbalance", "flow_imbalance")])


@query(f"WITH {Q} SELECT symbol, seq, round(spread / 100.0, 6) AS spread_ticks, round(spread / (mid_x2 / 2.0) * 10000.0, 6) AS spread_bps, CAST(trades AS DOUBLE) AS trade_intensity FROM two")
def feat_spread(spark, sf):
    return panel.with_features(two(spark, sf), KEY).select("symbol", "seq", r6(F.col("spread_ticks")).alias("spread_ticks"), r6(F.col("spread_bps")).alias("spread_bps"), "trade_intensity")


@query(f"WITH {Q} SELECT symbol, seq, round(CASE WHEN bid_shares + ask_shares > 0 THEN least(greatest((bid_depth + ask_depth) / (bid_shares + ask_shares), 0), 100) ELSE 0 END, 6) AS depth_ratio FROM two")
def feat_depth_ratio(spark, sf):
    return panel.with_features(two(spark, sf), KEY).select("symbol", "seq", r6(F.col("depth_ratio")).alias("depth_ratio"))


LOGS = f"{Q}, logs AS (SELECT *, ln(mid_x2 / 2.0) AS lm FROM two), rets AS (SELECT *, (lm - lag(lm, 1) OVER ({W})) * 10000 AS ret_1, (lm - lag(lm, 5) OVER ({W})) * 10000 AS ret_5, (lm - lag(lm, 30) OVER ({W})) * 10000 AS ret_30 FROM logs)"


@query(f"WITH {LOGS} SELECT symbol, seq, round(ret_1, 6) AS ret_1, round(ret_5, 6) AS ret_5, round(ret_30, 6) AS ret_30 FROM rets")
def feat_returns(spark, sf):
    return panel.with_features(two(spark, sf), KEY).select("symbol", "seq", *[r6(F.col(c)).alias(c) for c in ("ret_1", "ret_5", "ret_30")])


@query(f"WITH {LOGS} SELECT symbol, seq, round(coalesce(CASE WHEN count(ret_1) OVER ({W} ROWS 29 PRECEDING) >= 10 THEN stddev_samp(ret_1) OVER ({W} ROWS 29 PRECEDING) END, 0), 6) AS vol_30 FROM rets")
def feat_vol(spark, sf):
    return panel.with_features(two(spark, sf), KEY).select("symbol", "seq", r6(F.col("vol_30")).alias("vol_30"))


@query(f"""WITH {Q}, s AS (SELECT *, buy_shares - sell_shares AS signed, CASE WHEN count(*) OVER ({W} ROWS 299 PRECEDING) >= 30 THEN avg(abs(buy_shares - sell_shares)) OVER ({W} ROWS 299 PRECEDING) END AS scale FROM two)
SELECT symbol, seq, round(CASE WHEN scale > 0 THEN greatest(least(signed / scale, 10), -10) ELSE 0 END, 6) AS signed_flow_norm FROM s""")
def feat_flow_norm(spark, sf):
    return panel.with_features(two(spark, sf), KEY).select("symbol", "seq", r6(F.col("signed_flow_norm")).alias("signed_flow_norm"))


@query(f"""WITH {Q}, f AS (SELECT date, symbol, ts, seq, round(spread / 100.0, 8) AS x, CAST(trades AS DOUBLE) AS y FROM two),
z AS (SELECT *, count(x) OVER w AS n, avg(x) OVER w AS mx, stddev_samp(x) OVER w AS sx, avg(y) OVER w AS my, stddev_samp(y) OVER w AS sy FROM f WINDOW w AS ({W} ROWS 199 PRECEDING))
SELECT symbol, seq, round(CASE WHEN n >= 50 THEN CASE WHEN sx > 0 THEN (x - mx) / sx ELSE 0 END END, 6) AS spread_ticks, round(CASE WHEN n >= 50 THEN CASE WHEN sy > 0 THEN (y - my) / sy ELSE 0 END END, 6) AS trade_intensity FROM z""")
def feat_zscore(spark, sf):
    out = panel.standardised(panel.with_features(two(spark, sf), KEY), KEY, 200, 50, ["spread_ticks", "trade_intensity"])
    return out.select("symbol", "seq", r6(F.col("spread_ticks")).alias("spread_ticks"), r6(F.col("trade_intensity")).alias("trade_intensity"))


TRADEABLE = f"""{Q}, g AS (SELECT *, spread / (mid_x2 / 2.0) * 10000.0 AS spread_bps, coalesce(ts - lag(ts) OVER ({W}), 0) / 1e9 AS gap_s FROM two),
m AS (SELECT *, CASE WHEN count(*) OVER ({W} ROWS UNBOUNDED PRECEDING) >= 30 THEN median(spread_bps) OVER ({W} ROWS UNBOUNDED PRECEDING) END AS med FROM g),
kept AS (SELECT * FROM m WHERE spread_bps > 0 AND spread_bps <= least(8.0, 1.2 * coalesce(med, 8.0)) AND gap_s <= 30 AND bid_shares >= 150 AND ask_shares >= 150)"""
CFG = panel.Config(session_only=False, warmup_s=0, min_rows_per_symbol=10, zscore_window=200, zscore_min_periods=50, max_spread_bps=8.0, max_spread_ratio=1.2, min_touch_shares=150, horizon_s=30, tolerance_s=20)


def kept_rows(spark, sf):
    return panel.tradeable(panel.with_features(two(spark, sf), KEY), KEY, CFG)


@query(f"WITH {TRADEABLE} SELECT symbol, seq, round(spread_bps, 6) AS spread_bps, round(gap_s, 6) AS gap_s FROM kept")
def tradeable_filter(spark, sf):
    return kept_rows(spark, sf).select("symbol", "seq", r6(F.col("spread_bps")).alias("spread_bps"), r6(F.col("gap_s")).alias("gap_s"))


@query(f"""WITH {Q}, g AS (SELECT *, spread / (mid_x2 / 2.0) * 10000.0 AS spread_bps FROM two)
SELECT symbol, seq, round(CASE WHEN count(*) OVER ({W} ROWS UNBOUNDED PRECEDING) >= 30 THEN median(spread_bps) OVER ({W} ROWS UNBOUNDED PRECEDING) END, 6) AS median FROM g""")
def running_median(spark, sf):
    out = panel.running_median(panel.with_features(two(spark, sf), KEY), KEY, "spread_bps", 30)
    return out.select("symbol", "seq", r6(F.col("median")).alias("median"))


@query(f"""WITH {TRADEABLE}, f AS (SELECT *, min({{'ts': ts, 'seq': seq, 'mid_x2': mid_x2}}) OVER (PARTITION BY date, symbol ORDER BY ts RANGE BETWEEN 30000000000 FOLLOWING AND 50000000000 FOLLOWING) AS nxt FROM kept)
SELECT symbol, seq, round(ln(nxt.mid_x2 / mid_x2) * 10000, 6) AS fwd_bps, nxt.ts AS fwd_ts FROM f""")
def forward_return(spark, sf):
    out = panel.with_forward_return(kept_rows(spark, sf), KEY, 30, 20)
    return out.select("symbol", "seq", r6(F.col("fwd_bps")).alias("fwd_bps"), "fwd_ts")


REAL = f"{views.BASE_SQL}, real AS (SELECT symbol, seq, ts_ns AS ts FROM base), fst AS (SELECT *, min(ts) OVER (PARTITION BY symbol) AS first_ts FROM real)"


def real_time(spark, sf):
    return views.base(spark, sf).select("symbol", "seq", F.col("ts_ns").alias("ts"))


@query(f"""WITH {REAL}, s AS (SELECT *, (ts % 86400000000000) // 1000000000 AS sod, month(make_timestamp(first_ts // 1000)) IN (11, 12, 1, 2) AS winter FROM fst)
SELECT symbol, seq, ts FROM s WHERE CASE WHEN winter THEN sod >= 52200 AND sod < 75600 ELSE sod >= 48600 AND sod < 72000 END""")
def session_window(spark, sf):
    return panel.in_session(real_time(spark, sf), BY)


@query(f"WITH {REAL} SELECT symbol, seq, ts FROM fst WHERE ts >= first_ts + 864000000000000")
def warmup(spark, sf):
    return panel.after_warmup(real_time(spark, sf), BY, 864000)


@query(f"WITH {views.BASE_SQL}, n AS (SELECT symbol, event_type, seq, ts_ns AS ts, count(*) OVER (PARTITION BY symbol, event_type) AS n FROM base) SELECT symbol, event_type, seq, ts FROM n WHERE n >= 200")
def min_rows(spark, sf):
    rows = views.base(spark, sf).select("symbol", "event_type", "seq", F.col("ts_ns").alias("ts"))
    return panel.enough_rows(rows, ["symbol", "event_type"], 200)


def imbalance_sql(a: str, b: str) -> str:
    return f"CASE WHEN {a} + {b} > 0 THEN ({a} - {b}) / ({a} + {b}) ELSE 0 END"


PANEL = f"""{LOGS}, scaled AS (
  SELECT *, buy_shares - sell_shares AS signed, CASE WHEN count(*) OVER ({W} ROWS 299 PRECEDING) >= 30 THEN avg(abs(buy_shares - sell_shares)) OVER ({W} ROWS 299 PRECEDING) END AS scale,
    spread / (mid_x2 / 2.0) * 10000.0 AS spread_bps, coalesce(ts - lag(ts) OVER ({W}), 0) / 1e9 AS gap_s,
    coalesce(CASE WHEN count(ret_1) OVER ({W} ROWS 29 PRECEDING) >= 10 THEN stddev_samp(ret_1) OVER ({W} ROWS 29 PRECEDING) END, 0) AS vol_30 FROM rets
), feats AS (
  SELECT date, symbol, ts, seq, mid_x2, bid_shares, ask_shares, spread_bps, gap_s, {imbalance_sql("bid_shares", "ask_shares")} AS queue_imbalance, {imbalance_sql("bid_depth", "ask_depth")} AS depth_imbalance,
    {imbalance_sql("buy_shares", "sell_shares")} AS flow_imbalance, CASE WHEN scale > 0 THEN greatest(least(signed / scale, 10), -10) ELSE 0 END AS signed_flow_norm, spread / 100.0 AS spread_ticks,
    CAST(trades AS DOUBLE) AS trade_intensity, ret_1, ret_5, ret_30, vol_30, least(greatest((bid_depth + ask_depth) / (bid_shares + ask_shares), 0), 100) AS depth_ratio FROM scaled
), trail AS (
  SELECT *, CASE WHEN count(*) OVER ({W} ROWS UNBOUNDED PRECEDING) >= 30 THEN median(spread_bps) OVER ({W} ROWS UNBOUNDED PRECEDING) END AS med, {", ".join(f"count({c}) OVER w AS n_{c}, avg({c}) OVER w AS m_{c}, stddev_samp({c}) OVER w AS s_{c}" for c in panel.FEATURES)}
  FROM feats WINDOW w AS ({W} ROWS 199 PRECEDING)
), kept AS (
  SELECT * FROM trail WHERE spread_bps > 0 AND spread_bps <= least(8.0, 1.2 * coalesce(med, 8.0)) AND gap_s <= 30 AND bid_shares >= 150 AND ask_shares >= 150
), ahead AS (
  SELECT *, min({{'ts': ts, 'seq': seq, 'mid_x2': mid_x2}}) OVER (PARTITION BY date, symbol ORDER BY ts RANGE BETWEEN 30000000000 FOLLOWING AND 50000000000 FOLLOWING) AS nxt FROM kept
), scores AS (
  SELECT date, symbol, seq, {", ".join(f"round(CASE WHEN n_{c} >= 50 THEN CASE WHEN s_{c} > 0 THEN ({c} - m_{c}) / s_{c} ELSE 0 END END, 4) AS {c}" for c in panel.FEATURES)}, round(spread_bps, 4) AS spread_bps, round(ln(nxt.mid_x2 / mid_x2) * 10000, 4) AS fwd_bps FROM ahead
)"""


@query(f"WITH {PANEL} SELECT * FROM scores WHERE {' AND '.join(f'{c} IS NOT NULL' for c in [*panel.FEATURES, 'fwd_bps'])}")
def panel_rows(spark, sf):
    out = panel.build_panel(views.quotes(spark, sf), CFG)
    return out.select("date", "symbol", "seq", *[F.round(F.col(c), 4).alias(c) for c in [*panel.FEATURES, "spread_bps", "fwd_bps"]])


# Model and scores

SCORED = f"""{Q}, scored AS (SELECT date, symbol, ts, seq, (buy_shares - 25) / 10.0 AS pred, ((spread * 7) % 1000 - 500) / 100.0 AS fwd_bps, spread / (mid_x2 / 2.0) * 10000.0 AS spread_bps, ((sell_shares * 37) % 100 - 50) / 10.0 AS ret_5 FROM two),
pos AS (SELECT *, sign(pred) AS sgn, sign(pred) * fwd_bps AS gross, 0.5 * spread_bps AS cost, sign(pred) * fwd_bps - CASE WHEN pred <> 0 THEN 0.5 * spread_bps ELSE 0 END AS net FROM scored)"""


def scored(spark, sf):
    t = two(spark, sf)
    return t.select("date", "symbol", "ts", "seq", ((F.col("buy_shares") - 25) / 10.0).alias("pred"), (((F.col("spread") * 7) % 1000 - 500) / 100.0).alias("fwd_bps"), (F.col("spread") / (F.col("mid_x2") / 2.0) * 10000.0).alias("spread_bps"), (((F.col("sell_shares") * 37) % 100 - 50) / 10.0).alias("ret_5"))


RANKS = "(SELECT avg_rank.*, rank() OVER (ORDER BY pred) + (count(*) OVER (PARTITION BY pred) - 1) / 2.0 AS rp, rank() OVER (ORDER BY fwd_bps) + (count(*) OVER (PARTITION BY fwd_bps) - 1) / 2.0 AS ry, rank() OVER (ORDER BY -ret_5) + (count(*) OVER (PARTITION BY ret_5) - 1) / 2.0 AS rr FROM pos avg_rank)"


@query(f"WITH {SCORED}, ranks AS {RANKS} SELECT round(corr(pred, fwd_bps), 6) AS ic_pearson, round(corr(rp, ry), 6) AS ic_spearman FROM ranks")
def score_ic(spark, sf):
    rows = scored(spark, sf)
    return scoring.spearman(rows, "pred", "fwd_bps").crossJoin(rows.agg(scoring.correlation("pred", "fwd_bps").alias("p"))).select(r6(F.col("p")).alias("ic_pearson"), r6(F.col("ic")).alias("ic_spearman"))


@query(f"WITH {SCORED}, ranks AS {RANKS} SELECT round(corr(rr, ry), 6) AS baseline_reversal_ic FROM ranks")
def reversal_baseline(spark, sf):
    return scoring.spearman(scored(spark, sf).withColumn("rev", -F.col("ret_5")), "rev", "fwd_bps").select(r6(F.col("ic")).alias("baseline_reversal_ic"))


@query(f"WITH {SCORED} SELECT round(avg(CASE WHEN sgn <> 0 AND fwd_bps <> 0 THEN CAST(sign(fwd_bps) = sgn AS DOUBLE) END), 6) AS hit_rate, round(avg(CASE WHEN sgn <> 0 THEN CAST(fwd_bps <> 0 AS DOUBLE) END), 6) AS moved_fraction FROM pos")
def score_hit(spark, sf):
    got = scoring.positions(scored(spark, sf)).agg(*scoring.hits())
    return got.select(*[r6(F.col(c)).alias(c) for c in got.columns])


@query(f"WITH {SCORED} SELECT round(avg(gross), 6) AS gross_bps, round(avg(net), 6) AS net_bps, round(avg(CAST(abs(pred) > cost AS DOUBLE)), 6) AS tradeable_fraction, round(avg(spread_bps), 6) AS mean_spread_bps FROM pos")
def score_cost(spark, sf):
    got = scoring.summary(scoring.positions(scored(spark, sf)))
    return got.select(*[r6(F.col(c)).alias(c) for c in ("gross_bps", "net_bps", "tradeable_fraction", "mean_spread_bps")])


@query(f"WITH {SCORED} SELECT CAST(count(*) AS BIGINT) AS n, round(avg(net) / stddev_pop(net), 6) AS sharpe_per_bar, round(avg(net) / stddev_pop(net) * sqrt(count(*)), 6) AS sharpe_daily FROM pos")
def score_sharpe(spark, sf):
    got = scoring.summary(scoring.positions(scored(spark, sf)))
    return got.select("n", r6(F.col("sharpe_per_bar")).alias("sharpe_per_bar"), r6(F.col("sharpe_per_bar") * F.sqrt("n")).alias("sharpe_daily"))


@query(f"""WITH {SCORED}, m AS (SELECT avg(gross) AS mu FROM pos), e AS (SELECT date, symbol, ts, seq, gross - mu AS e FROM pos, m), l AS (SELECT e, {", ".join(f"lag(e, {k}) OVER (ORDER BY date, symbol, ts, seq) AS l{k}" for k in range(1, 11))} FROM e)
SELECT CAST(count(*) AS BIGINT) AS n, round(sum(e * e), 4) AS gross_0, {", ".join(f"round(sum(e * l{k}), 4) AS gross_{k}" for k in range(1, 11))} FROM l""")
def hac_terms(spark, sf):
    held = scoring.positions(scored(spark, sf))
    got = scoring.lag_products(held, ["gross"], 10, ["date", "symbol", "ts", "seq"])
    return got.select("n", *[F.round(F.col(f"gross_{k}"), 4).alias(f"gross_{k}") for k in range(11)])


GRAM = [("x", "spread"), ("y", "trades"), ("z", "bid_shares")]


@query(f"""WITH {Q}, f AS (SELECT spread / 100.0 AS x, CAST(trades AS DOUBLE) AS y, bid_shares / 100.0 AS z, ask_shares / 100.0 AS fwd_bps FROM two)
SELECT CAST(count(*) AS BIGINT) AS n, round(sum(fwd_bps), 4) AS sy, round(sum(fwd_bps * fwd_bps), 4) AS syy, round(sum(x), 4) AS s_0, round(sum(y), 4) AS s_1, round(sum(z), 4) AS s_2, round(sum(x * fwd_bps), 4) AS t_0, round(sum(y * fwd_bps), 4) AS t_1, round(sum(z * fwd_bps), 4) AS t_2,
round(sum(x * x), 4) AS p_0_0, round(sum(x * y), 4) AS p_0_1, round(sum(x * z), 4) AS p_0_2, round(sum(y * y), 4) AS p_1_1, round(sum(y * z), 4) AS p_1_2, round(sum(z * z), 4) AS p_2_2 FROM f""")
def ridge_gram(spark, sf):
    rows = two(spark, sf).select((F.col("spread") / 100.0).alias("x"), F.col("trades").cast("double").alias("y"), (F.col("bid_shares") / 100.0).alias("z"), (F.col("ask_shares") / 100.0).alias("fwd_bps"))
    got = model.moments(rows, ["x", "y", "z"])
    return got.select("n", *[F.round(F.col(c), 4).alias(c) for c in got.columns if c != "n"])


@query(f"""WITH {Q}, f AS (SELECT spread / 100.0 AS x, CAST(trades AS DOUBLE) AS y FROM two)
SELECT round(avg(x), 6) AS mean_x, round(stddev_pop(x), 6) AS std_x, round(avg(y), 6) AS mean_y, round(stddev_pop(y), 6) AS std_y FROM f""")
def feature_moments(spark, sf):
    rows = two(spark, sf).select((F.col("spread") / 100.0).alias("x"), F.col("trades").cast("double").alias("y"))
    return rows.agg(*[r6(f(c)).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


COEFFICIENTS = [0.11, -0.07, 0.05, 0.03, -0.02, 0.01, -0.15, 0.04, 0.02, -0.01, 0.06]


@query(f"""WITH {LOGS}, v AS (SELECT *, (bid_shares - ask_shares) / (bid_shares + ask_shares) AS f0, spread / 100.0 AS f4, CAST(trades AS DOUBLE) AS f5, coalesce(ret_1, 0) AS f6 FROM rets)
SELECT symbol, seq, round(((f0 - 0.1) / 0.5 * 0.11 + (f4 - 0.1) / 0.5 * -0.02 + (f5 - 0.1) / 0.5 * 0.01 + (f6 - 0.1) / 0.5 * -0.15 + 0.2) * 3.0, 6) AS pred FROM v""")
def ridge_predict(spark, sf):
    fitted = model.Model("", [], 0, panel.FEATURES, [b if i in (0, 4, 5, 6) else 0.0 for i, b in enumerate(COEFFICIENTS)], 0.2, [0.1] * 11, [0.5] * 11, 3.0, 50.0, "")
    rows = panel.with_features(two(spark, sf), KEY).na.fill(0.0, panel.FEATURES)
    return rows.select("symbol", "seq", r6(fitted.prediction()).alias("pred"))


@query(f"""WITH {SCORED}, m AS (SELECT CAST(count(*) AS BIGINT) AS n, string_agg(DISTINCT symbol, '|' ORDER BY symbol) AS symbols, string_agg(DISTINCT date, '|' ORDER BY date) AS dates, avg(fwd_bps) AS mean, stddev_pop(fwd_bps) AS sd FROM scored)
SELECT n, symbols, substr(sha256(CAST(n AS VARCHAR) || dates || symbols || printf('%.9f:%.9f', mean, sd)), 1, 16) AS fingerprint FROM m""")
def training_fingerprint(spark, sf):
    return model.fingerprint_row(scored(spark, sf))


CARDS = """cards AS (SELECT CAST(o_custkey % 40 AS BIGINT) AS day, CAST(count(*) AS BIGINT) AS n, round(avg(o_totalprice) / 1000 - 150, 4) AS net_bps, round(avg(o_orderkey % 100) / 100.0, 4) AS ic_spearman FROM orders GROUP BY 1)"""


def cards(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    rows = o.groupBy((F.col("o_custkey") % 40).alias("day")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice") / 1000 - 150, 4).alias("net_bps"), F.round(F.avg(F.col("o_orderkey") % 100) / 100.0, 4).alias("ic_spearman"))
    blank = {c: F.col("ic_spearman") for c in ("hit_rate", "gross_bps", "mean_spread_bps", "tradeable_fraction", "baseline_reversal_ic", "moved_fraction", "sharpe_per_bar")}
    return rows.withColumns(blank)


@query(f"""WITH {CARDS} SELECT CAST(count(*) AS BIGINT) AS days, CAST(sum(n) AS BIGINT) AS rows, round(sum(ic_spearman * n) / sum(n), 6) AS ic, round(sum(net_bps * n) / sum(n), 6) AS net_bps,
round(avg(net_bps) / (stddev_samp(net_bps) / sqrt(count(*))), 5) AS t_across_days, round(min(net_bps), 4) AS worst_day_net, round(max(net_bps), 4) AS best_day_net, CAST(count(*) FILTER (WHERE net_bps > 0) AS BIGINT) AS days_positive FROM cards""")
def pooled_stats(spark, sf):
    got = scoring.pooled(cards(spark, sf))
    return got.select("days", "rows", r6(F.col("ic")).alias("ic"), r6(F.col("net_bps")).alias("net_bps"), F.round("t_across_days", 5).alias("t_across_days"), F.round("worst_day_net", 4).alias("worst_day_net"), F.round("best_day_net", 4).alias("best_day_net"), "days_positive")


@query(f"""WITH {TRADEABLE}, raw AS (SELECT symbol, CAST(count(*) AS BIGINT) AS bars, CAST(sum(trades) AS BIGINT) AS trades, CAST(sum(trade_shares) AS BIGINT) AS volume, CAST(sum(notional_cents) AS BIGINT) AS notional_cents,
  round(CASE WHEN sum(buy_shares) + sum(sell_shares) > 0 THEN (sum(buy_shares) - sum(sell_shares)) / (sum(buy_shares) + sum(sell_shares)) ELSE 0 END, 6) AS flow FROM two GROUP BY symbol),
k AS (SELECT symbol, CAST(count(*) AS BIGINT) AS kept, round(median(spread_bps), 6) AS spread FROM kept GROUP BY symbol) SELECT raw.*, coalesce(kept, 0) AS kept, spread FROM raw LEFT JOIN k ON k.symbol = raw.symbol""")
def market_report(spark, sf):
    from ledgerlight.plans.brief import session_report

    out = session_report(two(spark, sf), kept_rows(spark, sf))
    return out.select("symbol", "bars", "trades", "volume", "notional_cents", r6(F.col("flow")).alias("flow"), "kept", r6(F.col("spread")).alias("spread"))


@query("""WITH days AS (SELECT DISTINCT strftime(o_orderdate, '%Y%m%d') AS day FROM orders), models AS (SELECT day AS through FROM days WHERE substr(day, 7, 2) IN ('01', '15'))
SELECT day, max(through) AS through FROM days LEFT JOIN models ON through < day GROUP BY day""")
def model_asof(spark, sf):
    from ledgerlight.plans.walk import models_before

    days = spark.read.parquet(f"{sf}/orders.parquet").select(F.date_format("o_orderdate", "yyyyMMdd").alias("day")).distinct()
    models = days.where(F.substring("day", 7, 2).isin("01", "15")).select(F.col("day").alias("through"))
    return models_before(days, models)


@query("""SELECT DISTINCT strftime(o_orderdate, '%Y%m%d') AS day FROM orders WHERE strftime(o_orderdate, '%Y%m%d') NOT IN (SELECT strftime(o_orderdate, '%Y%m%d') FROM orders WHERE o_orderstatus = 'P')""")
def scored_anti(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.date_format("o_orderdate", "yyyyMMdd").alias("day"), "o_orderstatus")
    return unscored(o.select("day"), o.where("o_orderstatus = 'P'").select(F.col("day").alias("date")))


@query(f"""WITH {Q} SELECT symbol, CAST(row_number() OVER (PARTITION BY symbol ORDER BY spread DESC, seq) AS INT) AS place, seq, spread FROM two QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY spread DESC, seq) <= 6""")
def top_k(spark, sf):
    w = Window.partitionBy("symbol").orderBy(F.col("spread").desc(), "seq")
    return two(spark, sf).select("symbol", F.row_number().over(w).alias("place"), "seq", "spread").where("place <= 6")


@query(f"WITH {Q} SELECT '1' AS part, symbol, seq FROM two WHERE trades > 2 UNION ALL SELECT '2', symbol, seq FROM two WHERE spread > 300")
def union_days(spark, sf):
    rows = two(spark, sf)
    return rows.where("trades > 2").select(F.lit("1").alias("part"), "symbol", "seq").unionByName(rows.where("spread > 300").select(F.lit("2").alias("part"), "symbol", "seq"))


@query(f"WITH {Q} SELECT CAST(count(DISTINCT symbol) AS BIGINT) AS n_symbols, min(date) AS first_date FROM two")
def distinct_symbols(spark, sf):
    return two(spark, sf).agg(F.countDistinct("symbol").alias("n_symbols"), F.min("date").alias("first_date"))


@query(f"""WITH {views.BASE_SQL}, b AS (SELECT CASE WHEN price4 < 64 THEN price4 ELSE ((CAST(floor(log2(price4)) AS BIGINT) - 6 + 1) * 64) + (price4 >> (CAST(floor(log2(price4)) AS BIGINT) - 6)) - 64 END AS bucket FROM base WHERE price4 > 0)
SELECT CAST(bucket AS BIGINT) AS bucket, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY 1""")
def log_linear_histogram(spark, sf):
    return stats.histogram(views.base(spark, sf).where("price4 > 0"), "price4")


@query(f"""WITH {views.BASE_SQL}, b AS (SELECT symbol, CASE WHEN price4 < 64 THEN price4 ELSE (CAST(floor(log2(price4)) AS BIGINT) - 6) * 64 + (price4 >> (CAST(floor(log2(price4)) AS BIGINT) - 6)) END AS bucket FROM base WHERE price4 >= 0),
c AS (SELECT symbol, bucket, sum(count(*)) OVER (PARTITION BY symbol ORDER BY bucket) AS upto, sum(count(*)) OVER (PARTITION BY symbol) AS total FROM b GROUP BY symbol, bucket),
s AS (SELECT symbol, share, min(bucket) AS bucket FROM c, (VALUES (0.1::DOUBLE), (0.5), (0.99), (1.0)) v(share) WHERE upto >= floor(share * total) GROUP BY symbol, share)
SELECT symbol, share, CAST(CASE WHEN bucket < 64 THEN bucket ELSE (bucket % 64 + 64) << CAST(bucket // 64 - 1 AS INT) END AS BIGINT) AS value FROM s""")
def histogram_percentiles(spark, sf):
    counts = stats.histogram(views.base(spark, sf), "price4", ("symbol",))
    return stats.percentiles(counts, [0.1, 0.5, 0.99, 1.0], ("symbol",))


@query(f"""WITH {E}, u AS (SELECT *, price BETWEEN 1 AND 2147483647 AS sound, price % 30000 <> 0 AS off, lag(size) OVER (PARTITION BY symbol, side, price ORDER BY seq) AS was FROM depth WHERE kind = 'level')
SELECT symbol, CAST(count(*) FILTER (WHERE sound) AS BIGINT) AS updates, CAST(count(*) FILTER (WHERE NOT sound) AS BIGINT) AS bad_price, CAST(count(*) FILTER (WHERE sound AND off AND size > 0) AS BIGINT) AS unrepresentable,
CAST(count(*) FILTER (WHERE sound AND size = 0 AND (off OR coalesce(was, 0) = 0)) AS BIGINT) AS absent_clear FROM u GROUP BY symbol""")
def l2_counters(spark, sf):
    """What a level book counts of prices off its grid, prices that can't be, and clears of levels that aren't there."""
    found = tape.symbol_summary(views.depth(spark, sf).withColumn("price", F.col("price")), BY, 30_000)
    return found.select("symbol", "updates", "bad_price", "unrepresentable", "absent_clear")


#: View R: in sixes an order, its replacement, an execution at another price, an order of the replacement's reference, a hidden trade and a replacement of nothing.
REPLACED = f"""{views.BASE_SQL}, six AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY seq) - 1 AS nth FROM base),
steps AS (SELECT symbol, nth, nth // 6 AS grp, nth % 6 AS step, CASE WHEN k % 2 = 0 THEN 'B' ELSE 'S' END AS side, k + 1 AS shares, price4 - price4 % {TICK} AS price, price4 AS exec_price, k % 3 <> 0 AS printable FROM six),
groups_ AS (SELECT symbol, grp, max(side) FILTER (WHERE step = 0) AS side, max(shares) FILTER (WHERE step = 1) AS s1, max(price) FILTER (WHERE step = 1) AS p1, max(shares) FILTER (WHERE step = 2) AS s2,
  max(side) FILTER (WHERE step = 3) AS side3, max(shares) FILTER (WHERE step = 3) AS s3, max(price) FILTER (WHERE step = 3) AS p3, max(side) FILTER (WHERE step = 0) AS side0, max(shares) FILTER (WHERE step = 0) AS s0, max(price) FILTER (WHERE step = 0) AS p0 FROM steps GROUP BY symbol, grp)"""


def replaced(spark, sf) -> DataFrame:
    k, nth = F.col("k"), F.col("nth")
    b = views.base(spark, sf).withColumn("nth", (F.row_number().over(Window.partitionBy("symbol").orderBy("seq")) - 1).cast("bigint"))
    step, first = nth % 6, nth - nth % 6
    kind = F.element_at(F.array(*[F.lit(x) for x in "AUCFPU"]), (step + 1).cast("int"))
    ref = F.when(step == 0, first).when(step == 1, first).when(step.isin(2, 3), first + 1).when(step == 5, -nth)
    return b.select("symbol", nth.alias("seq"), "ts_ns", kind.alias("msg_type"), ref.alias("order_ref"), F.when(step == 1, first + 1).when(step == 5, nth).alias("new_order_ref"), F.when(k % 2 == 0, "B").otherwise("S").alias("side"),
        (k + 1).alias("shares"), (F.col("price4") - F.col("price4") % TICK).alias("price"), F.col("price4").alias("exec_price"), (k % 3 != 0).alias("printable"))


@query(f"""WITH {REPLACED}, left_ AS (SELECT symbol, side, p1 AS price, s1 - least(coalesce(s2, 0), s1) AS shares FROM groups_ WHERE s1 IS NOT NULL UNION ALL SELECT symbol, side3, p3, s3 FROM groups_ WHERE s3 IS NOT NULL
  UNION ALL SELECT symbol, side0, p0, s0 FROM groups_ WHERE s1 IS NULL)
SELECT symbol, side, price, CAST(sum(shares) AS BIGINT) AS shares, CAST(count(*) AS BIGINT) AS orders, CAST(row_number() OVER (PARTITION BY symbol, side ORDER BY CASE WHEN side = 'B' THEN -price ELSE price END) AS INT) AS level
FROM left_ WHERE shares > 0 GROUP BY symbol, side, price""")
def l3_replacements(spark, sf):
    """Levels after replacements that inherit their side, executions at other prices and repeated references."""
    return books.state_levels(books.order_book_states(replaced(spark, sf), BY, TICK), BY)


@query(f"""WITH {REPLACED}, g AS (SELECT symbol, CAST(count(s0) + count(s3) AS BIGINT) AS adds, CAST(count(s1) AS BIGINT) AS replaces, CAST(count(s2) AS BIGINT) AS executes, CAST(count(*) FILTER (WHERE s2 > s1) AS BIGINT) AS overfill, CAST(count(*) FILTER (WHERE s3 IS NOT NULL AND s2 < s1) AS BIGINT) AS duplicate_order_refs FROM groups_ GROUP BY symbol),
t AS (SELECT symbol, CAST(count(*) FILTER (WHERE step = 5) AS BIGINT) AS unknown_ref_replace, CAST(count(*) FILTER (WHERE step = 4 OR step = 2 AND printable) AS BIGINT) AS trades, CAST(coalesce(sum(shares) FILTER (WHERE step = 4 OR step = 2 AND printable), 0) AS BIGINT) AS shares_traded,
  CAST(count(*) FILTER (WHERE step = 4) AS BIGINT) AS hidden_trades, CAST(coalesce(sum(shares) FILTER (WHERE step = 4), 0) AS BIGINT) AS hidden_shares, CAST(coalesce(sum(CASE WHEN step = 4 THEN price * shares // 10000 WHEN step = 2 AND printable THEN exec_price * shares // 10000 END), 0) AS BIGINT) AS notional_dollars FROM steps GROUP BY symbol)
SELECT * FROM g JOIN t USING (symbol)""")
def l3_replacement_counts(spark, sf):
    """The counters and the tape of the same feed, from the events of the book."""
    e = books.order_book_events(replaced(spark, sf), BY, TICK)
    noted = books.diagnostics(e, BY).select("symbol", "adds", "replaces", "executes", "overfill", "duplicate_order_refs", "unknown_ref_replace")
    return noted.join(books.tape(e, BY).select("symbol", "trades", "shares_traded", "hidden_trades", "hidden_shares", "notional_dollars"), "symbol")


@query(f"""WITH {Q}, f AS (SELECT spread / 100.0 AS x, CAST(trades AS DOUBLE) AS y, ((spread * 7) % 1000 - 500) / 100.0 AS t FROM two),
m AS (SELECT CAST(count(*) AS BIGINT) AS n, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy, avg(t) AS mt, stddev_pop(t) AS st, count(*) * corr(x, y) AS g, count(*) * corr(x, t) AS cx, count(*) * corr(y, t) AS cy, count(*) + 50 AS d FROM f)
SELECT n, round(mx, 6) AS mean_x, round(sx, 6) AS std_x, round(my, 6) AS mean_y, round(sy, 6) AS std_y, round(st, 6) AS target_std, round(mt / st, 6) AS intercept, round((d * cx - g * cy) / (d * d - g * g), 6) AS beta_x, round((d * cy - g * cx) / (d * d - g * g), 6) AS beta_y FROM m""")
def ridge_fit(spark, sf):
    """A whole fit: moments, scales, coefficients and intercept, with all but two features constant."""
    names = {"queue_imbalance": "x", "trade_intensity": "y"}
    t = two(spark, sf).select("date", "symbol", (F.col("spread") / 100.0).alias("queue_imbalance"), F.col("trades").cast("double").alias("trade_intensity"), (((F.col("spread") * 7) % 1000 - 500) / 100.0).alias("fwd_bps"))
    fitted = model.fit(t.withColumns({c: F.lit(0.0) for c in panel.FEATURES if c not in names}))
    out = {"n": fitted.n_train_rows, "target_std": fitted.target_std, "intercept": fitted.intercept}
    for c, short in names.items():
        i = panel.FEATURES.index(c)
        out |= {f"mean_{short}": fitted.feature_mean[i], f"std_{short}": fitted.feature_std[i], f"beta_{short}": fitted.coefficients[i]}
    return spark.range(1).select(*[F.lit(v).cast("bigint").alias(c) if c == "n" else r6(F.lit(float(v))).alias(c) for c, v in out.items()])


HAC = ", ".join(f"lag(gross - mg, {k}) OVER o AS g{k}, lag(net - mn, {k}) OVER o AS n{k}" for k in range(1, 11))
HAC_SUM = {c: " + ".join(f"(1 - {k} / 11.0) * 2 * sum(e{c} * {c}{k})" for k in range(1, 11)) for c in "gn"}


@query(f"""WITH {SCORED}, ranks AS {RANKS}, m AS (SELECT avg(gross) AS mg, avg(net) AS mn FROM pos), e AS (SELECT gross - mg AS eg, net - mn AS en, {HAC} FROM pos, m WINDOW o AS (ORDER BY date, symbol, ts, seq)),
t AS (SELECT (SELECT mg FROM m) / sqrt((sum(eg * eg) + {HAC_SUM["g"]}) / count(*) / count(*)) AS gross_t, (SELECT mn FROM m) / sqrt((sum(en * en) + {HAC_SUM["n"]}) / count(*) / count(*)) AS net_t FROM e),
r AS (SELECT corr(pred, fwd_bps) AS ic_pearson, corr(rp, ry) AS ic_spearman, corr(rr, ry) AS baseline_reversal_ic FROM ranks),
s AS (SELECT CAST(count(*) AS BIGINT) AS n, avg(CASE WHEN sgn <> 0 AND fwd_bps <> 0 THEN CAST(sign(fwd_bps) = sgn AS DOUBLE) END) AS hit_rate, avg(CASE WHEN sgn <> 0 THEN CAST(fwd_bps <> 0 AS DOUBLE) END) AS moved_fraction, avg(gross) AS gross_bps, avg(net) AS net_bps,
  avg(net) / stddev_pop(net) AS sharpe_per_bar, avg(net) / stddev_pop(net) * sqrt(count(*)) AS sharpe_daily, avg(spread_bps) AS mean_spread_bps, avg(CAST(abs(pred) > cost AS DOUBLE)) AS tradeable_fraction FROM pos)
SELECT n, {", ".join(f"round({c}, 5) AS {c}" for c in ("ic_pearson", "ic_spearman", "hit_rate", "moved_fraction", "gross_bps", "net_bps", "gross_t", "net_t", "sharpe_per_bar", "sharpe_daily", "mean_spread_bps", "tradeable_fraction", "baseline_reversal_ic"))} FROM s, r, t""")
def scorecard(spark, sf):
    """The whole scorecard, t values with Bartlett weights over all rows among it."""
    card = scoring.score(scored(spark, sf)).as_dict()
    return spark.range(1).select(*[F.lit(v).cast("bigint").alias(c) if c == "n" else F.round(F.lit(float(v)), 5).alias(c) for c, v in card.items() if c != "baseline_zero_bps"])
