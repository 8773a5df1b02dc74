"""The driver's tables as feeds: the same views in Spark and in SQL.

E: ``events`` as depth messages. Q: ``events`` as two-sided quotes, a feature table. L: ``orders`` and ``lineitem`` as order messages.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Prices of view E are cut to whole dollars, so that levels are hit again.
TICK = 10_000
HOUR = 3600


def base(spark: SparkSession, sf: str) -> DataFrame:
    """The events' columns as the views use them. Filters stop at the observed rows: pushed below, each would work out anew, for every
    place where it names them, the numbers that a stored table holds."""
    return base_of(spark.read.parquet(f"{sf}/events.parquet")).observe(f"rows_{uuid4().hex}", F.count(F.lit(1)).alias("rows"))


def number_after(text: Column, key: str) -> Column:
    """The whole number after a key of a flat JSON text. Views use it many times a row, also in filters, and parsing is ten times dearer."""
    rest = F.substring_index(text, key, -1)
    return F.trim(F.substring_index(F.substring_index(rest, ",", 1), "}", 1)).cast("bigint")


def base_of(events: DataFrame) -> DataFrame:
    cents = F.round(F.col("value") * 10000).cast("bigint")
    return events.select(
        F.concat(F.lit("S"), F.pmod(F.col("user_id"), F.lit(10)).cast("string")).alias("symbol"), F.col("event_id").cast("bigint").alias("seq"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"), "event_type", number_after(F.col("props"), '"k":').alias("k"), cents.alias("price4"),
    )


BASE_SQL = """base AS (
  SELECT 'S' || CAST(user_id % 10 AS VARCHAR) AS symbol, CAST(event_id AS BIGINT) AS seq, epoch_us(ts) * 1000 AS ts_ns, event_type,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(round(value * 10000) AS BIGINT) AS price4
  FROM events
)"""


def depth(spark: SparkSession, sf: str) -> DataFrame:
    """View E: view and click are bid and ask levels, purchase a trade, error a trading status, signup a security event."""
    return depth_of(spark.read.parquet(f"{sf}/events.parquet"))


def depth_of(events: DataFrame) -> DataFrame:
    t = F.col("event_type")
    kind = F.when(t.isin("view", "click"), "level").when(t == "purchase", "trade").when(t == "error", "status").otherwise("event")
    return base_of(events).select(
        "symbol", "seq", "ts_ns", kind.alias("kind"), F.when(t == "view", "B").when(t == "click", "S").alias("side"), (F.col("price4") - F.col("price4") % TICK).alias("price"), F.col("k").alias("size"),
        ((F.col("seq") % 4 != 0) & t.isin("view", "click")).alias("complete"), (F.col("k") < 10).alias("odd_lot"), (F.col("k") % 7 == 0).alias("iso"),
        F.when(t == "error", F.when(F.col("k") % 2 == 0, "T").otherwise("H")).alias("status"),
        F.when(t == "signup", F.when(F.col("k") % 10 == 0, "O").when(F.col("k") % 10 == 1, "C").otherwise("X")).alias("event"),
    )


DEPTH_SQL = f"""{BASE_SQL}, depth AS (
  SELECT symbol, seq, ts_ns,
    CASE WHEN event_type IN ('view', 'click') THEN 'level' WHEN event_type = 'purchase' THEN 'trade' WHEN event_type = 'error' THEN 'status' ELSE 'event' END AS kind,
    CASE event_type WHEN 'view' THEN 'B' WHEN 'click' THEN 'S' END AS side, price4 - price4 % {TICK} AS price, k AS size,
    seq % 4 <> 0 AND event_type IN ('view', 'click') AS complete, k < 10 AS odd_lot, k % 7 = 0 AS iso,
    CASE WHEN event_type = 'error' THEN CASE WHEN k % 2 = 0 THEN 'T' ELSE 'H' END END AS status,
    CASE WHEN event_type = 'signup' THEN CASE k % 10 WHEN 0 THEN 'O' WHEN 1 THEN 'C' ELSE 'X' END END AS event
  FROM base
)"""
#: The best prices after each completed transaction: a level is valid from its update to the next at its price.
TOPS_SQL = f"""{DEPTH_SQL}, updates AS (
  SELECT *, lead(seq) OVER (PARTITION BY symbol, side, price ORDER BY seq) AS until FROM depth WHERE kind = 'level' AND price BETWEEN 1 AND 2147483647
), live AS (SELECT * FROM updates WHERE size > 0), done AS (
  SELECT symbol, seq, ts_ns FROM depth WHERE complete
), tops AS (
  SELECT d.symbol, d.seq, any_value(d.ts_ns) AS ts_ns,
    max(l.price) FILTER (WHERE l.side = 'B') AS bid, arg_max(l.size, l.price) FILTER (WHERE l.side = 'B') AS bid_shares,
    min(l.price) FILTER (WHERE l.side = 'S') AS ask, arg_min(l.size, l.price) FILTER (WHERE l.side = 'S') AS ask_shares,
    count(*) FILTER (WHERE l.side = 'B') AS bid_levels, count(*) FILTER (WHERE l.side = 'S') AS ask_levels
  FROM done d LEFT JOIN live l ON l.symbol = d.symbol AND l.seq <= d.seq AND (l.until IS NULL OR l.until > d.seq)
  GROUP BY d.symbol, d.seq
)"""


def quotes(spark: SparkSession, sf: str) -> DataFrame:
    """View Q: a feature table of two days with date, symbol and seq; event time is divided by an hour, so that bars are seconds apart."""
    b, k = base(spark, sf), F.col("k")
    ts = F.call_function("div", F.col("ts_ns"), F.lit(HOUR))
    return b.select(
        F.when(F.col("seq") % 1000 < 500, "20200102").otherwise("20200103").alias("date"), "symbol", "seq", ts.alias("ts_ns"), (1_000_000 + F.col("price4") % 20000 - 50 - (k % 7) * 100).alias("bid"), (k * 10 + 100).alias("bid_shares"),
        (1_000_000 + F.col("price4") % 20000 + 50 + (k % 5) * 100).alias("ask"), (1100 - k * 10).alias("ask_shares"), (k * 30 + 300).alias("bid_depth"), (3300 - k * 20).alias("ask_depth"),
        (k % 6).alias("trades"), (k * 3).alias("trade_shares"), ((k * 7) % 50).alias("buy_shares"), ((k * 11) % 40).alias("sell_shares"), (k * 100).alias("notional_cents"),
    )


QUOTES_SQL = f"""{BASE_SQL}, quotes AS (
  SELECT CASE WHEN seq % 1000 < 500 THEN '20200102' ELSE '20200103' END AS date, symbol, seq, ts_ns // {HOUR} AS ts_ns, 1000000 + price4 % 20000 - 50 - (k % 7) * 100 AS bid, k * 10 + 100 AS bid_shares,
    1000000 + price4 % 20000 + 50 + (k % 5) * 100 AS ask, 1100 - k * 10 AS ask_shares, k * 30 + 300 AS bid_depth, 3300 - k * 20 AS ask_depth,
    k % 6 AS trades, k * 3 AS trade_shares, (k * 7) % 50 AS buy_shares, (k * 11) % 40 AS sell_shares, k * 100 AS notional_cents
  FROM base
), two AS (
  SELECT *, ts_ns AS ts, bid + ask AS mid_x2, ask - bid AS spread FROM quotes WHERE bid > 0 AND ask > 0 AND ask >= bid
)"""


def orders(spark: SparkSession, sf: str) -> DataFrame:
    """View L: each order adds, its lines execute (N), cancel (A) or delete (R) it; a symbol is a tenth of the customers.

    All is in one order by date and then by every column, adds before what changes them; equal rows are interchangeable.
    """
    o, line = spark.read.parquet(f"{sf}/orders.parquet"), spark.read.parquet(f"{sf}/lineitem.parquet")
    symbol = F.concat(F.lit("C"), F.pmod(F.col("o_custkey"), F.lit(10)).cast("string"))
    adds = o.select(symbol.alias("symbol"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("day"), F.lit(0).alias("rank"), F.lit("A").alias("msg_type"), F.col("o_orderkey").alias("order_ref"),
        F.when(F.col("o_custkey") % 2 == 0, "B").otherwise("S").alias("side"), F.lit(100).cast("bigint").alias("shares"), (F.round(F.col("o_totalprice")).cast("bigint") * 100).alias("price"), F.lit(0).alias("line"))
    kind = F.when(F.col("l_returnflag") == "N", "E").when(F.col("l_returnflag") == "A", "X").otherwise("D")
    changes = line.join(o, line.l_orderkey == o.o_orderkey).select(symbol.alias("symbol"), F.unix_micros(F.greatest("l_shipdate", "o_orderdate").cast("timestamp")).alias("day"), F.lit(1).alias("rank"), kind.alias("msg_type"),
        F.col("l_orderkey").alias("order_ref"), F.lit(None).cast("string").alias("side"), F.col("l_quantity").cast("bigint").alias("shares"), F.lit(None).cast("bigint").alias("price"), F.col("l_linenumber").alias("line"))
    every = adds.union(changes)
    order = Window.partitionBy("symbol").orderBy("day", "rank", "order_ref", "line", "msg_type", "shares")
    rows = every.withColumn("seq", F.row_number().over(order).cast("bigint"))
    return rows.select("symbol", "seq", (F.col("day") * 1000).alias("ts_ns"), "msg_type", "order_ref", F.lit(None).cast("bigint").alias("new_order_ref"), "side", "shares", "price", F.lit(None).cast("bigint").alias("exec_price"), F.lit(None).cast("boolean").alias("printable"))


#: Without replacements the clamps are running sums: an order dies at the first change that brings what is taken to its shares.
ORDERS_SQL = """every AS (
  SELECT 'C' || CAST(o_custkey % 10 AS VARCHAR) AS symbol, epoch_us(o_orderdate) AS day, 0 AS rank, 'A' AS msg_type, o_orderkey AS order_ref,
    CASE WHEN o_custkey % 2 = 0 THEN 'B' ELSE 'S' END AS side, CAST(100 AS BIGINT) AS shares, CAST(round(o_totalprice) AS BIGINT) * 100 AS price, 0 AS line
  FROM orders
  UNION ALL
  SELECT 'C' || CAST(o_custkey % 10 AS VARCHAR), epoch_us(greatest(l_shipdate, o_orderdate)), 1, CASE l_returnflag WHEN 'N' THEN 'E' WHEN 'A' THEN 'X' ELSE 'D' END, l_orderkey,
    NULL, CAST(l_quantity AS BIGINT), NULL, l_linenumber
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), feed AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day, rank, order_ref, line, msg_type, shares) AS seq FROM every
), changes AS (
  SELECT c.*, a.side AS own_side, a.price AS own_price, a.shares AS own_shares, CASE WHEN c.msg_type = 'D' THEN 1000000000 ELSE c.shares END AS wanted
  FROM feed c JOIN feed a ON a.symbol = c.symbol AND a.order_ref = c.order_ref AND a.msg_type = 'A' WHERE c.msg_type <> 'A'
), sums AS (
  SELECT *, coalesce(sum(wanted) OVER (PARTITION BY symbol, order_ref ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken_before FROM changes
), outcome AS (
  SELECT *, taken_before >= own_shares AS unknown, least(wanted, own_shares - taken_before) AS taken FROM sums
)"""
