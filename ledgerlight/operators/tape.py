"""The trade tape against the quotes: classification, sampling on a time grid, interval sums and the feature table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlight.operators.books import counter, level_book, sound_price, whole

FEATURES = (
    "ts_ns bigint, symbol string, bid bigint, bid_shares bigint, ask bigint, ask_shares bigint, spread bigint, bid_depth bigint, ask_depth bigint,"
    " bid_levels bigint, ask_levels bigint, trades bigint, trade_shares bigint, buy_shares bigint, sell_shares bigint, unclassified_shares bigint,"
    " notional_cents bigint, last_price bigint, odd_lot_trades bigint, sweep_trades bigint, trading_status string"
)
FEATURE_NAMES = [c.split()[0] for c in FEATURES.split(", ")]
SECOND = 1_000_000_000


def before(keys: list[str], order: str = "seq"):
    """All earlier rows of a key."""
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def upto(keys: list[str], order: str = "seq"):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def aggressor(price: Column, mid_x2: Column) -> Column:
    """buy above the middle, sell below it, else unclassified."""
    return F.when(2 * price > mid_x2, "buy").when(2 * price < mid_x2, "sell").otherwise("unclassified")


def is_grid_sample(ts: Column, complete: Column, keys: list[str], sample_ns: int) -> Column:
    """Whether a completed transaction is the first of its bucket; a key's first transaction only starts the grid.

    The last bucket that sampled or started the grid is always the largest so far, so a running maximum
    tells the same as the state machine, also when time runs backwards.
    """
    if not sample_ns:
        return F.coalesce(complete, F.lit(False))
    bucket = F.when(complete, whole_floor(ts, sample_ns))
    return F.coalesce(bucket > F.max(bucket).over(before(keys)), F.lit(False))


def whole_floor(value: Column, by: int) -> Column:
    """Integer division towards minus infinity, exact for longs."""
    return whole(value - F.pmod(value, F.lit(by)), by)


def merged(messages: DataFrame, keys: list[str], tick: int = 100, depth: int = 4) -> DataFrame:
    """Updates with their book, trades, states and events in one order, each row with the last stable quote and the live book.

    messages: the keys, seq, ts_ns, kind (level, trade, status, event), side, price, size, complete, odd_lot, iso, status, event.
    """
    book = level_book(messages.where("kind = 'level'"), keys, tick, depth)
    stable = F.when(F.col("complete"), F.struct("bid", "bid_shares", "ask", "ask_shares"))
    live = F.struct("bid_depth", "ask_depth", "bid_levels", "ask_levels")
    levels = book.select(*keys, "seq", "ts_ns", F.lit("level").alias("kind"), "complete", "sound", stable.alias("stable"), live.alias("live"))
    others = messages.where("kind <> 'level'").select(*keys, "seq", "ts_ns", "kind", "price", "size", "odd_lot", "iso", "status", "event")
    rows = levels.unionByName(others, allowMissingColumns=True)
    rows = rows.where((F.col("kind") != "trade") | sound_price(F.col("price")))
    w = upto(keys)
    rows = rows.withColumns({"stable": F.last("stable", True).over(w), "live": F.last("live", True).over(w), "trading_status": F.coalesce(F.last(F.when(F.col("kind") == "status", F.col("status")), True).over(w), F.lit("?"))})
    return rows.withColumn("mid_x2", F.col("stable.bid") + F.col("stable.ask"))


def classified(rows: DataFrame) -> DataFrame:
    """Trades with ``aggressor``, over ``merged``: against the stable quote before them."""
    return rows.where("kind = 'trade'").withColumn("aggressor", aggressor(F.col("price"), F.col("mid_x2")))


def sampled(rows: DataFrame, keys: list[str], sample_ns: int = SECOND) -> DataFrame:
    """Mark samples in ``merged`` rows, forced ones by open and close events too, and add a last row for each key that had a transaction."""
    complete = F.coalesce(F.col("complete"), F.lit(False))
    forced = (F.col("kind") == "event") & F.col("event").isin("O", "C")
    rows = rows.withColumns({"grid": is_grid_sample(F.col("ts_ns"), complete, keys, sample_ns), "forced": F.coalesce(forced, F.lit(False))})
    moved = (F.col("kind") == "trade") | ((F.col("kind") == "level") & F.col("sound"))
    order = Window.partitionBy(*keys).orderBy("seq")
    rows = rows.withColumns({"_done": F.sum(complete.cast("int")).over(upto(keys)), "_moved": F.last(F.when(moved, F.col("ts_ns")), True).over(upto(keys)), "_end": F.lead("seq").over(order).isNull()})
    # the last row of a key comes twice, the second time as its flush; so the fold before runs once
    both = F.when(F.col("_end") & (F.col("_done") > 0), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    rows = rows.withColumn("_flush", F.explode(both))
    flush = F.col("_flush")
    rows = rows.withColumns({
        "seq": F.col("seq") + flush.cast("int"), "ts_ns": F.when(flush, F.coalesce("_moved", F.lit(0))).otherwise(F.col("ts_ns")), "kind": F.when(flush, "flush").otherwise(F.col("kind")),
        "grid": F.col("grid") & ~flush, "forced": F.col("forced") & ~flush,
    })
    return rows.drop("_done", "_moved", "_end", "_flush").withColumn("sample", F.col("grid") | F.col("forced") | (F.col("kind") == "flush"))


def intervals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per sample of ``sampled`` rows: the trades since the sample before, and the book at it."""
    rows = rows.withColumn("interval", F.coalesce(F.sum(F.col("sample").cast("int")).over(before(keys)), F.lit(0)))
    trade, side = F.col("kind") == "trade", aggressor(F.col("price"), F.col("mid_x2"))
    total = lambda value: F.coalesce(F.sum(F.when(trade, value)), F.lit(0)).cast("bigint")
    at = F.when(F.col("sample"), F.col("seq"))
    shown = F.max_by(F.struct("ts_ns", "stable", "live", "trading_status", "kind", "forced"), at).alias("at")
    return rows.groupBy(*keys, "interval").agg(
        F.count_if(F.col("sample")).alias("samples"), shown, F.count_if(trade).alias("trades"), total(F.col("size")).alias("trade_shares"),
        *[total(F.when(side == s, F.col("size")).otherwise(0)).alias(f"{s}_shares") for s in ("buy", "sell", "unclassified")],
        total(whole(F.col("price") * F.col("size"), 100)).alias("notional_cents"),
        F.coalesce(F.max_by("price", F.when(trade, F.col("seq"))), F.lit(0)).cast("bigint").alias("last_price"),
        total(F.coalesce(F.col("odd_lot"), F.lit(False)).cast("int")).alias("odd_lot_trades"), total(F.coalesce(F.col("iso"), F.lit(False)).cast("int")).alias("sweep_trades"),
    ).where("samples > 0")


def feature_table(messages: DataFrame, keys: list[str], sample_ns: int = SECOND, tick: int = 100, depth: int = 4) -> DataFrame:
    """FEATURES' columns (and the keys): a row for each sample; 0 for no price, spread -1 without both sides."""
    out = intervals(sampled(merged(messages, keys, tick, depth), keys, sample_ns), keys)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    book = {f"{s}{x}": zero(f"at.stable.{s}{x}") for s in ("bid", "ask") for x in ("", "_shares")} | {f"{s}_{x}": zero(f"at.live.{s}_{x}") for s in ("bid", "ask") for x in ("depth", "levels")}
    spread = F.coalesce(F.col("at.stable.ask") - F.col("at.stable.bid"), F.lit(-1))
    out = out.withColumns(book | {"spread": spread, "ts_ns": F.col("at.ts_ns"), "trading_status": F.col("at.trading_status")})
    return out.select(*[k for k in keys if k not in FEATURE_NAMES], *FEATURE_NAMES)


def symbol_summary(messages: DataFrame, keys: list[str], tick: int = 100) -> DataFrame:
    """Counts of each key: updates, transactions, in-transition updates, crossed transactions, bad prices, trades."""
    book = level_book(messages.where("kind = 'level'"), keys, tick)
    noted = book.groupBy(*keys).agg(*[counter(n) for n in ("updates", "transactions", "in_transition", "crossed", "bad_price", "absent_clear", "unrepresentable")])
    trades = messages.where("kind = 'trade'").groupBy(*keys).agg(F.count_if(sound_price(F.col("price"))).alias("trades"))
    return noted.join(trades, keys, "full_outer").na.fill(0)


def deep_messages(decoded: DataFrame) -> DataFrame:
    """Decoded depth messages as ``merged`` takes them; others go. ``seq`` is the place in the file."""
    kind = F.when(F.col("msg_type").isin("8", "5"), "level").when(F.col("msg_type") == "T", "trade").when(F.col("msg_type") == "H", "status").when(F.col("msg_type") == "E", "event")
    nth = F.row_number().over(Window.partitionBy("file", "symbol").orderBy("packet_no", "seq"))
    rows = decoded.withColumn("kind", kind).where(F.col("kind").isNotNull())
    return rows.select("file", "symbol", nth.cast("bigint").alias("seq"), "ts_ns", "kind", "side", "price", "size", F.col("event_complete").alias("complete"), "odd_lot", "iso", "status", "event")


def official_prices(decoded: DataFrame) -> DataFrame:
    """The last official opening and closing price of each symbol."""
    at = F.struct("packet_no", "seq")
    good = decoded.where((F.col("msg_type") == "X") & sound_price(F.col("price")))
    return good.groupBy("symbol").agg(F.max_by("price", F.when(F.col("price_type") == "Q", at)).alias("official_open"), F.max_by("price", F.when(F.col("price_type") == "M", at)).alias("official_close"))
