"""The book folds as streams: the same state machines, with their state in the state store.

Within a micro-batch the rows of a key are put in order of ``seq``; a row that comes after later ones had been applied is
marked ``late`` and still applied, as a feed handler would. Only levels and orders that changed are written back.
Sessions need the RocksDB state store; ``prepare`` sets it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import _parse_datatype_string

from ledgerlight.operators.books import APPLIED, LARGEST_PRICE, Ladder, OrderBook

TOPS = (
    "symbol string, seq bigint, ts_ns bigint, complete boolean, late boolean, sample boolean, bid bigint, bid_shares bigint, ask bigint, ask_shares bigint,"
    " bid_depth bigint, ask_depth bigint, bid_levels bigint, ask_levels bigint"
)
ORDERS = (
    "symbol string, seq bigint, ts_ns bigint, msg_type string, late boolean, bid bigint, bid_shares bigint, bid_orders bigint, ask bigint, ask_shares bigint, ask_orders bigint,"
    " print_price bigint, print_shares bigint, hidden boolean, live_orders bigint"
)


def prepare(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable")


def whole(rows: DataFrame, numbers: list[str]) -> DataFrame:
    """0 for missing numbers: with nulls pandas would make a column of doubles, which don't hold 64-bit references."""
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in numbers})


class Ladders:
    """Two ladders kept in a map state from (side, price) to (shares, orders)."""

    def __init__(self, state, tick: int):
        self.state, self.tick = state, tick

    def load(self) -> dict[str, Ladder]:
        self.sides = {"B": Ladder(True, self.tick), "S": Ladder(False, self.tick)}
        for (side, price), (shares, orders) in self.state.iterator():
            self.sides[side].put(price)[:] = shares, orders
        self.before = {(s, p): tuple(level) for s, ladder in self.sides.items() for p, level in ladder.levels.items()}
        return self.sides

    def save(self) -> None:
        now = {(s, p): tuple(level) for s, ladder in self.sides.items() for p, level in ladder.levels.items()}
        for key in self.before.keys() - now.keys():
            self.state.removeKey(key)
        for key, level in now.items():
            if self.before.get(key) != level:
                self.state.updateValue(key, level)


class LevelBook(StatefulProcessor):
    """Price-level updates of one symbol to the tops after them; ``sample`` marks the first transaction of each bucket of time."""

    def __init__(self, tick: int = 100, depth: int = 4, sample_ns: int = 0):
        self.tick, self.depth, self.sample_ns = tick, depth, sample_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.levels = Ladders(handle.getMapState("levels", "side string, price bigint", "shares bigint, orders bigint"), self.tick)
        self.last = handle.getValueState("last", "seq bigint, bucket bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        sides = self.levels.load()
        bids, asks = sides["B"], sides["S"]
        last, bucket = self.last.get() if self.last.exists() else (-1, -1)
        out = []
        for r in in_order(rows).itertuples(index=False):
            complete = bool(r.complete)
            if 0 < r.price <= LARGEST_PRICE:
                sides["B" if r.side == "B" else "S"].set(r.price, r.size, [])
            sample = complete and not self.sample_ns
            if complete and self.sample_ns:
                now = r.ts_ns // self.sample_ns
                sample, bucket = bucket >= 0 and now > bucket, max(bucket, now)
            bid, ask = bids.best(), asks.best()
            out.append((key[0], r.seq, r.ts_ns, complete, r.seq <= last, sample, bid, bids.levels[bid][0] if bid is not None else None, ask, asks.levels[ask][0] if ask is not None else None, bids.within(self.depth), asks.within(self.depth), len(bids.levels), len(asks.levels)))
            last = max(last, r.seq)
        self.levels.save()
        self.last.update((int(last), int(bucket)))
        yield frame(out, TOPS)


class OrderEvents(StatefulProcessor):
    """Order messages of one symbol to the top of the book after each, with what printed."""

    def __init__(self, tick: int = 100):
        self.tick = tick

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.levels = Ladders(handle.getMapState("levels", "side string, price bigint", "shares bigint, orders bigint"), self.tick)
        self.orders = handle.getMapState("orders", "ref bigint", "side string, price bigint, shares bigint")
        self.last = handle.getValueState("last", "seq bigint, live bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        book = OrderBook(self.tick)
        book.sides = self.levels.load()
        bids, asks = book.sides["B"], book.sides["S"]
        last, live = self.last.get() if self.last.exists() else (-1, 0)
        batch = in_order(rows)
        wanted = {int(x) for c in ("order_ref", "new_order_ref") for x in batch[c]}
        before = {}
        for ref in wanted:  # only the orders that this batch speaks of
            if self.orders.containsKey((ref,)):
                before[ref] = tuple(self.orders.getValue((ref,)))
        book.orders = dict(before)
        out = []
        for r in batch.itertuples(index=False):
            held = len(book.orders)
            printed = book.apply(r.msg_type, r.order_ref, r.new_order_ref, r.side, r.shares, r.price, r.exec_price, bool(r.printable))
            live += len(book.orders) - held
            bid, ask = bids.best(), asks.best()
            out.append((key[0], r.seq, r.ts_ns, r.msg_type, r.seq <= last, bid, *(bids.levels[bid] if bid is not None else (None, None)), ask, *(asks.levels[ask] if ask is not None else (None, None)), *printed[:3], live))
            last = max(last, r.seq)
        for side in (bids, asks):
            side.changes.clear()
        for ref in before.keys() - book.orders.keys():
            self.orders.removeKey((ref,))
        for ref, order in book.orders.items():
            if before.get(ref) != order:
                self.orders.updateValue((ref,), order)
        self.levels.save()
        self.last.update((int(last), int(live)))
        yield frame(out, ORDERS)


def frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    kinds = {"bigint": "Int64", "boolean": "boolean", "string": "object"}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pd.DataFrame({name: pd.array(list(c), dtype=kinds[kind]) if kind != "string" else list(c) for (name, kind), c in zip(fields, columns, strict=True)})


def stream_level_book(updates: DataFrame, tick: int = 100, depth: int = 4, sample_ns: int = 0) -> DataFrame:
    """A stream of price-level updates (symbol, seq, ts_ns, side, price, size, complete) to TOPS' columns."""
    rows = updates.select("symbol", "seq", "ts_ns", "side", "price", "size", "complete")
    rows = whole(rows, ["price", "size"])
    return rows.groupBy("symbol").transformWithStateInPandas(LevelBook(tick, depth, sample_ns), _parse_datatype_string(TOPS), "Append", "None")


def stream_order_book(messages: DataFrame, tick: int = 100) -> DataFrame:
    """A stream of order messages (symbol and what ``order_book_events`` takes) to ORDERS' columns."""
    rows = messages.where(messages.msg_type.isin(*APPLIED)).select("symbol", "seq", "ts_ns", "msg_type", "order_ref", "new_order_ref", "side", "shares", "price", "exec_price", "printable")
    rows = whole(rows, ["order_ref", "new_order_ref", "shares", "price", "exec_price"])
    return rows.groupBy("symbol").transformWithStateInPandas(OrderEvents(tick), _parse_datatype_string(ORDERS), "Append", "None")
