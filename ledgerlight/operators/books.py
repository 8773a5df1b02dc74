"""Order books as state machines: orders and levels by order (L3), levels by price (L2)."""

from __future__ import annotations

from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlight.operators.fold import ordered_fold, ordered_summary

#: A price must fit into 31 bits and be above zero.
LARGEST_PRICE = 0x7FFFFFFF


class Ladder:
    """One side: price to [shares, orders]. The best price comes from a heap whose dead entries are skipped."""

    def __init__(self, bid: bool, tick: int):
        self.sign, self.tick, self.levels, self.heap = -1 if bid else 1, tick, {}, []
        #: What orders have changed since it was last emptied: (side, price, shares, orders).
        self.changes: list[tuple[str, int, int, int]] = []

    def put(self, price: int) -> list[int]:
        level = self.levels[price] = [0, 0]
        heappush(self.heap, self.sign * price)
        return level

    def add(self, price: int, shares: int, notes: list[str]) -> None:
        if price % self.tick:
            notes += ["off_tick", "unrepresentable_price"]
            return
        level = self.levels.get(price) or self.put(price)
        level[0] += shares
        level[1] += 1
        self.changes.append(("B" if self.sign < 0 else "S", price, shares, 1))

    def remove(self, price: int, shares: int, gone: bool, notes: list[str]) -> None:
        level = self.levels.get(price)
        if level is None:
            notes.append("missing_level")
            return
        was = tuple(level)
        level[0] -= shares
        level[1] = max(0, level[1] - gone)
        if level[0] < 0:
            notes.append("negative_level_qty")
        if level[0] <= 0:
            level[:] = 0, 0
            del self.levels[price]
        self.changes.append(("B" if self.sign < 0 else "S", price, level[0] - was[0], level[1] - was[1]))

    def set(self, price: int, size: int, notes: list[str]) -> None:
        if not size:
            if self.levels.pop(price, None) is None:
                notes.append("absent_clear")
        elif price % self.tick:
            notes.append("unrepresentable")
        else:
            level = self.levels.get(price) or self.put(price)
            level[0], level[1] = size, 0

    def best(self) -> int | None:
        heap = self.heap
        while heap and self.sign * heap[0] not in self.levels:
            heappop(heap)
        return self.sign * heap[0] if heap else None

    def within(self, ticks: int) -> int:
        """Shares at most ``ticks`` from the best price."""
        best = self.best()
        if best is None:
            return 0
        steps = (self.levels.get(best + self.sign * k * self.tick) for k in range(ticks + 1)) if ticks < len(self.levels) else (v for p, v in self.levels.items() if abs(p - best) <= ticks * self.tick)
        return sum(level[0] for level in steps if level)

    def top(self, n: int) -> list[tuple[int, int, int]]:
        return [(p, *self.levels[p]) for p in sorted(self.levels, key=lambda p: self.sign * p)[:n]]


class OrderBook:
    """Orders by reference. ``apply`` returns (print price, printed shares, hidden, notes); None where nothing prints.

    It keeps what is odd about the feed's rules: a repeated reference replaces the order while both quantities
    stay in the level; an order at a price off the grid is known but in no level; an execution of an unknown order prints at
    price 0, and an overfill prints all its shares.
    """

    def __init__(self, tick: int = 100):
        self.orders: dict[int, tuple[str, int, int]] = {}
        self.sides = {"B": Ladder(True, tick), "S": Ladder(False, tick)}

    def add(self, ref: int, side: str, shares: int, price: int, notes: list[str]) -> None:
        if ref in self.orders:
            notes.append("duplicate_order_refs")
        self.orders[ref] = (side, price, shares)
        self.sides[side].add(price, shares, notes)

    def reduce(self, ref: int, shares: int | None, kind: str, over: str, done: str, notes: list[str]) -> str | None:
        """Take shares from an order, all if None; returns its side."""
        if (found := self.orders.get(ref)) is None:
            notes.append(f"unknown_ref_{kind}")
            return None
        side, price, resting = found
        taken = resting if shares is None else min(shares, resting)
        if shares is not None and taken < shares:
            notes.append(over)
        gone = taken == resting
        if gone:
            del self.orders[ref]
        else:
            self.orders[ref] = (side, price, resting - taken)
        self.sides[side].remove(price, taken, gone, notes)
        notes.append(done)
        return side

    def apply(self, kind: str, ref: int, new_ref: int | None, side: str | None, shares: int | None, price: int | None, exec_price: int | None, printable: bool | None) -> tuple[int | None, int | None, bool, list[str]]:
        notes: list[str] = []
        if kind in "AF":
            if not shares:
                notes.append("zero_share_adds")
            else:
                self.add(ref, "B" if side == "B" else "S", shares, price, notes)
                notes.append("adds")
        elif kind == "E":
            resting = self.orders.get(ref)
            self.reduce(ref, shares, "exec", "overfill", "executes", notes)
            return (resting[1] if resting else 0), shares, False, notes
        elif kind == "C":
            self.reduce(ref, shares, "exec", "overfill", "executes", notes)
            if printable:
                return exec_price, shares, False, notes
        elif kind == "X":
            self.reduce(ref, shares, "cancel", "overcancel", "cancels", notes)
        elif kind == "D":
            self.reduce(ref, None, "delete", "", "deletes", notes)
        elif kind == "U":
            inherited = self.reduce(ref, None, "replace", "", "replaces", notes)
            if inherited and shares:
                self.add(new_ref, inherited, shares, price, notes)
        elif kind == "P":
            return price, shares, True, notes
        return None, None, False, notes


#: Counters of an order book; those that mean a broken feed make up the corruption total.
NOTES = ["adds", "executes", "cancels", "deletes", "replaces", "unknown_ref_exec", "unknown_ref_cancel", "unknown_ref_delete", "unknown_ref_replace", "overfill", "overcancel", "zero_share_adds", "unrepresentable_price", "negative_level_qty", "missing_level", "off_tick", "duplicate_order_refs"]
CORRUPT = [n for n in NOTES[5:] if n != "zero_share_adds"]
APPLIED = ("A", "F", "E", "C", "X", "D", "U", "P", "Q")
EVENTS = (
    "seq bigint, ts_ns bigint, msg_type string, bid bigint, bid_shares bigint, bid_orders bigint, ask bigint, ask_shares bigint, ask_orders bigint,"
    " print_price bigint, print_shares bigint, hidden boolean, live_orders bigint, bid_levels bigint, ask_levels bigint, notes array<string>,"
    " changes array<struct<side:string,price:bigint,shares:bigint,orders:bigint>>"
)


def order_book_events(messages: DataFrame, keys: list[str], tick: int = 100) -> DataFrame:
    """One row per applied message, in order of ``seq``: the top of the book after it, what it printed and what it counted.

    messages: the keys, seq, ts_ns, msg_type, order_ref, new_order_ref, side, shares, price, exec_price, printable.
    """
    columns = ["seq", "ts_ns", "msg_type", "order_ref", "new_order_ref", "side", "shares", "price", "exec_price", "printable"]

    def start():
        book = OrderBook(tick)
        bids, asks = book.sides["B"], book.sides["S"]

        def step(row: tuple) -> tuple:
            seq, ts, kind, *rest = row[len(keys) :]
            price, shares, hidden, notes = book.apply(kind, *rest)
            bid, ask = bids.best(), asks.best()
            changes = [dict(zip(("side", "price", "shares", "orders"), c, strict=True)) for c in (*bids.changes, *asks.changes)]
            bids.changes.clear(), asks.changes.clear()
            return (seq, ts, kind, bid, *(bids.levels[bid] if bid is not None else (None, None)), ask, *(asks.levels[ask] if ask is not None else (None, None)), price, shares, hidden, len(book.orders), len(bids.levels), len(asks.levels), notes, changes)

        return step

    return ordered_fold(messages.where(F.col("msg_type").isin(*APPLIED)).select(*keys, *columns), keys, ["seq"], start, EVENTS)


STATE = "counts map<string,bigint>, live_orders bigint, bid_levels bigint, ask_levels bigint, levels array<struct<side:string,price:bigint,shares:bigint,orders:bigint>>"


def order_book_states(messages: DataFrame, keys: list[str], tick: int = 100) -> DataFrame:
    """One row for each key: what its book counted, and what is left in it after all messages. Much cheaper than its events."""

    def start():
        book, counts = OrderBook(tick), dict.fromkeys(NOTES, 0)
        bids, asks = book.sides["B"], book.sides["S"]

        def step(seq, kind, *rest) -> None:
            for note in book.apply(kind, *rest)[3]:
                counts[note] += 1
            bids.changes.clear(), asks.changes.clear()

        def end() -> tuple:
            left = [{"side": s, "price": p, "shares": level[0], "orders": level[1]} for s, side in book.sides.items() for p, level in side.levels.items()]
            return list(counts.items()), len(book.orders), len(bids.levels), len(asks.levels), left

        return step, end

    columns = ["seq", "msg_type", "order_ref", "new_order_ref", "side", "shares", "price", "exec_price", "printable"]
    return ordered_summary(messages.where(F.col("msg_type").isin(*APPLIED)).select(*keys, *columns), keys, ["seq"], start, STATE)


def state_levels(states: DataFrame, keys: list[str], n: int | None = None) -> DataFrame:
    """The levels in ``order_book_states``, best first: side, price, shares, orders, level from 1."""
    left = states.select(*keys, F.inline("levels"))
    better = Window.partitionBy(*keys, "side").orderBy(F.when(F.col("side") == "B", -F.col("price")).otherwise(F.col("price")))
    ranked = left.withColumn("level", F.row_number().over(better))
    return ranked.where(F.col("level") <= n) if n else ranked


def state_diagnostics(states: DataFrame, keys: list[str]) -> DataFrame:
    """The columns of ``diagnostics``, from ``order_book_states``."""
    named = states.select(*keys, *[F.col("counts")[n].alias(n) for n in NOTES], "live_orders", "bid_levels", "ask_levels")
    return named.withColumn("corruption", sum((F.col(c) for c in CORRUPT[1:]), F.col(CORRUPT[0])))


def order_levels(events: DataFrame, keys: list[str], n: int | None = None) -> DataFrame:
    """The levels that are left after all events, best first: side, price, shares, orders, level from 1."""
    one = events.select(*keys, F.explode("changes").alias("c")).groupBy(*keys, F.col("c.side").alias("side"), F.col("c.price").alias("price"))
    left = one.agg(F.sum("c.shares").alias("shares"), F.sum("c.orders").alias("orders")).where("shares > 0")
    better = Window.partitionBy(*keys, "side").orderBy(F.when(F.col("side") == "B", -F.col("price")).otherwise(F.col("price")))
    ranked = left.withColumn("level", F.row_number().over(better))
    return ranked.where(F.col("level") <= n) if n else ranked


def counter(note: str) -> Column:
    """How often a note was taken."""
    return F.coalesce(F.sum(F.size(F.filter("notes", lambda x: x == note))), F.lit(0)).cast("bigint").alias(note)


def diagnostics(events: DataFrame, keys: list[str]) -> DataFrame:
    """The counters of each key, the corruption total, and the last state."""
    counted = [counter(n) for n in NOTES]
    last = [F.max_by(c, "seq").alias(c) for c in ("live_orders", "bid_levels", "ask_levels")]
    return events.groupBy(*keys).agg(*counted, *last).withColumn("corruption", sum((F.col(c) for c in CORRUPT[1:]), F.col(CORRUPT[0])))


def whole(value: Column, by: int) -> Column:
    """Integer division, cut towards zero; exact for longs, as no double is involved."""
    return F.call_function("div", value, F.lit(by))


def tape(events: DataFrame, keys: list[str]) -> DataFrame:
    """Prints of each key: trades, shares, whole dollars (cut at each print), hidden trades, last price."""
    printed = F.col("print_shares").isNotNull()
    product = F.col("print_price") * F.col("print_shares")
    return events.groupBy(*keys).agg(
        F.count_if(printed).alias("trades"),
        F.coalesce(F.sum("print_shares"), F.lit(0)).alias("shares_traded"),
        F.coalesce(F.sum(F.when(printed, whole(product, 10000))), F.lit(0)).alias("notional_dollars"),
        F.count_if(F.col("hidden")).alias("hidden_trades"),
        F.coalesce(F.sum(F.when(F.col("hidden"), F.col("print_shares"))), F.lit(0)).alias("hidden_shares"),
        F.max_by("print_price", F.when(printed, F.col("seq"))).alias("last_price"),
    )


def resolved(messages: DataFrame, symbols: list[str], force: dict[str, int] | None = None) -> DataFrame:
    """Messages of the symbols, with ``symbol``: those after the directory entry that names the locate, or of a forced locate.

    The directory of a session is a few thousand rows; it is joined by locate, the latest entry before each message counting.
    """
    keep = F.col("symbol").isin(*symbols)
    if force:
        named = F.create_map(*[x for s, loc in force.items() for x in (F.lit(loc), F.lit(s))])
        return messages.withColumn("symbol", named[F.col("locate")]).where(keep)
    order = Window.partitionBy("file", "locate").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("symbol", F.last(F.when(F.col("msg_type") == "R", F.col("stock")), True).over(order)).where(keep)


def placed(rows: DataFrame, block: int = 1 << 16) -> DataFrame:
    """Add ``nth``, the place by seq from 1: the sizes of blocks of seq are added up, and rows are numbered within their block."""
    cut = rows.withColumn("_block", F.call_function("div", F.col("seq"), F.lit(block)))
    sizes = cut.groupBy("_block").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_block").orderBy("seq"))
    return cut.withColumn("_in", inside).join(starts, "_block").withColumn("nth", F.col("_start") + F.col("_in")).drop("_block", "_in", "_start")


def verify(events: DataFrame, truth: DataFrame) -> DataFrame:
    """Compare events with the truth by position: a row for each place that differs, with ``reason``.

    events and truth: seq order gives the place; msg_type, ts_ns, bid, bid_shares, ask, ask_shares with 0 for none.
    """
    shown = ["msg_type", "ts_ns", "bid", "bid_shares", "ask", "ask_shares"]
    events, truth, nth = placed(events.select("seq", *shown)), placed(truth.select("seq", *shown)), F.col("nth")
    got = events.select(nth.alias("nth"), F.struct(*[F.coalesce(F.col(c), F.lit(0)).alias(c) if c[:3] in ("bid", "ask") else F.col(c) for c in shown]).alias("got"))
    want = truth.select(nth.alias("nth"), F.struct(*shown).alias("want"))
    both = got.join(want, "nth", "full_outer")
    reason = F.when(F.col("want").isNull(), "extra").when(F.col("got").isNull(), "unused").when(F.col("got") != F.col("want"), "mismatch")
    return both.withColumn("reason", reason).where(F.col("reason").isNotNull())


STABLE = (
    "seq bigint, ts_ns bigint, complete boolean, sound boolean, bid bigint, bid_shares bigint, ask bigint, ask_shares bigint, bid_depth bigint, ask_depth bigint,"
    " bid_levels bigint, ask_levels bigint, notes array<string>"
)


def level_book(updates: DataFrame, keys: list[str], tick: int = 100, depth: int = 4) -> DataFrame:
    """One row per price-level update: the best prices, depth near them and level counts after it.

    updates: the keys, seq, ts_ns, side, price, size, complete. A price that can't be is counted, but its update still ends the transaction.
    Only rows with ``complete`` show a book that may be looked at.
    """

    def start():
        bids, asks = Ladder(True, tick), Ladder(False, tick)

        def step(row: tuple) -> tuple:
            seq, ts, side, price, size, complete = row[len(keys) :]
            notes: list[str] = []
            sound = price is not None and 0 < price <= LARGEST_PRICE
            if sound:
                (bids if side == "B" else asks).set(price, size, notes)
                notes.append("updates")
                if not complete:
                    notes.append("in_transition")
            else:
                notes.append("bad_price")
            bid, ask = bids.best(), asks.best()
            if complete:
                notes.append("transactions")
                if bid is not None and ask is not None and bid > ask:
                    notes.append("crossed")
            return (seq, ts, complete, sound, bid, bids.levels[bid][0] if bid is not None else None, ask, asks.levels[ask][0] if ask is not None else None, bids.within(depth), asks.within(depth), len(bids.levels), len(asks.levels), notes)

        return step

    return ordered_fold(updates.select(*keys, "seq", "ts_ns", "side", "price", "size", "complete"), keys, ["seq"], start, STABLE)


def sound_price(price: Column) -> Column:
    return price.between(1, LARGEST_PRICE)


def final_levels(updates: DataFrame, keys: list[str], n: int | None = None) -> DataFrame:
    """The levels that are left after all updates, best first (``level`` from 1): the last size of each price, if above zero."""
    last = updates.where(sound_price(F.col("price"))).groupBy(*keys, "side", "price").agg(F.max_by("size", "seq").alias("size")).where("size > 0")
    better = Window.partitionBy(*keys, "side").orderBy(F.when(F.col("side") == "B", -F.col("price")).otherwise(F.col("price")))
    ranked = last.withColumn("level", F.row_number().over(better))
    return ranked.where(F.col("level") <= n) if n else ranked


def depth_within(levels: DataFrame, keys: list[str], ticks: int = 4, tick: int = 100) -> DataFrame:
    """Shares of each side at most ``ticks`` from its best price, over ``final_levels``."""
    side = Window.partitionBy(*keys, "side")
    best = F.when(F.col("side") == "B", F.max("price").over(side)).otherwise(F.min("price").over(side))
    near = levels.withColumn("best", best).where(F.abs(F.col("price") - F.col("best")) <= ticks * tick)
    return near.groupBy(*keys, "side").agg(F.max("best").alias("best"), F.sum("size").alias("depth"))
