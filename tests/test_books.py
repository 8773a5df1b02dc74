import pytest
from feeds import plain_tops, random_orders
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlight.operators import books, tape

P0 = 1_000_000


def book(*script, tick=100):
    b = books.OrderBook(tick)
    notes, prints = [], []
    for kind, *rest in script:
        args = dict(ref=0, new_ref=None, side=None, shares=None, price=None, exec_price=None, printable=None) | (rest[0] if rest else {})
        price, shares, hidden, found = b.apply(kind, **args)
        notes += found
        if shares is not None:
            prints.append((price, shares, hidden))
    return b, notes, prints


def add(ref, side, shares, price):
    return "A", dict(ref=ref, side=side, shares=shares, price=price)


def test_top_spread_and_partial_cancel():
    b, _, _ = book(add(1, "B", 500, P0), add(2, "S", 300, P0 + 100), ("X", dict(ref=1, shares=200)))
    assert (b.sides["B"].best(), b.sides["S"].best(), b.sides["B"].levels[P0]) == (P0, P0 + 100, [300, 1])


def test_executions_clamp_and_print():
    b, notes, prints = book(add(1, "S", 500, P0), ("E", dict(ref=1, shares=150)), ("E", dict(ref=1, shares=350)), ("E", dict(ref=1, shares=1)))
    assert not b.orders and b.sides["S"].best() is None and notes.count("executes") == 2 and "unknown_ref_exec" in notes
    assert prints == [(P0, 150, False), (P0, 350, False), (0, 1, False)]
    _, notes, prints = book(add(1, "S", 100, P0), ("E", dict(ref=1, shares=500)))
    assert "overfill" in notes and "negative_level_qty" not in notes and prints == [(P0, 500, False)]


def test_an_execution_at_another_price_reduces_the_resting_level():
    b, _, prints = book(add(1, "B", 400, P0), add(2, "B", 400, P0 - 100), ("C", dict(ref=1, shares=400, exec_price=P0 - 100, printable=True)), ("C", dict(ref=2, shares=100, exec_price=P0 + 700, printable=False)))
    assert b.sides["B"].levels == {P0 - 100: [300, 1]} and prints == [(P0 - 100, 400, False)]


def test_replacements_inherit_the_side():
    b, _, _ = book(add(1, "S", 100, P0 + 200), ("U", dict(ref=1, new_ref=2, shares=300, price=P0 + 100)))
    assert b.orders == {2: ("S", P0 + 100, 300)} and b.sides["S"].levels == {P0 + 100: [300, 1]}
    chain = [("U", dict(ref=i, new_ref=i + 1, shares=100, price=P0)) for i in range(1, 19999)]
    b, notes, _ = book(add(1, "B", 100, P0), *chain)
    assert len(b.orders) == 1 and notes.count("replaces") == 19998
    b, notes, _ = book(add(1, "B", 100, P0), ("U", dict(ref=1, new_ref=2, shares=0, price=P0)), ("U", dict(ref=9, new_ref=3, shares=5, price=P0)))
    assert not b.orders and "unknown_ref_replace" in notes


def test_odd_orders():
    b, notes, prints = book(add(1, "B", 0, P0), add(2, "B", 100, P0 + 50), add(3, "B", 100, P0), add(3, "B", 50, P0 - 100), ("D", dict(ref=2)), ("P", dict(side="B", shares=300, price=P0)))
    assert {"zero_share_adds", "off_tick", "unrepresentable_price", "duplicate_order_refs", "missing_level"} <= set(notes)
    assert b.sides["B"].levels == {P0: [100, 1], P0 - 100: [50, 1]} and b.orders == {3: ("B", P0 - 100, 50)} and prints == [(P0, 300, True)]


def test_depth_from_the_touch():
    side = books.Ladder(False, 100)
    for i, q in ((0, 10), (1, 20), (2, 40), (100, 80)):
        side.add(P0 + 100 * i, q, [])
    assert [side.within(d) for d in (0, 1, 2, 5, 100)] == [10, 30, 70, 70, 150]
    notes = []
    for p in (P0 - 100, P0 + 5000, P0, P0):
        side.set(p, 0, notes)
    assert notes.count("absent_clear") == 3


@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 500)), max_size=200), st.booleans())
@settings(max_examples=60, deadline=None)
def test_ladders_against_a_plain_dictionary(updates, bid):
    side, plain = books.Ladder(bid, 1), {}
    for price, size in updates:
        side.set(price + 1, size, [])
        plain.pop(price + 1, None)
        if size:
            plain[price + 1] = size
        best = (max if bid else min)(plain, default=None)
        assert side.best() == best
        assert side.within(4) == sum(q for p, q in plain.items() if best is not None and abs(p - best) <= 4)
    assert [p for p, *_ in side.top(3)] == sorted(plain, reverse=bid)[:3]


COLUMNS = "symbol string, seq bigint, ts_ns bigint, msg_type string, order_ref bigint, new_order_ref bigint, side string, shares bigint, price bigint, exec_price bigint, printable boolean"


@pytest.mark.parametrize("seed", [1, 2])
def test_events_against_a_plain_book(spark, seed):
    feeds = {s: random_orders(1500, seed * 10 + i) for i, s in enumerate("AB")}
    df = spark.createDataFrame([(s, *r) for s, rows in feeds.items() for r in rows], COLUMNS)
    events = books.order_book_events(df, ["symbol"]).cache()
    for s, rows in feeds.items():
        got = [tuple(r) for r in events.where(f"symbol = '{s}'").orderBy("seq").select("seq", "bid", "bid_shares", "bid_orders", "ask", "ask_shares", "ask_orders").collect()]
        assert got == plain_tops(rows)
    last = {r.symbol: r for r in books.diagnostics(events, ["symbol"]).collect()}
    levels = books.order_levels(events, ["symbol"])
    for s in "AB":
        assert last[s].bid_levels == levels.where(f"symbol = '{s}' and side = 'B'").count()
        assert last[s].corruption > 0 and last[s].duplicate_order_refs > 0


def test_verification(spark):
    df = spark.createDataFrame([("A", *r) for r in random_orders(400, 9)], COLUMNS)
    events = books.order_book_events(df, ["symbol"])
    zero = [f"coalesce({c}, 0) as {c}" for c in ("bid", "bid_shares", "ask", "ask_shares")]
    truth = events.selectExpr("seq", "ts_ns", "msg_type", *zero).cache()
    assert books.verify(events, truth).count() == 0
    wrong = truth.selectExpr("seq", "ts_ns", "msg_type", "if(seq = 7, bid + 1, bid) as bid", "bid_shares", "ask", "ask_shares").where("seq < 390")
    reasons = {r.reason: r.n for r in books.verify(events, wrong).groupBy("reason").agg({"*": "count"}).toDF("reason", "n").collect()}
    assert reasons["mismatch"] == 1 and reasons["extra"] == truth.count() - wrong.count()


DEEP = "symbol string, seq bigint, ts_ns bigint, kind string, side string, price bigint, size bigint, complete boolean, odd_lot boolean, iso boolean, status string, event string"
S = 1_000_000_000


def lv(seq, side, price, size, complete=True, ts=None):
    return "Z", seq, ts if ts is not None else seq * S, "level", side, price, size, complete, None, None, None, None


def tr(seq, price, size, odd=False, iso=False):
    return "Z", seq, seq * S, "trade", None, price, size, None, odd, iso, None, None


def test_a_sweep_shows_only_when_it_is_complete(spark):
    up = [lv(i, "S", P0 + 100 * i, 100 * i) for i in (1, 2, 3)]
    sweep = [lv(4, "S", P0 + 100, 0, False), lv(5, "S", P0 + 200, 0, False), lv(6, "S", P0 + 300, 300)]
    rows = books.level_book(spark.createDataFrame(up + sweep + [lv(7, "B", -5, 5)], DEEP), ["symbol"]).orderBy("seq").collect()
    assert [r.ask for r in rows if r.complete] == [P0 + 100] * 3 + [P0 + 300] * 2
    assert rows[-1].notes == ["bad_price", "transactions"] and rows[5].ask_shares == 300


def test_quote_rule(spark):
    data = [tr(1, P0, 100), lv(2, "B", P0, 100), lv(3, "S", P0 + 200, 100), tr(4, P0 + 200, 300), tr(5, P0, 400), tr(6, P0 + 100, 500), tr(7, -1, 9)]
    got = tape.classified(tape.merged(spark.createDataFrame(data, DEEP), ["symbol"]))
    assert [(r.size, r.aggressor) for r in got.orderBy("seq").collect()] == [(100, "unclassified"), (300, "buy"), (400, "sell"), (500, "unclassified")]


def test_samples_carry_their_own_time(spark):
    data = [lv(1, "B", P0, 100, ts=1 * S), tr(2, P0, 7), lv(3, "B", P0, 200, ts=97 * S), lv(4, "B", P0, 300, ts=int(98.5 * S)), ("Z", 5, 99 * S, "event", None, None, None, None, None, None, None, "O"), ("Z", 6, 99 * S, "status", None, None, None, None, None, None, "H", None)]
    table = tape.feature_table(spark.createDataFrame(data, DEEP), ["symbol"], S).orderBy("ts_ns").collect()
    assert [(r.ts_ns, r.trades, r.bid_shares, r.trading_status, r.spread) for r in table] == [(97 * S, 1, 200, "?", -1), (int(98.5 * S), 0, 300, "?", -1), (int(98.5 * S), 0, 300, "H", -1), (99 * S, 0, 300, "?", -1)]
    every = tape.feature_table(spark.createDataFrame(data, DEEP), ["symbol"], 0)
    assert every.count() == 5


def test_notional_is_cut_at_each_print(spark):
    data = [lv(1, "B", P0, 1), tr(2, 1_000_099, 3, True), tr(3, 99, 1, False, True), lv(4, "B", P0, 2)]
    row = tape.feature_table(spark.createDataFrame(data, DEEP), ["symbol"], 0).where("trades > 0").first()
    assert (row.trades, row.notional_cents, row.odd_lot_trades, row.sweep_trades, row.last_price) == (2, 30002, 1, 1, 99)


def test_directory_comes_before(spark):
    rows = [("f", 1, "A", 5, None), ("f", 2, "R", 5, "ABC"), ("f", 3, "A", 5, None), ("f", 4, "A", 6, None)]
    df = spark.createDataFrame(rows, "file string, seq bigint, msg_type string, locate int, stock string")
    assert [r.seq for r in books.resolved(df, ["ABC"]).collect()] == [3]
    assert [r.seq for r in books.resolved(df, ["X"], {"X": 6}).collect()] == [4]
