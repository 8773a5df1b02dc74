from feeds import random_orders

from ledgerlight.operators import books
from ledgerlight.plans import views
from ledgerlight.streaming import books as streams

COLUMNS = "symbol string, seq bigint, ts_ns bigint, msg_type string, order_ref bigint, new_order_ref bigint, side string, shares bigint, price bigint, exec_price bigint, printable boolean"


def drain(stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def replay(spark, rows, folder, parts):
    """Rows written as files that arrive one after the other."""
    for i in range(parts):
        rows.where(f"ntile = {i + 1}").drop("ntile").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.drop("ntile").schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_level_book_as_a_stream_equals_the_batch(spark, tmp_path):
    streams.prepare(spark)
    updates = views.depth(spark, "/root/testdata/sf0.001").where("kind = 'level'").select("symbol", "seq", "ts_ns", "side", "price", "size", "complete")
    rows = updates.selectExpr("*", "ntile(3) over (order by seq) as ntile")
    got = drain(streams.stream_level_book(replay(spark, rows, str(tmp_path / "in"), 3), views.TICK), "tops").where("complete")
    want = books.level_book(updates, ["symbol"], views.TICK).where("complete")
    columns = ["symbol", "seq", "bid", "bid_shares", "ask", "ask_shares", "bid_depth", "ask_depth", "bid_levels", "ask_levels"]
    assert sorted(got.select(columns).collect()) == sorted(want.select(columns).collect())
    assert got.where("late").count() == 0


def test_order_book_as_a_stream_equals_the_batch(spark, tmp_path):
    streams.prepare(spark)
    data = [("S", *r) for r in random_orders(300, 5)]
    feed = spark.createDataFrame(data, COLUMNS)
    rows = feed.selectExpr("*", "ntile(2) over (order by seq) as ntile")
    got = drain(streams.stream_order_book(replay(spark, rows, str(tmp_path / "in"), 2)), "orders_stream")
    want = books.order_book_events(feed, ["symbol"])
    columns = ["seq", "msg_type", "bid", "bid_shares", "bid_orders", "ask", "ask_shares", "ask_orders", "print_price", "print_shares", "live_orders"]
    assert [tuple(r) for r in got.select(columns).orderBy("seq").collect()] == [tuple(r) for r in want.select(columns).orderBy("seq").collect()]
