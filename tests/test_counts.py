from test_books import DEEP, P0, lv, tr

from ledgerlight.streaming import counts


def test_event_time_windows(spark, tmp_path):
    rows = spark.createDataFrame([lv(1, "B", P0, 5), tr(2, P0, 3), tr(3, P0 + 50, 4), tr(65, P0, 1)], DEEP)
    rows.withColumnRenamed("kind", "msg_type").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.withColumnRenamed("kind", "msg_type").schema).parquet(str(tmp_path / "in"))
    for name, out in (("mix", counts.message_mix(stream)), ("bars", counts.trade_bars(stream.where("msg_type = 'trade'"), every="1 minute"))):
        q = out.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted((r.window.start.minute, r.msg_type, r.n) for r in spark.table("mix").collect()) == [(0, "level", 1), (0, "trade", 2), (1, "trade", 1)]
    assert sorted((r.trades, r.shares, r.notional_cents) for r in spark.table("bars").collect()) == [(1, 1, 10_000), (2, 7, 30_000 + 40_002)]
