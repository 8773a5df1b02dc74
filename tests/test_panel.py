import json
import math

import numpy as np
import pandas as pd
import pytest

from ledgerlight.functions import stats
from ledgerlight.operators import model, panel, scoring
from ledgerlight.operators.tape import FEATURES
from ledgerlight.plans import brief, walk
from ledgerlight.sources import store, tables

S = 1_000_000_000
START = 1_577_457_000
CFG = panel.Config(warmup_s=0, min_rows_per_symbol=10, zscore_window=60, zscore_min_periods=20)


def quotes(n=400, seed=1, symbol="AAA", mid=1_000_000, start=START, signal=False):
    rng = np.random.default_rng(seed)
    lean = rng.integers(-18, 19, n) * 100 if signal else np.zeros(n, int)
    bid_shares, ask_shares = 2100 + lean, 2100 - lean
    if not signal:
        bid_shares, ask_shares = rng.integers(2, 40, n) * 100, rng.integers(2, 40, n) * 100
    moves = rng.integers(-1, 2, n) * 100
    if signal:
        pull = np.convolve(lean, np.ones(8), "full")[:n]
        moves = np.where(np.abs(pull) > 1500, np.sign(pull) * 100, moves).astype(int)
        moves = np.concatenate(([0], moves[:-1]))
    mids = mid + np.cumsum(moves)
    out = pd.DataFrame({"ts_ns": (start + np.arange(n)) * S, "symbol": symbol, "bid": mids - 50, "bid_shares": bid_shares, "ask": mids + 50, "ask_shares": ask_shares, "spread": 100})
    out["bid_depth"], out["ask_depth"], out["bid_levels"], out["ask_levels"] = out.bid_shares * 3, out.ask_shares * 3, 5, 5
    out["trades"], out["trade_shares"] = rng.integers(0, 4, n), 100
    out["buy_shares"], out["sell_shares"], out["unclassified_shares"] = rng.integers(0, 5, n) * 100, rng.integers(0, 5, n) * 100, 0
    out["notional_cents"], out["last_price"], out["odd_lot_trades"], out["sweep_trades"], out["trading_status"] = 1000, mids, 0, 0, "T"
    return out


def table(spark, frame, date="20191227"):
    frame = frame.assign(date=date, seq=range(len(frame)))
    return spark.createDataFrame(frame, f"{FEATURES}, date string, seq bigint")


def test_horizons_go_by_time(spark):
    frame = quotes()
    frame.loc[200:, "ts_ns"] += 600 * S
    got = panel.build_panel(table(spark, frame), CFG).select("ts", "fwd_ts").collect()
    assert got and all(10 * S <= r.fwd_ts - r.ts <= 15 * S for r in got)
    short = panel.build_panel(table(spark, quotes(300)), CFG)
    assert 0 < short.count() <= 290 and short.where("fwd_bps is null").count() == 0


def test_filters(spark):
    one = quotes(300)
    one.loc[:99, "ask"] = 0
    assert panel.two_sided(table(spark, one)).count() == 200
    wide = quotes(600)
    wide.loc[300:, "ask"] = wide.bid + 200_000
    assert panel.build_panel(table(spark, wide), CFG).agg({"spread_bps": "max"}).first()[0] <= 25
    late = quotes(400)
    late.loc[200:, "ts_ns"] += 300 * S
    assert panel.build_panel(table(spark, late), CFG).agg({"gap_s": "max"}).first()[0] <= 30


def test_no_flow_keeps_the_symbol_and_prices_do_not_show(spark):
    flat = quotes(300).assign(buy_shares=0, sell_shares=0)
    rows = panel.build_panel(table(spark, flat), CFG).select("signed_flow_norm").distinct().collect()
    assert [r[0] for r in rows] == [0.0]
    for mid in (1_000_000, 50_000_000):
        got = panel.with_features(panel.two_sided(table(spark, quotes(100, mid=mid))), ["date", "symbol"]).first()
        assert got.spread_ticks == 1 and math.isclose(got.spread_bps, 100 / ((got.bid + got.ask) / 2) * 1e4)


def plain_panel(g, cfg):
    """The same columns by pandas."""
    mid = (g.bid + g.ask) / 2
    out = pd.DataFrame({"queue_imbalance": (g.bid_shares - g.ask_shares) / (g.bid_shares + g.ask_shares), "spread_ticks": (g.ask - g.bid) / 100, "trade_intensity": g.trades.astype(float)})
    signed = (g.buy_shares - g.sell_shares).astype(float)
    scale = signed.abs().rolling(300, min_periods=30).mean()
    out["signed_flow_norm"] = (signed / scale).where(scale > 0, 0.0).clip(-10, 10)
    log = np.log(mid)
    for n in (1, 5, 30):
        out[f"ret_{n}"] = (log - log.shift(n)) * 1e4
    out["vol_30"] = out.ret_1.rolling(30, min_periods=10).std().fillna(0.0)
    for c in out.columns:
        roll = out[c].rolling(cfg.zscore_window, min_periods=cfg.zscore_min_periods)
        mean, sd = roll.mean(), roll.std()
        out[c] = ((out[c] - mean) / sd).where(sd > 1e-9, 0.0).where(mean.notna())
    return out


def test_trailing_statistics_against_pandas(spark):
    frame = quotes(500, seed=4)
    keys = ["date", "symbol"]
    got = panel.standardised(panel.with_features(panel.two_sided(table(spark, frame)), keys), keys, 60, 20).orderBy("seq").toPandas()
    want = plain_panel(frame, CFG)
    for c in want.columns:
        assert np.allclose(got[c].astype(float), want[c], atol=1e-5, equal_nan=True), c


def test_running_median():
    seen, values = panel.RunningMedian(4), np.random.default_rng(1).integers(0, 50, 300).tolist()
    for i, v in enumerate(values):
        seen.add(v)
        assert seen.median() == np.median(values[: i + 1])


def test_session_and_daylight(spark):
    rows = [("w", i, (START - START % 86400 + s) * S) for i, s in enumerate((52199, 52200, 75599, 75600))] + [("s", i, (1_561_939_200 + s) * S) for i, s in enumerate((48599, 48600, 71999, 72000))]
    got = panel.in_session(spark.createDataFrame(rows, "symbol string, seq bigint, ts bigint"), ["symbol"])
    assert sorted((r.symbol, r.seq) for r in got.collect()) == [("s", 1), ("s", 2), ("w", 1), ("w", 2)]


def scored(spark, pred, y, spread=None):
    n = len(y)
    frame = pd.DataFrame({"date": "1", "symbol": "A", "ts": range(n), "seq": range(n), "pred": pred, "fwd_bps": y, "spread_bps": np.ones(n) if spread is None else spread, "ret_5": np.roll(y, 3)})
    return spark.createDataFrame(frame, "date string, symbol string, ts bigint, seq bigint, pred double, fwd_bps double, spread_bps double, ret_5 double")


def plain_t(x, lags):
    e = x - x.mean()
    var = e @ e / len(x) + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) / len(x) for k in range(1, lags + 1))
    return x.mean() / math.sqrt(var / len(x))


def test_scorecard_against_numpy(spark):
    rng = np.random.default_rng(3)
    y = rng.normal(0, 2, 3000).round(1)
    pred = (0.3 * y + rng.normal(0, 1, 3000)).round(2)
    card = scoring.score(scored(spark, pred, y))
    sign, moved = np.sign(pred), (np.sign(pred) != 0) & (y != 0)
    net = sign * y - 0.5 * (sign != 0)
    assert math.isclose(card.ic_spearman, np.corrcoef(pd.Series(pred).rank(), pd.Series(y).rank())[0, 1], rel_tol=1e-9)
    assert math.isclose(card.ic_pearson, np.corrcoef(pred, y)[0, 1], rel_tol=1e-9)
    assert math.isclose(card.hit_rate, (np.sign(y[moved]) == sign[moved]).mean())
    assert math.isclose(card.net_t, plain_t(net, 10), rel_tol=1e-9) and math.isclose(card.gross_t, plain_t(sign * y, 10), rel_tol=1e-9)
    assert math.isclose(card.sharpe_daily, net.mean() / net.std() * math.sqrt(3000), rel_tol=1e-9)
    assert card.gross_t > 5 and card.net_bps > 0


def test_scores_of_noise_costs_and_small_samples(spark):
    rng = np.random.default_rng(5)
    noise = scoring.score(scored(spark, rng.normal(size=20_000), rng.normal(size=20_000)))
    assert abs(noise.ic_spearman) < 0.02
    y = rng.normal(size=2000)
    dear = scoring.score(scored(spark, y + rng.normal(0, 3, 2000), y, np.full(2000, 10.0)))
    assert dear.net_bps < 0 < dear.gross_bps
    assert math.isnan(scoring.score(scored(spark, y[:30], y[:30])).net_bps)
    half = y * (np.arange(2000) % 2)
    perfect = scoring.score(scored(spark, y, half))
    assert perfect.hit_rate == 1 and abs(perfect.moved_fraction - 0.5) < 0.01
    still = scoring.score(scored(spark, np.zeros(100), y[:100]))
    assert math.isnan(still.ic_pearson) and math.isnan(still.hit_rate)


def test_statistics():
    assert stats.deflated_sharpe(0.005, 50, 20000) < 0.2 < 0.6 < stats.deflated_sharpe(0.005, 1, 20000)
    chances = [stats.deflated_sharpe(0.01, t, 20000) for t in (1, 2, 5, 20, 100)]
    assert chances == sorted(chances, reverse=True)
    assert abs(stats.normal_ppf(0.975) - 1.959963985) < 1e-8 and math.isnan(stats.normal_ppf(0.0))
    x = np.convolve(np.random.default_rng(2).normal(size=5000), np.ones(10), "valid") + 0.5
    naive = x.mean() / (x.std() / math.sqrt(len(x)))
    e = x - x.mean()
    hac = stats.newey_west_t(len(x), x.mean(), e @ e, [e[k:] @ e[:-k] for k in range(1, 11)])
    assert hac < 0.6 * naive and math.isnan(stats.newey_west_t(20, 1.0, 1.0, []))
    assert [stats.log_linear_bucket(v) for v in (0, 63, 64, 127, 128, 130)] == [0, 63, 64, 127, 128, 129]


def test_ridge_against_numpy(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(3, 2, (500, 11))
    x[:, 4] = 1.0
    y = x @ rng.normal(size=11) + rng.normal(size=500) + 5
    frame = pd.DataFrame(x, columns=panel.FEATURES).assign(fwd_bps=y, date="20200102", symbol="A")
    df = spark.createDataFrame(frame)
    fitted = model.fit(df)
    mean, sd = x.mean(0), x.std(0)
    z = (x - mean) / np.where(sd > 0, sd, 1)
    beta = np.linalg.solve(z.T @ z + 50 * np.eye(11), z.T @ (y / y.std() - (y / y.std()).mean()))
    assert np.allclose(fitted.coefficients, beta, atol=1e-8) and math.isclose(fitted.target_std, y.std(), rel_tol=1e-9)
    want = (z @ beta + y.mean() / y.std()) * y.std()
    got = df.withColumn("p", fitted.prediction()).toPandas()
    assert np.allclose(got.p, want, atol=1e-6)
    assert model.fingerprint_row(df).first().fingerprint == fitted.train_fingerprint
    again = model.Model.from_json(fitted.to_json())
    assert again == fitted and fitted.in_sample_ic > 0.5
    with pytest.raises(ValueError):
        model.Model.from_json(json.dumps(json.loads(fitted.to_json()) | {"schema_version": 2}))
    with pytest.raises(ValueError):
        model.fit(df.limit(0))
    with pytest.raises(ValueError):
        model.fit(df.withColumn("fwd_bps", df.fwd_bps * 0))


def test_store(spark, tmp_path):
    kept = store.Store(tmp_path)
    assert kept.days == [] and kept.newest() is None and kept.cards(spark).count() == 0
    fitted = model.Model("20200102", ["20200102"], 1, panel.FEATURES, [0.0] * 11, 0.0, [0.0] * 11, [1.0] * 11, 1.0, 50.0, "f")
    for day in ("20200103", "20200102"):
        kept.keep(fitted, day)
    assert kept.newest("20200103")[0] == "model_20200102.json" and kept.newest()[0] == "model_20200103.json" and kept.newest("20200102") is None
    assert kept.newest()[1] == fitted and store.Store(tmp_path, "other").newest() is None
    assert [kept.tried({"a": a}) for a in (1, 1, 2, 3)] == [1, 1, 2, 3] and kept.tried() == 3
    assert set(json.loads((tmp_path / "trials.json").read_text())) == {store.key_of({"a": a}) for a in (1, 2, 3)}
    kept.add({"date": "20200102", "config_id": "x", "n": 1, "net_bps": math.nan})
    with (tmp_path / "scorecard.jsonl").open("a") as f:
        f.write("\n{broken\n")
    kept.add({"date": "20200102", "config_id": "x", "n": 2, "net_bps": 0.5})
    cards = kept.cards(spark)
    assert [(r.n, math.isnan(r.net_bps)) for r in cards.orderBy("line").collect()] == [(1, True), (2, False)]
    assert [r.n for r in store.latest(cards).collect()] == [2]
    days = spark.createDataFrame([("20200102",), ("20200103",), ("20200103",)], "day string")
    assert [r.day for r in store.unscored(days, cards).collect()] == ["20200103"]


def test_judgements(spark):
    base = {"days": 30, "rows": 1000, "n_trials": 3, "ic": 0.05, "net_bps": 0.5, "spread_bps": 1.0, "tradeable": 0.2, "reversal_ic": 0.01, "t_across_days": 3.0, "dsr": 0.99}
    first = lambda **c: brief.judged(base | c)[0]
    assert "holds against chance" in first() and first(net_bps=-1.0).startswith("Trading costs more") and "chance" in first(t_across_days=1.0) and "chance" in first(t_across_days=math.nan)
    assert "luckiest of 3" in first(dsr=0.5) and "no net return" in first(net_bps=math.nan)
    assert "IC +0.2000 to +0.0500" in brief.judged(base | {"reversal_ic": 0.2})[1] and "3 days" in brief.judged(base | {"days": 3})[-1]
    assert len(brief.judged(base | {"net_bps": -1.0})) == 2 and len(brief.judged(base | {"net_bps": -1.0, "ic": 0.001})) == 2 and brief.judged(base) == [first()]
    assert brief.judged(brief.record(spark.createDataFrame([], f"{store.CARD}, line bigint"), 1)) == ["Nothing has been scored so far."]


def test_histogram_and_percentiles(spark):
    values = [0, 1, 63, 64, 127, 128, 130, 1000, 10**6, 2**62] * 3 + [5] * 70
    rows = spark.createDataFrame([(v,) for v in values], "v bigint")
    counts = stats.histogram(rows, "v")
    want = {}
    for v in values:
        want[stats.log_linear_bucket(v)] = want.get(stats.log_linear_bucket(v), 0) + 1
    assert {r.bucket: r.n for r in counts.collect()} == want
    got = {r.share: r.value for r in stats.percentiles(counts, [0.0, 0.5, 0.79, 0.9, 1.0]).collect()}
    assert got == {0.0: 0, 0.5: 5, 0.79: 63, 0.9: 130, 1.0: 2**62}


@pytest.mark.parametrize("signal", [True, False])
def test_walk_forward_finds_what_is_there_and_nothing_else(spark, tmp_path, signal):
    cfg = panel.Config(warmup_s=0, min_rows_per_symbol=50, zscore_window=300, zscore_min_periods=60)
    kept = store.Store(tmp_path)
    for i, day in enumerate(("20200102", "20200103", "20200106")):
        frame = pd.concat([quotes(900, 10 * i + k, s, start=START + 86400 * i, signal=signal) for k, s in enumerate(("AAA", "BBB"))])
        tables.write_features(table(spark, frame, day), kept.place(day))
    added = walk.walk(spark, str(tmp_path), cfg, train_days=2)
    assert [r["date"] for r in added] == ["20200103", "20200106"] and all(r["model_trained_through"] < r["date"] for r in added)
    ic = np.mean([r["ic_spearman"] for r in added])
    assert ic > 0.05 if signal else abs(ic) < 0.1
    assert walk.walk(spark, str(tmp_path), cfg, train_days=2) == []
    report = brief.brief(spark, str(tmp_path), cfg)
    assert "Session 20200106" in report and "pooled: 2 days" in report and kept.days == ["20200102", "20200103", "20200106"]
