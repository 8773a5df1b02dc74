"""From feature tables to a panel: features, trailing z-scores, tradeability and forward returns.

Everything is by window over (date, symbol) in the order of (ts, seq), but the running median, which is a fold.
Sums over long trailing windows are differences of running sums in decimals: a row costs the same whatever the window, and
nothing cancels.
"""

from __future__ import annotations

from bisect import insort
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ledgerlight.operators.fold import with_ordered_column
from ledgerlight.operators.tape import SECOND

#: In the order that models keep their coefficients in.
FEATURES = ["queue_imbalance", "depth_imbalance", "flow_imbalance", "signed_flow_norm", "spread_ticks", "trade_intensity", "ret_1", "ret_5", "ret_30", "vol_30", "depth_ratio"]
DAY = 86_400 * SECOND
#: Seconds of the day, UTC, of the regular session in standard and in summer time.
STANDARD, SUMMER = (52_200, 75_600), (48_600, 72_000)
EXACT, EXACT2 = "decimal(20,8)", "decimal(38,16)"


@dataclass(frozen=True)
class Config:
    horizon_s: int = 10
    zscore_window: int = 1800
    zscore_min_periods: int = 300
    tolerance_s: int = 5
    warmup_s: int = 300
    min_rows_per_symbol: int = 200
    max_spread_bps: float = 25.0
    max_spread_ratio: float = 4.0
    max_gap_s: float = 30.0
    min_touch_shares: int = 100
    session_only: bool = True
    flow_window: int = 300
    flow_min_periods: int = 30
    median_min_periods: int = 30


def ordered(keys: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("ts", "seq")


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom where bottom is above zero, else 0."""
    return F.when(bottom > 0, top.cast("double") / bottom).otherwise(0.0)


def imbalance(a: str, b: str) -> Column:
    return ratio(F.col(a) - F.col(b), F.col(a) + F.col(b))


def two_sided(table: DataFrame) -> DataFrame:
    """Rows with both sides and no crossed quote, with ts, mid_x2 and spread."""
    both = table.where((F.col("bid") > 0) & (F.col("ask") > 0) & (F.col("ask") >= F.col("bid")))
    return both.withColumns({"ts": F.col("ts_ns"), "mid_x2": F.col("bid") + F.col("ask"), "spread": F.col("ask") - F.col("bid")})


def in_session(table: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the regular session; the key's first row decides between standard (November to February) and summer time."""
    first = F.min("ts").over(Window.partitionBy(*keys))
    winter = F.month(F.timestamp_micros(F.call_function("div", first, F.lit(1000)))).isin(11, 12, 1, 2)
    second = F.call_function("div", F.pmod(F.col("ts"), F.lit(DAY)), F.lit(SECOND))
    inside = [(second >= lo) & (second < hi) for lo, hi in (STANDARD, SUMMER)]
    return table.withColumn("_in", F.when(winter, inside[0]).otherwise(inside[1])).where("_in").drop("_in")


def after_warmup(table: DataFrame, keys: list[str], warmup_s: int) -> DataFrame:
    start = F.min("ts").over(Window.partitionBy(*keys)) + warmup_s * SECOND
    return table.withColumn("_start", start).where(F.col("ts") >= F.col("_start")).drop("_start")


def enough_rows(table: DataFrame, keys: list[str], least: int) -> DataFrame:
    return table.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where(F.col("_n") >= least).drop("_n")


def trailing(table: DataFrame, keys: list[str], columns: list[str], window: int) -> tuple[DataFrame, dict[str, tuple[Column, Column, Column]]]:
    """Running sums of ``columns``, and for each the (count, sum, sum of squares) of the last ``window`` rows, nulls left out."""
    w = ordered(keys)
    run, back = w.rowsBetween(Window.unboundedPreceding, 0), window
    sums = {}
    for c in columns:
        x = F.col(c).cast(EXACT)
        sums |= {f"_n_{c}": F.count(c).over(run), f"_s_{c}": F.sum(x).over(run), f"_q_{c}": F.sum((x * x).cast(EXACT2)).over(run)}
    out = table.withColumns(sums)
    none = {"n": F.lit(0), "s": F.lit(0).cast(EXACT), "q": F.lit(0).cast(EXACT2)}

    def last(kind: str, c: str) -> Column:
        now = F.col(f"_{kind}_{c}")
        return F.coalesce(now, none[kind]) - F.coalesce(F.lag(f"_{kind}_{c}", back).over(w), none[kind])

    return out, {c: (last("n", c), last("s", c), last("q", c)) for c in columns}


def deviation(n: Column, s: Column, q: Column) -> Column:
    """Sample standard deviation from count, sum and sum of squares; null below two."""
    variance = (q - (s * s).cast("decimal(38,14)") / F.when(n > 0, n).cast("decimal(10,0)")).cast("double") / F.when(n > 1, n - 1)
    return F.sqrt(F.greatest(variance, F.lit(0.0)))


def with_features(table: DataFrame, keys: list[str], cfg: Config = Config()) -> DataFrame:
    """The eleven features and spread_bps, over ``two_sided`` rows."""
    w, mid = ordered(keys), F.col("mid_x2") / 2.0
    signed, touch = F.col("buy_shares") - F.col("sell_shares"), F.col("bid_shares") + F.col("ask_shares")
    out = table.withColumns({
        "queue_imbalance": imbalance("bid_shares", "ask_shares"),
        "depth_imbalance": imbalance("bid_depth", "ask_depth"),
        "flow_imbalance": imbalance("buy_shares", "sell_shares"),
        "spread_ticks": F.col("spread") / 100.0,
        "spread_bps": F.col("spread") / mid * 10_000.0,
        "trade_intensity": F.col("trades").cast("double"),
        "depth_ratio": F.least(F.greatest(ratio(F.col("bid_depth") + F.col("ask_depth"), touch), F.lit(0.0)), F.lit(100.0)),
        "_log": F.ln(mid),
        "_flow": F.abs(signed).cast("bigint"),
    })
    out = out.withColumns({f"ret_{n}": (F.col("_log") - F.lag("_log", n).over(w)) * 10_000.0 for n in (1, 5, 30)})
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumns({"_flows": F.sum("_flow").over(run), "_nth": F.row_number().over(w)})
    have = F.least(F.col("_nth"), F.lit(cfg.flow_window))
    scale = (F.col("_flows") - F.coalesce(F.lag("_flows", cfg.flow_window).over(w), F.lit(0))) / have.cast("double")
    recent = w.rowsBetween(-29, 0)
    out = out.withColumns({
        "_scale": F.when(have >= cfg.flow_min_periods, scale),
        "vol_30": F.coalesce(F.when(F.count("ret_1").over(recent) >= 10, F.stddev_samp("ret_1").over(recent)), F.lit(0.0)),
    })
    norm = F.when(F.col("_scale") > 0, F.greatest(F.least(signed / F.col("_scale"), F.lit(10.0)), F.lit(-10.0))).otherwise(0.0)
    return out.withColumn("signed_flow_norm", norm).drop("_log", "_flow", "_flows", "_nth", "_scale")


def standardised(table: DataFrame, keys: list[str], window: int, least: int, columns: list[str] = FEATURES) -> DataFrame:
    """Each feature as its trailing z-score: 0 where it doesn't vary, null until ``least`` values are there."""
    out, sums = trailing(table, keys, columns, window)
    made = {}
    for c, (n, s, q) in sums.items():
        made |= {f"_c_{c}": n, f"_m_{c}": s, f"_d_{c}": q}
    out = out.withColumns(made)
    scores = {}
    for c in columns:
        n, s, q = F.col(f"_c_{c}"), F.col(f"_m_{c}"), F.col(f"_d_{c}")
        sd = deviation(n, s, q)
        mean = s.cast("double") / F.when(n > 0, n)
        scores[c] = F.when(n >= least, F.when(F.coalesce(sd, F.lit(0.0)) > 0, (F.col(c) - mean) / sd).otherwise(0.0))
    return out.withColumns(scores).select(*table.columns)


class RunningMedian:
    """The median of all values so far, kept sorted in chunks, so that a value costs little among many."""

    def __init__(self, chunk: int = 512):
        self.chunks: list[list[float]] = [[]]
        self.n, self.chunk = 0, chunk

    def add(self, x: float) -> None:
        low, high = 0, len(self.chunks) - 1
        while low < high:
            middle = (low + high) // 2
            if self.chunks[middle] and self.chunks[middle][-1] < x:
                low = middle + 1
            else:
                high = middle
        insort(self.chunks[low], x)
        self.n += 1
        if len(self.chunks[low]) > 2 * self.chunk:
            whole = self.chunks[low]
            self.chunks[low : low + 1] = [whole[: self.chunk], whole[self.chunk :]]

    def at(self, k: int) -> float:
        for part in self.chunks:
            if k < len(part):
                return part[k]
            k -= len(part)
        raise IndexError(k)

    def median(self) -> float:
        return (self.at((self.n - 1) // 2) + self.at(ceil((self.n - 1) / 2))) / 2


def running_median(table: DataFrame, keys: list[str], value: str, least: int) -> DataFrame:
    """Add ``median``: that of ``value`` over the rows so far, null below ``least``. The rows stay as they are, repeated ones too."""

    def start():
        seen = RunningMedian()

        def step(x: float | None) -> float | None:
            if x is not None:
                seen.add(x)
            return seen.median() if seen.n >= least else None

        return step

    return with_ordered_column(table, keys, ["ts", "seq"], value, "median", start)


def tradeable(table: DataFrame, keys: list[str], cfg: Config = Config()) -> DataFrame:
    """Rows that could have been traded: spread below the ceiling, a live book, round lots on both sides. Adds gap_s."""
    gap = F.coalesce(F.col("ts") - F.lag("ts").over(ordered(keys)), F.lit(0)) / float(SECOND)
    both = running_median(table.withColumn("gap_s", gap), keys, "spread_bps", cfg.median_min_periods)
    top = F.least(F.lit(cfg.max_spread_bps), cfg.max_spread_ratio * F.coalesce("median", F.lit(cfg.max_spread_bps)))
    kept = (F.col("spread_bps") > 0) & (F.col("spread_bps") <= top) & (F.col("gap_s") <= cfg.max_gap_s)
    return both.where(kept & (F.col("bid_shares") >= cfg.min_touch_shares) & (F.col("ask_shares") >= cfg.min_touch_shares)).drop("median")


def with_forward_return(table: DataFrame, keys: list[str], horizon_s: float, tolerance_s: float) -> DataFrame:
    """fwd_bps and fwd_ts: the log return to the first row at or after the horizon, if it is within the tolerance."""
    ahead, late = int(horizon_s * SECOND), int(tolerance_s * SECOND)
    w = Window.partitionBy(*keys).orderBy("ts").rangeBetween(ahead, ahead + late)
    out = table.withColumn("_to", F.min(F.struct("ts", "seq", "mid_x2")).over(w))
    return out.withColumns({"fwd_bps": F.ln(F.col("_to.mid_x2") / F.col("mid_x2").cast("double")) * 10_000.0, "fwd_ts": F.col("_to.ts")}).drop("_to")


def build_panel(table: DataFrame, cfg: Config = Config(), keys: tuple[str, ...] = ("date", "symbol")) -> DataFrame:
    """The usable rows of a feature table with date, symbol and seq (its order among equal times), features and target."""
    by = list(keys)
    out = two_sided(table)
    if cfg.session_only:
        out = in_session(out, by)
    out = enough_rows(out, by, cfg.min_rows_per_symbol)
    out = enough_rows(after_warmup(out, by, cfg.warmup_s), by, cfg.min_rows_per_symbol)
    out = standardised(with_features(out, by, cfg), by, cfg.zscore_window, cfg.zscore_min_periods)
    out = enough_rows(tradeable(out, by, cfg), by, cfg.min_rows_per_symbol)
    return with_forward_return(out, by, cfg.horizon_s, cfg.tolerance_s).na.drop(subset=[*FEATURES, "fwd_bps"])
