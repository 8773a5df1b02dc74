"""Scores of predictions against realised returns, as one or two passes of aggregates."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from math import isfinite, nan, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlight.functions.stats import newey_west_t

LEAST = 50


@dataclass
class Scorecard:
    n: int
    ic_pearson: float = nan
    ic_spearman: float = nan
    hit_rate: float = nan
    moved_fraction: float = nan
    gross_bps: float = nan
    net_bps: float = nan
    gross_t: float = nan
    net_t: float = nan
    sharpe_per_bar: float = nan
    sharpe_daily: float = nan
    mean_spread_bps: float = nan
    tradeable_fraction: float = nan
    baseline_zero_bps: float = nan
    baseline_reversal_ic: float = nan

    def as_dict(self) -> dict:
        return asdict(self)


def finite(*columns: str) -> Column:
    test = F.lit(True)
    for c in columns:
        test = test & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return test


def correlation(x: str, y: str) -> Column:
    """Pearson's; null where either doesn't vary. The built-in divides by zero there, also inside a condition, as aggregates come first."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


#: Parts of an octave into which values are dealt for ranking.
PARTS = 1024


def octave(value: Column) -> Column:
    """A whole number that grows with a finite value: its sign, and the part of the octave that its size is in."""
    size = F.floor(F.log2(F.abs(value)) * PARTS) + 2048 * PARTS
    return F.when(value == 0, F.lit(0)).otherwise(F.signum(value).cast("bigint") * size).cast("bigint")


def average_ranks(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Add r_<column>: ranks from 1 of finite values, ties sharing their mean.

    Distinct values are counted and dealt by parts of octaves. The counts of the parts, some thousands, are added up in order;
    within a part the values are. No window holds all rows or all values.
    """
    for c in columns:
        counts = rows.groupBy(F.col(c).cast("double").alias("_v")).agg(F.count("*").alias("_k")).withColumn("_part", octave(F.col("_v")))
        sums = counts.groupBy("_part").agg(F.sum("_k").alias("_n"))
        before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        starts = sums.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
        inside = F.sum("_k").over(Window.partitionBy("_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
        ranks = counts.join(starts, "_part").select("_v", (F.col("_start") + inside - (F.col("_k") - 1) / 2.0).alias(f"r_{c}"))
        rows = rows.join(ranks, F.col(c).cast("double").eqNullSafe(F.col("_v"))).drop("_v")
    return rows


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row with ``ic``."""
    ranked = average_ranks(rows.select(F.col(x).alias("x"), F.col(y).alias("y")).where(finite("x", "y")), ["x", "y"])
    return ranked.agg(correlation("r_x", "r_y").alias("ic"))


def positions(rows: DataFrame, cost_multiplier: float = 0.5) -> DataFrame:
    """Add sign, gross, cost and net of a unit position in the predicted direction; rows that aren't finite go."""
    sign = F.signum("pred")
    rows = rows.where(finite("fwd_bps", "pred", "spread_bps")).withColumns({"sign": sign, "gross": sign * F.col("fwd_bps"), "cost": cost_multiplier * F.col("spread_bps")})
    return rows.withColumn("net", F.col("gross") - F.when(F.col("sign") != 0, F.col("cost")).otherwise(0.0))


def hits() -> tuple[Column, Column]:
    """hit_rate among positions whose price moved, and the fraction that moved."""
    y, sign = F.col("fwd_bps"), F.col("sign")
    moved = (sign != 0) & (y != 0)
    hit = F.avg(F.when(moved, (F.signum(y) == sign).cast("double")))
    return hit.alias("hit_rate"), F.avg(F.when(sign != 0, (y != 0).cast("double"))).alias("moved_fraction")


def sharpe(column: str) -> Column:
    sd = F.stddev_pop(column)
    return F.when(sd > 0, F.avg(column) / sd)


def summary(held: DataFrame) -> DataFrame:
    """One row of means over ``positions``."""
    return held.agg(
        F.count("*").alias("n"), correlation("pred", "fwd_bps").alias("ic_pearson"), *hits(), F.avg("gross").alias("gross_bps"), F.avg("net").alias("net_bps"),
        sharpe("net").alias("sharpe_per_bar"), F.avg("spread_bps").alias("mean_spread_bps"), F.avg((F.abs("pred") > F.col("cost")).cast("double")).alias("tradeable_fraction"),
    )


def lag_products(held: DataFrame, columns: list[str], lags: int, order: list[str], within: list[str] | None = None) -> DataFrame:
    """For each column: its mean, the sum of squared deviations (<column>_0) and of products with those 1 to ``lags`` rows before.

    The lags run over all rows in ``order``, whose first names but the last two are keys, and so go over from one key to the next;
    ``within`` keeps them inside keys of its own. Products inside a key come from a window over the key; those across come from
    the first and last ``lags`` rows of each key, numbered by the keys' sizes and dealt by blocks. Rows are exchanged once.
    """
    means = held.agg(*[F.avg(c).alias(f"m_{c}") for c in columns])
    keys = within or order[:-2]
    rest = order if within else order[-2:]
    rows = held.select(*dict.fromkeys([*keys, *rest]), *columns).crossJoin(F.broadcast(means))
    rows = rows.withColumns({f"e_{c}": F.col(c) - F.col(f"m_{c}") for c in columns})
    w = Window.partitionBy(*keys).orderBy(*rest)
    made = {f"{c}_{k}": F.col(f"e_{c}") * (F.lag(f"e_{c}", k).over(w) if k else F.col(f"e_{c}")) for c in columns for k in range(lags + 1)}
    inside = rows.withColumns(made).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"{c}_mean") for c in columns], *[F.coalesce(F.sum(name), F.lit(0.0)).alias(name) for name in made])
    if within or not keys:
        return inside
    placed = rows.withColumns({"_at": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy(*keys))})
    sizes = held.groupBy(*keys).agg(F.count("*").alias("_size"))  # a row for each key, as small as a directory
    in_order = Window.orderBy(*keys)
    starts = sizes.select(*keys, F.row_number().over(in_order).alias("_key"), (F.sum("_size").over(in_order) - F.col("_size")).alias("_start"))
    edge = placed.where((F.col("_at") < lags) | (F.col("_at") >= F.col("_n") - lags)).join(starts, keys).withColumn("_nth", F.col("_start") + F.col("_at"))
    block = 1 << 14
    at, tail = F.call_function("div", F.col("_nth"), F.lit(block)), F.pmod(F.col("_nth"), F.lit(block)) >= block - lags
    own, next_ = F.struct(at.alias("_block"), F.lit(True).alias("_own")), F.struct((at + 1).alias("_block"), F.lit(False).alias("_own"))
    dealt = edge.select("_key", "_nth", *[f"e_{c}" for c in columns], F.explode(F.when(tail, F.array(own, next_)).otherwise(F.array(own))).alias("_to")).select("*", "_to.*")
    b = Window.partitionBy("_block").orderBy("_nth")
    across = {}
    for k in range(1, lags + 1):
        other = (F.lag("_key", k).over(b) != F.col("_key")) & (F.lag("_nth", k).over(b) == F.col("_nth") - k)
        across |= {f"x_{c}_{k}": F.when(other, F.col(f"e_{c}") * F.lag(f"e_{c}", k).over(b)) for c in columns}
    between = dealt.withColumns(across).where("_own").agg(*[F.coalesce(F.sum(name), F.lit(0.0)).alias(name) for name in across])
    both = inside.crossJoin(F.broadcast(between))
    return both.withColumns({name[2:]: F.col(name[2:]) + F.col(name) for name in across}).drop(*across)


def score(panel: DataFrame, horizon_s: int = 10, cost_multiplier: float = 0.5, order: tuple[str, ...] = ("date", "symbol", "ts", "seq")) -> Scorecard:
    """The scorecard of ``pred`` on a panel with fwd_bps, spread_bps and ret_5."""
    held = positions(panel, cost_multiplier).cache()
    try:
        got = summary(held).first()
        if got.n < LEAST:
            return Scorecard(got.n)
        back = held.withColumn("rev", -F.col("ret_5"))
        ics = [spearman(held, "pred", "fwd_bps").first().ic, spearman(back, "rev", "fwd_bps").first().ic]
        lags = max(horizon_s, 10)
        sums = lag_products(held, ["gross", "net"], lags, list(order)).first()
    finally:
        held.unpersist()
    number = lambda x: nan if x is None else float(x)
    t = {c: newey_west_t(sums.n, sums[f"{c}_mean"], sums[f"{c}_0"], [sums[f"{c}_{k}"] for k in range(1, lags + 1)]) for c in ("gross", "net")}
    per_bar = number(got.sharpe_per_bar)
    return Scorecard(
        got.n, number(got.ic_pearson), number(ics[0]), number(got.hit_rate), number(got.moved_fraction), got.gross_bps, got.net_bps, t["gross"], t["net"],
        per_bar, per_bar * sqrt(got.n) if isfinite(per_bar) else nan, got.mean_spread_bps, got.tradeable_fraction, 0.0, number(ics[1]),
    )


def pooled(cards: DataFrame) -> DataFrame:
    """One row over daily scorecards: means weighted by n (finite values only), t of the net across days, worst, best and positive days."""
    ok = lambda c: F.when(finite(c), F.col(c))
    mean = lambda c: F.try_divide(F.sum(ok(c) * F.col("n")), F.sum(F.when(finite(c), F.col("n"))))
    net = ok("net_bps")
    sd = F.stddev_samp(net)
    names = {"ic": "ic_spearman", "hit": "hit_rate", "gross_bps": "gross_bps", "net_bps": "net_bps", "spread_bps": "mean_spread_bps", "tradeable": "tradeable_fraction", "reversal_ic": "baseline_reversal_ic", "moved": "moved_fraction", "sharpe_per_bar": "sharpe_per_bar"}
    t = F.when((F.count(net) >= 2) & (sd > 0), F.avg(net) / (sd / F.sqrt(F.count(net))))
    return cards.agg(
        F.count("*").alias("days"), F.sum("n").cast("bigint").alias("rows"), *[mean(c).alias(a) for a, c in names.items()], t.alias("t_across_days"),
        F.min(net).alias("worst_day_net"), F.max(net).alias("best_day_net"), F.count_if(net > 0).alias("days_positive"),
    )
