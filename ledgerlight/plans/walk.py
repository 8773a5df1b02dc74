"""Walk-forward research: score each day with the newest model that has not seen it, then train again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.functions.stats import deflated_sharpe
from ledgerlight.operators.model import fit
from ledgerlight.operators.panel import FEATURES, Config, build_panel
from ledgerlight.operators.scoring import score
from ledgerlight.sources.store import Store, key_of, now, unscored


def models_before(days: DataFrame, models: DataFrame) -> DataFrame:
    """(day, through): for each day the newest model strictly before it, null where there is none.

    Both kinds of rows are put in one order, so that the join by order needs one window, not all pairs.
    """
    from pyspark.sql.window import Window

    both = days.select("day", F.lit(None).cast("string").alias("through")).union(models.select(F.col("through").alias("day"), "through"))
    order = Window.orderBy("day", F.col("through").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    asof = both.withColumn("last", F.last("through", True).over(order))
    return asof.where(F.col("through").isNull()).select("day", F.col("last").alias("through"))


def panel_from_files(spark: SparkSession, store: Store, days: list[str], cfg: Config) -> DataFrame:
    """The panel over the feature files of several days; each (date, symbol) stands for itself."""
    return build_panel(store.rows(spark, days), cfg)


def walk(spark: SparkSession, root: str, cfg: Config = Config(), date: str = "all", alpha: float = 50.0, train_days: int = 20, cost: float = 0.5, rescore: bool = False, keyed_models: bool = False) -> list[dict]:
    """Score and train over the days of a store; the records added to the scorecard.

    A day that is already scored or has no usable row is passed over, its model with it. ``keyed_models`` keeps a
    model folder for each configuration, so that no configuration is scored with another's model.
    """
    config = {"features": FEATURES, "horizon_s": cfg.horizon_s, "alpha": alpha, "train_days": train_days, "cost_multiplier": cost, "model": "ridge"}
    name, added = key_of(config), []
    store = Store(root, name if keyed_models else "")
    trials, every = store.tried(config), store.days
    todo = [d for d in every if date in ("all", d)]
    if todo and not rescore:
        wanted = spark.createDataFrame([(d,) for d in todo], "day string")
        todo = sorted(r.day for r in unscored(wanted, store.cards(spark).where(F.col("config_id") == name)).collect())
    for day in todo:
        panel = panel_from_files(spark, store, [day], cfg).cache()
        try:
            if panel.isEmpty():
                continue
            if prior := store.newest(before=day):
                file, fitted = prior
                card = score(panel.withColumn("pred", fitted.prediction()), cfg.horizon_s, cost)
                record = {
                    "date": day, "config_id": name, "scored_at": now(), "model_file": file, "model_trained_through": fitted.trained_through,
                    "model_train_rows": fitted.n_train_rows, "model_fingerprint": fitted.train_fingerprint, "n_symbols": panel.select("symbol").distinct().count(),
                    "deflated_sharpe": deflated_sharpe(card.sharpe_per_bar, trials, card.n), "n_trials": trials, **card.as_dict(),
                }
                store.add(record)
                added.append(record)
        finally:
            panel.unpersist()
        seen = every[: every.index(day) + 1][-train_days:]
        train = panel_from_files(spark, store, seen, cfg).cache()
        try:
            if not train.isEmpty():
                store.keep(fit(train, alpha), day)
        finally:
            train.unpersist()
    return added
