"""A research store: a folder of feature files by day, models by day, a log of scorecards and a book of the configurations tried.

The names of the folders, files and keys are fixed by the documents that other tools read. Scores are a log that is only
appended to and read as a table by Spark; what counts is decided by queries over it.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_left
from dataclasses import fields
from datetime import UTC, datetime
from hashlib import sha256
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.operators.model import Model
from ledgerlight.operators.scoring import Scorecard
from ledgerlight.sources.tables import read_features

#: Fixed by the documents: a day in a file's name.
DAY = r"(\d{8})"
NUMBERS = [f.name for f in fields(Scorecard) if f.name != "n"]
CARD = ", ".join(
    [f"{c} string" for c in ("date", "config_id", "scored_at", "model_file", "model_trained_through", "model_fingerprint")]
    + [f"{c} bigint" for c in ("n", "model_train_rows", "n_symbols", "n_trials")] + [f"{c} double" for c in (*NUMBERS, "deflated_sharpe")]
)


def now() -> str:
    return datetime.now(UTC).isoformat(timespec="seconds")


def key_of(config: dict) -> str:
    """Twelve hexadecimal digits for a configuration, whatever the order of its keys."""
    return sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:12]


def latest(cards: DataFrame) -> DataFrame:
    """The last card of each date and configuration: a day that is scored again counts once."""
    whole = F.struct(*[c for c in cards.columns if c != "line"])
    return cards.groupBy("date", "config_id").agg(F.max_by(whole, "line").alias("card"), F.max("line").alias("line")).select("card.*", "line")


def unscored(days: DataFrame, cards: DataFrame) -> DataFrame:
    """The days, each once, that no card is about."""
    return days.select("day").distinct().join(cards.select(F.col("date").alias("day")), "day", "left_anti")


class Store:
    """``group`` keeps the models apart, so that those of different configurations don't mix."""

    def __init__(self, root: str | Path, group: str = ""):
        self.root = Path(root)
        self.models = self.root / "models" / group

    def _days(self, folder: Path, name: str) -> list[str]:
        """The days in the names of a folder's files that match, in order."""
        seen = os.listdir(folder) if folder.is_dir() else []
        return sorted(m[1] for m in map(re.compile(name).fullmatch, seen) if m)

    # Features

    @property
    def days(self) -> list[str]:
        return self._days(self.root / "features", DAY + r"\.csv\.gz")

    def place(self, day: str) -> str:
        return str(self.root / "features" / f"{day}.csv.gz")

    def rows(self, spark: SparkSession, days: list[str]) -> DataFrame:
        """The feature rows of some days as one table, with ``date``."""
        return read_features(spark, [self.place(d) for d in days])

    # Models

    def newest(self, before: str = "99999999") -> tuple[str, Model] | None:
        """The name and content of the last model whose training ended before a day, so that it has not seen it."""
        found = self._days(self.models, rf"model_{DAY}\.json")
        if not (n := bisect_left(found, before)):
            return None
        file = self.models / f"model_{found[n - 1]}.json"
        return file.name, Model.from_json(file.read_text())

    def keep(self, model: Model, day: str) -> None:
        self.models.mkdir(parents=True, exist_ok=True)
        replaced(self.models / f"model_{day}.json", model.to_json())

    # Scores and trials

    def add(self, card: dict) -> None:
        """Append a card to the log, in one write, so that logs of several writers stay whole."""
        self.root.mkdir(parents=True, exist_ok=True)
        log = os.open(self.root / "scorecard.jsonl", os.O_WRONLY | os.O_CREAT | os.O_APPEND, 0o644)
        try:
            os.write(log, f"{json.dumps(card, sort_keys=True)}\n".encode())
        finally:
            os.close(log)

    def cards(self, spark: SparkSession) -> DataFrame:
        """CARD's columns and ``line``, the place in the log; lines that hold no card are left out."""
        log = self.root / "scorecard.jsonl"
        if not log.exists():
            return spark.createDataFrame([], f"{CARD}, line bigint")
        text = spark.read.text(f"file://{log.resolve()}").withColumn("line", F.monotonically_increasing_id())
        return text.select(F.from_json("value", CARD).alias("card"), "line").where("card.date is not null").select("card.*", "line")

    def tried(self, config: dict | None = None) -> int:
        """How many configurations there are in the book, with this one noted."""
        path = self.root / "trials.json"
        try:
            book = json.loads(path.read_bytes())
        except (FileNotFoundError, ValueError):
            book = {}
        before = len(book)
        if config is not None:
            book.setdefault(key_of(config), {"config": config, "first_seen": now()})
        if len(book) > before:
            self.root.mkdir(parents=True, exist_ok=True)
            replaced(path, json.dumps(book, indent=2, sort_keys=True))
        return len(book)


def replaced(path: Path, text: str) -> None:
    """Write a file whole or not at all."""
    part = path.with_name(f".{path.name}.{os.getpid()}")
    part.write_text(text)
    part.replace(path)
