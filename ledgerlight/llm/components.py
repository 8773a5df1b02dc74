"""Connected components of a graph that no machine holds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.cluster import Workspace

ROUNDS = 60


def least_places(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For places 0 to n - 1 linked by pairs (a, b): the least place that each reaches. For what one task holds."""
    label, before = np.arange(n), None
    while before is None or (label != before).any():
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
    return label


def components(work: Workspace, edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long, not null); root is the least node reachable.

    Alternates large and small stars until the edges are stars around their roots, in about log(n) rounds. Each
    round is two grouped minima, summed up before the exchange, and two joins, whose hot keys adaptive
    execution can split; a hub is never gathered in one task.
    """
    now = work.table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges0")
    mark = None
    for step in range(1, ROUNDS + 1):
        both = now.union(now.select("v", "u"))
        least = both.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = now.select(F.col("v").alias("x"), "u").join(least, "x").select("u", F.col("m").alias("v"))
        large = work.table(large.where("u <> v").distinct(), f"large{step}")
        low = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        small = large.join(low, large.u == low.x)
        small = small.select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("x", "m"))
        now = work.table(small.distinct().toDF("u", "v"), f"edges{step}")
        work.drop(f"large{step}")
        work.drop(f"edges{step - 1}")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"no fixed point after {ROUNDS} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return work.table(roots.union(now.select("v", "v").distinct()), "roots")
