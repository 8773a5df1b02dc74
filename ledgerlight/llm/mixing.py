"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Each source has a target of words (or of any other size of a document). Among all rates
``r`` from 0 to ``max_copies`` that meet the targets, entropy balancing takes those of least relative
entropy ``sum(r ln r - r + 1)``. They are exponential tilts by size, ``r = min(max_copies, exp(a x))`` with
``x`` a document's size over its source's mean, and ``a`` comes from the convex dual, one per source, whose
gradient is the source's sum of sizes times rates less its target. Guarded Newton steps solve all
duals at once over the counts of documents for each source and size; the documents are read once.

Rates then become whole copies: within a source the running number of copies, by size, is the rounded
running sum of rates; what is left of the error is filled by a few copies more or fewer.

Defined cases: a null or empty text has size 0 and is taken 0 times its size; a text of any length is one number here, and may
be rated 0 where it outweighs its source's target; sources may be null (one source, last in order); documents of one
source and size tie, and a hash of doc_id decides which get one copy more; rows that repeat (doc_id, source, size) get
the same number of copies; an empty table gives an empty one; other columns are ignored. Duals that aren't solved raise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlight.llm.cluster import Workspace, running_total, wrapped

#: A word is a run of anything but these.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
STEPS, STEPS_A_JOB = 80, 4
#: Sums of rates are kept as decimals, so that they don't depend on the order of addition.
EXACT = "decimal(38,10)"
CORRECTIONS = 4


def words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: int = 3) -> DataFrame:
    """Add ``target`` to one row per source (``source``, ``source_size``).

    The sources in code-point order, null last, weigh as ``weights``, repeated. They share the total
    by weight; a target stops at ``max_copies`` times its source and the excess is shared again. The
    level at which the shares settle is the largest of those got by taking the sources as stopped one
    by one, the scarcest for its weight first.
    """
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights) + 1).cast("int"))
    scarce = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    every, before, rest = Window.partitionBy(), scarce.rowsBetween(Window.unboundedPreceding, -1), scarce.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - max_copies * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    weighed = sources.withColumn("weight", weight)
    levels = weighed.withColumn("level", left / F.sum("weight").over(rest))
    return levels.withColumn("target", F.least(max_copies * F.col("source_size").cast("double"), F.max("level").over(every) * F.col("weight"))).drop("level", "weight")


def stepped(cells: DataFrame, state: DataFrame, max_copies: int) -> DataFrame:
    """One guarded Newton step of every source's dual: a grouped sum over the cells. A step out of the bracket becomes a bisection."""
    tilted, most = F.col("tilt") * F.col("size") / F.col("mean"), math.log(max_copies)
    mass = F.col("n") * F.col("size") * F.when(tilted < most, F.exp(F.least(tilted, F.lit(most)))).otherwise(float(max_copies))
    slope = F.when(tilted < most, mass * F.col("size") / F.col("mean")).otherwise(0.0)
    sums = cells.join(state, "key").groupBy(*state.columns).agg(F.sum(mass.cast(EXACT)).cast("double").alias("got"), F.sum(slope.cast(EXACT)).cast("double").alias("slope"))
    over, tilt = F.col("got") - F.col("target"), F.col("tilt")
    low, high = F.when(over < 0, tilt).otherwise(F.col("low")), F.when(over > 0, tilt).otherwise(F.col("high"))
    newton = tilt - F.try_divide(over, F.col("slope"))
    inside = F.coalesce((newton > low) & (newton < high), F.lit(False))
    stay = F.abs(over) <= 1e-9 * F.col("target")
    return sums.select(
        "key", "target", "mean", F.when(stay, tilt).otherwise(F.when(inside, newton).otherwise((low + high) / 2)).alias("tilt"),
        F.when(stay, F.col("low")).otherwise(low).alias("low"), F.when(stay, F.col("high")).otherwise(high).alias("high"), stay.alias("done"),
    )


def tilts(work: Workspace, cells: DataFrame, sources: DataFrame, max_copies: int) -> DataFrame:
    """(key, tilt, mean): Newton steps on every source's dual until all targets are met.

    cells: key, size, n, sizes above zero. sources: key, target, source_size, mean, least (size). A few steps make one job; its
    result, a row for each source, is written before the next.
    """
    none = F.lit(0.0)
    state = work.table(sources.select(
        "key", "target", "mean", none.alias("tilt"),
        F.least(none, F.ln(F.col("target") / F.col("source_size")) * F.col("mean") / F.col("least")).alias("low"),
        (F.lit(math.log(max_copies)) * F.col("mean") / F.col("least")).alias("high"), F.lit(False).alias("done"),
    ), "tilt0")
    for job in range(1, STEPS // STEPS_A_JOB + 1):
        for _ in range(STEPS_A_JOB):
            state = stepped(cells, state, max_copies)
        state = work.table(state, f"tilt{job}")
        work.drop(f"tilt{job - 1}")
        if not state.where(~F.col("done")).limit(1).count():
            break
    else:
        raise RuntimeError(f"the targets aren't met after {STEPS} steps")
    return state.select("key", "tilt", "mean")


def corrected(rated: DataFrame, max_copies: int) -> DataFrame:
    """Lessen every source's rounding error by copies of its longest documents that still fit into the error."""
    source = Window.partitionBy("key")
    off = F.col("target") - F.sum(F.col("size") * (F.col("n") * F.col("base") + F.col("more"))).over(source)
    room = F.when(F.col("off") > 0, F.when(F.col("base") < max_copies, F.col("n") - F.col("more")).otherwise(0)).otherwise(F.col("more"))
    fits = (F.col("size") > 0) & (F.col("size") <= F.abs("off")) & (F.col("room") > 0)
    step = F.least(F.col("room"), F.floor(F.abs("off") / F.greatest(F.col("size"), F.lit(1)))) * F.signum("off").cast("long")
    chosen = rated.withColumn("off", off).withColumn("room", room).withColumn("pick", F.max(F.when(fits, F.col("size"))).over(source))
    return chosen.withColumn("more", F.col("more") + F.when(F.col("size") == F.col("pick"), step).otherwise(0)).drop("off", "room", "pick")


def mix_sizes(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: int = 3) -> DataFrame:
    """Copies for (doc_id, source, size) rows: doc_id, source, size, source_size, target, rate, copies, n (equal rows)."""
    spark = sized.sparkSession
    work = Workspace(spark, "mixing")
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    units = work.table(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")).withColumn("key", key), "units")
    cells = work.table(units.groupBy("key", "source", "size").agg(F.sum("n").alias("n")), "cells")
    some = F.col("size") > 0
    sources = cells.groupBy("key", "source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"),
        (F.sum(F.col("size") * F.col("n")) / F.sum(F.when(some, F.col("n")))).alias("mean"),
        F.min(F.when(some, F.col("size"))).alias("least"),
    )
    aims = work.table(targets(sources, weights, max_copies), "targets")
    full = F.col("target") >= max_copies * F.col("source_size")
    solved = tilts(work, cells.where(some).select("key", "size", "n"), aims.where((F.col("source_size") > 0) & ~full), max_copies)
    rate = F.when(full, F.lit(float(max_copies))).otherwise(F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.log(F.lit(float(max_copies))))))
    rated = cells.drop("source").join(aims.drop("source", "mean", "least"), "key").join(solved, "key", "left")
    rated = rated.withColumn("rate", F.when(F.col("size") > 0, rate).otherwise(1.0)).withColumn("base", F.floor("rate").cast("int"))
    by_size = Window.partitionBy("key").orderBy("size")
    upto = F.floor(F.sum((F.col("n") * (F.col("rate") - F.col("base"))).cast(EXACT)).over(by_size.rowsBetween(Window.unboundedPreceding, 0)) + 0.5)
    rated = rated.withColumn("upto", upto).withColumn("more", F.col("upto") - F.lag("upto", 1, 0).over(by_size))
    for _ in range(CORRECTIONS):
        rated = corrected(rated, max_copies)
    per_cell = work.table(rated.select("key", "size", "source_size", "target", "rate", "base", "more"), "rates")
    ranked = running_total(units, ["key", "size"], "n", [F.xxhash64("doc_id"), F.col("doc_id")], "rank", per_cell)
    copies = (F.col("base") + (F.col("rank") < F.col("more")).cast("int")).cast("int")
    return ranked.select("doc_id", "source", "size", "source_size", "target", "rate", copies.alias("copies"), "n")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: int = 3) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate, copies, taken."""
    sized = docs.select("doc_id", "source", words(F.col("text")).alias("size"))
    out = mix_sizes(sized, weights, max_copies).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))
    return out.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("_i", "n")


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: int = 3) -> DataFrame:
    """The documents themselves, each as many times as the mix takes it; same columns.

    Documents without a word are taken once.
    """
    sized = docs.select("doc_id", "source", words(F.col("text")).alias("size"))
    plan = mix_sizes(sized, weights, max_copies).where("copies > 0").select("doc_id", "source", "size", "copies")
    on = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & F.col("row.source").eqNullSafe(F.col("source")) & (words(F.col("row.text")) == F.col("size"))
    return wrapped(docs).join(plan, on).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op1_mix(spark, sf_dir: str) -> DataFrame:
    """All documents, mixed by the weights 5, 2, 1 with at most 3 copies each."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies", "rate")
