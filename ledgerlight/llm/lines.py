"""Line dedup by distinct-site spread, with DataFrame functions only.

A line found on many sites (the documents' ``source``) is boilerplate. For each line's hash a HyperLogLog sketch
of its sites is built in every task and merged by the aggregation, so that no list of sites is ever
gathered. Lines whose estimate is near the threshold get an exact distinct count; the others are decided by
the sketch, whose error is far smaller than their distance. Boilerplate lines go from every document but the
first that has them (least doc_id, then text hash), so that no passage is lost altogether.

A line is compared without spaces, tabs and carriage returns around it; blank lines are never counted nor removed.

Defined cases: a null text stays null; a text whose lines all go becomes empty; a null source is one site of its own,
the same as the empty one; a null doc_id comes last; repeated rows are treated alike; an empty table gives an
empty one; other columns are kept by ``without_boilerplate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.cluster import Workspace, wrapped

MIN_SITES = 6
#: Registers of a sketch, as a power of two; its relative standard error is 1.04 / sqrt(registers).
REGISTERS = 10
BLANK = " \t\r"


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, site, pos, line): a row for each line that isn't blank, by its hash."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce("source", F.lit("")).alias("site"), F.posexplode(split_lines(F.col("text"))).alias("pos", "raw"))
    bare = F.trim("raw", F.lit(BLANK))
    return rows.where(bare != "").select("doc_id", "text_hash", "site", "pos", F.xxhash64(bare).alias("line"))


def site_sketches(lines: DataFrame, registers: int = REGISTERS) -> DataFrame:
    """(line, sketch, first): a sketch of the sites of each line, and the first document that has it."""
    return lines.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(registers)).alias("sketch"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first"))


def merged_sketches(*tables: DataFrame) -> DataFrame:
    """The sketches of several tables as one, as for a corpus that grows."""
    every = tables[0]
    for more in tables[1:]:
        every = every.unionByName(more)
    return every.groupBy("line").agg(F.hll_union_agg("sketch").alias("sketch"), F.min("first").alias("first"))


def boilerplate(work: Workspace, lines: DataFrame, sketches: DataFrame, min_sites: int, registers: int) -> DataFrame:
    """(line, first) of the lines on ``min_sites`` sites or more."""
    band = max(1.0, min_sites * 4 * 1.04 / 2 ** (registers / 2))
    likely = sketches.select("line", F.hll_sketch_estimate("sketch").alias("sites"), "first").where(F.col("sites") >= min_sites - band)
    likely = work.table(likely, "likely")
    near = likely.where(F.col("sites") <= min_sites + band)
    exact = lines.select("line", "site").join(near.select("line"), "line").groupBy("line", "site").agg(F.lit(1).alias("one")).groupBy("line").agg(F.count("*").alias("exact"))
    sure = likely.where(F.col("sites") > min_sites + band).select("line", "first")
    return work.table(sure.union(near.join(exact.where(F.col("exact") >= min_sites), "line").select("line", "first")), "boilerplate")


def removals(docs: DataFrame, min_sites: int = MIN_SITES, registers: int = REGISTERS) -> DataFrame:
    """(doc_id, text_hash, gone): the positions of the lines to remove, in order."""
    work = Workspace(docs.sparkSession, "lines")
    lines = work.table(line_table(docs), "lines")
    bad = boilerplate(work, lines, site_sketches(lines, registers), min_sites, registers)
    later = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash")))
    return lines.join(bad, "line").where(later).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("pos")).alias("gone"))


def rebuilt(docs: DataFrame, min_sites: int, registers: int) -> DataFrame:
    """(row, text, n_lines, n_removed): each document, its text cleaned, its lines before and those gone.

    Between each two removed lines the rest is taken as one slice.
    """
    gone = removals(docs, min_sites, registers)
    text = F.col("row.text")
    joined = wrapped(docs).join(gone, F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64(text) == F.col("text_hash")), "left").withColumn("split", split_lines(text))
    ends = F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(F.size("split")))
    slices = F.transform(F.sequence(F.lit(2), F.size("gone") + 2), lambda k: F.slice(F.col("split"), F.element_at(ends, k - 1) + 2, F.element_at(ends, k) - F.element_at(ends, k - 1) - 1))
    kept = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.flatten(slices), "\n"))
    counts = [F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long").alias(n) for c, n in (("split", "n_lines"), ("gone", "n_removed"))]
    return joined.select("row", kept.alias("text"), *counts)


def without_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, registers: int = REGISTERS) -> DataFrame:
    """The documents without boilerplate lines; same columns."""
    out = rebuilt(docs, min_sites, registers)
    return out.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def cleaned(docs: DataFrame, min_sites: int = MIN_SITES, registers: int = REGISTERS) -> DataFrame:
    """doc_id, text, n_lines, n_removed: every document's text without boilerplate, its lines before and those gone."""
    return rebuilt(docs, min_sites, registers).select("row.doc_id", "text", "n_lines", "n_removed")


def recounted(docs: DataFrame, like: DataFrame) -> DataFrame:
    """``docs`` with n_chars, where ``like`` has it, as the length of the text."""
    if "n_chars" not in like.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType))


def op9_lines(spark, sf_dir: str) -> DataFrame:
    """All documents without the lines found on six sources or more, but for the first document of each."""
    return cleaned(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))


SQL = """
WITH parts AS (
  SELECT doc_id, coalesce(source, '') AS site, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL
), exploded AS (
  SELECT doc_id, site, unnest(lines) AS raw, generate_subscripts(lines, 1) AS pos FROM parts
), trimmed AS (
  SELECT doc_id, site, raw, pos, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM exploded
), bad AS (
  SELECT line, min(doc_id) AS first_id FROM trimmed WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= 6
), marked AS (
  SELECT t.doc_id, t.raw, t.pos, b.line IS NOT NULL AND t.doc_id <> b.first_id AS gone FROM trimmed t LEFT JOIN bad b USING (line)
), rebuilt AS (
  SELECT doc_id, string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS text, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(r.text, '') END AS text,
  CAST(coalesce(r.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(r.n_removed, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN rebuilt r USING (doc_id)
"""
