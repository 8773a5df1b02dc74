"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir), with docs what the stage before has kept, and returns a DataFrame; all but the last
return the columns of documents. ``run`` writes each stage's rows to the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlight.llm import lines, mixing, packing, quality, similar
from ledgerlight.llm.cluster import Workspace


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, learnt from the labelled ones."""
    return quality.accepted(docs, quality.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that are spread over many sources; n_chars counts what is left."""
    return lines.recounted(lines.without_boilerplate(docs), docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: texts whose shingles of five words have a Jaccard similarity of 0.8 or more."""
    return similar.deduplicated(docs, width=5)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 ids, packed into windows, with their ids."""
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", simhash_stage),
    ("mixing sources", mixing_stage),
    ("packing", packing_stage),
]
#: SQL can't express the classifier, the mix or the plan of the windows; tests hold each stage against its operator, and the operators against plainer versions of their parts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = work.table(stage(spark, docs, sf_dir), str(k))
    return docs
