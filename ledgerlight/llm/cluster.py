"""What the operators share: tables in the cluster's shared folder, and ranks over hot groups."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlight.session import shared_dir


#: Rows and bytes of texts that go to a Python worker at a time.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


class Workspace:
    """Tables that cut the lineage: Parquet in the shared folder, so that a lost executor costs no upstream work.

    A table lasts until ``drop`` or, as results are lazy and may read it, until the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        for key, most in BATCHES.items():  # a worker holds a batch and what it makes of it
            spark.conf.set(key, most)
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        path = self._path(self.root)
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)  # only of what is there

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back."""
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        path = self._path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def whole_tiles(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 4096) -> Iterator[pa.Table]:
    """Sorted rows as tables of about ``rows``, none of which ends inside rows of equal ``keys`` (numbers)."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        more = pa.Table.from_batches([batch])
        rest = more if rest is None else pa.concat_tables([rest, more]).combine_chunks()
        if rest.num_rows > rows:
            change = np.flatnonzero(np.any([(c := rest.column(k).to_numpy())[1:] != c[:-1] for k in keys], axis=0))
            if len(change) and change[-1] >= rows:
                yield rest.slice(0, int(change[-1]) + 1)
                rest = rest.slice(int(change[-1]) + 1)
    if rest is not None and rest.num_rows:
        yield rest


def wrapped(df: DataFrame) -> DataFrame:
    """The rows as one column ``row``, so that no name of theirs meets those that an operator adds; ``row.*`` unwraps them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


#: Parts into which a group is dealt for ranking; a group's share of one task falls by this factor.
SALTS = 256


def running_total(df: DataFrame, keys: list[str], value: str, order: list[Column], out: str, per_key: DataFrame | None = None, salts: int = SALTS) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same keys that come before.

    The order is by a hash of ``order`` into ``salts`` parts, then by ``order``. Part sums are added up
    first, so that no task holds a whole group: one exchange by (keys, part), whatever the skew.
    ``per_key`` has columns to add, one row for each combination of keys. Keys must not be null.
    ``df`` is read twice; pass a written table.
    """
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(*keys, "_part").agg(F.sum(value).alias("_sum")).select(*keys, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    if per_key is not None:
        offsets = offsets.join(per_key, keys)
    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(offsets, [*keys, "_part"]).withColumn(out, F.col("_offset") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_part", "_offset")
