"""Where a stream's rows end: files that executors write, so that the driver holds none of them."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame

from ledgerlight.session import shared_dir


def landed(stream: DataFrame) -> DataFrame:
    """What a stream that appends makes of all input there is now, in one trigger, as Parquet in the shared folder.

    Its checkpoint is there too, as executors read and write the state. Both last until the driver's JVM ends, for the result is lazy.
    """
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/stream-{uuid4().hex}"
    rows = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/rows")
    store = rows.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(rows)  # without input no trigger runs that would make it
    store.deleteOnExit(rows.getParent())
    run = stream.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start(f"{root}/rows")
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")
