"""Session defaults shared by the command line, the benchmark and the tests."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from functools import wraps
from pathlib import Path

from pyspark.sql import SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str = "local[*]", shuffle_partitions: int = 8, memory: str = "8g", **more: str) -> SparkSession:
    """A session with the settings that the operators expect; ``more`` overrides them."""
    conf = CONF | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": memory} | more
    spark = SparkSession.builder.master(master).appName("ledgerlight").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or the one given to ``setCheckpointDir``.

    Without either, a session whose executors are in the driver's process gets a temporary folder; a cluster gets an
    error, as no folder of one machine is seen by all.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[[^]]*\])?\Z", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="ledgerlight-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, unless they find it where the driver's environment points.

    Functions that run on executors are pickled by the name of their module.
    """
    root = Path(__file__).resolve().parent
    home = str(root.parent)
    if home in [str(Path(p).resolve()) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p] or "site-packages" in home:
        return
    context = spark.sparkContext
    if getattr(context, "_ledgerlight_sent", False):
        return
    path = Path(tempfile.mkdtemp(prefix="ledgerlight-")) / "ledgerlight.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(path))
    context._ledgerlight_sent = True


def shipped(query):
    """The query, with ``ship`` before it."""

    @wraps(query)
    def run(spark, *args):
        ship(spark)
        return query(spark, *args)

    return run
