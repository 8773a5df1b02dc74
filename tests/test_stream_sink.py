import subprocess
import sys

from conftest import ROOT

from ledgerlight.plans.market import QUERIES
from ledgerlight.session import shared_dir
from ledgerlight.streaming.sink import landed

DATA = "/root/testdata/sf0.001"

#: The driver may be sent a megabyte in all; the tops of sf0.1 are several.
NARROW = """
from ledgerlight.plans.market import QUERIES
from ledgerlight.session import session

spark = session("local[2]", 2, "1g", **{"spark.driver.maxResultSize": "1m"})
tops = QUERIES["stream_stable_top"](spark, "/root/testdata/sf0.1")
print("rows", tops.count(), QUERIES["l2_stable_top"](spark, "/root/testdata/sf0.1").count())
spark.stop()
"""


def test_tops_larger_than_what_the_driver_may_be_sent(tmp_path):
    run = subprocess.run([sys.executable, "-c", NARROW], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    _, got, want = [x for x in run.stdout.splitlines() if x.startswith("rows")][0].split()
    assert int(got) == int(want) > 20_000


def test_tops_are_files_of_the_shared_folder(spark):
    views = spark.catalog.listTables()
    got = QUERIES["stream_stable_top"](spark, DATA)
    files = got.inputFiles()
    assert files and all(f.split("://")[-1].lstrip("/").startswith(shared_dir(spark).split("://")[-1].lstrip("/")) for f in files)
    assert spark.catalog.listTables() == views
    want = QUERIES["l2_stable_top"](spark, DATA)
    assert got.columns == want.columns and got.count() > 0
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_events_that_are_a_folder_of_files(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    events.write.parquet(f"{tmp_path}/other.parquet")
    got = QUERIES["stream_stable_top"](spark, str(tmp_path)).collect()
    assert sorted(got, key=str) == sorted(QUERIES["l2_stable_top"](spark, DATA).collect(), key=str)


def test_a_stream_without_input_lands_no_rows(spark, tmp_path):
    out = landed(spark.readStream.schema("a bigint, b string").parquet(str(tmp_path)))
    assert out.columns == ["a", "b"] and out.collect() == []
