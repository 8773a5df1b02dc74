import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from ledgerlight.session import session

    shared = tmp_path_factory.mktemp("shared")
    out = session("local[4]", 4, "4g", **{"spark.sql.warehouse.dir": str(shared / "warehouse"), "spark.checkpoint.dir": f"file://{shared}/checkpoints"})
    yield out
    out.stop()
