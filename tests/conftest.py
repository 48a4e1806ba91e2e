from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from runlens.session import session

    folder = tmp_path_factory.mktemp("shared")
    made = session("tests", master="local[4]", shuffle_partitions=4, spark__checkpoint__dir=f"file://{folder}", spark__driver__memory="4g", spark__sql__warehouse__dir=str(folder / "warehouse"))
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF
