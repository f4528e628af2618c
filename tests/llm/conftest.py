import os
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[2])
# Python workers import the package, wherever pytest is started
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text) rows, with columns whose names the operators use for their own."""

    def make(*rows):
        return spark.createDataFrame([(i, t, "x", 1.0, "n") for i, t in rows], "doc_id long, text string, key string, score double, node string")

    return make
