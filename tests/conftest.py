import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from sparkledger.session import session

    made = session(4, 4, "6g")
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """Values of an expression over rows: evaluate(rows, schema, {name: column}) -> list of dicts, in order."""

    def run(rows, schema, **columns):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_i int, {schema}")
        return [r.asDict() for r in df.select("_i", *(c.alias(n) for n, c in columns.items())).orderBy("_i").collect()]

    return run
