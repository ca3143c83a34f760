from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from keyloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    # tiny inputs: compiling every stage costs far more than running it interpreted
    plain = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"}
    return local_session(4, "keyloom-tests", **plain)


@pytest.fixture(scope="session")
def frame(spark):
    """Builds a small DataFrame from rows and a schema string, spread over a few partitions."""

    def build(rows, schema, parts=3):
        return spark.createDataFrame(list(rows), schema).repartition(parts)

    return build
