import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from visitframe.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "6g", 4)


@pytest.fixture(scope="session")
def tables(spark):
    from visitframe.plans.fixtures import Tables
    return Tables.of(spark, SF)
