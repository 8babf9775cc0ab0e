import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

SF = os.environ.get("ASSAY_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from assay.session import local_session

    return local_session(4, shuffle_partitions=4)


@pytest.fixture(scope="session")
def sf():
    return SF
