import os
import sys
from pathlib import Path

# small products: threads of a numeric library wait for each other longer than they compute
os.environ.setdefault("OMP_NUM_THREADS", "1")

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from tallyloom.session import session

    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    own = session("tests", cores=4, partitions=4)
    yield own
    own.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
