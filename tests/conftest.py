import os
import shutil
import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


@pytest.fixture(scope="session")
def spark():
    from gridloom.session import get_session, ship

    shared = tempfile.mkdtemp()
    s = get_session("tests", "local[4]", **{"spark__sql__shuffle__partitions": "4", "spark__ui__enabled": "false", "spark__checkpoint__dir": f"file://{shared}", "spark__driver__memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()
    shutil.rmtree(shared, ignore_errors=True)
