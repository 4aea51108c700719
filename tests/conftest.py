import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from sessionlens.session import local_session

    session = local_session("tests", cores="4", partitions=4, memory="3g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
