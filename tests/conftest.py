import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT.parent))
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from longspark.session import build_session

    session = build_session("tests", cores="8", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()
