import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")


@pytest.fixture(scope="session")
def spark():
    from quillgraph.session import local_session, ship

    session = local_session(
        4,
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="4g",
        spark__default__parallelism="4",
    )
    ship(session)
    yield session
    session.stop()
