import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from effnum.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    # One machine: a temporary folder is shared by all workers, if none is named.
    if not session.conf.get("spark.checkpoint.dir", None):
        session.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-"))
    yield session
    session.stop()


@pytest.fixture
def tiny_blocks(monkeypatch):
    """Blocks of a few rows, so that small groups take the many-block routes."""
    from effnum.operators import blocks, sequences, trees

    monkeypatch.setattr(blocks, "rows_per_block", lambda dim: 4)
    monkeypatch.setattr(sequences, "HEIGHT", 3)
    monkeypatch.setattr(trees, "HEIGHT", 3)
