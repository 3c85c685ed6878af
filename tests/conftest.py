import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lodegraph.session import local_session

    shared = tmp_path_factory.mktemp("shared")
    session = local_session(4, "tests", shuffle_partitions="4", **{"spark.checkpoint.dir": f"file://{shared}", "spark.ui.showConsoleProgress": "false"})
    yield session
    session.stop()
