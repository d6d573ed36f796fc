import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from paperstream.session import local_session

    session = local_session(4, app="tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "3g"})
    yield session
    session.stop()
