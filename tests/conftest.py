import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tracestrata import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__driver__memory="4g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """rows([...], schema) -> DataFrame"""
    return lambda data, schema: spark.createDataFrame(data, schema)


EVENT = (
    "repo_id long, activity string, timestamp timestamp, actor_login string, actor_id long, "
    "push_size double, action string, create_ref_type string, delete_ref_type string, "
    "review_state string, pr_merged boolean, event_seq long"
)
_NAMES = [part.split()[0] for part in EVENT.split(", ")]


@pytest.fixture
def events(spark):
    """Canonical events from dicts; missing fields are null, order gives event_seq."""

    def make(*given):
        data = [
            tuple({"event_seq": i, **row}.get(name) for name in _NAMES)
            for i, row in enumerate(given)
        ]
        return spark.createDataFrame(data, EVENT)

    return make
