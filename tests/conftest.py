import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from quillspark.session import local_session

    settings = {}
    if not os.environ.get("SPARK_CONF_DIR"):
        settings["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    session = local_session(4, name="tests", **settings)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")
