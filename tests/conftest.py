import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from busline.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("busline-tests", "local[8]", spark__sql__shuffle__partitions="4",
                            spark__ui__enabled="false", spark__driver__memory="8g",
                            spark__ui__showConsoleProgress="false")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="busline-tests-"))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
