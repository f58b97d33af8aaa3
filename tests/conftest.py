import pytest

from quillstream.session import get_session


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[4]", "tests", spark__sql__shuffle__partitions="4", spark__driver__memory="3g", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
