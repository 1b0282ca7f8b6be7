import pytest

from larder.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", spark__master="local[4]", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__sql__shuffle__partitions="4",
        spark__driver__memory="8g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """The rows of a DataFrame as plain tuples, in a fixed order."""
    def collect(df, *names):
        chosen = df.select(*names) if names else df
        return sorted((tuple(r) for r in chosen.collect()), key=repr)

    return collect
