import pytest

from quadrat.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", app="tests", shuffle_partitions=4, spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted(tuple(r) for r in picked.collect())
