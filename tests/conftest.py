import pytest

from jobtide.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "jobtide-tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows():
    def collect(df, *order):
        ordered = df.orderBy(*order) if order else df
        return [tuple(r) for r in ordered.collect()]

    return collect
