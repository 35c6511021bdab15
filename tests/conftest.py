import pytest

from loomgraph.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def rows():
    def collect(df, *columns):
        return sorted((tuple(r[c] for c in columns) if columns else tuple(r) for r in df.collect()), key=repr)

    return collect
