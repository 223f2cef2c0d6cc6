import pytest

from meterline import session


@pytest.fixture(scope="session")
def spark():
    s = session.build("local[8]", 8, **{"spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
