import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from fieldglass.session import session, share_path

    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"}
    found = session("tests", "local[4]", **conf)
    found.sparkContext.setLogLevel("ERROR")
    share_path(found)
    return found
