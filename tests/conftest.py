import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lectern.session import session

    folder = tmp_path_factory.mktemp("spark")
    made = session(4, **{"spark.sql.shuffle.partitions": "2", "spark.driver.memory": "4g", "spark.sql.warehouse.dir": str(folder / "warehouse")})
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
