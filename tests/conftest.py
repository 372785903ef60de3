import logging
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

@pytest.fixture(scope="session")
def spark():
    from strandline import get_session

    session = get_session(
        "strandline-tests",
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
           "spark.checkpoint.dir": tempfile.mkdtemp(prefix="strandline-tests-"), "spark.ui.showConsoleProgress": "false"},
    )
    session.sparkContext.setLogLevel("OFF")
    logging.getLogger("DataFrameQueryContextLogger").setLevel(logging.CRITICAL)
    return session


@pytest.fixture(scope="session")
def tables(spark):
    from oracle import SMALL

    from strandline.plans.fixtures import Tables

    return Tables(spark, SMALL)


@pytest.fixture()
def rows():
    def collect(df, *cols):
        picked = df.select(*cols) if cols else df
        return sorted([tuple(r) for r in picked.collect()], key=lambda r: tuple((v is None, str(v)) for v in r))

    return collect
