import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from kerbsight.session import build_session

    session = build_session(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__driver__memory="4g",
    )
    session.sparkContext.setLogLevel("ERROR")
    if not (session.conf.get("spark.checkpoint.dir", None) or session.sparkContext.getCheckpointDir()):
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def ws(spark):
    from kerbsight.session import Workspace

    space = Workspace(spark)
    yield space
    space.close()


@pytest.fixture(scope="session")
def violations(spark, ws):
    from kerbsight.sources.events import read_violations

    return ws.save("violations", read_violations(spark, SF_DIR))


@pytest.fixture(scope="session")
def city(spark, violations, ws):
    from kerbsight.plans.batch import CityTables

    return CityTables(spark, violations, method="ols", ws=ws)
