import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from checks.compare import database, session  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    spark = session("8")
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("fleetpulse.localScratch", str(tmp_path_factory.mktemp("scratch")))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


@pytest.fixture(scope="session")
def con():
    return database(FOLDER)


@pytest.fixture
def limits(spark):
    """Set size limits for one test."""
    names = []

    def set_limits(**kwargs):
        for name, value in kwargs.items():
            names.append(name)
            spark.conf.set(f"fleetpulse.{name}", str(value))

    yield set_limits
    for name in names:
        spark.conf.unset(f"fleetpulse.{name}")
