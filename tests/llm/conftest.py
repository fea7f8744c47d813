"""A session that is made anew where an earlier test has ended the JVM."""

import contextlib

import pytest
from pyspark import SparkContext
from pyspark.sql import SparkSession

from nearpass.session import local_session

# As in tests/conftest.py: in a run of the whole suite, this is the `conftest` that test_queries.py imports from.
SMALL = "/root/testdata/sf0.001"


def _alive(session) -> bool:
    try:
        return session.range(1).count() == 1
    except Exception:  # any failure of the gateway means that the session is of no use
        return False


@pytest.fixture(scope="module")
def spark(tmp_path_factory):
    session = SparkSession._instantiatedSession
    if session is not None and not _alive(session):
        with contextlib.suppress(Exception):
            SparkContext._gateway.shutdown()
        SparkContext._gateway = SparkContext._jvm = SparkContext._active_spark_context = None
        SparkSession._instantiatedSession = None
    return local_session(cores=8, shuffle_partitions=4, memory="6g", shared=str(tmp_path_factory.mktemp("shared")))
