import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

from sparkwarden.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    session.sparkContext.setLogLevel("ERROR")
    if session.sparkContext.getCheckpointDir() is None:
        session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))
    yield session
    session.stop()


@pytest.fixture
def files_of(spark):
    """Files table from (path, content) pairs; the language follows from the path."""
    from pyspark.sql import functions as F

    from sparkwarden.functions.paths import language_of

    def make(*rows, repo="r"):
        df = spark.createDataFrame([(repo, p, c) for p, c in rows], "repo string, path string, content string")
        return df.withColumn("language", language_of(F.col("path")))

    return make
