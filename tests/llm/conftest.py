import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) pairs, written so that it reads alike each time, with clashing columns."""
    import tempfile

    def make(rows, schema="doc_id long, text string, kept string, row string, score string"):
        path = tempfile.mkdtemp(prefix="corpusloom-test-") + "/documents"
        spark.createDataFrame([(*r, "x", "y", "z") for r in rows], schema).write.parquet(path)
        return spark.read.parquet(path)

    return make
