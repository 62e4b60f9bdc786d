import os
import sys

sys.path.insert(0, os.path.dirname(__file__))

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, id string, shard int, score string, fp string"


def make(spark, rows):
    """Documents (doc_id, text) with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, f"s{(i or 0) % 3}", len(t or ""), "r", "i", 1, "s", "f") for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return lambda rows: make(spark, rows)
