import os

import pytest

# Python workers import the package by name.
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

TEXTS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture
def make(spark):
    """Documents from (id, text) pairs, with clashing further columns."""

    def build(rows, **more):
        frame = spark.createDataFrame(
            [(i, t, "en" if (i or 0) % 2 else "de", None if i == 3 else "src1", None) for i, t in rows], TEXTS)
        for name in ("n", "component_id", "score", "p", "rate", "copies", "host", "chunk", "bucket", "kept"):
            frame = frame.selectExpr("*", f"'x' as {name}")
        return frame

    return build


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], TEXTS)


@pytest.fixture
def no_labels(spark):
    return spark.createDataFrame([], LABELS)


@pytest.fixture(scope="session")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")
