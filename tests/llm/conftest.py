import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).parent))

from cases import AWKWARD, DOC  # noqa: E402

from purser.llm.common import table  # noqa: E402

@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@pytest.fixture(scope="session")
def texts(sf_dir):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet' ORDER BY doc_id").fetchall()
    return dict(rows)


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns with names that operators use."""
    from pyspark.sql import functions as F

    extra = ["score", "spans", "row", "key", "slot", "label", "curve", "part", "n", "kept", "class_id", "word", "bucket", "term"]
    return spark.createDataFrame(AWKWARD, DOC).withColumns({c: F.lit(7) for c in extra})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOC)
