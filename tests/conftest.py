import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from quire.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session(4, "quire-tests")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    return s


@pytest.fixture
def one(spark):
    """Value of a column expression over one row of literals."""
    from pyspark.sql import functions as F

    def run(expr, **cols):
        return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]).select(expr).first()[0]

    return run
