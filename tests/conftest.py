import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TIDELINE_TESTDATA", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark():
    from tideline.session import local_session

    return local_session(8, "tests", "6g")


@pytest.fixture(scope="session")
def folder():
    if not os.path.isdir(DATA):
        pytest.skip("test tables are not available")
    return DATA


@pytest.fixture(scope="session")
def walk(spark):
    """Two tickers, 150 days, positive random-walk prices with volume; cached."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    frames = []
    for name, vol in (("AAA", 0.01), ("BBB", 0.04)):
        close = 100 * np.exp(np.cumsum(rng.normal(0, vol, 150)))
        open_ = close * np.exp(rng.normal(0, vol / 3, 150))
        frames.append(pd.DataFrame({
            "ticker": name, "date": pd.bdate_range("2020-01-01", periods=150).date, "open": open_,
            "high": np.maximum(open_, close) * 1.01, "low": np.minimum(open_, close) * 0.99, "close": close,
            "volume": rng.integers(100, 5000, 150).astype(float)}))
    pdf = pd.concat(frames)
    return spark.createDataFrame(pdf).withColumn("ann", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(252.0)).cache(), pdf
