import datetime as dt

import pytest

AT = dt.datetime(2025, 1, 1)
VECTORS = "chunk_id bigint, tenant_id bigint, embedding_model string, embedding_version string, embedding array<float>, loaded_at timestamp_ntz"
SPACES = "model string, version string, dimension int, status string, created_at timestamp_ntz"


@pytest.fixture(scope="session")
def spaces(spark):
    return spark.createDataFrame([("m", "1", 8, "active", AT), ("m", "0", 8, "retired", AT)], SPACES)


@pytest.fixture(scope="session")
def embedded(spark):
    def make(rows, version="1"):
        return spark.createDataFrame([(i, 1, "m", version, None if v is None else [None if e is None else float(e) for e in v], AT) for i, v in rows], VECTORS)

    return make


@pytest.fixture(scope="session")
def stock(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, None if v is None else [float(e) for e in v]) for i, t, v in rows], "stock_id bigint, text string, embedding array<float>")

    return make
