import pytest


@pytest.fixture(scope="session")
def spark():
    from meterwise.session import local_session

    s = local_session(4, shuffle_partitions=4, app_name="meterwise-llm-tests")
    yield s


@pytest.fixture
def frame(spark):
    """Rows of a documents-like table, with columns whose names clash with
    the operators' own."""
    def make(rows, columns="doc_id long, text string, lang string, source string, n_chars long"):
        extra = ", k1 string, h string, shard_id string, at long, key long, bytes long"
        width = columns.count(",") + 1
        full = [tuple(r) + (None,) * (width - len(r)) + ("x", "y", "z", 1, 2, 3) for r in rows]
        return spark.createDataFrame(full, columns + extra)

    return make
