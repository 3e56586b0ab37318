import pytest


@pytest.fixture
def frame(spark):
    """frame(rows, schema): a small table."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)


@pytest.fixture
def sf(spark, tmp_path):
    """sf(table=(rows, schema), ...): a folder of Parquet tables."""

    def make(**tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return make
