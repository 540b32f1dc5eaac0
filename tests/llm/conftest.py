import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def rows(spark):
    """A table from tuples, over several partitions."""
    def make(data, schema, parts=4):
        return spark.createDataFrame(list(data), schema).repartition(parts)
    return make


@pytest.fixture(scope="session")
def texts(rows):
    """doc_id, text, and columns that clash with the operators' own."""
    def make(data, parts=4):
        plain = rows(data, "doc_id bigint, text string", parts)
        clash = {c: F.lit("x") for c in ("_row", "_text", "kept", "size", "node", "key", "a", "b", "fp", "spans", "n_words", "source")}
        return plain.withColumns(clash)
    return make
