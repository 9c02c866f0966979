import pytest
from pyspark.sql import types as T

LONG = "word and another " * 9000  # 153,000 characters


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and very long texts, ties, repeated rows, and extra columns whose names operators use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, `key1` string, `fp` string, `size` int, `_copies` int, `shard` int, `score` double"
    rows = [
        (1, "the cat sat on the mat and the dog lay by the door of the old house", "en", "a", 10),
        (2, "the cat sat on the mat and the dog lay by the door of the old house", "en", "a", 10),
        (2, "the cat sat on the mat and the dog lay by the door of the old house", "en", "a", 10),
        (3, None, "en", "b", None),
        (4, "", None, None, 0),
        (5, "  \n\t ", "de", "b", 3),
        (None, "der Hund und die Katze liegen vor der alten Tür des Hauses am Fluss", "de", None, 5),
        (None, None, None, None, None),
        (6, LONG, "en", "a", len(LONG)),
        (7, LONG, "en", "c", len(LONG)),
        (8, "9 8 7 -- !!", None, "c", 7),
    ]
    return spark.createDataFrame([(*r, "x", "y", 1, 2, 3, 0.5) for r in rows], schema)


@pytest.fixture(scope="session")
def none(spark, odd):
    return spark.createDataFrame([], T.StructType(odd.schema.fields))


@pytest.fixture
def saved(tmp_path):
    """Write tables where queries look for them, and give that folder."""

    def save(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return save


@pytest.fixture(scope="session")
def documents(spark):
    """A small fixture of real rows."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
