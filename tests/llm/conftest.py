import pytest


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text), in few partitions, with columns whose names operators use inside."""

    def documents(rows, parts=3):
        df = spark.createDataFrame([(i, t, "en", "s", None, 7, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, n long, utf8 string")
        return df.repartition(parts)

    return documents
