import pytest


@pytest.fixture()
def docs(spark):
    """Makes documents with hostile rows: nulls in any column, empty texts, repeated rows, a clashing extra column."""

    def make(*texts, ids=None, extra=True):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, None if k % 3 == 0 else "en", None if k % 2 else f"s{k % 4}", None, k) for k, (i, t) in enumerate(zip(ids, texts))]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, TEXT2 long")
        return df.withColumnRenamed("TEXT2", "TEXT") if extra else df.drop("TEXT2")

    return make
