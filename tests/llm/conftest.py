import pytest


@pytest.fixture(scope="session")
def small(spark, tmp_path_factory):
    """save(name, rows, schema): writes a table into a new folder, or the folder given, and returns the folder."""

    def save(folder=None, **tables):
        folder = folder or str(tmp_path_factory.mktemp("sf"))
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        return folder

    return save


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
