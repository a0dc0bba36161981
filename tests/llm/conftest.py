import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows):
        """Rows of (doc_id, text[, lang[, source]])."""
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def sf_dir(tmp_path, docs_of):
    """A folder with a documents table of the given rows."""

    def make(rows):
        docs_of(rows).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        return str(tmp_path)

    return make
