import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Rows (doc_id, text) as a documents table."""

    def make(rows, extra=False):
        full = [(i, t, "en", "a", None if t is None else len(t)) for i, t in rows]
        df = spark.createDataFrame(full, DOCS)
        if not extra:
            return df
        from pyspark.sql import functions as F

        # columns that clash with names the operators make
        return df.withColumns({c: F.lit("x") for c in ("score", "lang_pred", "rule", "tokens", "runs", "n", "id", "component", "stat_log_words", "piece_ids", "decoded")})

    return make
