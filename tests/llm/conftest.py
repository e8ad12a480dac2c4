import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """Makes a documents table from (doc_id, text[, lang[, source]]) tuples, with a clashing extra column."""

    def make(*rows, extra=()):
        full = [(*r, *(None,) * (4 - len(r)), len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        for name in ("fp", "key", "copy", *extra):
            df = df.selectExpr("*", f"'x' AS `{name}`")
        return df

    return make
