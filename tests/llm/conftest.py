import pytest


@pytest.fixture
def frame(spark):
    """Rows of documents (doc_id, text, lang, source) with columns whose names operators use inside."""

    def make(rows, schema="doc_id long, text string, lang string, source string"):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([r + (None,) * (len(schema.split(", ")) - len(r)) for r in rows], schema)
        for clash in ("size", "key", "row", "kept", "accepted", "cls", "grp", "n", "chunk", "held_out", "score", "gone", "words"):
            if clash not in df.columns:
                df = df.withColumn(clash, F.lit("x"))
        return df

    return make
