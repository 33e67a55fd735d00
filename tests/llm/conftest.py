import pytest
from llm_rows import DOC_SCHEMA


@pytest.fixture
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with columns whose names clash with helper names."""
    def make(rows, extra=False):
        full = [(i, t, "en" if i is not None and i % 2 else None, "s", None if t is None else len(t)) for i, t in rows]
        df = spark.createDataFrame(full, DOC_SCHEMA)
        if extra:
            for c in ("shard", "size", "key", "n", "a", "b", "h", "s", "part", "spans", "sequence_id", "leaf", "rep"):
                df = df.selectExpr("*", f"'x' as {c}")
        return df
    return make
