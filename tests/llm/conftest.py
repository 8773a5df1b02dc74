import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """Rows of (doc_id, text, source) as a table of documents."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", s, len(t) if t is not None else None) for i, t, s in rows], DOCUMENTS)

    return make


@pytest.fixture
def awkward(docs):
    """Nulls in every column, empty and long texts, ties and repeated rows, and extra columns whose names clash with what operators use."""
    long = " ".join(f"word{i % 977} and{i}" for i in range(20_000))
    rows = [(1, None, "a"), (2, "", "a"), (3, "  \n\t ", None), (4, long, "b"), (5, "same text here for all", "a"), (6, "same text here for all", "b"), (6, "same text here for all", "b"), (None, "same text here for all", None), (8, "é 漢字 　x <|endoftext|>", ""), (9, "one", "c")]
    from pyspark.sql import functions as F

    extra = {c: F.lit(3) for c in ("size", "key", "n", "rank", "copies", "fp", "list", "_id", "_hash", "_own", "gone", "score", "label", "length", "start", "u", "v", "least", "line", "pos", "_part")}
    return docs(rows).withColumns(extra)


@pytest.fixture
def sample(spark):
    return lambda table, sf="sf0.001": spark.read.parquet(f"/root/testdata/{sf}/{table}.parquet")
