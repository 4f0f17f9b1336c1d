import pytest

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
PROSE = ". ".join(" ".join(f"word{(i * 7 + k) % 211}" for k in range(9)) for i in range(12)) + "."


@pytest.fixture
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, clashing extra columns."""
    rows = [
        (1, PROSE, "en", "a", len(PROSE)),
        (2, PROSE, "en", "a", len(PROSE)),
        (2, PROSE, "en", "a", len(PROSE)),
        (3, PROSE.replace("word9", "other"), "en", None, None),
        (4, "", "en", "a", 0),
        (5, None, None, None, None),
        (None, PROSE, "de", "b", 1),
        (None, None, None, None, None),
        (6, LONG, "en", "b", len(LONG)),
        (7, " \t\n ", "fr", "b", 4),
        (8, "one two", "fr", "b", 7),
        (9, "\x00nul ▁ \U0001f600 <|endoftext|>", "fr", "b", 5),
        (2, "the same id, another text entirely", "en", "a", 3),
    ]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")
    extra = {c: "x" for c in ("shard", "rank", "length", "score", "predicted", "key", "component", "_id", "_hash", "_starts", "_gone", "n_removed", "curve", "host", "a.b")}
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(v).alias(k) for k, v in extra.items()])


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.limit(0)
