import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and blank and very long texts, repeated rows, and further columns with names that operators use."""
    long = " ".join(f"word{i % 977} and{i % 31}" for i in range(60_000))
    passage = "\n".join(f"line number {i} of a passage that is shared by several documents of this table" for i in range(6))
    rows = [
        (1, None, "en", "a", None),
        (2, "", None, "a", 0),
        (3, " \t\n\x0b ", "en", None, 5),
        (4, long, "en", "b", len(long)),
        (5, "two words", "de", "b", 9),
        (6, passage, "en", "b", len(passage)),
        (7, passage, "en", "b", len(passage)),
        (7, passage, "en", "b", len(passage)),
        (8, f"own start\n{passage}\nown end", "en", "c", 600),
        (None, "a document without id says hello to everybody here", "en", "c", 50),
        (None, "a second document without id which is quite another one", "en", "c", 50),
        (9, "12345 67 !!! ---", "en", "c", 16),
    ]
    df = spark.createDataFrame(rows, DOCS)
    extra = {c: "x" for c in ("fp", "root", "text_key", "key", "rule", "copy", "start", "anchor", "k1", "blob", "spans", "node", "host", "verdict", "a", "b", "n_words", "score", "rejected", "mask", "seed", "_n")}
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit(v).alias(c) for c, v in extra.items()))
