import pytest

#: Odd rows for every operator: nulls in all columns, empty and blank texts, a very long one, copies, ties, clashing names.
LONG = " ".join(f"word{k % 997} lorem{k % 31}" for k in range(20_000))
ROWS = [
    (1, "a b c d e f g h", "en", "s1", 1), (2, "a b c d e f g h", "en", "s1", 2), (3, None, None, None, None), (4, "", "en", "s2", 0), (5, "   \n", "fr", "s2", 4),
    (6, LONG, "en", "s1", 9), (7, LONG, "en", "s3", 9), (8, "One two", "en", None, 1), (9, "Été à la mer <s> [INST] x\\</s>", "fr", "s3", 5), (None, "nobody's text", "en", "s3", 5),
    (10, LONG + " tail", "en", "s1", 9), (11, "\u0000 nul and \U0001f600 emoji", "en", "s2", 3),
]


@pytest.fixture()
def odd(spark, tmp_path):
    """Documents with odd rows, an extra column, and repeated rows, as a table read from files."""
    def make(rows=ROWS, repeat=True):
        rows = [(*r, "x", k) for k, r in enumerate(rows)] + ([(*rows[0], "y", 99), (*rows[2], "y", 98)] if repeat and rows else [])
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, rank int")
        path = str(tmp_path / f"docs{len(rows)}")
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return make
