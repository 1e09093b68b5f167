import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empties, copies, a long text, words of other alphabets, and columns with clashing names."""
    base = " ".join(f"word{i * 7919 % 1000}" for i in range(400))
    rows = [
        (1, base, "en", "b", "x"), (2, base, "en", "b", "x"), (2, base, "en", "b", "x"), (3, base.replace("word7 ", "other "), "en", None, "y"), (4, None, None, None, None), (5, "", "en", "a", ""), (6, "  \n\t ", "en", "a", ""),
        (7, "one two", "de", "a", "z"), (8, "one two", "de", "c", "z"), (None, "Ünï ▁ cafés été \x1c don't 12 <|endoftext|> it's", "fr", "c", "z"), (9, "long " * 30000 + "tail", "en", "b", "z"), (10, "\n".join(["same line here"] * 9), "en", "c", "z"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_bytes string").selectExpr("*", "doc_id AS id", "text AS body", "lang AS tid", "source AS sid")
