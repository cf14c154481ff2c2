import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and columns named like the operators' own."""
    words = [f"w{i}" for i in range(400)]
    rows = [
        (1, " ".join(words), "en"),
        (2, " ".join(words), None),
        (2, " ".join(words), None),
        (3, None, "en"),
        (4, "", "en"),
        (5, " \n\t ", "en"),
        (6, "one two", "de"),
        (7, "ONE  two", "de"),
        (None, "lost its number but not its words at all", None),
        (None, None, None),
        (8, "é" * 5000 + " " + "word " * 3000, "fr"),
        (9, "x" * 100_000, "fr"),
        (10, " ".join([f"v{i}" for i in range(100)] + words[100:200]), "en"),
        (11, "日本語 テキスト 🙂 and more of the words that follow here", "ja"),
    ]
    schema = "doc_id long, text string, lang string"
    df = spark.createDataFrame(rows, schema).selectExpr("*", "nullif(lang, 'fr') as source", "length(text) + 0L as n_chars")
    for name in ("_text", "_key", "key", "node", "score", "path", "h", "k", "cuts", "_order", "shard", "label", "part"):
        df = df.selectExpr("*", f"'{name}' as {name}")
    return df


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
