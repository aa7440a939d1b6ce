import pytest

#: Documents with what operators must stand: nulls, empty and long texts, copies, ties, odd characters.
LONG = " ".join(f"word{i % 977} and{i % 13}, more." for i in range(6000))
PASSAGE = "This passage of more than two hundred bytes stands in several of the documents, word for word, and so " \
          "it must be found by every operator that looks for passages which are repeated somewhere else. Über!"
DOCS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "en"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today.", "en"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today.", "en"),
    (3, None, None), (4, "", "en"), (5, "   \n\t ", None), (6, "12345 !!", "de"),
    (7, LONG, "en"), (8, "Der schnelle braune Fuchs springt über den faulen Hund und läuft fort.", "de"),
    (9, "naïve café — “quotes” 漢字 🎉 <|endoftext|> it's we'll", None),
    (10, "Erster Satz. " + PASSAGE + " Ende.", "de"), (11, "Other start: " + PASSAGE + PASSAGE, "en"),
    (None, "a", "en"), (None, "a", "en"), (12, "a b c", "en"),
]


@pytest.fixture(scope="session")
def stored(spark, tmp_path_factory):
    """Store rows as Parquet and read them back, as operators take stored tables."""
    def store(rows, schema, files=2):
        path = str(tmp_path_factory.mktemp("t")) + "/rows"
        spark.createDataFrame(rows, schema).repartition(files).write.parquet(path)
        return spark.read.parquet(path)
    return store


@pytest.fixture(scope="session")
def docs(stored):
    """The documents above with extra columns whose names operators use inside."""
    rows = [(*r, "src", len(r[1] or ""), 0.5, "x", 7, "y") for r in DOCS]
    return stored(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                        "score double, _row string, component_id int, kept string")


@pytest.fixture(scope="session")
def no_docs(stored):
    return stored([], "doc_id long, text string, lang string, source string, n_chars long", 1)
