"""Small tables for the tests of the training-data operators."""

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _h bigint, score double, size int, shard int, position string"


def documents(spark, rows):
    """A documents table with extra columns whose names clash with results."""
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), 1, 0.5, 3, 9, "x") for i, t, lang, s in rows], DOCS)


LONG = " ".join(f"word{i % 977} tail{i % 13}" for i in range(60_000))
PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards quietly box with daft zebras"
MESSY = [(5, "", "en", "a"), (3, None, None, None), (None, "no key at all here", "en", "b"), (7, PASSAGE, "de", "a"), (8, PASSAGE, "de", "b"),
         (8, PASSAGE, "de", "b"), (9, PASSAGE.upper().replace(" ", "\t"), None, "c"), (10, " \t\n ", "fr", "c"), (11, "Äpfel ÉTÉ x", "de", None),
         (12, LONG, "en", "a"), (13, "b " + LONG, "en", "a"), (14, "x", "en", "z"), (2, "x", "en", "z")]
