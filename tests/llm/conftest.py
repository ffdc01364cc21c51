import pytest

AWKWARD = [
    (0, "Alpha beta gamma delta epsilon zeta eta theta iota kappa.", "en", 1.0),
    (1, None, "en", None),
    (2, "", None, 2.0),
    (3, " \n\t ", "fr", 2.0),
    (3, " \n\t ", "fr", 2.0),
    (4, "word", "fr", 2.0),
    (5, "Alpha beta gamma delta epsilon zeta eta theta iota kappa.", "en", 1.0),
    (5, "Alpha beta gamma delta epsilon zeta eta theta iota kappa.", "en", 1.0),
    (None, "no id here, but words are present and counted", "en", 0.0),
    (6, "12345 67890 !!! ###", "de", 0.0),
    (7, "long " * 40_000, "en", 0.0),
    (8, "é漢字🙂 \x00 ünïcödé ▁ <|im_end|> \\ text", "de", 0.0),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and very long texts, repeated rows, and extra columns whose names clash with outputs."""
    return spark.createDataFrame([(*r, "x", "y", 7, "z") for r in AWKWARD], "doc_id long, text string, lang string, score double, lang_pred string, ids string, fp int, decoded string")


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
