import pytest


@pytest.fixture
def documents(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and an extra column that clashes."""
    base = "The quick brown fox jumps over the lazy dog and runs away from the small red house. "
    rows = [
        (1, base * 5, "en", "a", 1),
        (2, base * 5, "en", "a", 1),
        (2, base * 5, "en", "a", 1),
        (3, None, None, None, None),
        (4, "", "en", "a", 2),
        (5, "12 34 !!", "fr", "b", 3),
        (6, "Le petit chat noir dort sur le grand lit de la maison rouge. " * 4, "fr", "b", 4),
        (7, " ".join(f"word{i}" for i in range(9000)), "en", "b", 5),
        (None, "un texte sans nom, écrit en français", "fr", "a", 6),
    ]
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_words int"
    )


@pytest.fixture
def none(documents):
    return documents.limit(0)
