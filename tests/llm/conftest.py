import pytest

COLUMNS = ("doc_id long, text string, lang string, source string, n_chars long, size long, fp long, root long, part int, "
           "_id string, _size int, start int, kept string, score double, host string, key string, hits array<int>")
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))


def _row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, len(text or ""), 7, 8, 9, 1, "x", 3, 4, "k", 0.5, "h", "y", [1])


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and clashing names."""
    rows = [_row(1, None), _row(2, ""), _row(3, " \t\n\x0b\f\r "), _row(4, "a"), _row(5, "Two words"), _row(6, LONG),
            _row(7, LONG), _row(8, "x" * 200_000), _row(9, "ünï 🙂 çödé \u00a0 日本語"), _row(9, "ünï 🙂 çödé \u00a0 日本語"),
            _row(10, "one two three four", None, None), _row(None, "no id at all here", "fr"), _row(11, LONG, "de", "b"),
            (12,) + (None,) * 16, (None,) * 17, _row(13, "same id"), _row(13, "other text of the same id")]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, 1, 0) for i in range(1, 9)] + [(9, 0, 1), (10, None, None), (None, 0, 1), (10, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
