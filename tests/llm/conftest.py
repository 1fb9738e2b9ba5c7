import pytest

ODD = [  # doc_id, text, lang, source: nulls, empty, ties, repeats, odd characters
    (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "b"),
    (2, None, "en", "a"), (3, "", None, "a"), (None, "no id here at all", "en", "a"),
    (4, "alpha beta gamma delta epsilon zeta eta theta", "en", None),
    (5, "  \t\n ", "de", "c"), (6, "ü ß   漢字 \U0001f600 end", "de", "c"),
    (7, "tied row", "en", "b"), (7, "tied row", "en", "b"), (8, "x " * 6000, "en", "b"),
    (1 << 60, "all rights reserved cc by", "en", "c"), ((1 << 60) + 1, "one two", "en", None),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Difficult documents with extra columns whose names operators use inside."""
    rows = [(*r, "m", "f", 9, 9, "s") for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, m_size string, fp string, "
                                       "size long, shard long, score string")


@pytest.fixture(scope="session")
def none(odd):
    """The same columns, no row."""
    return odd.limit(0)
