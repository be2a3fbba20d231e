import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, content string, hash long, size int, doc int, tag string, root int, pid int, component_id string, copies int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, a very long text, repeated rows, and columns with clashing names."""
    long_text = " ".join(f"word{i % 977}x{i}" for i in range(40_000))
    same = " ".join(f"alpha{i} beta{i}" for i in range(40))
    rows = [
        (1, same, "en", "a"), (2, same, "en", "b"), (2, same, "en", "b"), (3, None, "en", "a"), (4, "", None, None), (5, " \t\n ", "en", "c"),
        (6, long_text, "en", "a"), (None, same, "en", "a"), (None, None, None, None), (7, "one", "en", "a"), (8, "été \U0001f600 " * 60, "fr", "d"),
    ]
    return spark.createDataFrame([(i, t, g, s, len(t or ""), "c", 1, 2, 3, "t", 4, 5, "x", 9) for i, t, g, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture()
def make_docs(spark):
    def make(rows):
        full = [(i, t, "en", s, len(t or "")) for i, t, s in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")

    return make
