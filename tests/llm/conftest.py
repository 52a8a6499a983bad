import pytest

#: Rows that every operator on documents must survive: nulls, blanks, ties, repeated rows, clashing names.
EDGE = [
    (1, "one two three four five six", "a"),
    (2, None, "a"),
    (3, "", None),
    (4, " \t\n ", "b"),
    (5, "one two three four five six", "b"),
    (5, "one two three four five six", "b"),
    (6, "word " * 30000, "a"),
    (None, "nameless row", None),
    (7, "Ünï cödé texts, with 1234 digits!!", "c"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Edge rows with extra columns whose names the operators use inside."""
    rows = [(i, t, s, 9, "k", 0.5) for i, t, s in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, digest string, key double")


@pytest.fixture(scope="session")
def empty(edge):
    return edge.where("false")
