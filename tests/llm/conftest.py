import pytest

#: Texts with what can go wrong: null, empty, no letters, ties, repeated rows, long ones, characters of every width.
LOREM = "the river ran past old stone walls while seven quiet birds watched from a tall green tree and nobody spoke about winter"
TEXTS = [
    None, "", "   \n\t ", "1234 5678 !!!", "a", "Hello", LOREM, LOREM, LOREM.upper(), f"{LOREM}\n{LOREM}\n{LOREM}\n{LOREM}",
    LOREM.replace("river", "stream"), "é ü ß 漢字 🙂 naïve space", "x " * 3000, "word" * 5000, "# $ % & | < > " * 20,
    " ".join(f"w{i % 977}" for i in range(20000)), "BUY!! NOW!! " * 60, "line one here\nline two here\n" * 30,
]


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls in any column, an id twice with one text, and columns named like results."""
    rows = [(i, t, ("en", "de", None)[i % 3], None if i % 4 == 0 else f"s{i}", None, 7, "x") for i, t in enumerate(TEXTS)]
    rows += [(6, LOREM, "en", "s", 1, 7, "x"), (None, LOREM, None, None, None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept int, _text string").repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
