import pytest

#: Words that near-copies are built from.
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


@pytest.fixture(scope="session")
def docs(spark):
    """Builds documents from (doc_id, text) with columns whose names clash with those that operators use."""

    def build(rows):
        full = [(i, t, "en", f"src{(i or 0) % 3}" if (i or 0) % 7 else None, len(t or ""), "x", 1, "y") for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, fp string, h int, _text string").repartition(3)

    return build


#: Empty and null texts, repeated rows, null ids, a long text, white space, and letters beyond ASCII.
ODD = [
    (1, ""),
    (2, None),
    (3, "one"),
    (4, "one two"),
    (None, "one two three four"),
    (None, None),
    (5, "Same text here, in two rows."),
    (5, "Same text here, in two rows."),
    (6, " \t\n "),
    (7, "ÉCOLE ßtraße 日本語 \U0001f600 naïve é ̈"),
    (8, "word " * 20_000),
    (9, "x" * 50_000),
]
