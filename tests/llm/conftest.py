import pytest

LONG = "word " * 5 + " ".join(f"w{i}" for i in range(300))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with names that operators use."""
    base = "the quick brown fox jumps over the lazy dog near the old stone bridge while seven grey geese walk slowly past the mill and nobody minds them at all"
    rows = [
        (0, base, "en", "a"), (1, base, "en", "a"), (1, base, "en", "a"), (2, None, None, None), (3, "", "en", "b"), (4, "   \n\t ", None, "b"), (None, base + " more", "en", None),
        (5, LONG * 40, "en", "a"), (6, LONG * 40 + " tail", "de", "a"), (7, "x", "de", "c"), (8, "été ßtraße " * 30, "fr", "c"), (9, "été ßtraße " * 30, "fr", "c"),
        (10, base.upper(), "en", "a"), (11, "a\nb\n\nb\nb|c#", "es", "b"), (12, "z" * 5000, None, "a"),
    ]
    rows = [(*r, None if r[1] is None else len(r[1]), 1, "k", -1, 2.5, b"x") for r in rows]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, key int, kind string, _id bigint, score double, blob binary"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
