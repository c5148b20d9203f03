import pytest

CLASHES = "score string, quality string, n_words string, shard string, copy string, lang_pred string, words string, `a.b` string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, equal rows, ties, and names that operators use themselves."""
    long = " ".join(f"w{i % 977} the" for i in range(30_000))
    twin = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    rows = [(1, twin, "en", "s0"), (2, twin, "en", "s0"), (2, twin, "en", "s0"), (3, twin + " sixteen", "en", None),
            (4, "", None, "s1"), (5, None, "fr", "s1"), (None, None, None, None), (None, "lonely words here", "de", "s1"),
            (6, long, "en", "s0"), (7, " \n\t ", "es", "s0"), (8, "12 34 --", "es", "s2"), (9, "Zwei", "de", "s2")]
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"
    return spark.createDataFrame([(*r, None, *["x"] * 8) for r in rows], schema)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("1 = 0")
