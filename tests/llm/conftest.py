import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the quick brown fox jumps over the lazy dog and then sleeps under a warm tree until morning comes again".split()


def nasty_rows():
    """Nulls in any column, empty and blank texts, one very long text, ties, repeated rows, odd characters."""
    long = " ".join(WORDS[i * i % 19] + str(i % 13) for i in range(30_000))
    base = " ".join(WORDS)
    rows = [
        (1, base, "en", "a", 5), (2, base.upper(), "en", "a", 5), (3, base, "en", None, None), (3, base, "en", None, None),
        (3, base.title(), "en", None, None), (4, None, "en", "b", 0), (5, "", None, "b", 0), (6, " \t\n", "de", "b", 3),
        (None, base + " extra", "en", "c", 1), (None, "nur ein Text ohne Nummer", "de", "c", 1), (7, "word", "en", "a", 4),
        (8, "two words", None, None, 9), (9, long, "en", "a", len(long)), (10, "Ünïcödé ÀÉÎ ßtraße 日本語 😀 \u0085 x y", "de", "a", 9),
        (11, "1234 5678 --- ###", "en", "b", 2), (2 ** 62, "a far id", "en", "d", 8), (-5, "a negative id", "en", "d", 13),
    ]
    return rows


@pytest.fixture(scope="session")
def nasty(spark):
    """With extra columns whose names the operators use inside."""
    df = spark.createDataFrame(nasty_rows(), SCHEMA)
    for c in ("row", "n", "name", "fp", "row_key", "digest", "label", "h", "part", "slot", "place", "block", "phases",
              "component_id", "kept", "copies", "word", "number"):
        df = df.withColumn(c, F.lit(f"own {c}"))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def prose():
    """Invented prose in two languages from different syllables."""
    import random
    rng = random.Random(5)
    parts = {"xa": ["tho", "rin", "gat", "el", "wes", "ing", "ound", "ly"], "xb": ["zü", "kra", "cht", "ung", "ße", "pf", "ein", "er"]}

    def text(lang, n):
        return " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) + rng.choice(["", "", "", ".", ","])
                        for _ in range(n))
    return [(i, text("xa" if i % 3 else "xb", rng.randint(20, 120)), "xa" if i % 3 else "xb", f"s{i % 4}", 0) for i in range(400)]
