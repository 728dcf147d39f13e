import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, salt int, kept_text string, lang_pred string, component long, copies string, taken int"


def prose(seed: int, n: int, alphabet: str = "aeinorst") -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(alphabet) for _ in range(r.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def messy_rows():
    """Nulls everywhere, empty and very long texts, ties and repeated rows, names that clash."""
    long = prose(1, 40_000)
    base = prose(2, 300)
    near = base.split()
    near[150] = "changed"
    rows = [
        (1, None, None, None),
        (2, "", "en", ""),
        (3, " \n\t ", None, "b"),
        (4, base, "en", "a"),
        (5, base, "en", "a"),
        (6, base.replace(" ", "  \n", 3), "en", "a"),
        (7, " ".join(near), "en", "b"),
        (8, long, "en", None),
        (8, long, "en", None),
        (9, "123 456 !!!", "de", "c"),
        (10, "one two", "en", "c"),
        (11, "one two", "en", "c"),
        (None, base, "en", "a"),
        (12, "Ünïcode Grüße жизнь 日本 ½ \x1c end", "de", "é"),
        (13, "tab\tand\x0bvertical\r\nlines\n\n", "de", "b"),
        *[(20 + i, f"A line that is shared by many of them\nown line {i} of this document here\nShort", "en", "hot") for i in range(30)],
    ]
    return [(*r, len(r[1] or ""), "x", 1, "y", "z", 0, "w", None) for r in rows]


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    return spark.createDataFrame(messy_rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
