import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, fp string, h long"


def messy_rows():
    """Rows with nulls in any column, ties, repeats, empty and long texts, and clashing extra columns."""
    pick = random.Random(5)
    words = ["alpha", "Beta", "gamma", "DELTA", "épsilon", "zeta7", "eta", "theta"]
    prose = lambda n: " ".join(pick.choice(words) for _ in range(n))
    rows = [(i, prose(pick.randrange(1, 90)), "en", f"src{i % 3}") for i in range(60)]
    base = prose(80)
    rows += [(100 + i, base, "en", "src0") for i in range(20)]
    rows += [(130 + i, base + " " + words[i % 3], "en", None) for i in range(6)]
    rows += [(200, None, None, None), (201, "", "en", "src1"), (202, " \t\n", "en", "src1"), (203, "one", None, "src2"), (204, "one two", "", "")]
    rows += [(None, base, "en", "src1"), (None, None, None, None), (205, "same", "en", "src9"), (205, "same", "en", "src9"), (205, "other", "en", "src9")]
    rows += [(206, prose(20000), "en", "src0"), (207, "x" * 50000, "en", "src0"), (208, "line one here\nline one here\n\nline two\r\n", "en", "src0"), (-3, prose(30), "en", "src2")]
    return [(i, t, lang, src, None if t is None else len(t), 7, "clash", 9) for i, t, lang, src in rows]


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(messy_rows(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
