import random

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, head int, hash int, leaf int, tokens int, pos int, drop int, template string, cluster long, node long, n_lines int, score string"


def frame(spark, rows, lang=None):
    """Documents from (doc_id, text) with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, "s", None, 1, 2, 3, 4, 5, 6, "x", 7, 8, 9, "y") for i, t in rows], DOC_SCHEMA)


@pytest.fixture(scope="session")
def docs_of(spark):
    return lambda rows, lang=None: frame(spark, rows, lang)


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty and blank texts, a very long one, repeated rows, shared and null ids, odd characters."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    prose = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(6)]
    return [(0, None), (1, ""), (2, " \t\n "), (3, long), (4, prose[0]), (5, prose[0]), (5, prose[0]), (6, prose[1]), (6, prose[2]),
            (None, prose[0]), (None, None), (7, "one"), (8, "One"), (9, "été\u0085 \x1c 漢字 <|im_end|> İ ß \U0001f600"), (10, prose[3] + " extra words here"),
            (11, prose[3]), (12, "two words"), (13, "\n\n" + prose[4] + "\n" + prose[4]), (-5, prose[5]), (2 ** 40, prose[5])]
