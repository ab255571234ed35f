import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

WORDS = ("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho "
         "sigma tau upsilon").split()


def prose(seed: int, n: int) -> str:
    """Invented text of n words; equal seeds give equal texts."""
    import random
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


@pytest.fixture(scope="session")
def edge_docs():
    """Nulls in every column, empty and long texts, copies and repeated rows."""
    base = prose(1, 120)
    near = base.replace(base.split()[60], "changed", 1)
    rows = [(1, base), (2, None), (3, ""), (4, "  \n\t "), (5, base), (6, near), (7, "two words"),
            (8, "Two WORDS"), (9, prose(2, 30_000)), (None, base), (None, None), (10, prose(3, 200)),
            (10, prose(3, 200)), (11, "x" * 50_000), (12, "é" * 300 + " \x1c ß ſ"),
            (13, "line\nline\nline\n" + prose(4, 60)), (14, prose(5, 80) + " ### $$$ %%% |||" * 20)]
    return [(i, t, None if k % 3 else "en", "s", None) for k, (i, t) in enumerate(rows)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, edge_docs):
    return spark.createDataFrame(edge_docs, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clash():
    """Extra columns with the names that operators use for their own."""
    from pyspark.sql import functions as F

    def add(df):
        names = ("row", "id", "failed", "n_words", "ids", "shard", "slot", "row_number", "component",
                 "base", "found", "length", "payload", "kept")
        return df.withColumns({n: F.lit("x") for n in names})
    return add
