import random

import pytest

SCHEMA = "doc_id bigint, text string, n_words string, fp int, block string, `odd name` int"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with extra columns whose names clash with internal ones."""

    def make(rows):
        return spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in rows], SCHEMA)

    return make


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ing", "é"]) + rng.choice(["", "", ",", "."]) for _ in range(n))


#: Rows with every edge case: null id, null text, empty, white space, short, repeated, long, other scripts.
EDGES = [(1, prose(1, 120)), (2, prose(1, 120)), (3, None), (4, ""), (5, " \t\n"), (6, "one"), (None, prose(2, 60)), (7, prose(3, 5000)), (7, prose(3, 5000)), (8, "ab " * 40), (9, "漢字かな 한국어 ΟΔΟΣ"), (10, "x" * 3000), (11, prose(1, 110) + " end " + prose(4, 20))]
