import pytest

DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A table like `documents` from (doc_id, text) or (doc_id, text, source), with columns of awkward names."""

    def make(*rows):
        records = [
            (r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), 7, "x", True)
            for r in rows
        ]
        clashes = ", size bigint, row string, gone boolean"
        return spark.createDataFrame(records, DOCUMENT + clashes)

    return make


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi pi rho sigma tau phi chi psi omega".split()


def sentence(seed, n=40):
    import random

    return " ".join(random.Random(seed).choice(WORDS) + str(random.Random(seed * 31 + i).randrange(50)) for i in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, equal ids and repeated rows."""
    return [
        (None, "a text without an id, long enough to have some words in it"),
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (4, sentence(4)),
        (4, sentence(4)),
        (4, sentence(5)),
        (5, "x" * 30_000 + " " + "ab " * 20_000),
        (6, "Ünïcödé 中文 text \U0001f600 " * 5, None),
    ]
