import random

import pytest


@pytest.fixture(scope="session")
def texts():
    """Awkward texts: null, empty, white space, long, repeated, near copies, other scripts."""
    r = random.Random(7)
    words = [w for w in "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()]
    out = [None, "", " \n\t", "one", "ONE", "one two", "Ä b", "ä b", "x" * 30_000, "😀 " * 50, "a\x0bb\x85c d"]
    for _ in range(40):
        base = [r.choice(words) + str(r.randrange(60)) for _ in range(r.choice([5, 12, 25, 60, 130]))]
        for _ in range(r.choice([1, 2, 6])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2])):
                w[r.randrange(len(w))] = f"q{r.randrange(9)}"
            out.append(" ".join(w))
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as documents, with a repeated row, a null id, a repeated id, and columns whose names clash with inner ones."""
    rows = [(i, t, "xx", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[12], (None, "one two", "xx", "s", 7), (None, None, None, None, None), (20, "another text of id twenty", "xx", "s", 25)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("sig", "t", "rate", "n", "bucket", "b", "value", "words"):
        d = d.selectExpr("*", f"'clash' as `{name}`")
    return d.repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark, docs):
    return spark.createDataFrame([], docs.schema)
