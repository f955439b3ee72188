"""Small tables with everything odd in them."""

import random

import pytest

WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "la", "mu", "nu", "xi", "omi", "pi", "rho", "sigma", "tau", "ups"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        k, at = rng.randrange(3), rng.randrange(len(w))
        if k == 0:
            w[at] = "x" + str(rng.randrange(1000))
        elif k == 1:
            w.insert(at, "y" + str(rng.randrange(1000)))
        elif len(w) > 1:
            del w[at]
    return " ".join(w)


@pytest.fixture(scope="session")
def odd_texts():
    """(doc_id, text): copies, near copies, nulls, empties, short, long and odd texts."""
    rng = random.Random(11)
    base = [prose(rng, rng.choice([1, 2, 3, 5, 12, 30, 60, 150, 400])) for _ in range(40)]
    texts = [None, "", " \n\t ", "a", "A b", "Ä ä \x00 z", "for " * 3000, prose(rng, 6000), "x" * 20000, "\n" * 50]
    for t in base:
        texts += [t] * rng.choice([1, 1, 2])
        texts += [edited(rng, t, rng.choice([1, 2, 4, 8])) for _ in range(rng.choice([0, 1, 3]))]
    big = prose(rng, 100)
    texts += [edited(rng, big, rng.randrange(1, 12)) for _ in range(60)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """The same with columns whose names clash with the operators' own."""
    rows = [(i, t, "en", "s", len(t or ""), 7, "q") for i, t in odd_texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, set_id int, gone string").repartition(3)
