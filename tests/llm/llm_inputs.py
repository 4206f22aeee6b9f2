"""Small inputs shared by the tests of this folder."""

import random

import pytest

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"

#: Names that the operators use inside, given to extra columns of the inputs.
CLASHES = ("id", "n", "hash", "digest", "token", "tokens", "set", "part", "value", "score", "seed", "kind", "norm", "component", "sha", "hints",
           "row", "place", "raw", "made", "held_out", "predicted")


@pytest.fixture(scope="session")
def corpus(spark):
    """(rows, DataFrame): copies, near copies, shared passages, odd and missing texts, with clashing extra columns."""
    r = random.Random(7)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 7))) for _ in range(400)]

    def text(n):
        return " ".join(r.choice(words) for _ in range(n))

    passage = text(70)
    rows = [(i, text(r.choice([3, 12, 40, 120, 300]))) for i in range(60)]
    base = text(150).split()
    for i in range(60, 90):  # a group of near copies with one to five changed words
        w = list(base)
        for _ in range(i % 6):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((i, " ".join(w)))
    rows += [(i, rows[i - 90][1]) for i in range(90, 110)]  # exact copies
    rows += [(i, f"{text(30)}\n{passage}\t{text(20)}") for i in range(110, 125)]
    rows += [(125, None), (126, ""), (127, " \n\t "), (128, "One"), (129, "ONE"), (130, "é" * 3000), (131, text(9000)),
             (None, rows[3][1]), (None, None), (5, rows[5][1]), (7, "another text under the same id " + text(80)), (2**40, rows[61][1].upper())]
    extra = {c: F_TYPES[i % 2] for i, c in enumerate(CLASHES)}
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} {t}" for c, t in extra.items())
    data = [(d, t, None if i % 5 else "en", None, None if t is None else len(t), *[None if i % 3 else (i if k == "long" else str(i)) for k in extra.values()])
            for i, (d, t) in enumerate(rows)]
    return rows, spark.createDataFrame(data, schema)


F_TYPES = ("long", "string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
