import re
from itertools import permutations

import pytest

from txnlens.llm.filter_audit import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, labels):
    """Every order applied to every document, filter by filter."""
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    docs = []
    for d, t, lang in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
                 "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and first[t] < d}
        mine = [x for x in labels if x[0] == d and d is not None]
        docs.append((lang or "", fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = {}
    for part in {x[0] for x in docs}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = [x for x in docs if x[0] == part]
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[1][f]]
                failing = [x for x in docs if x[0] == part and x[1][f]]
                left = [x for x in left if not x[1][f]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(sum(x[1].values()) == 1 for x in failing),
                                                   sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def got(spark, rows, labels, **extra):
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, lang string, n long, mask string, good int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return {tuple(r[:3]): list(r[3:]) for r in filter_audit(docs, marks, **extra).collect()}


def prose(n, start=0):
    return " ".join(f"word{i}" for i in range(start, start + n))


@pytest.fixture(scope="module")
def cases():
    rows = [(1, prose(120), "en"), (2, prose(120), "en"), (3, prose(120), "de"), (4, prose(120), None), (0, prose(99), ""), (5, prose(100), "en"),
            (6, " ".join(["a b c"] * 50), "en"), (7, prose(120) + " # ", "de"), (8, prose(110).upper(), "de"), (9, None, "en"), (10, "", "en"),
            (11, "\n \t", None), (12, "AB #", "en"), (13, "AB #", "de"), (None, prose(120), "en"), (None, None, None), (2, prose(120), "en"),
            (2, prose(130, 7), "en"), (14, prose(130, 7), "en"), (15, "é" * 90 + " " + "É" * 10, "fr"), (16, prose(30000), "fr"), (17, prose(80) + " " + prose(20), "fr")]
    return rows, [(1, 1, 0), (2, 0, 1), (3, 1, 1), (8, 1, None), (8, 0, 1), (12, None, 1), (None, 1, 1), (10, 1, 0), (99, 1, 1), (14, 1, 1)]


def test_all_orders_equal_the_plain_version(spark, cases):
    assert got(spark, *cases) == plain(*cases)


def test_parts_are_whole_and_empty_tables_give_nothing(spark, cases):
    rows, labels = cases
    assert {p for p, _, _ in got(spark, rows, [])} == {"en", "de", "fr", ""}
    assert len(got(spark, [(1, "one text", "xx")], labels)) == 600
    assert got(spark, [], labels) == {}


def test_many_copies_over_languages(spark):
    rows = [(i, prose(101) if i % 3 else prose(5), ["en", "de", None][i % 3]) for i in range(400)]
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 400, 3)]
    assert got(spark, rows, labels) == plain(rows, labels)
