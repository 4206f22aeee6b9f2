import hashlib
import random
import zlib

import numpy as np
import pytest
from brute import words

from txnlens.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, depth int, n long, key1 string"


def plain(rows):
    """All nodes by listing every prefix of every rebuilt conversation."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    members, ends = {}, {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        path = own.get(c - c % 20, [])[:h] + own[c][h:]
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
        ends.setdefault(tuple(path), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node, cs in members.items():
        tokens = (len(cs) - 1) * len(words(node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += tokens
    return sorted((min(cs), len(n), -1 if not n else min(members[n[:-1]]), len(cs), len(children.get(n, [])), leaves[n], saved[n],
                   hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest()) for n, cs in members.items())


def got(spark, rows, partitions=3):
    data = [(*r, 1, 2, "x") for r in rows]
    df = spark.createDataFrame(data, SCHEMA).repartition(partitions)
    out = pt.conversation_trie(df)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if x is None else x for x in r) for r in out.collect())


def made(seed, n=90, texts=3, longest=6):
    r = random.Random(seed)
    return [(c * r.choice([1, 1, 1, 7]), t, r.choice(["user", "assistant", None]) if t % 3 else "user", r.choice(["a b", "a  b c\n", "", None, "d"][:texts + 1]))
            for c in range(n) for t in range(r.randint(1, longest))]


@pytest.mark.parametrize("seed", range(2))
def test_nodes_equal_the_plain_version(spark, seed):
    rows = [r for r in {(c, t): (c, t, role, text) for c, t, role, text in made(seed)}.values()]
    assert got(spark, rows) == plain(rows)


def test_small_tiles_and_shards_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(pt, "SHARD", 4)
    monkeypatch.setattr(pt, "DEPTHS", 2)
    rows = list({(c, t): (c, t, role, text) for c, t, role, text in made(5, texts=2)}.values())
    assert got(spark, rows) == plain(rows)


def test_a_conversation_over_many_partitions(spark):
    """One conversation with most rows, copies of it under other ids, and conversations that adopt its first turns."""
    long = [(40, t, "user", f"turn {t % 50}") for t in range(900)]
    rows = long + [(47, t, "user", f"turn {t % 50}") for t in range(300)] + [(c, 0, "user", "hello") for c in range(41, 47)]
    rows += [(c, t, "user", f"turn {t}") for c in range(60, 90) for t in range(3)]
    assert got(spark, rows, 7) == plain(rows)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "x"), (7, None, "user", "null first"), (7, 0, None, None), (7, 1, "user", "y"), (20, 0, "user", "y"), (21, 5, "user", "y"),
            (21, 9, "a", "bc"), (22, 5, "ab", "c"), (22, 9, "user", "z " * 20000), (-3, 0, "user", "y"), (2**40, 0, "user", "y"), (23, 0, "", ""), (23, 1, None, "")]
    assert got(spark, rows) == plain(rows)
    repeated = [(5, 1, "user", "same")] * 4 + [(6, 1, "user", "same")] * 3
    assert got(spark, repeated) == plain(repeated)


def test_turnless_conversations_end_at_the_root(spark):
    alone = [c for c in range(1, 400) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20][:5]
    rows = [(c, 0, "user", "gone") for c in alone]
    assert got(spark, rows) == plain(rows) and len(plain(rows)) == 1


def test_empty_table(spark):
    assert got(spark, []) == [] and got(spark, [(None, 1, "user", "x")]) == []


def test_powers():
    n = np.array([0, 1, 2, 63, 1000003, -1, -3])
    for base in pt.BASES:
        assert [int(x) for x in pt._powers(base, n)] == [pow(base, int(i), 1 << 64) for i in n]
