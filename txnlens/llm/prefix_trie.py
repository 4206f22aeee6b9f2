"""Prefix trie of conversations by vertical bitmaps.

A node is a distinct sequence of first turns; its key is a polynomial hash of the
turns (two sums modulo 2**64), so the key of every depth of every conversation comes
from running sums, even where a conversation is longer than a task should hold.

Conversations are dealt into shards of SHARD neighbours by id, and a shard's turns
into tiles of DEPTHS positions. A tile indexes each (position, turn) to the bitset
of the conversations that have it, and goes depth first: a node's bitset and the
posting of its smallest open member give that member's child, until no member is
open. So a tile gives its nodes with popcounts, smallest members and end lists, which
are merged by key. Sums over subtrees need no walk: the nodes whose smallest member
is m are the last ones on m's path, so what m adds to a node depends only on where
on the path its own nodes begin.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnlens.llm.tables import cut

#: Conversations of a shard, positions of a tile.
SHARD, DEPTHS = 1024, 64
#: Bases of the two polynomial hashes (odd, so each has an inverse modulo 2**64).
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_MASK = (1 << 64) - 1
_SPACE = r"[\x20\x09-\x0D]+"
_KEY = ["key1", "key2"]


def _powers(base: int, n: np.ndarray) -> np.ndarray:
    """base**n modulo 2**64 for each n, by squaring; negative n by the inverse."""
    out = np.ones(len(n), dtype=np.uint64)
    for of, sign in ((base, 1), (pow(base, -1, 1 << 64), -1)):
        left, square = np.maximum(sign * n, 0), of
        while left.any():
            odd = (left & 1).astype(bool)
            out[odd] *= np.uint64(square)
            left, square = left >> 1, square * square & _MASK
    return out


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _unsigned(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return _column(batch, name).astype(np.int64, copy=False).view(np.uint64)


def _record(schema: str, *columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns]
    return pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in schema.split(", ")])


_TURNS = "conv_id long, part int, nth long, at long, a long, b long, words long, sum1 long, sum2 long, until long"


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns with their place in the conversation, its number in the partition, and running sums, all within this partition."""
    part = TaskContext.get().partitionId()
    now, nth, n, sums, until = None, -1, 0, [np.uint64(0)] * 2, 0
    for batch in batches:
        conv, words = _column(batch, "conv_id"), _column(batch, "words")
        if not len(conv):
            continue
        new = np.concatenate(([conv[0] != now], conv[1:] != conv[:-1]))
        start = np.flatnonzero(np.concatenate(([True], new[1:])))
        run = np.cumsum(np.concatenate(([0], new[1:])))
        goes_on = run == 0 if not new[0] else np.zeros(len(conv), dtype=bool)
        at = np.arange(len(conv)) - start[run] + np.where(goes_on, n, 0)
        total = np.cumsum(words)
        total = total - (total[start] - words[start])[run] + np.where(goes_on, until, 0)
        number = nth + np.cumsum(new)
        out = []
        for i, name in enumerate("ab"):
            term = _unsigned(batch, name) * _powers(BASES[i], at)
            s = np.cumsum(term, dtype=np.uint64)
            out.append(s - (s[start] - term[start])[run] + np.where(goes_on, sums[i], np.uint64(0)))
        yield _record(_TURNS, conv, np.full(len(conv), part, dtype=np.int32), number, at, _unsigned(batch, "a"), _unsigned(batch, "b"), words, *out, total)
        now, nth, n, sums, until = conv[-1], number[-1], at[-1] + 1, [s[-1] for s in out], total[-1]


def _carried(turns: DataFrame) -> DataFrame:
    """(part, conv_id, before, sum1_before, ...): what a partition's first conversation had in partitions before it.

    The driver sees two conversations a partition.
    """
    ends = turns.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "at", "sum1", "sum2", "until")).alias("last")).collect()
    rows, held = [], None
    for r in sorted(ends, key=lambda r: r["part"]):
        last = r["last"]
        total = [last["at"] + 1, last["sum1"] & _MASK, last["sum2"] & _MASK, last["until"]]
        if held and held[0] == r["first"]:
            before = held[1]
            rows.append((r["part"], r["first"], before[0], *[x - (1 << 64) if x >> 63 else x for x in before[1:3]], before[3]))
            if last["conv_id"] == r["first"]:
                total = [before[0] + total[0], *[(before[i] + pow(BASES[i - 1], before[0], 1 << 64) * total[i]) & _MASK for i in (1, 2)], before[3] + total[3]]
        held = (last["conv_id"], total)
    return turns.sparkSession.createDataFrame(rows, "part int, conv_id long, before long, sum1_before long, sum2_before long, until_before long")


_PATHS = "conv_id long, shard long, length long, adopted int, shift int, add1 long, add2 long, add_words long, words long"
_NODES = "shard long, conv_id long, depth long, key1 long, key2 long, parent1 long, parent2 long, a long, words long, until long, ends boolean"


def _list_sums(values: pa.ListArray, name: str, kind, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, value) of the first ``upto`` structs of each list."""
    at = np.diff(values.offsets.to_numpy())
    row = np.repeat(np.arange(len(values)), at)
    place = np.arange(len(row)) - np.repeat(np.cumsum(at) - at, at)
    flat = values.flatten()
    value = flat.field(name).to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(kind)
    some = place < upto[row]
    return row[some], place[some], value[some]


def _path_sums(batch: pa.RecordBatch, column: str, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both polynomial sums and the words of the first ``upto`` turns of a column of turn lists."""
    n, values = batch.num_rows, batch.column(column)
    out = []
    for i, name in enumerate("ab"):
        row, place, value = _list_sums(values, name, np.uint64, upto)
        sums = np.zeros(n, dtype=np.uint64)
        np.add.at(sums, row, value * _powers(BASES[i], place))
        out.append(sums)
    row, _, value = _list_sums(values, "words", np.int64, upto)
    return out[0], out[1], np.bincount(row, value, minlength=n).astype(np.int64)


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a conversation's own turns need to become depths of its rebuilt path: depth - place, key - sum of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        adopted, dropped = _column(batch, "adopted").astype(np.int64), _column(batch, "dropped").astype(np.int64)
        base, own = _path_sums(batch, "base", adopted), _path_sums(batch, "first", dropped)
        shift = adopted - dropped
        add = [base[i] - _powers(BASES[i], shift) * own[i] for i in range(2)]
        more = base[2] - own[2]
        yield _record(_PATHS, _column(batch, "conv_id"), _column(batch, "shard"), _column(batch, "length"), adopted.astype(np.int32), shift.astype(np.int32),
                      *add, more, _column(batch, "own_words") + more)


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The root and the adopted turns of each conversation as nodes of its path."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        adopted, length = _column(batch, "adopted").astype(np.int64), _column(batch, "length")
        before = [np.zeros(n, dtype=np.uint64)] * 2 + [np.zeros(n, dtype=np.int64)]
        for depth in range(int(adopted.max()) + 1):
            rows = np.flatnonzero(adopted >= depth)
            until = _path_sums(batch, "base", np.full(n, depth)) if depth else before
            turn = np.zeros(n, dtype=np.uint64)
            if depth:
                row, place, value = _list_sums(batch.column("base"), "a", np.uint64, np.full(n, depth))
                turn[row[place == depth - 1]] = value[place == depth - 1]
            yield _record(_NODES, *[x[rows] for x in (
                _column(batch, "shard"), _column(batch, "conv_id"), np.full(n, depth), until[0], until[1], before[0], before[1], turn,
                until[2] - before[2], before[2], length == depth)])
            before = until


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's own turns as nodes of its rebuilt path."""
    for batch in batches:
        if not batch.num_rows:
            continue
        before, shift = _column(batch, "before"), _column(batch, "shift").astype(np.int64)
        at = before + _column(batch, "at")
        keys, parents = [], []
        for i, turn in enumerate("ab"):
            own = _unsigned(batch, f"sum{i + 1}_before") + _powers(BASES[i], before) * _unsigned(batch, f"sum{i + 1}")
            move, add = _powers(BASES[i], shift), _unsigned(batch, f"add{i + 1}")
            keys.append(add + move * own)
            parents.append(add + move * (own - _powers(BASES[i], at) * _unsigned(batch, turn)))
        depth, words = at + shift + 1, _column(batch, "words")
        until = _column(batch, "until_before") + _column(batch, "until") + _column(batch, "add_words")
        yield _record(_NODES, _column(batch, "shard"), _column(batch, "conv_id"), depth, *keys, *parents, _unsigned(batch, "a"), words, until - words,
                      depth == _column(batch, "length"))


def rebuilt_paths(conversations: DataFrame, *, block: int = 20, folds: int = 4) -> tuple[DataFrame, DataFrame]:
    """(nodes of every conversation's rebuilt path, one row a conversation).

    Turns are sorted by range, so a conversation of any length is spread over tasks;
    its running sums are put together from one row a partition.
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    conv = F.col("conv_id").cast("long")
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        conv.alias("conv_id"), "turn", *[F.xxhash64(F.lit(i), role, text).alias(name) for i, name in enumerate("ab")],
        F.size(F.array_remove(F.split(text, _SPACE), "")).cast("long").alias("words"),
        F.monotonically_increasing_id().alias("tie"))  # only so that any number of equal rows can be spread
    order = ["conv_id", F.asc_nulls_first("turn"), "a", "b", "tie"]
    ranged = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "a", "b", "words")
    turns = cut(ranged.mapInArrow(_running, _TURNS))
    turns = turns.join(F.broadcast(_carried(turns)), ["part", "conv_id"], "left").fillna(0)  # at most a row a partition

    place = F.col("at") + F.col("before")
    heads = turns.groupBy("conv_id").agg(
        F.count("*").alias("n"), F.sum("words").alias("own_words"), F.min(F.shiftleft(F.col("part").cast("long"), 32) + F.floor(F.col("nth") / SHARD)).alias("shard"),
        F.sort_array(F.collect_list(F.when(place < folds - 1, F.struct(place.alias("place"), "a", "b", "words")))).alias("first"))
    heads = heads.withColumn("of", F.col("conv_id") - F.col("conv_id") % block).withColumn(
        "dropped", (F.crc32(F.col("conv_id").cast("string")) % folds).cast("int"))
    bases = heads.filter(F.col("of") == F.col("conv_id")).select("of", F.col("first").alias("base"))
    heads = heads.join(bases, "of", "left").withColumn("base", F.coalesce("base", F.slice("first", 1, 0))).withColumn(
        "adopted", F.least("dropped", F.size("base"))).withColumn("length", F.col("adopted") + F.greatest(F.col("n") - F.col("dropped"), F.lit(0)))
    heads = cut(heads.drop("of"))
    paths = cut(heads.mapInArrow(_paths, _PATHS))
    own = turns.join(paths.drop("words"), "conv_id").filter(place >= F.col("adopted") - F.col("shift"))
    return own.mapInArrow(_own, _NODES).unionByName(heads.mapInArrow(_heads, _NODES)), paths


_FOUND = "shard long, conv_id long, depth long, key1 long, key2 long, parent1 long, parent2 long, words long, until long, n long, ended array<long>"


def _bits(members: np.ndarray) -> int:
    flags = np.zeros(int(members[-1]) + 1, dtype=np.uint8)
    flags[members] = 1
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def _members(bits: int) -> np.ndarray:
    raw = np.frombuffer(bits.to_bytes((bits.bit_length() + 7) // 8, "little"), dtype=np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little"))


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin, and the end."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), len(new))


def tile_nodes(conv: np.ndarray, depth: np.ndarray, turn: np.ndarray, entry: np.ndarray, ends: np.ndarray) -> tuple[list[int], list[int], list[np.ndarray | None]]:
    """The nodes of one tile: (row of the smallest member, popcount, members that end here) by depth-first intersection.

    One row a conversation and depth; ``entry`` tells apart the nodes above the tile's first depth.
    """
    ids, member = np.unique(conv, return_inverse=True)
    low = int(depth.min())
    row_of = np.full((len(ids), int(depth.max()) - low + 1), -1, dtype=np.int64)
    level = depth - low
    row_of[member, level] = np.arange(len(conv))
    # index: (position, turn) to the bitset of conversations
    order = np.lexsort((member, turn, level))
    runs = _runs(level[order], turn[order])
    postings, posting_of = [], np.empty(len(conv), dtype=np.int64)
    for k, (i, j) in enumerate(zip(runs[:-1].tolist(), runs[1:].tolist(), strict=True)):
        postings.append(1 << int(member[order[i]]) if j == i + 1 else _bits(member[order[i:j]]))
        posting_of[order[i:j]] = k
    here = [_bits(np.sort(member[level == d])) if (level == d).any() else 0 for d in range(row_of.shape[1])] + [0]
    stops = [_bits(np.sort(member[(level == d) & ends])) if ((level == d) & ends).any() else 0 for d in range(row_of.shape[1])]
    # every parent of the first level opens a walk
    top = np.flatnonzero(level == 0)
    top = top[np.lexsort((member[top], entry[top]))]
    bounds = _runs(entry[top])
    stack = [(_bits(member[top[i:j]]), -1) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
    rows, counts, ended = [], [], []
    deep = row_of.shape[1]
    while stack:
        bits, d = stack.pop()
        d += 1
        if bits.bit_count() == 1:  # alone for the rest of the tile
            for r in row_of[bits.bit_length() - 1, d:].tolist():
                if r < 0:
                    break
                rows.append(r)
                counts.append(1)
                ended.append(conv[r:r + 1] if ends[r] else None)
            continue
        left = bits & here[d]
        while left:
            first = row_of[(left & -left).bit_length() - 1, d]
            child = left & postings[posting_of[first]]
            left ^= child
            rows.append(int(first))
            counts.append(child.bit_count())
            stop = child & stops[d]
            ended.append(ids[_members(stop)] if stop else None)
            if d + 1 < deep and child & here[d + 1]:
                stack.append((child, d))
    return rows, counts, ended


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of each tile; a tile's rows follow each other."""
    names = [f.split()[0] for f in _NODES.split(", ")]
    kept: dict[str, list] = {x: [] for x in names}

    def tile() -> pa.RecordBatch:
        c = {x: np.concatenate(v) for x, v in kept.items()}
        rows, counts, ended = tile_nodes(c["conv_id"], c["depth"], c["a"], c["parent1"], c["ends"])
        at = np.array(rows, dtype=np.int64)
        some = [x is not None for x in ended]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([0 if x is None else len(x) for x in ended]))), pa.int32()),
                                         pa.array(np.concatenate([x for x in ended if x is not None]) if any(some) else np.zeros(0, dtype=np.int64)),
                                         mask=pa.array(np.logical_not(some)))
        return _record(_FOUND, *[c[x][at] for x in ("shard", "conv_id", "depth", *_KEY, "parent1", "parent2", "words", "until")], np.array(counts, dtype=np.int64), lists)

    now = None
    for batch in batches:
        columns = {x: _column(batch, x) for x in names}
        shard, block = columns["shard"], _block(columns["depth"])
        bounds = _runs(shard, block)
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if now is not None and now != (shard[i], block[i]):
                yield tile()
                kept = {x: [] for x in names}
            now = (shard[i], block[i])
            for x in names:
                kept[x].append(columns[x][i:j])
    if now is not None:
        yield tile()


def _block(depth):
    """The tile of a depth: the root goes with the first depths."""
    return np.maximum(depth - 1, 0) // DEPTHS


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's joined lists, which follow each other in order; only the running hash is held."""
    now, digest = None, None
    for batch in batches:
        out = []
        for key1, key2, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if now != (key1, key2):
                if now is not None:
                    out.append((*now, digest.hexdigest()))
                now, digest = (key1, key2), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["key1", "key2", "ends_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, digest.hexdigest())], names=["key1", "key2", "ends_sha256"])


def conversation_trie(conversations: DataFrame, *, block: int = 20, folds: int = 4) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    ``conversations`` has conv_id, turn, role and text. Conversation c is rebuilt from
    the first h turns of conversation c - c % ``block`` and its own turns after its
    first h, h = crc32(c) % ``folds``. Turns go by ``turn``, null first, then by a
    hash of role and text; repeated rows are turns of their own. A null role or text
    is empty. Rows without conv_id belong to no conversation. An empty table has no
    members, so not even a root: an empty result. Other columns are not read. Turns
    are told apart by two 64-bit hashes. The hash of an end list is one pass over the
    list in one task, whatever its length, in constant memory.
    """
    nodes, paths = rebuilt_paths(conversations, block=block, folds=folds)
    nodes = cut(nodes)
    dealt = nodes.withColumn("block", F.floor(F.greatest(F.col("depth") - 1, F.lit(0)) / DEPTHS)).repartition("shard", "block")
    found = cut(dealt.sortWithinPartitions("shard", "block").drop("block").mapInArrow(_found, _FOUND))
    least: list[Column] = [F.min_by("until", "conv_id").alias("until"), F.min("conv_id").alias("conv_id")]
    merged = cut(found.groupBy(*_KEY).agg(*least, *[F.max(c).alias(c) for c in ("depth", "parent1", "parent2")], F.sum("n").alias("n_convs")))
    below = merged.filter("depth > 0").groupBy(F.col("parent1").alias("key1"), F.col("parent2").alias("key2")).agg(F.count("*").alias("n_children"))
    merged = cut(merged.join(below, _KEY, "left").fillna(0, ["n_children"]))
    # of each conversation: the words above the first node that it is the smallest member of, and whether one of these has no child
    mine = merged.groupBy("conv_id").agg(F.min_by("until", "depth").alias("above"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    mine = paths.select("conv_id", "words").join(mine, "conv_id", "left").select(
        "conv_id", F.coalesce("above", "words").alias("above"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    sums = nodes.select("conv_id", *_KEY, "until").join(mine, "conv_id").groupBy(*_KEY).agg(
        F.sum("leaf").alias("n_leaves"), F.sum(F.greatest(F.col("above") - F.col("until"), F.lit(0))).alias("saved_tokens"))
    lists = found.filter("ended is not null").select(*_KEY, F.array_join("ended", ",").alias("ids"), "shard")
    digests = lists.repartition(*_KEY).sortWithinPartitions(*_KEY, "shard").select(*_KEY, "ids").mapInArrow(_digests, "key1 long, key2 long, ends_sha256 string")
    parents = merged.select(F.col("key1").alias("parent1"), F.col("key2").alias("parent2"), F.col("conv_id").alias("parent_conv_id"))
    named = merged.join(parents, ["parent1", "parent2"], "left").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("parent_conv_id")))
    return named.join(sums, _KEY).join(digests, _KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
