import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer
from llm_inputs import corpus, no_docs  # noqa: F401

from txnlens.llm.packing import Levels, added_tokens, pack, pack_documents, powers_of_two

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def check(pieces, ids, size):
    """Every id in one piece, sequences without gaps, and no padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for key, start, length, crc, total, sequence, offset in pieces:
        assert total == len(ids[key]) and crc == zlib.crc32(ids[key][start:start + length].tobytes())
        by_doc[key].append((start, length))
        by_sequence[sequence].append((offset, length))
    assert set(by_doc) == set(ids)
    for parts, end in [(by_doc[k], len(ids[k])) for k in ids] + [(v, None) for v in by_sequence.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert end is None and at <= size or at == end
    fills = [sum(n for _, n in v) for v in by_sequence.values()]
    return sum(size - f for f in fills if f & (f - 1))


@pytest.mark.parametrize("size, max_open", [(64, 512), (64, 3), (1024, 40)])
def test_random_lengths(size, max_open):
    r = random.Random(size + max_open)
    ids = {i: np.arange(r.choice([1, 2, 37, 38, size - 1, size, size + 1, r.randint(1, 5 * size)]), dtype="<u4") for i in range(700)}
    pieces = []
    for number, sequence in enumerate(pack(iter(ids.items()), size, max_open)):
        offset = 0
        for key, start, total, part in sequence:
            pieces.append((key, start, len(part), zlib.crc32(part.tobytes()), total, number, offset))
            offset += len(part)
    assert check(pieces, ids, size) == 0


def test_placement_minimises_the_sum_of_squares():
    r = random.Random(2)
    levels = Levels(16)
    for _ in range(2000):
        n = r.randint(1, 15)
        before = levels.count.copy()

        def after(at, before=before, n=n):
            c = before.copy()
            if at:
                c[at] -= 1
            if at + n < 16:
                c[at + n] += 1
            return int((c**2).sum())

        best = min(after(at) for at in range(16 - n + 1) if at == 0 or before[at])
        levels.place((0, 0, n, np.zeros(n, dtype="<u4")))
        levels.count[16] = 0
        assert int((levels.count**2).sum()) == best


def test_leftovers_are_cut_into_powers_of_two():
    got = list(powers_of_two([(1, 0, 9, np.arange(9)), (2, 4, 8, np.arange(4))]))
    assert [sum(len(p[3]) for p in s) for s in got] == [8, 4, 1]


def test_table_with_ids_of_the_tokenizer_file(corpus):
    rows, docs = corpus
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    out = pack_documents(docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).coalesce(1), PATH, PATTERN)
    kept = {}
    for d, t in rows:
        kept.setdefault(d, set()).add(t)
    texts = {d: t for d, t in ((r["doc_id"], r["text"]) for r in docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).coalesce(1).collect())}
    ids = {d: np.array([*e.ids, 0], dtype="<u4") for d, e in zip(texts, tokenizer.encode_batch([t or "" for t in texts.values()], add_special_tokens=False), strict=True)}
    assert check([tuple(r) for r in out.collect()], ids, 1024) == 0


def test_rows_without_id_or_text_and_empty_table(spark, no_docs):
    docs = spark.createDataFrame([(None, None), (None, "a"), (3, "a"), (3, "a")], "doc_id long, text string")
    got = pack_documents(docs, PATH, PATTERN).collect()
    assert sum(r["length"] for r in got) == 1 + 2 * 3
    assert pack_documents(no_docs, PATH, PATTERN).count() == 0


def test_added_tokens_are_read_out_of_the_text(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    end, tokenizer = "<|endoftext|>", Tokenizer.from_file(path)
    special = added_tokens(path)
    assert special == {end: 50256}
    r = random.Random(9)
    texts = ["one doc<|endoftext|>next", end, end * 3, f" {end} ", f"a  {end}\n\n{end}b", "<|endoftext|", "<|ENDOFTEXT|>", "<<|endoftext|>>", "plain",
             *("".join(r.choice([end, "<|", "|>", " ", "  ", "\n", "word", " é", "12", "'s", "!"]) for _ in range(r.randint(1, 60))) for _ in range(200))]
    ids = {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], dtype="<u4") for i, t in enumerate(texts)}
    assert ids[0].tolist() == [505, 2205, 50256, 19545, 0]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = pack_documents(docs, PATH, PATTERN, special=special, size=64)
    assert check([tuple(x) for x in out.collect()], ids, 64) == 0


def test_the_query_and_the_stage_take_the_added_tokens(spark, tmp_path):
    import corpus_pipeline
    from txnlens.llm.queries import op9_sum_of_squares_packing

    docs = spark.createDataFrame([(1, "one doc<|endoftext|>next")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for out in (op9_sum_of_squares_packing(spark, str(tmp_path)), corpus_pipeline.packing(spark, docs, str(tmp_path))):
        rows = out.collect()
        assert {x["doc_tokens"] for x in rows} == {5} and sum(x["length"] for x in rows) == 5
        # five ids end as sequences of four and of one
        assert sorted(x["ids_crc32"] for x in rows) == sorted([zlib.crc32(np.array([505, 2205, 50256, 19545], dtype="<u4").tobytes()), zlib.crc32(b"\0\0\0\0")])


def test_short_documents_are_cut_only_at_the_end_of_a_stream():
    """However many sequences are open: before the stream ends, pieces of a document are whole sequences and one rest."""
    r = random.Random(5)
    ids = {i: np.arange(r.choice([520, 600, 700, 5, 1030]) + r.randrange(60), dtype="<u4") for i in range(3000)}
    ended = []

    def documents():
        yield from ids.items()
        ended.append(True)

    before, open_at_end = 0, 0
    for sequence in pack(documents(), 1024):
        if ended:
            open_at_end += 1
            continue
        before += 1
        for _, start, total, part in sequence:
            assert start % 1024 == 0 and len(part) == min(1024, total - start)
    assert before > 500 and open_at_end > 512  # a small cap would have cut documents
