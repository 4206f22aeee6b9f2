import corpus_pipeline
from brute import removed
from llm_inputs import no_docs, SF_SMALL  # noqa: F401

import __spark_entry__ as contract
from txnlens.llm.ngram_join import ngram_jaccard_groups
from txnlens.llm.tables import table


def test_stages(spark, tmp_dir):
    docs = table(spark, SF_SMALL, "documents")
    columns, sizes = docs.columns, [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF_SMALL).write.parquet(f"{tmp_dir}/{name}")
        docs = spark.read.parquet(f"{tmp_dir}/{name}")
        sizes.append(docs.count())
        if i + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
        if name == "near_duplicates":
            groups = ngram_jaccard_groups(before, shingle_words=5, percent=80).collect()
            assert {r["doc_id"] for r in docs.select("doc_id").collect()} == {r["component_id"] for r in groups}
        if name == "repeated_passages":
            gone = {d: sum(g) for d, _, g in removed([(r["doc_id"], r["text"]) for r in before.collect()], 50)}
            after = {r["doc_id"]: len(r["text"].split()) for r in docs.collect()}
            assert all(len(r["text"].split()) - after[r["doc_id"]] == gone[r["doc_id"]] for r in before.collect())
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] == sizes[4]
    # the last stage packs every remaining document
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} == {r["doc_id"] for r in before.select("doc_id").collect()}


def test_run_and_registration(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "personal_data", "packing"]
    queries = contract.queries()
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in queries) == 1
    out = queries["pipeline"](spark, SF_SMALL)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.count() > 0


def test_stages_accept_an_empty_table(spark, no_docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, SF_SMALL).count() == 0
