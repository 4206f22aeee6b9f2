"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from txnlens.llm.bpe import encoding_report
from txnlens.llm.filter_audit import filter_audit
from txnlens.llm.fingerprints import fingerprint_edits
from txnlens.llm.html_text import extract_pages
from txnlens.llm.language_model import score_language
from txnlens.llm.ngram_join import ngram_jaccard_groups
from txnlens.llm.packing import added_tokens, pack_documents
from txnlens.llm.pii import surrogate_key, surrogate_report
from txnlens.llm.prefix_trie import conversation_trie
from txnlens.llm.quality_model import fit_quality, score_quality
from txnlens.llm.quality_rules import compression_rules
from txnlens.llm.substring_dedup import substring_report
from txnlens.llm.tables import table
from txnlens.llm.toxicity import fit_chain, score_toxicity


def op1_text_to_tag_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op2_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_chain(docs, table(spark, sf_dir, "labels")))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_groups(table(spark, sf_dir, "documents"), shingle_words=3, percent=90)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_report(table(spark, sf_dir, "documents"),
                           public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op6_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_rules(table(spark, sf_dir, "documents"))


def op7_substring_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_report(table(spark, sf_dir, "documents"))


def op8_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op9_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the same vocabulary as byte_bpe_50k.json, as ranks, and that file's added tokens
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
                          special=added_tokens(public_tokenizers.path("byte_bpe_50k.json")))


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogate_report(table(spark, sf_dir, "documents"), key=surrogate_key(spark))


def op11_filter_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_vertical_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


def op13_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_language(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_text_to_tag_ratio": op1_text_to_tag_ratio,
    "op2_classifier_chain": op2_classifier_chain,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_factorisation_machine": op5_factorisation_machine,
    "op6_compression_bands": op6_compression_bands,
    "op7_substring_doubling": op7_substring_doubling,
    "op8_bottom_k": op8_bottom_k,
    "op9_sum_of_squares_packing": op9_sum_of_squares_packing,
    "op10_surrogates": op10_surrogates,
    "op11_filter_folds": op11_filter_folds,
    "op12_vertical_bitmaps": op12_vertical_bitmaps,
    "op13_log_bilinear": op13_log_bilinear,
}

_WORDS = r"""
w AS (SELECT doc_id, regexp_extract_all({text}, '[^\x20\x09-\x0D]+') AS ws FROM documents)"""

#: The operators that SQL can express; the others are tested against plain versions, round trips or held-out rows.
ORACLE_SQL: dict[str, str] = {
    "op3_ngram_jaccard": "WITH RECURSIVE" + _WORDS.format(
        text="translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')") + """,
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS t
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT w.doc_id, COUNT(s.t) AS n FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * p.c >= 90 * (x.n + y.n - p.c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT n.doc_id, n.n AS n_shingles, m.component_id FROM n JOIN (SELECT a, MIN(b) AS component_id FROM r GROUP BY a) m ON n.doc_id = m.a""",
    "op7_substring_doubling": "WITH" + _WORDS.format(text="COALESCE(text, '')") + """,
v AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS t
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
f AS (SELECT t, MIN(doc_id) AS first FROM v GROUP BY t),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM v JOIN f USING (t) WHERE first < doc_id),
k AS (SELECT doc_id, ws[i] AS x, i FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w) WHERE (doc_id, i) NOT IN (SELECT doc_id, i FROM g))
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, COALESCE(c.n, 0) AS n_removed, sha256(COALESCE(j.kept, '')) AS kept_sha256
FROM w LEFT JOIN (SELECT doc_id, COUNT(*) AS n FROM g GROUP BY doc_id) c ON w.doc_id = c.doc_id
LEFT JOIN (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM k GROUP BY doc_id) j ON w.doc_id = j.doc_id""",
    "op11_filter_folds": r"""WITH t AS (SELECT doc_id, COALESCE(lang, '') AS part, COALESCE(text, '') AS x FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws FROM t),
l AS (SELECT doc_id, bool_or(COALESCE(quality = 1, false)) AS good, bool_or(COALESCE(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, COALESCE(good, false) AS good, COALESCE(toxic, false) AS toxic,
      map {'A': len(ws) < 100, 'B': 100 * len(list_distinct(ws)) < 80 * len(ws),
           'C': 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 10 * length(x), 'D': regexp_matches(x, '[#$%&*|]'),
           'E': COALESCE(w.doc_id > MIN(w.doc_id) OVER (PARTITION BY x), false)} AS fails
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e
      WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
c AS (SELECT part, fails, good, toxic, COUNT(*) AS n FROM d GROUP BY ALL),
s AS (SELECT part, filter_order, step, good, toxic, n, fails[filter_order[step]] AS now,
      len(list_filter(range(1, step), lambda i: fails[filter_order[i]])) > 0 AS gone,
      len(list_filter(range(1, 6), lambda i: fails[filter_order[i]])) = 1 AS one
      FROM c, o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, COALESCE(SUM(n) FILTER (NOT now AND NOT gone), 0)::BIGINT AS kept,
      COALESCE(SUM(n) FILTER (now AND NOT gone), 0)::BIGINT AS removed, COALESCE(SUM(n) FILTER (now AND gone), 0)::BIGINT AS redundant,
      COALESCE(SUM(n) FILTER (now AND one), 0)::BIGINT AS unique_fails, COALESCE(SUM(n) FILTER (now AND NOT gone AND good), 0)::BIGINT AS good_lost,
      COALESCE(SUM(n) FILTER (now AND NOT gone AND toxic), 0)::BIGINT AS toxic_lost FROM s GROUP BY ALL)
SELECT *, SUM(removed) OVER (PARTITION BY part, filter_order[step])::BIGINT AS shapley FROM r""",
    # crc32 by its table; a node is known by the hash of its turns' hashes
    "op12_vertical_bitmaps": r"""WITH z AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
        CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS crcs),
t AS (SELECT conv_id, COALESCE(role, '') AS role, COALESCE(text, '') AS x,
      ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda a: ascii(a)::BIGINT), lambda s, a:
        xor(s // 256, crcs[xor(s, a) % 256 + 1]), 4294967295), 4294967295) % 4 AS h FROM (SELECT DISTINCT conv_id FROM t), z),
p AS (SELECT c.conv_id, 0 AS own, t.i, role, x FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.i <= h
      UNION ALL SELECT c.conv_id, 1, t.i, role, x FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > h),
d AS (SELECT conv_id, ROW_NUMBER() OVER w AS depth, md5(string_agg(md5(len(role) || ':' || role || x), '') OVER w) AS k,
      len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY own, i)),
r AS (SELECT conv_id, 0 AS depth, '' AS k, 0 AS words FROM c UNION ALL SELECT * FROM d),
m AS (SELECT *, LAG(k) OVER w AS up, LEAD(k) OVER w IS NULL AS last FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
n AS (SELECT k, MIN(conv_id) AS conv_id, MIN(depth) AS depth, MIN(up) AS up, COUNT(*) AS n_convs, (COUNT(*) - 1) * MIN(words) AS saved,
      sha256(COALESCE(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM m GROUP BY k),
b AS (SELECT up, COUNT(*) AS n FROM n WHERE depth > 0 GROUP BY up),
s AS (SELECT a.k, SUM(n.saved) AS saved, COUNT(*) FILTER (n.k NOT IN (SELECT up FROM b)) AS leaves
      FROM n JOIN m a ON a.conv_id = n.conv_id AND a.depth <= n.depth GROUP BY a.k)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, COALESCE(b.n, 0) AS n_children, s.leaves AS n_leaves,
       s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN s ON s.k = n.k LEFT JOIN n u ON n.up = u.k LEFT JOIN b ON b.up = n.k""",
}
