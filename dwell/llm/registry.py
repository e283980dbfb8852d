"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from dwell.llm.bpe_automaton import op7_bpe_automaton
from dwell.llm.grid_join import op8_grid_join
from dwell.llm.hard_negatives import op11_dual_tree_negatives
from dwell.llm.html_extraction import op9_html_blocks
from dwell.llm.lexical_search import op13_sorted_impacts
from dwell.llm.line_frequency import MAX_DOCUMENTS, op4_line_frequency
from dwell.llm.packing import op3_cost_packing
from dwell.llm.quality_classifier import op1_quality_nbsvm
from dwell.llm.sharding import op12_lpt_shards
from dwell.llm.simhash import op10_simhash_golay
from dwell.llm.token_counts import op2_token_counts
from dwell.llm.toxicity import op5_toxicity_subword
from dwell.llm.warc import LEAST_BYTES, op6_warc_zstd

QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_nbsvm,
        op2_token_counts,
        op3_cost_packing,
        op4_line_frequency,
        op5_toxicity_subword,
        op6_warc_zstd,
        op7_bpe_automaton,
        op8_grid_join,
        op9_html_blocks,
        op10_simhash_golay,
        op11_dual_tree_negatives,
        op12_lpt_shards,
        op13_sorted_impacts,
    )
}

_SPACE = r"[\x20\x09-\x0D]+"
_WORDS = rf"list_filter(regexp_split_to_array(coalesce({{x}}, ''), '{_SPACE}'), lambda w: w <> '')"
_EIGHT = " || ' ' || ".join(["word", *(f"lead(word, {k}) OVER o" for k in range(1, 8))])
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000"

#: Trained models, tokenizers, byte-level archives' bytes, XXH64 and page rules are beyond SQL: tests/llm has plain versions.
SQL: dict[str, str] = {
    "op4_line_frequency": rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS.format(x="text")} AS w FROM documents),
l0 AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d),
l1 AS (SELECT doc_id, source, line, {_WORDS.format(x="line")} AS w FROM l0),
l AS (SELECT doc_id, source, line, len(w) AS n, translate(array_to_string(w, ' '), '{_UPPER}', '{_LOWER}') AS norm FROM l1 WHERE len(w) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY doc_id),
freq AS (SELECT source, norm FROM l GROUP BY source, norm HAVING count(DISTINCT doc_id) > {MAX_DOCUMENTS}),
rem AS (SELECT l.doc_id, sum(l.n) AS removed_words FROM l JOIN freq f ON l.norm = f.norm AND l.source IS NOT DISTINCT FROM f.source GROUP BY l.doc_id),
wp AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
win AS (SELECT doc_id, i, {_EIGHT} AS g FROM wp WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
win2 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win WHERE g IS NOT NULL),
rep AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(generate_series(i, i + 7)) AS j FROM win2 WHERE c > 1) GROUP BY doc_id),
s AS (SELECT d.doc_id, len(w) AS n_words, length(text) - length(regexp_replace(text, '[^\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed_words, 0) AS removed_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN rem USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words - removed_words >= 20 AND n_words - removed_words >= 0.5 * n_words AS kept, removed_words FROM b""",
    "op6_warc_zstd": f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
t AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS target FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id <> target THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id <> target THEN target END AS refers_to FROM t""",
    "op8_grid_join": """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_dot_product(a.u, b.u) >= 0.95),
r AS (SELECT vec_id, vec_id AS root FROM u UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.vec_id),
c AS (SELECT vec_id, min(root) AS component_id FROM r GROUP BY vec_id)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a) USING (vec_id)""",
    "op11_dual_tree_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
    "op13_sorted_impacts": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
c AS (SELECT count(*) AS nd, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
e AS (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM e WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * (SELECT nd FROM c) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf GROUP BY term),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nd) // l)))) AS BIGINT) AS score FROM i JOIN tf USING (term) JOIN w USING (term), c GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10""",
}
