"""The registered queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

from mosaiq.llm import ann, cotraining, html_text, language_model, line_dedup, minhash, mixing, pieces, quality_rules, toxicity
from mosaiq.llm.common import read


def op1_neighbours(spark, sf_dir):
    return ann.search(read(spark, sf_dir, "embeddings"))


def op2_main_text(spark, sf_dir):
    return html_text.extract(read(spark, sf_dir, "pages"))


def op3_mix(spark, sf_dir):
    return mixing.report(read(spark, sf_dir, "documents"))


def op4_lm(spark, sf_dir):
    return language_model.score(read(spark, sf_dir, "documents"))


def op5_line_dedup(spark, sf_dir):
    return line_dedup.report(read(spark, sf_dir, "documents"))


def op6_pieces(spark, sf_dir):
    return pieces.encode(read(spark, sf_dir, "documents"))


def op7_quality_rules(spark, sf_dir):
    return quality_rules.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_cotraining(spark, sf_dir):
    return cotraining.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_toxicity(spark, sf_dir):
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_near_duplicates(spark, sf_dir):
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), width=4, percent=80)


QUERIES = {f.__name__: f for f in (op1_neighbours, op2_main_text, op3_mix, op4_lm, op5_line_dedup, op6_pieces, op7_quality_rules, op8_cotraining, op9_toxicity, op10_near_duplicates)}

_OP10 = r"""
WITH RECURSIVE docs AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s FROM docs),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
sh AS (SELECT doc_id, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, to_) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT reach.node, e.b FROM reach JOIN e ON e.a = reach.to_)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, min(r.to_) AS component_id, s.doc_id = min(r.to_) AS kept
FROM sizes s JOIN reach r ON r.node = s.doc_id GROUP BY s.doc_id, s.n
"""

#: At this size the windows hold all vectors, so the search is exact.
_OP1 = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""

ORACLE_SQL = {"op1_neighbours": _OP1, "op10_near_duplicates": _OP10}
