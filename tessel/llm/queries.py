"""The package's registered queries, with the same result in DuckDB's SQL for the two that are plain questions on pairs.

The others rest on library tokens or fitted models; tests hold them against the libraries, plain re-implementations or
held-out labels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessel.llm.bpe_codec import op7_bpe_codec
from tessel.llm.count_rtree import op10_count_rtree
from tessel.llm.cover_tree import op4_cover_tree
from tessel.llm.html_blocks import op3_html_blocks
from tessel.llm.lattice_lm import op2_lattice_lm
from tessel.llm.packing import op8_packing
from tessel.llm.quality_cnn import op6_quality_cnn
from tessel.llm.quality_rules import op5_quality_rules
from tessel.llm.token_counts import op9_token_counts
from tessel.llm.token_files import op1_token_orc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_orc": op1_token_orc,
    "op2_lattice_lm": op2_lattice_lm,
    "op3_html_blocks": op3_html_blocks,
    "op4_cover_tree": op4_cover_tree,
    "op5_quality_rules": op5_quality_rules,
    "op6_quality_cnn": op6_quality_cnn,
    "op7_bpe_codec": op7_bpe_codec,
    "op8_packing": op8_packing,
    "op9_token_counts": op9_token_counts,
    "op10_count_rtree": op10_count_rtree,
}

#: Classes of links (a, b): what a row reaches, then the least of it.
REACH_SQL = "reach AS (SELECT id, id AS hit FROM nodes UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.hit)"

ORACLE_SQL: dict[str, str] = {
    "op4_cover_tree": f"""
        WITH RECURSIVE nodes AS (SELECT vec_id AS id FROM embeddings),
        wide AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
        units AS (
            SELECT vec_id, label, list_transform(x, lambda v: v / sqrt(list_dot_product(x, x))) AS u FROM wide
            WHERE label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(x, lambda v: v <> 0)) > 0
        ),
        links AS (
            SELECT p.vec_id AS a, q.vec_id AS b FROM units p JOIN units q ON p.label = q.label AND p.vec_id <> q.vec_id
            WHERE len(p.u) = len(q.u) AND list_dot_product(p.u, q.u) >= 0.93
        ),
        {REACH_SQL}
        SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
        FROM (SELECT id AS vec_id, min(hit) AS component_id FROM reach GROUP BY id)
    """,
    "op10_count_rtree": f"""
        WITH RECURSIVE nodes AS (SELECT doc_id AS id FROM documents),
        words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
            FROM documents
        ),
        shingles AS (
            SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM words WHERE len(w) > 0)
        ),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        common AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS n FROM shingles p JOIN shingles q ON p.s = q.s AND p.doc_id <> q.doc_id GROUP BY ALL),
        links AS (
            SELECT a, b FROM common c JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c.n >= 85 * (p.n + q.n - c.n)
        ),
        {REACH_SQL}
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
        FROM (SELECT id AS doc_id, min(hit) AS component_id FROM reach GROUP BY id) LEFT JOIN sizes USING (doc_id)
    """,
}
