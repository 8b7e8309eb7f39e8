"""Queries of the training-data operators and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spoolmark.llm import components, leakage, mixing, pii, topn
from spoolmark.sources.tables import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.group_ids(table(spark, sf_dir, "graph_edges"), "from_node", "to_node")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = topn.top_n(table(spark, sf_dir, "pipe_candidates"), ["line_key", "idf_pipe"], "dxf_pipe", "score", 5)
    return best.select("line_key", "idf_pipe", "rnk", "dxf_pipe")


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "bench_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("item_id", "doc_id")


def p7_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir)


def p7_clean_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return leakage.clean_corpus(docs, _leaks(spark, sf_dir)).select("doc_id", "source", "n_chars")


def _mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def p9_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.mask_pii(table(spark, sf_dir, "documents"))


QUERIES = {
    "p3_found": p3_found, "p5_found": p5_found, "p7_found": p7_found, "p7_matches": p7_matches, "p7_clean_docs": p7_clean_docs,
    "p8_mix": p8_mix, "p8_shares": p8_shares,
    "p9_found": p9_found, "p9_masked": p9_masked,
}

_FULL = "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u3000"
_HALF = "".join(map(chr, range(0x21, 0x7F))) + " "
_Q = lambda text: text.replace("'", "''")
# Of NFKC the SQL knows full-width signs only, which is what the tables hold.
_WORDS = rf"""
d AS (SELECT DISTINCT doc_id AS id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL), i AS (SELECT DISTINCT item_id AS id, item_text AS text FROM bench_items WHERE item_id IS NOT NULL AND item_text IS NOT NULL),
both_ AS (SELECT 'd' AS side, * FROM d UNION ALL SELECT 'i', * FROM i),
w AS (SELECT side, id, regexp_extract_all(regexp_replace(lower(translate(text, '{_Q(_FULL)}', '{_Q(_HALF)}')), '([\x{{4E00}}-\x{{9FFF}}])', ' \1 ', 'g'), '[\p{{L}}\p{{N}}]+') AS w FROM both_),
g AS (SELECT side, id, unnest(range(len(w) - 12)) AS at, unnest(list_transform(range(1, len(w) - 11), lambda k: array_to_string(w[k:k + 12], ' '))) AS s FROM w WHERE len(w) >= 13),
hit AS (SELECT b.id AS item_id, a.id AS doc_id, a.at AS doc_word, b.at AS item_word FROM g a JOIN g b ON a.side = 'd' AND b.side = 'i' AND a.s = b.s)
"""

SQL = {
    "p7_found": f"WITH {_WORDS} SELECT DISTINCT item_id, doc_id FROM hit",
    "p7_matches": f"""WITH {_WORDS}, r AS (SELECT *, doc_word - row_number() OVER (PARTITION BY item_id, doc_id, doc_word - item_word ORDER BY doc_word) AS run FROM hit),
    m AS (SELECT item_id, doc_id, (count(*) + 12)::INT AS n_words, min(doc_word)::INT AS doc_word, min(item_word)::INT AS item_word FROM r GROUP BY item_id, doc_id, doc_word - item_word, run)
    SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY item_id, doc_id ORDER BY n_words DESC, doc_word, item_word) = 1""",
    "p7_clean_docs": f"WITH {_WORDS} SELECT doc_id, source, n_chars FROM documents WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM hit)",
    "p3_found": """
    WITH RECURSIVE e AS (
      SELECT DISTINCT trim(from_node, ' ' || chr(9) || chr(10) || chr(13)) AS a, trim(to_node, ' ' || chr(9) || chr(10) || chr(13)) AS b FROM graph_edges
      WHERE trim(from_node, ' ' || chr(9) || chr(10) || chr(13)) <> '' AND trim(to_node, ' ' || chr(9) || chr(10) || chr(13)) <> ''
    ), n AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),
    reach AS (
      SELECT x AS node, x AS g FROM n
      UNION SELECT n.y, r.g FROM reach r JOIN n ON n.x = r.node WHERE r.g < n.y
    )
    SELECT node AS node_id, min(g) AS group_id FROM reach GROUP BY node""",
    "p5_found": """
    SELECT line_key, idf_pipe, rnk::INT AS rnk, dxf_pipe FROM (
      SELECT line_key, idf_pipe, dxf_pipe, row_number() OVER (PARTITION BY line_key, idf_pipe ORDER BY max(score) DESC, dxf_pipe) AS rnk
      FROM pipe_candidates WHERE idf_pipe IS NOT NULL AND dxf_pipe IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)
      GROUP BY line_key, idf_pipe, dxf_pipe)
    WHERE rnk <= 5""",
}
