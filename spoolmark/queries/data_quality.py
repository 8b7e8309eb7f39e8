"""Queries over rejects, orphans, hierarchies and nested pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spoolmark.functions.keys import graphic_key, uci_key
from spoolmark.operators import hierarchy, nested, orphans, rejects
from spoolmark.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = rejects.split_lines(table(spark, sf_dir, "idf_lines").select("row_id", "line_no", "raw_line"))
    return bad.select("row_id", "reason")


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = rejects.split_lines(table(spark, sf_dir, "idf_lines").select("row_id", "idf_file", "line_no", "raw_line"))
    return good.drop("raw_line")


def p1_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.header_lines(table(spark, sf_dir, "idf_lines").select("row_id", "idf_file", "line_no", "raw_line")).drop("raw_line")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    attributes = table(spark, sf_dir, "dynamic_attributes")
    graphic = graphic_key(c("drawing_id"), c("graphic_ref"))
    cites = [
        orphans.citations(table(spark, sf_dir, "psm_envelopes"), "psm_envelopes", "envelope_id", graphic, "recorded_at"),
        orphans.citations(table(spark, sf_dir, "weld_blocks"), "weld_blocks", "weld_id", uci_key(c("uci")), "recorded_at"),
        orphans.citations(table(spark, sf_dir, "point_targets"), "point_targets", "point_id", uci_key(c("uci")), "recorded_at"),
    ]
    parents = [orphans.lives(attributes, key, "created_at", "deleted_at") for key in (graphic, uci_key(c("uci")))]
    return orphans.find_orphans(cites, parents)


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_counts(p2_found(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    owned = hierarchy.ownership(table(spark, sf_dir, "composites"), "drawing_id", "parent_ref", "children", "child_ref")
    return hierarchy.hierarchies(owned).select(
        F.col("domain").alias("drawing_id"), F.col("node").alias("node_ref"), "verdict", F.col("root").alias("root_ref"),
        "depth", F.col("path").alias("node_path"), "n_below",
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = nested.flatten_pages(table(spark, sf_dir, "dxf_pages"), "page_id", "page_json")
    return items.select("page_id", "item_kind", "item_id", "parent_id", "val")


def _page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.page_fields(table(spark, sf_dir, "dxf_pages"), "page_id", "page_json")


def p6_handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_fields(spark, sf_dir).where("field = 'handles'").select("page_id", "owner_id", "place", F.col("val").alias("handle"))


def p6_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _page_fields(spark, sf_dir).where("field in ('endpoints', 'outline', 'welds', 'subpaths', 'centre', 'point', 'anchor.point')")
    return own.select("page_id", "owner_id", "field", "place", "part", "x", "y")


def p6_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _page_fields(spark, sf_dir).where("field in ('title', 'by.rule', 'by.gap', 'anchor.of.kind', 'anchor.of.handle')")
    return own.select("page_id", "owner_id", "field", "val")


QUERIES = {
    "p6_handles": p6_handles, "p6_points": p6_points, "p6_details": p6_details,
    "p1_found": p1_found, "p1_records": p1_records, "p1_headers": p1_headers, "p2_found": p2_found, "p2_counts": p2_counts,
    "p4_found": p4_found, "p6_found": p6_found,
}

_LINES = r"""
WITH lines AS (
  SELECT row_id, idf_file, line_no, line,
    regexp_matches(line, '^[ \t]*(("([^"]|"")*"|[^ \t"]+)([ \t]+|$))*$', 's') AS quoted,
    list_transform(regexp_extract_all(line, '"(?:[^"]|"")*"|[^ \t"]+', 0, 's'),
      lambda x: CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END) AS f
  FROM (SELECT *, CASE WHEN right(raw_line, 1) = chr(13) THEN raw_line[:-2] ELSE coalesce(raw_line, '') END AS line FROM idf_lines)
), judged AS (
  SELECT *, CASE
    WHEN NOT quoted THEN 'quoting'
    WHEN line_no BETWEEN 1 AND 10 THEN CASE
      WHEN len(f) <> 14 THEN 'column_count'
      WHEN NOT list_bool_and(list_transform(f, lambda x: regexp_full_match(x, '[+-]?[0-9]+'))) THEN 'bad_switch' END
    WHEN len(f) <> 10 THEN 'column_count'
    WHEN NOT regexp_full_match(f[1], '[0-9]{1,3}') OR try_cast(f[1] AS INT) = 0 THEN 'bad_code'
    WHEN NOT list_bool_and(list_transform(f[2:7], lambda x:
      regexp_full_match(x, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([Ee][+-]?[0-9]+)?') AND coalesce(isfinite(try_cast(x AS DOUBLE)), false))) THEN 'bad_coord'
    WHEN NOT (regexp_full_match(f[8], '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([Ee][+-]?[0-9]+)?')
      AND coalesce(try_cast(f[8] AS DOUBLE) > 0 AND try_cast(f[8] AS DOUBLE) <= 3000, false)) THEN 'bad_bore'
    WHEN try_cast(f[1] AS INT) = 100 AND NOT contains(f[10], ',') THEN 'bad_tail' END AS reason
  FROM lines
)
"""

_ORPHANS = r"""
WITH parents AS (
  SELECT 'g:' || drawing_id || ':' || graphic_ref AS k, created_at, deleted_at FROM dynamic_attributes
  UNION ALL
  SELECT 'u:' || upper(trim(translate(uci, '{}', ''), ' ' || chr(9))), created_at, deleted_at FROM dynamic_attributes
), cites AS (
  SELECT 'psm_envelopes' AS src_table, envelope_id AS src_id, 'g:' || drawing_id || ':' || graphic_ref AS k, recorded_at FROM psm_envelopes
  UNION SELECT 'weld_blocks', weld_id, 'u:' || upper(trim(translate(uci, '{}', ''), ' ' || chr(9))), recorded_at FROM weld_blocks
  UNION SELECT 'point_targets', point_id, 'u:' || upper(trim(translate(uci, '{}', ''), ' ' || chr(9))), recorded_at FROM point_targets
), orphans AS (
  SELECT src_table, src_id,
    CASE WHEN count(p.k) = 0 THEN 'missing' WHEN bool_or(coalesce(created_at <= recorded_at, false)) THEN 'deleted' ELSE 'late' END AS verdict,
    strftime(recorded_at, '%Y-%m') AS ref_month
  FROM cites c LEFT JOIN parents p ON p.k = c.k
  WHERE c.k IS NOT NULL AND c.k <> 'u:'
  GROUP BY src_table, src_id, c.k, recorded_at
  HAVING NOT coalesce(bool_or(created_at <= recorded_at AND (deleted_at IS NULL OR deleted_at > recorded_at)), false)
)
"""

_PAGES = """WITH pages AS (SELECT DISTINCT page_id, CASE WHEN json_valid(page_json) THEN page_json::JSON END AS j FROM dxf_pages),
    page AS (SELECT page_id, j FROM pages WHERE json_type(j) = 'OBJECT'),
    pipe AS (
      SELECT page_id, 'P' || lpad((i - 1)::VARCHAR, greatest(3, len((i - 1)::VARCHAR))::INT, '0') AS id, p FROM (
        SELECT page_id, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS p FROM (
          SELECT page_id, CASE WHEN json_type(j -> 'pipes') = 'ARRAY' THEN (j -> 'pipes')::JSON[] END AS ps FROM page))
      WHERE coalesce(json_type(p), 'NULL') <> 'NULL'
    ), comp AS (
      SELECT page_id, 'C' || lpad((i - 1)::VARCHAR, greatest(3, len((i - 1)::VARCHAR))::INT, '0') AS id, p FROM (
        SELECT page_id, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS p FROM (
          SELECT page_id, CASE WHEN json_type(j -> 'components') = 'ARRAY' THEN (j -> 'components')::JSON[] END AS ps FROM page))
      WHERE coalesce(json_type(p), 'NULL') <> 'NULL'
    ), ann AS (
      SELECT page_id, id, i, p FROM (
        SELECT page_id, id, unnest(range(len(ps))) AS i, unnest(ps) AS p FROM (
          SELECT page_id, id, CASE WHEN json_type(p -> 'endpoint_annotations') = 'ARRAY' THEN (p -> 'endpoint_annotations')::JSON[] END AS ps FROM pipe))
      WHERE coalesce(json_type(p), 'NULL') <> 'NULL'
    ), seg AS (
      SELECT page_id, id, i, p FROM (
        SELECT page_id, id, unnest(range(len(ps))) AS i, unnest(ps) AS p FROM (
          SELECT page_id, id, CASE WHEN json_type(p -> 'source_vector_segments') = 'ARRAY' THEN (p -> 'source_vector_segments')::JSON[] END AS ps FROM pipe))
      WHERE coalesce(json_type(p), 'NULL') <> 'NULL'
    ), owner AS (
      SELECT page_id, id, p FROM pipe UNION ALL SELECT page_id, id, p FROM comp
      UNION ALL SELECT page_id, id || ':E' || i, p FROM ann UNION ALL SELECT page_id, id || ':V' || i, p FROM seg
    )"""


def _list_sql(field: str, of: str) -> str:
    """Elements of a list member of the owners whose id begins with a pattern."""
    return f"""SELECT page_id, id, '{field}' AS field, place::INT AS place, e FROM (SELECT page_id, id, unnest(range(len(l))) AS place, unnest(l) AS e FROM (
      SELECT page_id, id, CASE WHEN json_type(p -> '{field}') = 'ARRAY' THEN (p -> '{field}')::JSON[] END AS l FROM owner WHERE regexp_full_match(id, '{of}'))) WHERE coalesce(json_type(e), 'NULL') <> 'NULL'"""


def _one_sql(field: str, path: str, of: str) -> str:
    """A member of the owners, at a path."""
    value = "p" + "".join(f" -> '{n}'" for n in path.split("."))
    return f"SELECT page_id, id, '{field}' AS field, {value} AS e FROM owner WHERE regexp_full_match(id, '{of}') AND coalesce(json_type({value}), 'NULL') <> 'NULL'"


_PIPE, _PART, _MARK, _SEGMENT = "P[0-9]+", "C[0-9]+", "P[0-9]+:E[0-9]+", "P[0-9]+:V[0-9]+"
_XY = "CASE WHEN json_type(e) = 'ARRAY' AND json_type(e -> 0) NOT IN ('ARRAY', 'OBJECT') THEN try_cast(e ->> 0 AS DOUBLE) END AS x, CASE WHEN json_type(e) = 'ARRAY' AND json_type(e -> 1) NOT IN ('ARRAY', 'OBJECT') THEN try_cast(e ->> 1 AS DOUBLE) END AS y"
_LISTS = " UNION ALL ".join([_list_sql("endpoints", _PIPE), _list_sql("endpoints", _SEGMENT), _list_sql("outline", _PART)])
_LINES_OF = " UNION ALL ".join([_list_sql("welds", _PART), _list_sql("subpaths", _PART)])
_ONES = " UNION ALL ".join([_one_sql("centre", "centre", _PART), _one_sql("point", "point", _MARK), _one_sql("anchor.point", "anchor.point", _PART)])
_DETAILS = " UNION ALL ".join([_one_sql("title", "title", _PIPE), _one_sql("by.rule", "by.rule", _MARK), _one_sql("by.gap", "by.gap", _MARK), _one_sql("anchor.of.kind", "anchor.of.kind", _PART), _one_sql("anchor.of.handle", "anchor.of.handle", _PART)])

SQL = {
    "p6_handles": f"{_PAGES} SELECT page_id, id AS owner_id, place, coalesce(e ->> '$', '') AS handle FROM ({_list_sql('handles', _PIPE)} UNION ALL {_list_sql('handles', _PART)})",
    "p6_points": f"""{_PAGES}, lines AS ({_LINES_OF}), inner_ AS (SELECT page_id, id, field, place, unnest(range(len(l)))::INT AS part, unnest(l) AS e FROM (SELECT *, CASE WHEN json_type(e) = 'ARRAY' THEN e::JSON[] END AS l FROM lines))
    SELECT page_id, id AS owner_id, field, place, NULL::INT AS part, {_XY} FROM ({_LISTS})
    UNION ALL SELECT page_id, id, field, place, part, {_XY} FROM inner_ WHERE coalesce(json_type(e), 'NULL') <> 'NULL'
    UNION ALL SELECT page_id, id, field, NULL, NULL, {_XY} FROM ({_ONES})""",
    "p6_details": f"{_PAGES} SELECT page_id, id AS owner_id, field, e ->> '$' AS val FROM ({_DETAILS})",
    "p1_found": _LINES + "SELECT row_id, reason FROM judged WHERE reason IS NOT NULL",
    "p1_records": _LINES
    + """SELECT row_id, idf_file, line_no, f[1]::INT AS code, f[2]::DOUBLE AS ax, f[3]::DOUBLE AS ay, f[4]::DOUBLE AS az,
      f[5]::DOUBLE AS bx, f[6]::DOUBLE AS by, f[7]::DOUBLE AS bz, f[8]::DOUBLE AS bore, f[9] AS uci, f[10] AS tail
    FROM judged WHERE reason IS NULL AND (line_no NOT BETWEEN 1 AND 10)""",
    "p1_headers": _LINES + "SELECT row_id, idf_file, line_no, "
    + ", ".join(f"try_cast(f[{i + 1}] AS BIGINT) AS s{i:02d}" for i in range(rejects.HEADER_FIELDS))
    + """, CASE WHEN list_bool_and(list_transform(f, lambda x: try_cast(x AS BIGINT) IS NOT NULL)) THEN NULL ELSE array_to_string(f, chr(9)) END AS corrupt_raw
    FROM judged WHERE reason IS NULL AND line_no BETWEEN 1 AND 10""",
    "p2_found": _ORPHANS + "SELECT DISTINCT * FROM orphans",
    "p2_counts": _ORPHANS + "SELECT src_table, ref_month, verdict, count(*) AS n_orphans FROM (SELECT DISTINCT * FROM orphans) GROUP BY ALL",
    "p4_found": """
    WITH RECURSIVE named AS (
      SELECT drawing_id, parent_ref AS node, NULL::BIGINT AS owner FROM composites
      UNION ALL SELECT drawing_id, c.child_ref, parent_ref FROM (SELECT drawing_id, parent_ref, unnest(children) AS c FROM composites)
    ), owned AS (
      SELECT drawing_id, node, min(owner) AS owner FROM named WHERE node IS NOT NULL AND drawing_id IS NOT NULL GROUP BY ALL
    ), up AS (
      SELECT drawing_id, node, owner AS above, 1 AS hops FROM owned WHERE owner IS NOT NULL
      UNION SELECT u.drawing_id, u.node, o.owner, 1 FROM up u JOIN owned o ON o.drawing_id = u.drawing_id AND o.node = u.above WHERE o.owner IS NOT NULL
    ), cyc AS (SELECT DISTINCT drawing_id, node FROM up WHERE node = above),
    bad AS (SELECT DISTINCT u.drawing_id, u.node FROM up u JOIN cyc c ON c.drawing_id = u.drawing_id AND c.node = u.above),
    down AS (
      SELECT drawing_id, node, node AS root, 0 AS depth, node::VARCHAR AS path FROM owned WHERE owner IS NULL
      UNION ALL SELECT o.drawing_id, o.node, d.root, d.depth + 1, d.path || '/' || o.node FROM down d JOIN owned o ON o.drawing_id = d.drawing_id AND o.owner = d.node
    ), below AS (SELECT drawing_id, above AS node, count(DISTINCT node) AS n FROM up GROUP BY ALL)
    SELECT o.drawing_id, o.node AS node_ref,
      CASE WHEN c.node IS NOT NULL THEN 'cycle' WHEN b.node IS NOT NULL THEN 'below_cycle' ELSE 'tree' END AS verdict,
      CASE WHEN c.node IS NULL AND b.node IS NULL THEN d.root ELSE -1 END AS root_ref,
      CASE WHEN c.node IS NULL AND b.node IS NULL THEN d.depth ELSE -1 END AS depth,
      CASE WHEN c.node IS NULL AND b.node IS NULL THEN d.path ELSE '' END AS node_path,
      CASE WHEN c.node IS NULL AND b.node IS NULL THEN coalesce(n.n, 0) ELSE -1 END AS n_below
    FROM owned o LEFT JOIN cyc c USING (drawing_id, node) LEFT JOIN bad b USING (drawing_id, node)
      LEFT JOIN down d USING (drawing_id, node) LEFT JOIN below n USING (drawing_id, node)""",
    "p6_found": """
    WITH pages AS (SELECT DISTINCT page_id, CASE WHEN json_valid(page_json) THEN page_json::JSON END AS j FROM dxf_pages),
    page AS (SELECT page_id, j FROM pages WHERE json_type(j) = 'OBJECT'),
    pipe AS (
      SELECT page_id, 'P' || lpad((i - 1)::VARCHAR, greatest(3, len((i - 1)::VARCHAR))::INT, '0') AS id, p FROM (
        SELECT page_id, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS p FROM (
          SELECT page_id, CASE WHEN json_type(j -> 'pipes') = 'ARRAY' THEN (j -> 'pipes')::JSON[] END AS ps FROM page))
      WHERE coalesce(json_type(p), 'NULL') <> 'NULL'
    ), comp AS (
      SELECT page_id, 'C' || lpad((i - 1)::VARCHAR, greatest(3, len((i - 1)::VARCHAR))::INT, '0') AS id, p FROM (
        SELECT page_id, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS p FROM (
          SELECT page_id, CASE WHEN json_type(j -> 'components') = 'ARRAY' THEN (j -> 'components')::JSON[] END AS ps FROM page))
      WHERE coalesce(json_type(p), 'NULL') <> 'NULL'
    ), ann AS (
      SELECT page_id, id, i, p FROM (
        SELECT page_id, id, unnest(range(len(ps))) AS i, unnest(ps) AS p FROM (
          SELECT page_id, id, CASE WHEN json_type(p -> 'endpoint_annotations') = 'ARRAY' THEN (p -> 'endpoint_annotations')::JSON[] END AS ps FROM pipe))
      WHERE coalesce(json_type(p), 'NULL') <> 'NULL'
    ), seg AS (
      SELECT page_id, id, i, p FROM (
        SELECT page_id, id, unnest(range(len(ps))) AS i, unnest(ps) AS p FROM (
          SELECT page_id, id, CASE WHEN json_type(p -> 'source_vector_segments') = 'ARRAY' THEN (p -> 'source_vector_segments')::JSON[] END AS ps FROM pipe))
      WHERE coalesce(json_type(p), 'NULL') <> 'NULL'
    )
    SELECT page_id, 'pipe' AS item_kind, id AS item_id, '' AS parent_id, coalesce(p ->> 'kind', '') AS val FROM pipe
    UNION ALL SELECT page_id, 'component', id, '', coalesce(p ->> 'kind', '') FROM comp
    UNION ALL SELECT page_id, 'endpoint_annotation', id || ':E' || i, id,
      CASE WHEN p ->> 'support' = 'true' AND p ->> 'weld' = 'true' THEN 'both' WHEN p ->> 'support' = 'true' THEN 'support'
        WHEN p ->> 'weld' = 'true' THEN 'weld' ELSE 'empty' END FROM ann
    UNION ALL SELECT page_id, 'source_vector_segment', id || ':V' || i, id, coalesce(p ->> 'handle', '') FROM seg""",
}
