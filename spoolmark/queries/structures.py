"""Queries over texts, binary records, graphs, searches and reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F, types as T

from spoolmark.functions import geometry as geo, text as tx
from spoolmark.operators import graph, linking, propagation, reports, search, sets, spatial
from spoolmark.queries.links import _KEY, IDF_SQL, _idf, _keyed
from spoolmark.sources import pcf, records, sinks
from spoolmark.sources.tables import table

_ALL: dict = {}
_W = "(SELECT DISTINCT weld_id, pcf_file, uci, component_identifier, master_component_identifier, skey, endpoint FROM weld_blocks WHERE pcf_file IS NOT NULL)"


def query(sql: str | None = None):
    def register(f):
        _ALL[f.__name__] = (f, sql)
        return f

    return register


# Component text: weld records are written as text and read back.


def _weld_lines(spark, d):
    cols = ["weld_id", "pcf_file", "uci", "component_identifier", "master_component_identifier", "skey", "endpoint"]
    return pcf.weld_text(table(spark, d, "weld_blocks").where("pcf_file is not null").select(*cols).distinct())


@query(f"""SELECT pcf_file AS path, component_identifier::BIGINT AS id, regexp_extract(uci, '(\\{{[^}}]+\\}})', 1) AS uci, CASE WHEN endpoint IS NOT NULL AND endpoint.pos_x >= 0 AND endpoint.pos_y >= 0 AND endpoint.pos_z >= 0 THEN 1 ELSE 0 END AS n_points
  FROM {_W} WHERE coalesce(component_identifier, master_component_identifier) IS NOT NULL AND regexp_matches(uci, '\\{{[^}}]+\\}}') AND component_identifier IS NOT NULL""".replace("\\\\", "\\"))
def s2_component_scan(spark, d):
    c = pcf.components(_weld_lines(spark, d).where("line not like '%MASTER-COMPONENT%'"))
    return c.select("path", "id", "uci", F.size("points").alias("n_points"))


@query(f"""SELECT pcf_file AS path, trim(uci, ' ') AS uci, component_identifier, master_component_identifier, nullif(trim(skey, ' '), '') AS skey, round(endpoint.pos_x, 3) AS x, round(endpoint.bore, 3) AS bore
  FROM {_W} WHERE trim(uci, ' ') <> '' AND trim(uci, ' ' || chr(9)) <> ''""")
def s3_weld_scan(spark, d):
    w = pcf.welds(_weld_lines(spark, d))
    return w.select("path", "uci", "component_identifier", "master_component_identifier", "skey", F.round("endpoint.x", 3).alias("x"), F.round("endpoint.bore", 3).alias("bore"))


@query(f"SELECT pcf_file AS path, count(*) AS n_welds, count(endpoint) AS n_points, 0::BIGINT AS n_numbered FROM {_W} GROUP BY 1")
def s5_diagnostic_scan(spark, d):
    lines = _weld_lines(spark, d)
    g = pcf.diagnostics(lines.withColumn("line", F.regexp_replace("line", "WELD-REMARK-NUMBER", "REPEAT-WELD-IDENTIFIER")))
    return g.groupBy("path").agg(F.count("*").alias("n_welds"), F.sum(F.when(F.size("points") > 0, 1).otherwise(0)).alias("n_points"), F.count("weld_id").alias("n_numbered"))


@query(f"SELECT pcf_file AS path, string_agg('N' || rn, ',' ORDER BY rn) AS numbers FROM (SELECT *, row_number() OVER (PARTITION BY pcf_file ORDER BY weld_id) AS rn FROM {_W}) GROUP BY 1")
def k3_renumbered_text(spark, d):
    lines = _weld_lines(spark, d)
    blocks = pcf.blocks(lines, ["path"], ["pos"], pcf.any_header(F.col("line"))).select("path", "block").distinct()
    new = pcf.renumber(lines, blocks.select("path", "block", F.concat(F.lit("N"), F.col("block").cast("string")).alias("number")))
    text = pcf.whole_text(new)
    return text.select("path", F.array_join(F.regexp_extract_all("value", F.lit(r"WELD-REMARK-NUMBER\s+(N[0-9]+)"), 1), ",").alias("numbers"))


# Binary records: tables are written as records and read back.

_STREAMS = T.StructType([T.StructField("path", T.StringType()), T.StructField("stream", T.StringType()), T.StructField("data", T.BinaryType())])


def _composite_rows(spark, d):
    whole = F.forall("children", lambda c: c.child_ref.isNotNull() & c.prim_type.isNotNull() & c.child_ref.between(0, 4294967295))
    return table(spark, d, "composites").where((F.size("children").between(1, 100)) & whole & F.col("parent_ref").isNotNull() & F.col("sheet_ref").isNotNull()).dropDuplicates(["composite_id"])


def _pack_composites(pdf: pd.DataFrame) -> pd.DataFrame:
    body = b"".join(
        records.pack_composite(int(r.parent_ref), int(r.sheet_ref), [tuple(int(c[k]) & (0xFFFFFFFF if k == "child_ref" else 0xFFFF) for k in ("child_ref", "box_left", "box_bottom", "box_right", "box_top", "prim_type")) for c in r.children])
        for r in pdf.sort_values("composite_id").itertuples()
    )
    return pd.DataFrame([(str(pdf["part"].iloc[0]), "Sheet1", body)], columns=_STREAMS.names)


def _composite_streams(spark, d):
    rows = _composite_rows(spark, d).withColumn("part", F.concat_ws("-", "drawing_id", F.pmod(F.xxhash64("composite_id"), F.lit(16))))
    return rows.select("part", "composite_id", "parent_ref", "sheet_ref", "children").groupBy("part").applyInPandas(_pack_composites, _STREAMS)


@query("""WITH w AS (SELECT DISTINCT composite_id, parent_ref, sheet_ref, children FROM composites WHERE len(children) BETWEEN 1 AND 100 AND parent_ref IS NOT NULL AND sheet_ref IS NOT NULL
    AND list_bool_and(list_transform(children, lambda c: c.child_ref IS NOT NULL AND c.prim_type IS NOT NULL)))
  SELECT parent_ref, sheet_ref, c.child_ref AS child_ref, c.box_left AS box_left, c.box_top AS box_top, c.prim_type AS prim_type, count(*) AS n FROM (SELECT parent_ref, sheet_ref, unnest(children) AS c FROM w) GROUP BY ALL""")
def s19_composite_scan(spark, d):
    return records.scan(_composite_streams(spark, d), "composite").groupBy("parent_ref", "sheet_ref", "child_ref", "box_left", "box_top", "prim_type").agg(F.count("*").alias("n"))


def _pack_envelopes(pdf: pd.DataFrame) -> pd.DataFrame:
    cols = ["graphic_ref", "box_left", "box_bottom", "box_right", "box_top", "opaque_tag"]
    rows = [tuple(map(int, r)) for r in pdf.sort_values("envelope_id")[cols].itertuples(index=False)]
    return pd.DataFrame([(str(pdf["part"].iloc[0]), "PSMspace", b"\xff" * 32 + records.pack_envelopes(rows))], columns=_STREAMS.names)


@query("""WITH e AS (SELECT DISTINCT envelope_id, drawing_id, graphic_ref, box_left, box_bottom, box_right, box_top, opaque_tag FROM psm_envelopes
    WHERE graphic_ref > 0 AND drawing_id IS NOT NULL AND box_left >= 0 AND box_bottom >= 0 AND box_left < box_right AND box_bottom < box_top AND box_right <= 16800 AND box_top <= 16800 AND opaque_tag IS NOT NULL),
  b AS (SELECT *, count(*) OVER (PARTITION BY drawing_id) AS n FROM e)
  SELECT drawing_id, graphic_ref, box_left, box_bottom, box_right, box_top, opaque_tag, count(*) AS n FROM b WHERE n >= 3 GROUP BY ALL""")
def s25_envelope_scan(spark, d):
    proper = "graphic_ref > 0 and drawing_id is not null and box_left >= 0 and box_bottom >= 0 and box_left < box_right and box_bottom < box_top and box_right <= 16800 and box_top <= 16800 and opaque_tag is not null"
    rows = table(spark, d, "psm_envelopes").where(proper).dropDuplicates(["envelope_id"]).withColumn("part", F.col("drawing_id").cast("string"))
    streams = rows.select("part", "envelope_id", "graphic_ref", "box_left", "box_bottom", "box_right", "box_top", "opaque_tag").groupBy("part").applyInPandas(_pack_envelopes, _STREAMS)
    found = records.scan(streams, "envelope").withColumn("drawing_id", F.col("path").cast("long"))
    return found.groupBy("drawing_id", "graphic_ref", "box_left", "box_bottom", "box_right", "box_top", "opaque_tag").agg(F.count("*").alias("n"))


@query("""SELECT point_id, regexp_replace(coalesce(uci, ''), '[\\x00-\\x1f]', '', 'g') AS text, round(center_x, 6) AS x, round(center_y, 6) AS y FROM (SELECT DISTINCT point_id, uci, center_x, center_y FROM point_targets)
  WHERE isfinite(center_x) AND isfinite(center_y) AND trim(coalesce(uci, ''), ' ' || chr(9)) <> ''""".replace("\\\\", "\\"))
def s22_text_scan(spark, d):
    rows = table(spark, d, "point_targets").select("point_id", "uci", "center_x", "center_y").distinct()
    rows = rows.where("abs(center_x) < double('infinity') and abs(center_y) < double('infinity')").where(F.btrim("uci", F.lit(" \t")) != "")

    def pack(batches):
        for pdf in batches:
            out = []
            for p, uci, x, y in pdf.itertuples(index=False):
                text = "".join(c for c in uci if c >= " ")
                out.append((str(p), "Sheet1", b"\x00" * 6 + records.pack_text((1, 2, 3, 4), text, (x, y, 1.0, 0.0))))
            yield pd.DataFrame(out, columns=_STREAMS.names)

    found = records.scan(rows.mapInPandas(pack, _STREAMS), "text")
    return found.select(F.col("path").cast("long").alias("point_id"), "text", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


# Predicates and scalar functions.


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '^[0-9 .-]+$') THEN 'number' WHEN regexp_matches(text, '(WELD|PIPE|ELBOW)\\n') THEN 'extract' WHEN regexp_matches(text, '\\[[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 'log'
  WHEN regexp_matches(text, '\\|.*\\|') THEN 'table' WHEN trim(text) = '' THEN 'blank' ELSE 'prose' END AS category FROM documents WHERE text IS NOT NULL""".replace("\\\\", "\\"))
def pred5_text_category(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", tx.text_category(F.col("text")).alias("category"))


@query("""SELECT candidate_id, CASE WHEN evidence_kind LIKE 'independent%' THEN 'direct' WHEN evidence_kind = 'matched_frame_incidence' THEN 'derived' WHEN score > 10 AND NOT isnan(score) THEN 'candidate' ELSE 'unresolved' END AS basis
  FROM (SELECT DISTINCT candidate_id, evidence_kind, score FROM pipe_candidates)""")
def pred4_evidence_basis(spark, d):
    c = table(spark, d, "pipe_candidates").select("candidate_id", "evidence_kind", "score").distinct()
    return c.select("candidate_id", tx.evidence_basis(F.col("evidence_kind"), F.col("score")).alias("basis"))


@query("""WITH k AS (SELECT DISTINCT edge_id, CASE WHEN kind = 'in_page_exact_endpoint' THEN 'endpoint' WHEN kind LIKE 'cross_page%' THEN 'crossing' END AS category FROM graph_edges)
  SELECT a.category, count(*) AS n_pairs FROM k a JOIN k b ON a.category = b.category AND b.edge_id = a.edge_id + 1 GROUP BY 1""")
def pred6_frame_category(spark, d):
    k = table(spark, d, "graph_edges").select("edge_id", tx.frame_category(F.col("kind")).alias("category")).distinct()
    nxt = k.select((F.col("edge_id") - 1).alias("edge_id"), F.col("category").alias("next"))
    return k.join(nxt, "edge_id").where(F.col("category") == F.col("next")).groupBy("category").agg(F.count("*").alias("n_pairs"))


@query("""SELECT DISTINCT envelope_id, box_right - box_left AS width, box_top - box_bottom AS height FROM psm_envelopes WHERE box_top - box_bottom > 320 OR box_right - box_left > (box_top - box_bottom) * 2 * 2.2::DOUBLE""")
def pred7_containers(spark, d):
    w, h = F.col("box_right") - F.col("box_left"), F.col("box_top") - F.col("box_bottom")
    e = table(spark, d, "psm_envelopes").select("envelope_id", w.alias("width"), h.alias("height")).distinct()
    return e.where(tx.is_container(F.col("width"), F.col("height")))


_FM = "(SELECT DISTINCT envelope_id, box_left::DOUBLE AS l, box_bottom::DOUBLE AS b, box_right::DOUBLE AS r, box_top::DOUBLE AS t, opaque_tag FROM psm_envelopes)"


@query(f"SELECT envelope_id, greatest(0, least(r, 9000) - greatest(l, 4000)) * greatest(0, least(t, 9000) - greatest(b, 4000)) AS area, l <= 9000 AND 4000 <= r AND b <= 9000 AND 4000 <= t AS meets, l >= 3950 AND b >= 3950 AND r <= 9050 AND t <= 9050 AS inside FROM {_FM}")
def pred8_box_predicates(spark, d):
    e = table(spark, d, "psm_envelopes").select("envelope_id", *[F.col(f"box_{s}").cast("double").alias(s) for s in ("left", "bottom", "right", "top")]).distinct()
    own, fix = [F.col(s) for s in ("left", "bottom", "right", "top")], [F.lit(x) for x in (4000.0, 4000.0, 9000.0, 9000.0)]
    return e.select("envelope_id", geo.overlap_area(own, fix).alias("area"), geo.boxes_overlap(own, fix).alias("meets"), geo.box_contains(fix, own, 50).alias("inside"))


@query("SELECT weld_id, len(description) > 0 AND len(description) <= 120 AS valid, regexp_full_match(coalesce(uci, ''), '\\{[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\\}') AS guid FROM (SELECT DISTINCT weld_id, description, uci FROM weld_blocks) WHERE description IS NOT NULL".replace("\\\\", "\\"))
def pred9_text_and_guid_validity(spark, d):
    w = table(spark, d, "weld_blocks").where("description is not null").select("weld_id", "description", "uci").distinct()
    return w.select("weld_id", tx.printable(F.col("description")).alias("valid"), tx.is_guid(F.col("uci")).alias("guid"))


@query("SELECT DISTINCT attr_id, tag FROM dynamic_attributes a WHERE NOT EXISTS (SELECT 1 FROM weld_blocks w WHERE upper(w.description) LIKE '%' || a.tag || '%') OR tag IS NULL")
def pred11_suppressed_titles(spark, d):
    labels = table(spark, d, "weld_blocks").where("description is not null").select(F.upper("description").alias("label")).distinct()
    tags = table(spark, d, "dynamic_attributes").select("tag").where("tag is not null").distinct()
    covered = linking.within_texts(tags, labels, "tag", "label")
    return table(spark, d, "dynamic_attributes").select("attr_id", "tag").distinct().join(covered, "tag", "left_anti").select("attr_id", "tag")


@query("SELECT regexp_replace(dxf_name, '[0-9]+', '#', 'g') AS family, count(*) AS n FROM dxf_pages WHERE dxf_name IS NOT NULL GROUP BY 1")
def fs1_digit_family(spark, d):
    return table(spark, d, "dxf_pages").where("dxf_name is not null").groupBy(tx.digit_family(F.col("dxf_name")).alias("family")).agg(F.count("*").alias("n"))


@query("""SELECT doc_id, coalesce(nullif(left(trim(regexp_replace(text, '[^A-Za-z0-9._-]+', '-', 'g'), '.-'), 80), ''), 'project') AS slug, upper(trim(text)) LIKE 'LINE%' OR upper(trim(text)) LIKE 'SHEET%' AS labelled,
  replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped FROM documents WHERE text IS NOT NULL""")
def fs4_slug_and_escape(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", tx.slug(t).alias("slug"), tx.starts_with_any(t, ["LINE", "SHEET"]).alias("labelled"), tx.html_escape(t).alias("escaped"))


@query("""SELECT candidate_id, try_cast(substr(idf_pipe, 2) AS INT) AS number, 'I' || lpad((try_cast(substr(idf_pipe, 2) AS INT) + 990)::VARCHAR, greatest(3, len((try_cast(substr(idf_pipe, 2) AS INT) + 990)::VARCHAR))::INT, '0') AS shifted
  FROM (SELECT DISTINCT candidate_id, idf_pipe FROM pipe_candidates) WHERE idf_pipe IS NOT NULL""")
def fs8_labels(spark, d):
    n = tx.serial_number(F.col("idf_pipe"))
    return table(spark, d, "pipe_candidates").select("candidate_id", "idf_pipe").distinct().where("idf_pipe is not null").select("candidate_id", n.alias("number"), tx.serial_label("I", n + 990).alias("shifted"))


@query("SELECT line_key, string_agg(DISTINCT evidence_kind, ',' ORDER BY evidence_kind) AS kinds FROM pipe_candidates WHERE evidence_kind IS NOT NULL GROUP BY 1")
def fs10_joined_set(spark, d):
    return table(spark, d, "pipe_candidates").where("evidence_kind is not null").groupBy("line_key").agg(F.array_join(F.array_sort(F.collect_set("evidence_kind")), ",").alias("kinds"))


_G = f"WITH {IDF_SQL}, q AS (SELECT * FROM g WHERE abs(ax) + abs(ay) + abs(az) + abs(bx) + abs(\"by\") + abs(bz) < 1e12)"


def _finite_idf(spark, d):
    return _idf(spark, d).where("abs(ax) + abs(ay) + abs(az) + abs(bx) + abs(by) + abs(bz) < 1e12")


@query(_G + """, s AS (SELECT row, (bx-ax)**2 + ("by"-ay)**2 + (bz-az)**2 AS sq, -ax*(bx-ax) - ay*("by"-ay) - az*(bz-az) AS dot, * FROM q), t AS (SELECT *, CASE WHEN sq = 0 THEN 0 ELSE greatest(0, least(1, dot / sq)) END AS t FROM s)
  SELECT row, round(sqrt((ax + t*(bx-ax))**2 + (ay + t*("by"-ay))**2 + (az + t*(bz-az))**2), 4) AS from_origin, round(abs(ax-bx) + abs(ay-"by"), 6) AS manhattan FROM t""")
def fm1_distances(spark, d):
    p, a, b = [F.lit(0.0)] * 3, [F.col(x) for x in ("ax", "ay", "az")], [F.col(x) for x in ("bx", "by", "bz")]
    return _finite_idf(spark, d).select("row", F.round(geo.point_segment_3d(p, a, b), 4).alias("from_origin"), F.round(geo.manhattan(a[0], a[1], b[0], b[1]), 6).alias("manhattan"))


@query(_G + """, v AS (SELECT row, bx-ax AS x, "by"-ay AS y FROM q WHERE bx <> ax OR "by" <> ay), w AS (SELECT row, degrees(atan2(y, x)) AS deg FROM v)
  SELECT ['E','NE','N','NW','W','SW','S','SE'][(floor((((deg + 360) % 360) + 22.5) % 360 / 45))::INT + 1] AS octant, count(*) AS n FROM w GROUP BY 1""")
def fm8_octants(spark, d):
    v = _finite_idf(spark, d).where("bx != ax or by != ay")
    return v.groupBy(geo.octant(geo.bearing(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))).alias("octant")).agg(F.count("*").alias("n"))


@query(_G + " SELECT row, round((ax-ay)*0.5, 4) AS hx, round((ax+ay)*0.288675 + az*0.57735, 4) AS hy, round((ax-ay)*(sqrt(3)/2), 4) AS fx, round((ax+ay)/2 + az, 4) AS fy, round((ax-ay)*0.866, 6) AS sx, round(az - (ax+ay)/2, 4) AS sy FROM q")
def fm6_projections(spark, d):
    x, y, z = F.col("ax"), F.col("ay"), F.col("az")
    out = [F.round(c, 6 if n == "sx" else 4).alias(n) for p, n2 in ((geo.project_half, "h"), (geo.project_full, "f"), (geo.project_short, "s")) for c, n in zip(p(x, y, z), (n2 + "x", n2 + "y"))]
    return _finite_idf(spark, d).select("row", *out)


@query("""WITH v AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c, embedding[4]::DOUBLE AS d, embedding[5]::DOUBLE AS e, embedding[6]::DOUBLE AS f, embedding[7]::DOUBLE AS g, embedding[8]::DOUBLE AS h FROM embeddings)
  SELECT vec_id, round((e*d - g*b) / (a*d - b*c), 4) AS xx, ((c-a)*(f-b) - (d-b)*(e-a)) * ((c-a)*(h-b) - (d-b)*(g-a)) < 0 AND ((g-e)*(b-f) - (h-f)*(a-e)) * ((g-e)*(d-f) - (h-f)*(c-e)) < 0 AS crosses,
    round(least((sqrt((a-e)**2+(b-f)**2) + sqrt((c-g)**2+(d-h)**2)) / 2, (sqrt((a-g)**2+(b-h)**2) + sqrt((c-e)**2+(d-f)**2)) / 2), 6) AS error FROM v WHERE abs(a*d - b*c) >= 1e-2""")
def fm7_fits_and_crossings(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("abcdefgh")])
    c = {x: F.col(x) for x in "abcdefgh"}
    fit = geo.affine_axes([c["a"], c["b"], c["c"], c["d"]], [c["e"], c["f"], c["g"], c["h"]])
    s, t = [c[x] for x in "abcd"], [c[x] for x in "efgh"]
    return v.where("abs(a*d - b*c) >= 1e-2").select("vec_id", F.round(fit["xx"], 4).alias("xx"), geo.segments_cross(s, t).alias("crosses"), F.round(geo.segment_error(s, t), 6).alias("error"))


@query("SELECT sha256(coalesce(text, '')) AS digest, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def fx2_digests(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")).agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT event_type, sum((props->>'k')::INT)::BIGINT AS total, count(props->>'k') AS n FROM events GROUP BY 1")
def fx7_json_access(spark, d):
    e = table(spark, d, "events").withColumn("p", F.from_json("props", "k int"))
    return e.groupBy("event_type").agg(F.sum("p.k").alias("total"), F.count("p.k").alias("n"))


# Graphs.

_E = """e AS (SELECT file, row, code, ax::DECIMAL(18,3) || ',' || ay::DECIMAL(18,3) || ',' || az::DECIMAL(18,3) AS point FROM q UNION ALL SELECT file, row, code, bx::DECIMAL(18,3) || ',' || "by"::DECIMAL(18,3) || ',' || bz::DECIMAL(18,3) FROM q)"""


def _ends(spark, d):
    return graph.ends(_finite_idf(spark, d), ["file"], "row")


@query(_G + f""", {_E}, l AS (SELECT DISTINCT a.file, a.row AS x, b.row AS y FROM e a JOIN e b ON a.file = b.file AND a.point = b.point WHERE a.row <> b.row), r AS (SELECT 1)
  SELECT file, node, min(g) AS component FROM (WITH RECURSIVE reach AS (SELECT file, x AS node, x AS g FROM l UNION SELECT l.file, l.y, reach.g FROM reach JOIN l ON l.file = reach.file AND l.x = reach.node WHERE reach.g < l.y) SELECT * FROM reach) GROUP BY 1, 2""")
def g1_components(spark, d):
    e = _ends(spark, d)
    hub = e.groupBy("file", "point").agg(F.min("row").alias("hub"))
    links = e.join(hub, ["file", "point"]).where("row != hub").select("file", "row", "hub")
    return graph.components(links, ["file"], "row", "hub")


_CONNECTED = _G + f""", {_E}, n AS (SELECT * FROM e WHERE code <> 100), l AS (SELECT DISTINCT a.file, a.row AS x, b.row AS y FROM n a JOIN n b ON a.file = b.file AND a.point = b.point),
  m AS (SELECT file, node AS row, min(g) AS connector FROM (WITH RECURSIVE reach AS (SELECT file, x AS node, x AS g FROM l UNION SELECT l.file, l.y, reach.g FROM reach JOIN l ON l.file = reach.file AND l.x = reach.node WHERE reach.g < l.y) SELECT * FROM reach) GROUP BY 1, 2),
  p AS (SELECT m.file, connector, count(DISTINCT e.row) AS n_pipes FROM m JOIN n ON n.file = m.file AND n.row = m.row JOIN e ON e.file = n.file AND e.point = n.point AND e.code = 100 GROUP BY 1, 2),
  k AS (SELECT m.file, connector, string_agg(code::VARCHAR, ',' ORDER BY code) AS codes, count(*) AS n_records FROM m JOIN (SELECT DISTINCT file, row, code FROM n) USING (file, row) GROUP BY 1, 2),
  c AS (SELECT k.*, coalesce(n_pipes, 0) AS n_pipes FROM k LEFT JOIN p USING (file, connector))"""


@query(_CONNECTED + " SELECT * FROM c")
def g2_connectors(spark, d):
    return graph.connectors(_ends(spark, d), ["file"])


@query(_CONNECTED + " SELECT kind, count(*) AS n FROM (SELECT CASE WHEN n_pipes = 2 AND codes = '35,36' THEN 'elbow' WHEN n_pipes = 2 AND n_records = 1 THEN 'direct' END AS kind FROM c) GROUP BY 1")
def g3_elbow_links(spark, d):
    return graph.elbow_links(graph.connectors(_ends(spark, d), ["file"])).groupBy("kind").agg(F.count("*").alias("n"))


@query("""SELECT DISTINCT drawing_id, box_left::DOUBLE AS box_left, box_bottom::DOUBLE AS box_bottom, box_right::DOUBLE AS box_right, box_top::DOUBLE AS box_top FROM psm_envelopes
  WHERE graphic_ref IS NOT NULL AND box_right - box_left BETWEEN 40 AND 1500 AND box_top - box_bottom BETWEEN 40 AND 500""")
def fm10_rectangles(spark, d):
    b = table(spark, d, "psm_envelopes").select("drawing_id", "graphic_ref", *[F.col(f"box_{s}").cast("double").alias(s[0]) for s in ("left", "bottom", "right", "top")]).distinct()
    side = lambda *c: F.struct(*[F.col(x).alias(n) for x, n in zip(c, ("x1", "y1", "x2", "y2"))])
    # A box without a reference lacks its right side and must not be found.
    sides = F.array_compact(F.array(side("l", "b", "r", "b"), side("r", "t", "l", "t"), side("l", "b", "l", "t"), F.when(F.col("graphic_ref").isNotNull(), side("r", "t", "r", "b"))))
    return spatial.rectangles(b.select("drawing_id", F.explode(sides).alias("s")).select("drawing_id", "s.*"), ["drawing_id"])


@query(_G + f", {_E} SELECT file, point, count(DISTINCT row)::INT AS degree FROM e WHERE code <> 100 GROUP BY 1, 2 HAVING count(DISTINCT row) >= 2")
def g5_hyperedges(spark, d):
    return graph.hyperedges(_ends(spark, d).where("code != 100"), ["file"], "point", "row").select("file", "point", "degree")


@query(_G + f", {_E} SELECT file, point, count(DISTINCT row) FILTER (code <> 41) AS n_others, CASE WHEN count(DISTINCT row) FILTER (code <> 41) >= 3 THEN 'junction' ELSE 'outlet_leg' END AS class FROM e GROUP BY 1, 2 HAVING max((code = 41)::INT) = 1")
def g4_branch_classes(spark, d):
    return graph.branch_classes(_ends(spark, d), ["file"], "point", "row")


@query(_G + """, p AS (SELECT file, row, bx-ax AS x, "by"-ay AS y, lead(bx-ax) OVER w AS u, lead("by"-ay) OVER w AS v FROM q WHERE code = 100 WINDOW w AS (PARTITION BY file ORDER BY line_no, row)),
  c AS (SELECT *, (x*x + y*y) * (u*u + v*v) AS n FROM p) SELECT file, count(*) FILTER (n > 0 AND abs((x*u + y*v) / sqrt(n)) < 0.995) AS n_turns, count(*) FILTER (n > 0 AND abs((x*u + y*v) / sqrt(n)) >= 0.995) AS n_straight FROM c GROUP BY 1""")
def g6_turn_frames(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("file").orderBy("line_no", "row")
    p = _finite_idf(spark, d).where("code = 100").select("file", "line_no", "row", (F.col("bx") - F.col("ax")).alias("x"), (F.col("by") - F.col("ay")).alias("y"))
    p = p.withColumn("u", F.lead("x").over(w)).withColumn("v", F.lead("y").over(w))
    k = graph.turns(p, ["x", "y"], ["u", "v"])
    return p.withColumn("k", k).groupBy("file").agg(F.count_if(F.col("k") == "turn").alias("n_turns"), F.count_if(F.col("k") == "straight").alias("n_straight"))


@query()
def g7_chain_order(spark, d):
    p = _finite_idf(spark, d).where("code = 100").select("file", "row", F.col("ax").alias("x1"), F.col("ay").alias("y1"), F.col("bx").alias("x2"), F.col("by").alias("y2"))
    return graph.chain_order(p, "file", "row", 400.0)


_PAGE_EDGES = "l AS (SELECT DISTINCT line_key, trim(from_node, ' ') AS x, trim(to_node, ' ') AS y FROM graph_edges WHERE line_key IS NOT NULL AND kind = 'in_page_exact_endpoint' AND trim(from_node, ' ') <> '' AND trim(to_node, ' ') <> '' AND trim(from_node, ' ') <> trim(to_node, ' ')), b AS (SELECT * FROM l UNION SELECT line_key, y, x FROM l)"


def _page_edges(spark, d, kinds="kind = 'in_page_exact_endpoint'"):
    e = table(spark, d, "graph_edges").where(f"line_key is not null and {kinds}").select("line_key", F.trim("from_node").alias("x"), F.trim("to_node").alias("y"))
    return e.where("x != '' and y != ''")


@query(f"""WITH {_PAGE_EDGES} SELECT p.line_key, p.x AS a, p.y AS b, q.y AS c, r.y AS d FROM b p JOIN b q ON q.line_key = p.line_key AND q.x = p.y JOIN b r ON r.line_key = p.line_key AND r.x = q.y
  WHERE q.y <> p.x AND r.y NOT IN (p.x, p.y) AND p.x || chr(1) || p.y || chr(1) || q.y || chr(1) || r.y <= r.y || chr(1) || q.y || chr(1) || p.y || chr(1) || p.x""")
def g10_simple_paths(spark, d):
    p = graph.simple_paths(_page_edges(spark, d), ["line_key"], "x", "y", 3)
    return p.select("line_key", *[F.get("path", F.lit(i)).alias(c) for i, c in enumerate("abcd")])


@query(f"""WITH {_PAGE_EDGES.replace("AND kind = 'in_page_exact_endpoint'", "")}, r AS (
    WITH RECURSIVE walk AS (
      SELECT b.line_key, b.x AS source, b.y AS node, 1 AS hops FROM b WHERE contains(b.x, ':C')
      UNION SELECT w.line_key, w.source, b.y, w.hops + 1 FROM walk w JOIN b ON b.line_key = w.line_key AND b.x = w.node WHERE NOT contains(w.node, ':C') AND w.hops < 100
    ) SELECT * FROM walk)
  SELECT line_key, source, node AS target, min(hops)::INT AS hops FROM r WHERE contains(node, ':C') AND node <> source GROUP BY 1, 2, 3""")
def g8_landmark_reach(spark, d):
    e = _page_edges(spark, d, "true")
    marks = e.select("line_key", F.col("x").alias("node")).union(e.select("line_key", "y")).where("contains(node, ':C')")
    return graph.landmark_reach(e, marks, ["line_key"], "x", "y")


_LINKS = "k AS (SELECT DISTINCT line_key, split_part(trim(from_node, ' '), ':', 1) AS a, split_part(trim(to_node, ' '), ':', 1) AS b FROM graph_edges WHERE kind LIKE 'cross_page%' AND line_key IS NOT NULL AND trim(from_node, ' ') <> '' AND trim(to_node, ' ') <> '')"


@query(f"""WITH {_LINKS}, l AS (SELECT * FROM k WHERE a < b), p AS (SELECT DISTINCT line_key, a AS p FROM k UNION SELECT line_key, b FROM k), d AS (SELECT line_key, p, (SELECT count(*) FROM l WHERE l.line_key = p.line_key AND l.a = p.p) AS o, (SELECT count(*) FROM l WHERE l.line_key = p.line_key AND l.b = p.p) AS i FROM p),
  s AS (SELECT line_key, count(*) AS n, count(*) FILTER (i = 0) AS roots, max(o) AS mo, max(i) AS mi, sum(o) AS links FROM d GROUP BY 1)
  SELECT line_key, n AS n_pages, CASE WHEN mo > 1 THEN 'branching' WHEN mi > 1 THEN 'merging' WHEN roots = 0 THEN 'no_root' WHEN roots > 1 THEN 'several_roots' WHEN links = n - 1 THEN 'path' ELSE 'cycle' END AS status FROM s""")
def g11_page_path(spark, d):
    page = lambda c: F.split(F.trim(c), ":")[0]
    k = table(spark, d, "graph_edges").where("kind like 'cross_page%' and line_key is not null and trim(from_node) != '' and trim(to_node) != ''").select("line_key", page("from_node").alias("a"), page("to_node").alias("b")).distinct()
    pages = k.select("line_key", F.col("a").alias("page")).union(k.select("line_key", "b"))
    return graph.page_path(k.where("a < b"), pages, ["line_key"], "a", "b", "page")


@query()
def g12_rule_propagation(spark, d):
    """Components and pipes of the graph against a renamed copy that lacks some edges, from a fifth of the pipes."""
    ends = table(spark, d, "graph_edges").where("line_key is not null").select("line_key", "edge_id", "page", F.trim("from_node").alias("x"), F.trim("to_node").alias("y"))
    both = ends.unionByName(ends.select("line_key", "edge_id", "page", F.col("y").alias("x"), F.col("x").alias("y"))).where("contains(x, ':C') and contains(y, ':P')")
    arms = both.select("line_key", "edge_id", F.col("x").alias("frame"), F.regexp_replace("y", ":E[0-9]+$", "").alias("pipe"), F.concat(F.lit("c"), (F.col("page") % 3).cast("string")).alias("kind"), F.lit(None).cast("double").alias("dx"), F.lit(None).cast("double").alias("dy"))
    copy = arms.where("edge_id % 17 != 0").withColumns({c: F.concat(F.lit("R"), c) for c in ("frame", "pipe")})
    seeds = arms.where("pmod(xxhash64(pipe), 5) = 0").select("line_key", F.col("pipe").alias("a"), F.concat(F.lit("R"), "pipe").alias("b")).distinct()
    return propagation.propagate(arms, copy, ["line_key"], pipes=seeds)


_BEST = "c AS (SELECT DISTINCT line_key, idf_pipe, dxf_pipe FROM pipe_candidates WHERE idf_pipe IS NOT NULL AND dxf_pipe IS NOT NULL AND line_key IS NOT NULL AND score > 15 AND NOT isnan(score))"
_ROUND = "SELECT line_key, idf_pipe, dxf_pipe FROM {c} WHERE (line_key, idf_pipe) IN (SELECT (line_key, idf_pipe) FROM {c} GROUP BY line_key, idf_pipe HAVING count(*) = 1) AND (line_key, dxf_pipe) IN (SELECT (line_key, dxf_pipe) FROM {c} GROUP BY line_key, dxf_pipe HAVING count(*) = 1)"
_REST = "SELECT * FROM {c} WHERE (line_key, idf_pipe) NOT IN (SELECT (line_key, idf_pipe) FROM {u}) AND (line_key, dxf_pipe) NOT IN (SELECT (line_key, dxf_pipe) FROM {u})"
_ROUNDS = ", ".join(f"u{k} AS ({_ROUND.format(c='c' if k == 1 else f'c{k - 1}')}), c{k} AS ({_REST.format(c='c' if k == 1 else f'c{k - 1}', u=f'u{k}')})" for k in range(1, 7))


@query(f"WITH {_BEST}, {_ROUNDS} " + " UNION ALL ".join(f"SELECT line_key, idf_pipe, dxf_pipe, {k} AS round FROM u{k}" for k in range(1, 7)))
def g12_propagated_pairs(spark, d):
    c = table(spark, d, "pipe_candidates").where("line_key is not null and score > 15 and not isnan(score)")
    return graph.propagate_pairs(c, ["line_key"], "idf_pipe", "dxf_pipe")


@query("""WITH g AS (SELECT line_key, idf_pipe, dxf_pipe, min(40 - score) AS gap FROM pipe_candidates WHERE score IS NOT NULL AND NOT isnan(score) AND idf_pipe IS NOT NULL AND dxf_pipe IS NOT NULL GROUP BY 1, 2, 3),
  r AS (SELECT *, row_number() OVER w AS r, lead(gap) OVER w AS nxt FROM g WINDOW w AS (PARTITION BY line_key, idf_pipe ORDER BY gap, dxf_pipe)) SELECT line_key, idf_pipe, dxf_pipe, round(gap, 6) AS gap FROM r WHERE r = 1 AND (gap <= 5 OR (gap <= 20 AND (nxt IS NULL OR nxt - gap >= 2)))""")
def g13_seeds(spark, d):
    c = table(spark, d, "pipe_candidates").where("score is not null and not isnan(score) and idf_pipe is not null and dxf_pipe is not null").groupBy("line_key", "idf_pipe", "dxf_pipe").agg(F.min(40 - F.col("score")).alias("gap"))
    return graph.seeds(c, ["line_key"], "idf_pipe", "dxf_pipe", "gap", 20.0, 2.0, 5.0).withColumn("gap", F.round("gap", 6))


@query(f"WITH {_BEST} {_ROUND.format(c='c')}")
def g14_unique_continuations(spark, d):
    c = table(spark, d, "pipe_candidates").where("line_key is not null and score > 15 and not isnan(score)")
    return graph.unique_pairs(c, ["line_key"], "idf_pipe", "dxf_pipe")


@query()
def g9_leader_trace(spark, d):
    g = _finite_idf(spark, d)
    strokes = g.where("code in (35, 36)").select("file", F.col("ax").alias("x1"), F.col("ay").alias("y1"), F.col("bx").alias("x2"), F.col("by").alias("y2"))
    anchors = g.where("code = 120").select("file", "row", F.col("ax").alias("px"), F.col("ay").alias("py"))
    return graph.leader_trace(strokes, anchors, "file", "row", 250.0, 5.0, 3000.0)


# Searches.


@query()
def x1_range_cover(spark, d):
    c = table(spark, d, "pipe_candidates").where("line_key is not null and page is not null and score is not null and not isnan(score) and idf_pipe is not null")
    n = c.withColumn("n", tx.serial_number(F.col("idf_pipe"))).groupBy("line_key", "page").agg(F.min("n").alias("first"), F.max("n").alias("last"), F.round(F.sum("score"), 3).alias("score"))
    wide = n.unionByName(n.select("line_key", "page", "first", F.greatest("first", F.col("last") - 1).alias("last"), (F.col("score") - 1).alias("score")))
    universe = n.groupBy("line_key").agg(F.max("last").alias("n"))
    return search.cover(wide, universe, "line_key", beam=300)


@query()
def x2_direction_assignment(spark, d):
    g = _finite_idf(spark, d).where("bx != ax or by != ay")
    legs = lambda code: g.where(F.col("code") == code).select("file", F.col("row").alias("id"), (F.col("bx") - F.col("ax")).alias("x"), (F.col("by") - F.col("ay")).alias("y"))
    return search.assign_directions(legs(35), legs(36), "file")


@query()
def x3_common_subgraph(spark, d):
    """Components of a page, linked where a pipe joins two of them, against a renamed copy that lacks some components."""
    e = table(spark, d, "graph_edges").where("line_key is not null and page is not null").select(F.concat_ws("-", "line_key", F.col("page").cast("string")).alias("sheet"), F.trim("from_node").alias("x"), F.trim("to_node").alias("y"))
    touch = e.union(e.select("sheet", "y", "x")).where("contains(x, ':C') and contains(y, ':P')").select("sheet", F.col("x").alias("c"), F.regexp_replace("y", ":E[0-9]+$", "").alias("pipe")).distinct()
    number = F.regexp_extract("c", ":C([0-9]+)", 1).try_cast("int")
    nodes = touch.select("sheet", "c").distinct().select("sheet", F.col("c").alias("id"), F.concat(F.lit("k"), (number % 3).cast("string")).alias("kind"), (number % 7).cast("double").alias("x"), (number % 5).cast("double").alias("y"))
    # A pipe touches few components; each is linked to the first one of its pipe.
    first = touch.groupBy("sheet", "pipe").agg(F.min("c").alias("a"))
    links = touch.join(first, ["sheet", "pipe"]).where("a != c").select("sheet", "a", F.col("c").alias("b")).distinct()
    copy = nodes.where("pmod(xxhash64(id), 6) > 0").select("sheet", F.concat(F.lit("R"), "id").alias("id"), "kind", (-F.col("y")).alias("x"), F.col("x").alias("y"))
    copied = links.select("sheet", F.concat(F.lit("R"), "a").alias("a"), F.concat(F.lit("R"), "b").alias("b"))
    return search.skeleton_matches(nodes, copy, links, copied, "sheet")


@query()
def x3_aligned_landmarks(spark, d):
    g = _finite_idf(spark, d).where("code in (35, 36, 41, 42, 55, 120) and bore < 1e6").select("file", F.col("line_no").alias("place"), F.col("row").alias("id"), F.col("code").cast("string").alias("kind"), F.round("bore").try_cast("int").alias("links"))
    odd, even = g.where("place % 2 = 1"), g.where("place % 2 = 0")
    return search.aligned_landmarks(odd, even, "file")


@query()
def x4_poses(spark, d):
    g = _finite_idf(spark, d).select("file", F.col("row").alias("id"), "code", F.col("ax").alias("x1"), F.col("ay").alias("y1"), F.col("bx").alias("x2"), F.col("by").alias("y2"))
    source = g.where("code = 100")
    turned = source.select("file", "id", (-F.col("y1") + 10).alias("x1"), F.col("x1").alias("y1"), (-F.col("y2") + 10).alias("x2"), F.col("x2").alias("y2"))
    return search.poses(source.drop("code"), turned, "file", 0.5)


@query(_G + """, a AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY line_no, row) AS slot, count(*) OVER (PARTITION BY file) AS n, length / sum(length) OVER (PARTITION BY file) AS a FROM q WHERE code = 35),
  b AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY line_no, row) AS slot, count(*) OVER (PARTITION BY file) AS m, length / sum(length) OVER (PARTITION BY file) AS b FROM q WHERE code = 36),
  f AS (SELECT file, sum(greatest(0, 3 - 12 * abs(a - b))) AS forward, any_value(n) AS n FROM a JOIN b USING (file, slot) WHERE n = m GROUP BY 1), r AS (SELECT a.file, sum(greatest(0, 3 - 12 * abs(a - b))) AS reverse FROM a JOIN b ON b.file = a.file AND b.m - b.slot + 1 = a.slot WHERE n = m GROUP BY 1)
  SELECT file, n, round(forward, 3) AS forward, round(reverse, 3) AS reverse, CASE WHEN forward >= reverse THEN 'forward' ELSE 'reverse' END AS direction, CASE WHEN abs(forward - reverse) >= 3 THEN 'high' WHEN abs(forward - reverse) >= 1 THEN 'medium' ELSE 'unresolved' END AS confidence FROM f JOIN r USING (file)""")
def x5_alignment(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("file").orderBy("line_no", "row")
    g = lambda code: _finite_idf(spark, d).where(F.col("code") == code).select("file", F.row_number().over(w).alias("place"), F.col("length").alias("size"))
    return search.align(g(35), g(36), "file")


@query("""WITH c AS (SELECT line_key, idf_pipe, dxf_pipe, count(*) FILTER (evidence_kind = 'matched_frame_incidence') AS inc, max(CASE WHEN evidence_kind = 'local_arm_direction' AND NOT isnan(score) THEN least(1.0, score / 10) END) AS cosine, coalesce(bool_or(evidence_kind LIKE 'independent%'), false) AS anchored
    FROM (SELECT DISTINCT * FROM pipe_candidates) WHERE idf_pipe IS NOT NULL AND dxf_pipe IS NOT NULL GROUP BY 1, 2, 3),
  s AS (SELECT *, 8 * inc + 2 * greatest(0, coalesce(cosine, 0)) + CASE WHEN anchored THEN 20 ELSE 0 END AS score FROM c), r AS (SELECT *, row_number() OVER w AS rank, score - lead(score) OVER w AS margin FROM s WINDOW w AS (PARTITION BY line_key, idf_pipe ORDER BY score DESC, dxf_pipe))
  SELECT line_key, idf_pipe, dxf_pipe, round(score, 6) AS score, CASE WHEN margin IS NULL OR margin >= 4 THEN 'leading' ELSE 'ambiguous' END AS status FROM r WHERE rank = 1""")
def x6_correspondence(spark, d):
    k = F.col("evidence_kind")
    c = table(spark, d, "pipe_candidates").distinct().where("idf_pipe is not null and dxf_pipe is not null").groupBy("line_key", "idf_pipe", "dxf_pipe").agg(
        F.count_if(k == "matched_frame_incidence").alias("inc"), F.max(F.when((k == "local_arm_direction") & ~F.isnan("score"), F.least(F.lit(1.0), F.col("score") / 10))).alias("cosine"),
        F.coalesce(F.bool_or(k.like("independent%")), F.lit(False)).alias("anchored"),
    )
    s = search.correspondence_scores(c, ["line_key"], "idf_pipe", "dxf_pipe", "inc", "cosine", "anchored")
    return s.where("rank = 1").select("line_key", "idf_pipe", "dxf_pipe", F.round("score", 6).alias("score"), "status")


@query()
def x8_callouts(spark, d):
    p = table(spark, d, "point_targets").dropDuplicates(["point_id"]).select("drawing_id", "point_id", (F.col("center_x") * 16800).alias("px"), (F.col("center_y") * 16800).alias("py"))
    return search.place_callouts(p, "drawing_id", "point_id", 600.0, 240.0, 300.0)


# Reports.


@query("""WITH r AS (SELECT DISTINCT drawing_id, graphic_ref FROM point_targets WHERE graphic_ref IS NOT NULL) SELECT CASE WHEN graphic_ref IN (SELECT parent_ref FROM composites) THEN 'composite' WHEN graphic_ref IN (SELECT graphic_ref FROM psm_envelopes WHERE graphic_ref IS NOT NULL) THEN 'envelope'
  WHEN graphic_ref IN (SELECT graphic_ref FROM dynamic_attributes) THEN 'attribute' END AS namespace, count(*) AS n FROM r GROUP BY 1""")
def y3_namespaces(spark, d):
    refs = table(spark, d, "point_targets").where("graphic_ref is not null").select("drawing_id", "graphic_ref").distinct()
    ranked = [("composite", table(spark, d, "composites").select("parent_ref")), ("envelope", table(spark, d, "psm_envelopes").select("graphic_ref")), ("attribute", table(spark, d, "dynamic_attributes").select("graphic_ref"))]
    return reports.namespaces(refs, "graphic_ref", ranked).groupBy("namespace").agg(F.count("*").alias("n"))


@query("SELECT kind, split_part(split_part(trim(from_node, ' '), ':', 2), '', 1)[1] AS a, split_part(trim(to_node, ' '), ':', 2)[1] AS b, count(*) AS n FROM graph_edges GROUP BY 1, 2, 3")
def y4_edge_patterns(spark, d):
    first = lambda c: F.substring(F.coalesce(F.get(F.split(F.trim(c), ":"), F.lit(1)), F.when(F.col(c).isNotNull(), F.lit(""))), 1, 1)
    e = table(spark, d, "graph_edges").select("kind", first("from_node").alias("a"), first("to_node").alias("b"))
    return reports.edge_patterns(e, ["kind", "a", "b"], F.col("kind").isNull())[0]


@query("""WITH RECURSIVE l AS (SELECT drawing_id, parent_ref AS x, min(c.child_ref) AS y FROM (SELECT drawing_id, parent_ref, unnest(children) AS c FROM composites) WHERE c.child_ref IS NOT NULL AND parent_ref IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT c.child_ref) = 1),
  w AS (SELECT drawing_id, x AS start, y AS place, 1 AS hops FROM l UNION ALL SELECT w.drawing_id, start, l.y, hops + 1 FROM w JOIN l ON l.drawing_id = w.drawing_id AND l.x = w.place WHERE hops < 500)
  SELECT drawing_id, start, CASE WHEN max(hops) < 500 THEN arg_max(place, hops) END AS terminal, CASE WHEN max(hops) < 500 THEN max(hops)::BIGINT END AS hops, max(hops) >= 500 AS looped FROM w GROUP BY 1, 2""")
def y5_successor_chains(spark, d):
    e = table(spark, d, "composites").where("drawing_id is not null").select("drawing_id", "parent_ref", F.explode("children").alias("c")).select("drawing_id", "parent_ref", "c.child_ref")
    return reports.successor_chains(e, ["drawing_id"], "parent_ref", "child_ref")


@query("SELECT root_ref & 4294959104 AS base, count(*) AS n, min(root_ref - (root_ref & 4294959104)) AS least_offset FROM composites WHERE root_ref >= 8192 GROUP BY 1")
def y7_segment_addresses(spark, d):
    base, offset = reports.segment_address(F.col("root_ref"))
    c = table(spark, d, "composites").select(base.alias("base"), offset.alias("offset")).where("base is not null")
    return c.groupBy("base").agg(F.count("*").alias("n"), F.min("offset").alias("least_offset"))


@query("SELECT line_key, n_declared, coalesce(n_found, 0) AS n_found, n_declared = coalesce(n_found, 0) AS agrees FROM (SELECT line_key, count(DISTINCT page) AS n_declared FROM dxf_pages WHERE line_key IS NOT NULL GROUP BY 1) LEFT JOIN (SELECT line_key, count(*) AS n_found FROM (SELECT DISTINCT line_key, page FROM pipe_candidates WHERE page IS NOT NULL) GROUP BY 1) USING (line_key)")
def y8_declared_counts(spark, d):
    declared = table(spark, d, "dxf_pages").where("line_key is not null").groupBy("line_key").agg(F.countDistinct("page").alias("n_declared"))
    return reports.declared_counts(declared, [table(spark, d, "pipe_candidates").where("page is not null").select("line_key", "page").distinct()], "line_key", "n_declared")


@query("""WITH a AS (SELECT DISTINCT line_key, page::VARCHAR AS name FROM dxf_pages WHERE line_key IS NOT NULL), b AS (SELECT DISTINCT line_key, page::VARCHAR AS name FROM pipe_candidates WHERE line_key IS NOT NULL), j AS (SELECT line_key, name, a.name IS NOT NULL AS e, b.name IS NOT NULL AS f FROM a FULL JOIN b USING (line_key, name)),
  s AS (SELECT line_key, coalesce(string_agg(name, ',' ORDER BY name) FILTER (NOT f), '') AS missing, coalesce(string_agg(name, ',' ORDER BY name) FILTER (NOT e), '') AS extra FROM (SELECT line_key, name, (line_key, name) IN (SELECT (line_key, name) FROM a) AS e, (line_key, name) IN (SELECT (line_key, name) FROM b) AS f FROM (SELECT * FROM a UNION SELECT * FROM b)) GROUP BY 1)
  SELECT line_key, missing, extra, missing IN ('', '4') AND extra = '' AS accepted FROM s""")
def y9_name_sets(spark, d):
    names = lambda t: table(spark, d, t).where("line_key is not null").select("line_key", F.col("page").cast("string").alias("name")).where("name is not null").distinct()
    s = sets.compare_names(names("dxf_pages"), names("pipe_candidates"), ["line_key"], "name", ["4"])
    return s.select("line_key", F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"), "accepted")


@query("""WITH r AS (SELECT DISTINCT graphic_ref FROM point_targets), f AS (SELECT DISTINCT graphic_ref AS r, 'attribute' AS f FROM dynamic_attributes UNION SELECT graphic_ref, 'envelope' FROM psm_envelopes)
  SELECT r.graphic_ref, coalesce(string_agg(f, '+' ORDER BY f), '') AS families FROM r LEFT JOIN f ON f.r = r.graphic_ref AND f.r <> 0 GROUP BY 1""")
def y10_attachments(spark, d):
    rows = table(spark, d, "point_targets").select("graphic_ref").distinct()
    fam = {"attribute": table(spark, d, "dynamic_attributes").select("graphic_ref"), "envelope": table(spark, d, "psm_envelopes").select("graphic_ref")}
    return reports.attachments(rows, "graphic_ref", fam).select("graphic_ref", F.array_join("families", "+").alias("families"))


@query("SELECT DISTINCT a.attr_id, b.attr_id AS next_id FROM dynamic_attributes a JOIN dynamic_attributes b ON b.drawing_id = a.drawing_id AND b.graphic_ref - 1 = a.graphic_ref")
def y11_offset_keys(spark, d):
    a = table(spark, d, "dynamic_attributes").select("drawing_id", "graphic_ref", "attr_id").distinct()
    b = a.select("drawing_id", (F.col("graphic_ref") - 1).alias("graphic_ref"), F.col("attr_id").alias("next_id"))
    return a.join(b, ["drawing_id", "graphic_ref"]).select("attr_id", "next_id")


@query("""WITH r AS (SELECT DISTINCT graphic_ref FROM point_targets WHERE graphic_ref IS NOT NULL), e AS (SELECT graphic_ref, min(envelope_id) AS v FROM psm_envelopes GROUP BY 1), a AS (SELECT graphic_ref, min(attr_id) AS v FROM dynamic_attributes GROUP BY 1)
  SELECT r.graphic_ref, coalesce(e.v, a.v) AS value, CASE WHEN e.v IS NOT NULL THEN 'envelope' WHEN a.v IS NOT NULL THEN 'attribute' END AS family FROM r LEFT JOIN e USING (graphic_ref) LEFT JOIN a USING (graphic_ref)""")
def y12_priority_join(spark, d):
    rows = table(spark, d, "point_targets").where("graphic_ref is not null").select("graphic_ref").distinct()
    fam = [("envelope", table(spark, d, "psm_envelopes").select("graphic_ref", F.col("envelope_id").alias("value"))), ("attribute", table(spark, d, "dynamic_attributes").select("graphic_ref", F.col("attr_id").alias("value")))]
    return linking.prioritised(rows, "graphic_ref", fam, "value")


@query("""WITH c AS (SELECT composite_id, unnest(children) AS c FROM (SELECT DISTINCT composite_id, children FROM composites)), k AS (SELECT composite_id, c.child_ref AS child_ref, c.box_left AS l, c.box_bottom AS b, c.box_right AS r, c.box_top AS t, c.prim_type AS p FROM c),
  j AS (SELECT a.composite_id, a.child_ref AS range_ref, a.l, a.b, a.r, a.t, m.l AS ml, m.b AS mb, m.r AS mr, m.t AS mt FROM k a JOIN k m ON m.composite_id = a.composite_id AND m.child_ref <> a.child_ref AND m.l >= a.l - 400 AND m.b >= a.b - 400 AND m.r <= a.r + 400 AND m.t <= a.t + 400 WHERE a.p = 0)
  SELECT composite_id, range_ref, count(*) AS n_members FROM j GROUP BY 1, 2""")
def y13_range_members(spark, d):
    c = table(spark, d, "composites").select("composite_id", "children").distinct().select("composite_id", F.explode("children").alias("c")).select("composite_id", "c.*")
    return reports.range_members(c, ["composite_id"], 400.0).select("composite_id", "range_ref", "n_members")


@query("SELECT composite_id, count(*) AS n_members, bool_and(coalesce(c.box_left < c.box_right AND c.box_bottom < c.box_top, false)) AS all_pass FROM (SELECT composite_id, unnest(children) AS c FROM (SELECT DISTINCT composite_id, children FROM composites)) GROUP BY 1")
def y14_all_members(spark, d):
    c = table(spark, d, "composites").select("composite_id", "children").distinct().select("composite_id", F.explode("children").alias("c"))
    return reports.all_members(c, ["composite_id"], (F.col("c.box_left") < F.col("c.box_right")) & (F.col("c.box_bottom") < F.col("c.box_top")))


@query(f"""WITH a AS (SELECT {_KEY} AS k FROM weld_blocks), b AS (SELECT {_KEY} AS k FROM point_targets), n AS (SELECT k, sum(a)::BIGINT AS a, sum(b)::BIGINT AS b FROM (SELECT k, 1 AS a, 0 AS b FROM a UNION ALL SELECT k, 0, 1 FROM b) WHERE k IS NOT NULL GROUP BY 1)
  SELECT sum(a)::BIGINT AS rows_a, sum(b)::BIGINT AS rows_b, count(*) FILTER (a > 0 AND b > 0) AS keys_both, count(*) FILTER (b = 0) AS keys_only_a, count(*) FILTER (a = 0) AS keys_only_b, count(*) FILTER (a > 1 OR b > 1) AS keys_repeated FROM n""")
def y15_reconcile(spark, d):
    return reports.reconcile(_keyed(table(spark, d, "weld_blocks")), _keyed(table(spark, d, "point_targets")), "uci_key")


@query("""SELECT owner, count(*) AS n FROM (SELECT p.point_id, max(e.graphic_ref) AS owner FROM (SELECT DISTINCT point_id, drawing_id, graphic_ref FROM point_targets WHERE graphic_ref IS NOT NULL) p LEFT JOIN psm_envelopes e ON e.drawing_id = p.drawing_id AND e.graphic_ref <= p.graphic_ref GROUP BY 1, p.drawing_id, p.graphic_ref) GROUP BY 1""")
def y16_interval_owners(spark, d):
    p = table(spark, d, "point_targets").where("graphic_ref is not null").select("point_id", "drawing_id", "graphic_ref").distinct()
    e = table(spark, d, "psm_envelopes").where("graphic_ref is not null").select("drawing_id", F.col("graphic_ref").alias("start"), F.col("graphic_ref").alias("owner"))
    return linking.as_of(p, e, ["drawing_id"], "graphic_ref", "start", ["owner"]).groupBy("owner").agg(F.count("*").alias("n"))


@query("""SELECT composite_id, string_agg(coalesce(t, 'unclassified'), ',' ORDER BY place) AS types, bool_and(coalesce(t = 'segment', false)) AS all_segments FROM (SELECT composite_id, place, CASE c.prim_type WHEN 0 THEN 'range' WHEN 5 THEN 'segment' WHEN 6 THEN 'arc' END AS t
  FROM (SELECT composite_id, unnest(range(len(children))) AS place, unnest(children) AS c FROM (SELECT DISTINCT composite_id, children FROM composites))) GROUP BY 1""")
def y17_member_types(spark, d):
    names = F.create_map(F.lit(0), F.lit("range"), F.lit(5), F.lit("segment"), F.lit(6), F.lit("arc"))
    types = F.transform("children", lambda c: F.when(c.prim_type.isNotNull(), F.try_element_at(names, c.prim_type)))
    c = table(spark, d, "composites").select("composite_id", "children").distinct().where("size(children) > 0").withColumn("t", types)
    return c.select("composite_id", F.array_join(F.transform("t", lambda x: F.coalesce(x, F.lit("unclassified"))), ",").alias("types"), F.forall("t", lambda x: F.coalesce(x == "segment", F.lit(False))).alias("all_segments"))


@query("""SELECT envelope_id, CASE WHEN (drawing_id, graphic_ref) IN (SELECT (drawing_id, graphic_ref) FROM dynamic_attributes) THEN 'attribute' WHEN graphic_ref IS NULL THEN 'unbound' ELSE 'envelope' END AS anchor, box_right - box_left <= 1 OR box_top - box_bottom <= 1 AS thin, box_left = 0 AND box_bottom = 0 AS at_origin
  FROM (SELECT DISTINCT envelope_id, drawing_id, graphic_ref, box_left, box_bottom, box_right, box_top FROM psm_envelopes)""")
def y18_anchor_classes(spark, d):
    known = table(spark, d, "dynamic_attributes").select("drawing_id", "graphic_ref").distinct().withColumn("hit", F.lit(True))
    e = table(spark, d, "psm_envelopes").select("envelope_id", "drawing_id", "graphic_ref", "box_left", "box_bottom", "box_right", "box_top").distinct().join(known, ["drawing_id", "graphic_ref"], "left")
    anchor = F.when(F.col("hit"), "attribute").when(F.col("graphic_ref").isNull(), "unbound").otherwise("envelope")
    thin = (F.col("box_right") - F.col("box_left") <= 1) | (F.col("box_top") - F.col("box_bottom") <= 1)
    return e.select("envelope_id", anchor.alias("anchor"), thin.alias("thin"), ((F.col("box_left") == 0) & (F.col("box_bottom") == 0)).alias("at_origin"))


# Sinks as documents.


@query("SELECT drawing_id, count(*) AS n_elements FROM (SELECT DISTINCT envelope_id, drawing_id FROM psm_envelopes) GROUP BY 1")
def k1_drawings(spark, d):
    e = table(spark, d, "psm_envelopes").dropDuplicates(["envelope_id"]).select(
        "drawing_id", F.coalesce("opaque_tag", F.lit(0)).alias("layer"), F.col("envelope_id").alias("ord"), F.col("box_left").cast("double").alias("x1"), F.col("box_bottom").cast("double").alias("y1"),
        F.col("box_right").cast("double").alias("x2"), F.col("box_top").cast("double").alias("y2"), F.col("graphic_ref").cast("string").alias("label"),
    )
    pages = sinks.svg_pages(e, ["drawing_id"], 16800, 16800)
    return pages.select("drawing_id", F.size(F.split("value", "<line ")).cast("long").alias("m")).select("drawing_id", (F.col("m") - 1).alias("n_elements"))


@query("""WITH s AS (SELECT drawing_id, list(struct_pack(envelope_id := envelope_id, graphic_ref := graphic_ref, box_left := box_left, box_bottom := box_bottom) ORDER BY envelope_id) AS l FROM (SELECT DISTINCT drawing_id, envelope_id, graphic_ref, box_left, box_bottom FROM psm_envelopes) GROUP BY 1),
  t AS (SELECT drawing_id, list(struct_pack(point_id := point_id, uci := uci) ORDER BY point_id) AS l FROM (SELECT DISTINCT drawing_id, point_id, uci FROM point_targets) GROUP BY 1)
  SELECT coalesce(s.drawing_id, t.drawing_id) AS drawing_id, coalesce(len(s.l), 0)::INT AS n_segments, coalesce(len(t.l), 0)::INT AS n_texts, coalesce(s.l::JSON::VARCHAR, '[]') AS segments, coalesce(t.l::JSON::VARCHAR, '[]') AS texts FROM s FULL JOIN t ON s.drawing_id = t.drawing_id""")
def k2_traces(spark, d):
    s = table(spark, d, "psm_envelopes").dropDuplicates(["envelope_id"]).select("drawing_id", "envelope_id", "graphic_ref", "box_left", "box_bottom")
    t = table(spark, d, "point_targets").dropDuplicates(["point_id"]).select("drawing_id", "point_id", "uci")
    pages = sinks.trace_pages(s, t, ["drawing_id"])
    text = lambda c: F.to_json(c, {"ignoreNullFields": "false"}).alias(c)
    return pages.select("drawing_id", F.col("counts.segments").alias("n_segments"), F.col("counts.texts").alias("n_texts"), text("segments"), text("texts"))


@query("SELECT count(*) AS n_rows, sum(n)::BIGINT AS total FROM (SELECT tag, count(*) AS n FROM dynamic_attributes GROUP BY 1)")
def k6_report(spark, d):
    counts = table(spark, d, "dynamic_attributes").groupBy("tag").agg(F.count("*").alias("n"))
    lines = sinks.report(counts, "Tags").where("section = 1")
    return lines.select(F.from_json("json", "tag string, n long").alias("j")).agg(F.count("*").alias("n_rows"), F.sum("j.n").alias("total"))


QUERIES = {k: f for k, (f, _) in _ALL.items()}
SQL = {k: s for k, (_, s) in _ALL.items() if s}
