"""Queries over links between records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spoolmark.functions.keys import uci_key
from spoolmark.functions.text import common_prefix_length, stem_key
from spoolmark.operators import linking, ranking, spatial
from spoolmark.sources import idf
from spoolmark.sources.tables import table


def _idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idf.geometry(table(spark, sf_dir, "idf_lines"), "idf_file", "line_no", "raw_line", "row_id")


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("uci_key", uci_key(F.col("uci")))


def j1_link_coverage(spark, d):
    return linking.coverage(_keyed(table(spark, d, "weld_blocks")), _keyed(table(spark, d, "dynamic_attributes")), "uci_key", ["skey"])


def j2_component_pages(spark, d):
    welds = _keyed(table(spark, d, "weld_blocks")).select("weld_id", "uci_key").distinct()
    graphics = _keyed(table(spark, d, "dynamic_attributes")).select("uci_key", "drawing_id", "graphic_ref").distinct()
    boxes = table(spark, d, "psm_envelopes").select("drawing_id", "graphic_ref", "envelope_id").distinct()
    pages = welds.join(graphics, "uci_key", "left").join(boxes, ["drawing_id", "graphic_ref"], "left")
    return pages.groupBy("weld_id").agg(F.countDistinct("drawing_id").alias("n_drawings"), F.countDistinct("envelope_id").alias("n_envelopes"))


def j3_uci_regions(spark, d):
    graphics = _keyed(table(spark, d, "dynamic_attributes")).where("uci_key is not null and graphic_ref is not null").select("drawing_id", "graphic_ref", "uci_key").distinct()
    first = table(spark, d, "psm_envelopes").groupBy("drawing_id", "graphic_ref").agg(
        F.min(F.struct("envelope_id", "box_left", "box_bottom", "box_right", "box_top")).alias("b")
    )
    return graphics.join(first, ["drawing_id", "graphic_ref"]).select("drawing_id", "graphic_ref", F.expr("substring(uci_key, 3)").alias("uci_key"), "b.*")


def j4_relation_members(spark, d):
    owners = table(spark, d, "composites").select("drawing_id", "parent_ref", F.explode("children").alias("c"))
    typed = owners.select("drawing_id", "parent_ref", "c.child_ref", "c.prim_type").where("prim_type is not null and child_ref is not null")
    visible = table(spark, d, "composites").select("drawing_id", F.col("parent_ref").alias("child_ref")).distinct()
    return typed.join(visible, ["drawing_id", "child_ref"], "left_semi").distinct()


def j5_boxes_meet(spark, d):
    boxes = table(spark, d, "psm_envelopes").dropDuplicates(["envelope_id"])
    a = boxes.where("opaque_tag = 1").select("drawing_id", F.col("envelope_id").alias("a_id"), *[F.col(f"box_{s}").alias(f"a_{s}") for s in ("left", "bottom", "right", "top")])
    b = boxes.where("opaque_tag = 12").select("drawing_id", F.col("envelope_id").alias("b_id"), *[F.col(f"box_{s}").alias(f"b_{s}") for s in ("left", "bottom", "right", "top")])
    sides = lambda p: [f"{p}_{s}" for s in ("left", "bottom", "right", "top")]
    return spatial.boxes_meet(a, b, ["drawing_id"], sides("a"), sides("b"), 1000.0, 80.0).select("drawing_id", "a_id", "b_id")


def _near(spark, d, code, limit):
    g = _idf(spark, d)
    segments = g.where("code = 100").select("file", F.col("row").alias("pipe_row"), F.col("ax").alias("x1"), F.col("ay").alias("y1"), F.col("bx").alias("x2"), F.col("by").alias("y2"))
    points = g.where(F.col("code") == code).select("file", F.col("row").alias("point_row"), F.col("ax").alias("px"), F.col("ay").alias("py"))
    near = spatial.nearest_segment(points, segments, ["file"], "point_row", "pipe_row", limit)
    return near.select("file", "point_row", "pipe_row", F.round("dist", 3).alias("dist"))


def j6_nearest_pipe(spark, d):
    return _near(spark, d, 120, 400.0)


def j8_body_contact(spark, d):
    return _near(spark, d, 35, 60.0)


def j7_epsilon_pairs(spark, d):
    points = table(spark, d, "point_targets").dropDuplicates(["point_id"])
    near = spatial.epsilon_pairs(points, ["drawing_id", "page"], "point_id", "center_x", "center_y", 0.05)
    return near.select("drawing_id", "page", "id_a", "id_b", F.round("gap", 6).alias("gap"))


def j9_smallest_frame(spark, d):
    points = table(spark, d, "point_targets").dropDuplicates(["point_id"]).select("drawing_id", "point_id", (F.col("center_x") * 16800).alias("px"), (F.col("center_y") * 16800).alias("py"))
    frames = table(spark, d, "psm_envelopes").dropDuplicates(["envelope_id"]).select("drawing_id", "envelope_id", "box_left", "box_bottom", "box_right", "box_top")
    wide = frames.select("drawing_id", "envelope_id", (F.col("box_left") - 900).alias("box_left"), (F.col("box_bottom") - 900).alias("box_bottom"), (F.col("box_right") + 900).alias("box_right"), (F.col("box_top") + 900).alias("box_top"))
    return spatial.smallest_frame(points, wide, ["drawing_id"], "point_id", "envelope_id", 1000.0).select("drawing_id", "point_id", "envelope_id", "area")


def j10_as_of(spark, d):
    events = table(spark, d, "events")
    left = events.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    right = events.where("event_type = 'signup'").select("user_id", F.col("ts").alias("signup_ts"), F.col("event_id").alias("signup_id"))
    return linking.as_of(left, right, ["user_id"], "ts", "signup_ts", ["signup_id"]).select("user_id", "event_id", "signup_id")


def j11_unique_candidate(spark, d):
    welds = _keyed(table(spark, d, "weld_blocks")).select("weld_id", "uci_key").distinct()
    attributes = _keyed(table(spark, d, "dynamic_attributes")).select("uci_key", "attr_id", "tag").distinct()
    return linking.unique_candidate(welds, attributes, "uci_key").select("weld_id", "attr_id", "tag")


def j11_candidate_distribution(spark, d):
    welds = _keyed(table(spark, d, "weld_blocks")).select("weld_id", "uci_key").distinct()
    attributes = _keyed(table(spark, d, "dynamic_attributes")).select("uci_key", "attr_id").distinct()
    return linking.candidate_distribution(welds, attributes, "uci_key")


def j12_unmatched(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return linking.unmatched(orders, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


def j13_line_inventory(spark, d):
    files = table(spark, d, "idf_lines").select(F.regexp_extract("idf_file", r"^([A-Z]+[0-9]+)", 1).alias("line_key")).distinct()
    pages = table(spark, d, "dxf_pages").select("line_key", "page", "dxf_name").distinct().groupBy("line_key").agg(
        F.count("*").alias("n_pages"), F.array_join(F.array_sort(F.collect_set("dxf_name")), ";").alias("pages")
    )
    status = F.when(F.col("n_pages").isNull(), "no_candidate").when(F.col("n_pages") == 1, "single_page").otherwise("multi_page")
    return files.join(pages, "line_key", "left").select("line_key", F.coalesce("n_pages", F.lit(0)).alias("n_pages"), F.coalesce("pages", F.lit("")).alias("pages"), status.alias("status"))


def _part_sets(spark, d, name="o"):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias(name)).agg(F.collect_set("l_partkey").alias("items"))


def j14_equal_sets(spark, d):
    sets = linking.equal_sets(_part_sets(spark, d), "o", "items")
    return sets.select(F.array_join("items", ",").alias("items"), F.array_join("members", ",").alias("members"), "n_members")


def j15_subset_pairs(spark, d):
    sets = _part_sets(spark, d)
    return linking.subset_pairs(sets.withColumnRenamed("o", "small"), sets.withColumnRenamed("o", "large"), "small", "large", "items").where("small != large")


def j16_source_pairs(spark, d):
    welds = _keyed(table(spark, d, "weld_blocks")).select("pcf_file", "uci_key").where("pcf_file is not null and uci_key is not null").distinct()
    attributes = _keyed(table(spark, d, "dynamic_attributes")).select("drawing_id", "uci_key").where("uci_key is not null").distinct()
    return welds.join(attributes, "uci_key").groupBy("pcf_file", "drawing_id").agg(F.count("*").alias("n_shared"))


def x7_recommended_pair(spark, d):
    return ranking.best_with_margin(j16_source_pairs(spark, d), ["pcf_file"], "n_shared", "drawing_id").select("pcf_file", "drawing_id", "n_shared", "margin")


def j17_tolerance_pairs(spark, d):
    return linking.tolerance_pairs(table(spark, d, "part"), ["p_brand", "p_type"], "p_partkey", "p_retailprice", 0.1, 0.02).select("p_brand", "p_type", "id_a", "id_b")


def j18_shared_points(spark, d):
    g = _idf(spark, d)
    dec = lambda c: F.col(c).cast("decimal(18,3)")
    g = g.where(F.abs(F.col("ax") + F.col("ay") + F.col("az") + F.col("bx") + F.col("by") + F.col("bz")) < 1e12)
    ends = g.select("file", "row", "code", dec("ax").alias("x"), dec("ay").alias("y"), dec("az").alias("z")).union(g.select("file", "row", "code", dec("bx"), dec("by"), dec("bz")))
    shared = ends.groupBy("file", "x", "y", "z").agg(F.countDistinct("row").alias("n_rows"), F.countDistinct("code").alias("n_codes")).where("n_rows >= 2 and n_codes >= 2")
    return shared.groupBy("file").agg(F.count("*").alias("n_points"), F.sum("n_rows").alias("n_rows"), F.max("n_codes").alias("most_codes"))


def j19_chained_lookup(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return c.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("c_custkey", "n_name", "r_name")


def j20_reverse_alias(spark, d):
    e = table(spark, d, "graph_edges").select(F.trim("from_node").alias("a"), F.trim("to_node").alias("b")).where("a != '' and b != ''")
    flags = e.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(
        F.count_if(F.col("a") < F.col("b")).alias("n_forward"), F.count_if(F.col("a") > F.col("b")).alias("n_reverse"), F.count_if(F.col("a") == F.col("b")).alias("n_self")
    )
    return flags.select(
        F.when(F.col("n_self") > 0, "self").when((F.col("n_forward") > 0) & (F.col("n_reverse") > 0), "both").when(F.col("n_forward") > 0, "forward").otherwise("reverse").alias("direction"),
        (F.col("n_forward") + F.col("n_reverse") + F.col("n_self")).alias("n"),
    ).groupBy("direction").agg(F.count("*").alias("n_pairs"), F.sum("n").alias("n_edges"))


def j21_family_dedup(spark, d):
    e = table(spark, d, "graph_edges").select("kind", F.array_sort(F.array(F.trim("from_node"), F.trim("to_node"))).alias("ends"))
    main = e.where("kind = 'in_page_exact_endpoint'").select("ends").distinct()
    rest = e.where("kind != 'in_page_exact_endpoint'").select("kind", "ends").distinct()
    return rest.join(main, "ends", "left_anti").groupBy("kind").agg(F.count("*").alias("n_pairs"))


def j22_sibling_files(spark, d):
    stem = lambda c: stem_key(F.regexp_replace(F.col(c), r"\.[A-Za-z]+$", ""))
    a = table(spark, d, "dxf_pages").where("dxf_name is not null").select("dxf_name", stem("dxf_name").alias("stem")).distinct()
    b = table(spark, d, "idf_lines").where("idf_file is not null").select("idf_file", stem("idf_file").alias("stem")).distinct()
    return a.join(b, "stem").select("stem", "dxf_name", "idf_file")


def j23_family_membership(spark, d):
    families = [(n, table(spark, d, n).select("drawing_id", "graphic_ref").where("graphic_ref is not null")) for n in ("psm_envelopes", "point_targets", "dynamic_attributes")]
    rows = None
    for name, f in families:
        part = f.select("*", F.lit(name).alias("family"))
        rows = part if rows is None else rows.unionByName(part)
    sets = rows.groupBy("drawing_id", "graphic_ref").agg(F.array_join(F.array_sort(F.collect_set("family")), "+").alias("families"))
    return sets.groupBy("families").agg(F.count("*").alias("n_graphics"))


def fs3_common_prefix(spark, d):
    a = table(spark, d, "weld_blocks").select("pcf_file").where("pcf_file is not null").distinct().select("pcf_file", F.substring("pcf_file", 1, 5).alias("k"))
    b = table(spark, d, "dxf_pages").select("dxf_name").where("dxf_name is not null").distinct().select("dxf_name", F.substring("dxf_name", 1, 5).alias("k"))
    scored = a.join(b, "k").select("pcf_file", "dxf_name", common_prefix_length(F.col("pcf_file"), F.col("dxf_name")).alias("prefix"))
    return scored.groupBy("pcf_file").agg(F.max("prefix").alias("prefix"))


QUERIES = {k: v for k, v in list(globals().items()) if k.split("_")[0] in {*(f"j{i}" for i in range(1, 24)), "x7", "fs3"} and callable(v)}

_KEY = "nullif(upper(trim(translate(uci, '{}', ''), ' ' || chr(9))), '')"
IDF_SQL = r"""
idf_f AS (SELECT idf_file AS file, line_no, row_id AS row, raw_line AS raw, list_filter(regexp_split_to_array(coalesce(raw_line, ''), '[ \t\r\n\x0b\f]+'), lambda x: x <> '') AS f FROM idf_lines),
idf_c AS (SELECT *, CASE WHEN regexp_full_match(f[1], '-?[0-9]+') THEN try_cast(f[1] AS INT) END AS code FROM idf_f),
idf_n AS (SELECT file, line_no, row, code, try_cast(f[2] AS DOUBLE) AS ax, try_cast(f[3] AS DOUBLE) AS ay, try_cast(f[4] AS DOUBLE) AS az, try_cast(f[5] AS DOUBLE) AS bx,
  try_cast(f[6] AS DOUBLE) AS "by", try_cast(f[7] AS DOUBLE) AS bz, try_cast(f[8] AS DOUBLE) AS bore, len(list_filter(f[9:], lambda x: contains(x, ','))) > 0 AS comma FROM idf_c WHERE len(f) >= 8),
g AS (SELECT *, sqrt((ax-bx)**2 + (ay-"by")**2 + (az-bz)**2) AS length FROM idf_n
  WHERE code IS NOT NULL AND ax IS NOT NULL AND ay IS NOT NULL AND az IS NOT NULL AND bx IS NOT NULL AND "by" IS NOT NULL AND bz IS NOT NULL AND bore IS NOT NULL AND (code <> 100 OR comma))
"""


def _near_sql(code: int, limit: float) -> str:
    return f"""
    WITH {IDF_SQL}, p AS (SELECT file, row AS point_row, ax AS px, ay AS py FROM g WHERE code = {code} AND isfinite(ax) AND isfinite(ay)),
    s AS (SELECT file, row AS pipe_row, ax AS x1, ay AS y1, bx AS x2, "by" AS y2, (bx-ax)**2 + ("by"-ay)**2 AS sq FROM g WHERE code = 100 AND isfinite(ax+ay+bx+"by")),
    c AS (SELECT p.file, point_row, pipe_row, px, py, x1, y1, x2, y2, CASE WHEN sq = 0 THEN 0 ELSE greatest(0, least(1, ((px-x1)*(x2-x1) + (py-y1)*(y2-y1)) / sq)) END AS t FROM p JOIN s USING (file)),
    m AS (SELECT file, point_row, pipe_row, sqrt((px - (x1 + t*(x2-x1)))**2 + (py - (y1 + t*(y2-y1)))**2) AS dist FROM c)
    SELECT file, point_row, pipe_row, round(dist, 3) AS dist FROM m WHERE dist <= {limit} QUALIFY row_number() OVER (PARTITION BY file, point_row ORDER BY dist, pipe_row) = 1"""


_SETS = "sets AS (SELECT l_orderkey AS o, list_sort(list_distinct(list(l_partkey))) AS items FROM lineitem GROUP BY 1)"
SQL = {
    "j1_link_coverage": f"""SELECT skey, count(*) AS n_rows, count(*) FILTER (hit) AS n_linked, count(*) FILTER (NOT hit) AS n_unlinked FROM (
      SELECT skey, coalesce({_KEY} IN (SELECT {_KEY} FROM dynamic_attributes WHERE {_KEY} IS NOT NULL), false) AS hit FROM weld_blocks) GROUP BY skey""",
    "j2_component_pages": f"""SELECT weld_id, count(DISTINCT drawing_id) AS n_drawings, count(DISTINCT envelope_id) AS n_envelopes FROM (SELECT DISTINCT weld_id, {_KEY} AS k FROM weld_blocks) w
      LEFT JOIN (SELECT DISTINCT {_KEY} AS k, drawing_id, graphic_ref FROM dynamic_attributes) a USING (k) LEFT JOIN psm_envelopes e USING (drawing_id, graphic_ref) GROUP BY weld_id""",
    "j3_uci_regions": f"""SELECT a.drawing_id, a.graphic_ref, uci_key, envelope_id, box_left, box_bottom, box_right, box_top FROM (SELECT DISTINCT drawing_id, graphic_ref, {_KEY} AS uci_key FROM dynamic_attributes WHERE {_KEY} IS NOT NULL) a
      JOIN (SELECT * FROM psm_envelopes QUALIFY row_number() OVER (PARTITION BY drawing_id, graphic_ref ORDER BY envelope_id) = 1) e ON e.drawing_id = a.drawing_id AND e.graphic_ref = a.graphic_ref""",
    "j4_relation_members": """SELECT DISTINCT drawing_id, parent_ref, c.child_ref AS child_ref, c.prim_type AS prim_type FROM (SELECT drawing_id, parent_ref, unnest(children) AS c FROM composites) x
      WHERE c.prim_type IS NOT NULL AND EXISTS (SELECT 1 FROM composites y WHERE y.drawing_id = x.drawing_id AND y.parent_ref = x.c.child_ref)""",
    "j5_boxes_meet": """SELECT DISTINCT a.drawing_id, a.envelope_id AS a_id, b.envelope_id AS b_id FROM psm_envelopes a JOIN psm_envelopes b ON a.drawing_id = b.drawing_id
      AND a.box_left <= b.box_right + 80 AND b.box_left - 80 <= a.box_right AND a.box_bottom <= b.box_top + 80 AND b.box_bottom - 80 <= a.box_top WHERE a.opaque_tag = 1 AND b.opaque_tag = 12""",
    "j6_nearest_pipe": _near_sql(120, 400.0),
    "j8_body_contact": _near_sql(35, 60.0),
    "j7_epsilon_pairs": """WITH p AS (SELECT DISTINCT point_id, drawing_id, page, center_x, center_y FROM point_targets WHERE isfinite(center_x) AND isfinite(center_y))
      SELECT a.drawing_id, a.page, a.point_id AS id_a, b.point_id AS id_b, round(sqrt((a.center_x-b.center_x)**2 + (a.center_y-b.center_y)**2), 6) AS gap
      FROM p a JOIN p b ON a.drawing_id = b.drawing_id AND a.page = b.page AND a.point_id < b.point_id AND sqrt((a.center_x-b.center_x)**2 + (a.center_y-b.center_y)**2) <= 0.05""",
    "j9_smallest_frame": """WITH p AS (SELECT DISTINCT point_id, drawing_id, center_x * 16800 AS px, center_y * 16800 AS py FROM point_targets WHERE isfinite(center_x) AND isfinite(center_y)),
      f AS (SELECT DISTINCT envelope_id, drawing_id, box_left - 900 AS l, box_bottom - 900 AS b, box_right + 900 AS r, box_top + 900 AS t FROM psm_envelopes),
      i AS (SELECT p.drawing_id, point_id, envelope_id, (r-l)::DOUBLE * (t-b) AS area FROM p JOIN f ON p.drawing_id = f.drawing_id AND px BETWEEN l AND r AND py BETWEEN b AND t),
      k AS (SELECT *, count(*) OVER (PARTITION BY drawing_id, envelope_id) AS n FROM i)
      SELECT drawing_id, point_id, envelope_id, area FROM k WHERE n >= 2 QUALIFY row_number() OVER (PARTITION BY drawing_id, point_id ORDER BY area, envelope_id) = 1""",
    "j10_as_of": """SELECT p.user_id, p.event_id, s.event_id AS signup_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
      ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'signup' GROUP BY ALL) s ON p.user_id = s.user_id AND p.ts >= s.ts""",
    "j11_unique_candidate": f"""SELECT weld_id, any_value(attr_id) AS attr_id, any_value(tag) AS tag FROM (SELECT DISTINCT weld_id, {_KEY} AS k FROM weld_blocks) w
      JOIN (SELECT DISTINCT {_KEY} AS k, attr_id, tag FROM dynamic_attributes) a USING (k) GROUP BY weld_id, k HAVING count(*) = 1""",
    "j11_candidate_distribution": f"""SELECT n_candidates, count(*) AS n_rows FROM (SELECT w.weld_id, w.k, count(a.attr_id) AS n_candidates FROM (SELECT DISTINCT weld_id, {_KEY} AS k FROM weld_blocks) w
      LEFT JOIN (SELECT DISTINCT {_KEY} AS k, attr_id FROM dynamic_attributes) a USING (k) GROUP BY ALL) GROUP BY n_candidates""",
    "j12_unmatched": "SELECT o_orderkey, o_orderpriority FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey",
    "j13_line_inventory": """SELECT line_key, coalesce(n_pages, 0) AS n_pages, coalesce(pages, '') AS pages, CASE WHEN n_pages IS NULL THEN 'no_candidate' WHEN n_pages = 1 THEN 'single_page' ELSE 'multi_page' END AS status
      FROM (SELECT DISTINCT regexp_extract(idf_file, '^([A-Z]+[0-9]+)', 1) AS line_key FROM idf_lines) LEFT JOIN
      (SELECT line_key, count(*) AS n_pages, array_to_string(list_sort(list_distinct(list(dxf_name))), ';') AS pages FROM (SELECT DISTINCT line_key, page, dxf_name FROM dxf_pages) GROUP BY 1) USING (line_key)""",
    "j14_equal_sets": f"WITH {_SETS} SELECT array_to_string(items, ',') AS items, array_to_string(list_sort(list(o)), ',') AS members, count(*)::INT AS n_members FROM sets GROUP BY sets.items HAVING count(*) > 1",
    "j15_subset_pairs": f"WITH {_SETS} SELECT a.o AS small, b.o AS large FROM sets a JOIN lineitem l ON l.l_partkey = a.items[1] JOIN sets b ON b.o = l.l_orderkey WHERE a.o <> b.o AND list_has_all(b.items, a.items) GROUP BY ALL",
    "j16_source_pairs": f"""SELECT pcf_file, drawing_id, count(*) AS n_shared FROM (SELECT DISTINCT pcf_file, {_KEY} AS k FROM weld_blocks WHERE pcf_file IS NOT NULL) w
      JOIN (SELECT DISTINCT drawing_id, {_KEY} AS k FROM dynamic_attributes) a USING (k) GROUP BY ALL""",
    "j17_tolerance_pairs": """SELECT a.p_brand, a.p_type, a.p_partkey AS id_a, b.p_partkey AS id_b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey
      AND abs(a.p_retailprice - b.p_retailprice) <= greatest(0.1::DOUBLE, 0.02::DOUBLE * greatest(a.p_retailprice, b.p_retailprice))""",
    "j18_shared_points": f"""WITH {IDF_SQL}, h AS (SELECT * FROM g WHERE abs(ax + ay + az + bx + "by" + bz) < 1e12 AND NOT isnan(ax + ay + az + bx + "by" + bz)), e AS (SELECT file, row, code, ax::DECIMAL(18,3) AS x, ay::DECIMAL(18,3) AS y, az::DECIMAL(18,3) AS z FROM h UNION ALL SELECT file, row, code, bx::DECIMAL(18,3), "by"::DECIMAL(18,3), bz::DECIMAL(18,3) FROM h),
      s AS (SELECT file, x, y, z, count(DISTINCT row) AS n_rows, count(DISTINCT code) AS n_codes FROM e GROUP BY ALL HAVING count(DISTINCT row) >= 2 AND count(DISTINCT code) >= 2)
      SELECT file, count(*) AS n_points, sum(n_rows)::BIGINT AS n_rows, max(n_codes) AS most_codes FROM s GROUP BY file""",
    "j19_chained_lookup": "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
    "j20_reverse_alias": """WITH e AS (SELECT trim(from_node, ' ') AS a, trim(to_node, ' ') AS b FROM graph_edges WHERE trim(from_node, ' ') <> '' AND trim(to_node, ' ') <> ''),
      f AS (SELECT least(a, b) AS lo, greatest(a, b) AS hi, count(*) FILTER (a < b) AS fw, count(*) FILTER (a > b) AS rv, count(*) FILTER (a = b) AS sf FROM e GROUP BY 1, 2)
      SELECT CASE WHEN sf > 0 THEN 'self' WHEN fw > 0 AND rv > 0 THEN 'both' WHEN fw > 0 THEN 'forward' ELSE 'reverse' END AS direction, count(*) AS n_pairs, sum(fw + rv + sf)::BIGINT AS n_edges FROM f GROUP BY 1""",
    "j21_family_dedup": """WITH e AS (SELECT kind, list_sort([trim(from_node, ' '), trim(to_node, ' ')], 'ASC', 'NULLS LAST') AS ends FROM graph_edges)
      SELECT kind, count(*) AS n_pairs FROM (SELECT DISTINCT kind, ends FROM e WHERE kind <> 'in_page_exact_endpoint') r WHERE NOT EXISTS (SELECT 1 FROM e m WHERE m.kind = 'in_page_exact_endpoint' AND m.ends = r.ends) GROUP BY kind""",
    "j22_sibling_files": """WITH a AS (SELECT DISTINCT dxf_name, regexp_replace(lower(regexp_replace(dxf_name, '\\.[A-Za-z]+$', '')), '(?:[-_.](?:pcf|sha|iso|[0-9]+))+$', '') AS stem FROM dxf_pages WHERE dxf_name IS NOT NULL),
      b AS (SELECT DISTINCT idf_file, regexp_replace(lower(regexp_replace(idf_file, '\\.[A-Za-z]+$', '')), '(?:[-_.](?:pcf|sha|iso|[0-9]+))+$', '') AS stem FROM idf_lines WHERE idf_file IS NOT NULL)
      SELECT stem, dxf_name, idf_file FROM a JOIN b USING (stem)""".replace("\\\\", "\\"),
    "j23_family_membership": """WITH r AS (SELECT drawing_id, graphic_ref, 'psm_envelopes' AS family FROM psm_envelopes UNION SELECT drawing_id, graphic_ref, 'point_targets' FROM point_targets UNION SELECT drawing_id, graphic_ref, 'dynamic_attributes' FROM dynamic_attributes)
      SELECT families, count(*) AS n_graphics FROM (SELECT drawing_id, graphic_ref, string_agg(family, '+' ORDER BY family) AS families FROM r WHERE graphic_ref IS NOT NULL GROUP BY 1, 2) GROUP BY 1""",
    "fs3_common_prefix": """WITH a AS (SELECT DISTINCT pcf_file AS x FROM weld_blocks), b AS (SELECT DISTINCT dxf_name AS y FROM dxf_pages),
      s AS (SELECT x, len(list_filter(range(1, least(len(x), len(y)) + 1), lambda i: left(x, i::INT) = left(y, i::INT))) AS p FROM a JOIN b ON left(x, 5) = left(y, 5))
      SELECT x AS pcf_file, max(p)::INT AS prefix FROM s GROUP BY x""",
}
SQL["x7_recommended_pair"] = f"""WITH s AS ({SQL['j16_source_pairs']}), r AS (SELECT *, row_number() OVER w AS rank, n_shared - lead(n_shared) OVER w AS margin FROM s WINDOW w AS (PARTITION BY pcf_file ORDER BY n_shared DESC, drawing_id))
      SELECT pcf_file, drawing_id, n_shared, margin FROM r WHERE rank = 1"""
