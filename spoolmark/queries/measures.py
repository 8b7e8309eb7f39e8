"""Queries over counts, robust statistics, sequences, ranks and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from spoolmark.functions import geometry as geo, text as tx
from spoolmark.operators import ranking, sequences, sets, stats
from spoolmark.queries.links import IDF_SQL, _idf
from spoolmark.sources import idf
from spoolmark.sources.tables import table

_ALL: dict = {}


def query(sql: str | None = None):
    def register(f):
        _ALL[f.__name__] = (f, sql)
        return f

    return register


# Counts and robust statistics.


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL")
def a1_count_by_key(spark, d):
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT median(n_chars) AS med FROM documents), a AS (SELECT median(abs(n_chars - med)) AS mad FROM documents, m)
  SELECT doc_id, n_chars, med, CASE WHEN n_chars > med + 4 * greatest(mad, 1) THEN 'dense' ELSE 'sparse' END AS mark FROM documents, m, a
  WHERE n_chars > med + 4 * greatest(mad, 1) OR n_chars < greatest(0, med - 4 * greatest(mad, 1))""")
def a2_global_outliers(spark, d):
    return stats.outliers(table(spark, d, "documents").select("doc_id", "n_chars"), [], "n_chars")


@query("""WITH m AS (SELECT l_returnflag, l_linestatus, count(*) AS n, median(l_extendedprice) AS med FROM lineitem GROUP BY 1, 2)
  SELECT l_returnflag, l_linestatus, n, round(any_value(med), 3) AS med, round(median(abs(l_extendedprice - med)), 3) AS mad FROM lineitem JOIN m USING (l_returnflag, l_linestatus) GROUP BY ALL HAVING n >= 20""")
def a3_group_median_mad(spark, d):
    m = stats.median_mad(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice").where("n >= 20")
    return m.select("l_returnflag", "l_linestatus", "n", F.round("med", 3).alias("med"), F.round("mad", 3).alias("mad"))


@query("SELECT l_returnflag, list_sort(list(l_extendedprice))[(count(*) // 2 + 1)::INT] AS upper_median, count(*) AS n FROM lineitem GROUP BY 1")
def a4_upper_median(spark, d):
    return stats.upper_median(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice")


@query("""WITH g AS (SELECT p_brand, p_type, median(p_size)::DOUBLE AS m FROM part GROUP BY 1, 2) SELECT p_brand, count(*) AS n_groups, median(m) AS med FROM g GROUP BY 1""")
def a5_pooled_median(spark, d):
    return stats.pooled_medians(table(spark, d, "part"), ["p_brand", "p_type"], "p_size", ["p_brand"])


@query("SELECT l_suppkey, l_returnflag, n FROM (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_returnflag DESC) = 1")
def a6_mode(spark, d):
    return stats.mode(table(spark, d, "lineitem"), ["l_suppkey"], "l_returnflag")


@query("""SELECT source, sum(c)::BIGINT AS n_occurrences, count(*) AS n_distinct, count(*) FILTER (k) AS n_known, coalesce(sum(c) FILTER (k), 0)::BIGINT AS n_known_occurrences
  FROM (SELECT source, line_key, count(*) AS c, line_key IN (SELECT line_key FROM dxf_pages WHERE line_key IS NOT NULL) AS k FROM documents WHERE line_key IS NOT NULL GROUP BY 1, 2) GROUP BY source""")
def a7_occurrences(spark, d):
    return stats.occurrences(table(spark, d, "documents"), "line_key", table(spark, d, "dxf_pages"), ["source"])


@query("SELECT multiplicity, count(*) AS n_keys FROM (SELECT o_orderkey, count(l_orderkey) AS multiplicity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1) GROUP BY 1")
def a8_multiplicity(spark, d):
    return stats.multiplicity(table(spark, d, "orders"), table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey")


@query("""SELECT r_name, count(*) FILTER (c_mktsegment = 'AUTOMOBILE') AS automobile, count(*) FILTER (c_mktsegment = 'BUILDING') AS building, count(*) FILTER (c_acctbal < 0) AS in_debt
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def a9_crosstab(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    seg = lambda s: F.count_if(F.col("c_mktsegment") == s)
    return c.groupBy("r_name").agg(seg("AUTOMOBILE").alias("automobile"), seg("BUILDING").alias("building"), F.count_if(F.col("c_acctbal") < 0).alias("in_debt"))


@query(f"WITH {IDF_SQL} SELECT file, count(*) FILTER (code = 41) AS junctions, count(*) FILTER (code IN (35, 36)) AS elbows, count(*) FILTER (code = 120) AS welds FROM g GROUP BY file")
def a10_signature_vector(spark, d):
    n = lambda *c: F.count_if(F.col("code").isin(*c))
    return _idf(spark, d).groupBy("file").agg(n(41).alias("junctions"), n(35, 36).alias("elbows"), n(120).alias("welds"))


@query("""SELECT signature, count(*) AS n FROM (SELECT array_to_string(list_transform(children, lambda c: coalesce(c.prim_type::VARCHAR, '')), '-') AS signature FROM composites WHERE children IS NOT NULL) GROUP BY 1""")
def a11_type_sequences(spark, d):
    types = F.array_join(F.transform("children", lambda c: F.coalesce(c.prim_type.cast("string"), F.lit(""))), "-")
    return table(spark, d, "composites").where("children is not null").select(types.alias("signature")).groupBy("signature").agg(F.count("*").alias("n"))


_REST = """WITH c AS (SELECT composite_id, children, unnest(range(len(children))) AS place FROM (SELECT DISTINCT composite_id, children FROM composites) WHERE len(children) > 2),
  o AS (SELECT composite_id, place, children[place + 1] AS own, list_filter(children, lambda x, j: j <> place + 1) AS rest FROM c)"""


@query(_REST + """ SELECT composite_id, place::INT AS place, 'cover' AS relation FROM o WHERE own.box_left <= list_min(list_transform(rest, lambda x: x.box_left)) AND own.box_bottom <= list_min(list_transform(rest, lambda x: x.box_bottom))
  UNION ALL SELECT composite_id, place::INT, 'equal' FROM o WHERE own.box_left = list_min(list_transform(rest, lambda x: x.box_left)) AND own.box_bottom = list_min(list_transform(rest, lambda x: x.box_bottom))
  UNION ALL SELECT composite_id, place::INT, 'union' FROM o WHERE own.box_left = list_min(list_transform(rest, lambda x: x.box_left)) AND own.box_bottom = list_min(list_transform(rest, lambda x: x.box_bottom))
    AND own.box_right = list_max(list_transform(rest, lambda x: x.box_right)) AND own.box_top = list_max(list_transform(rest, lambda x: x.box_top))
  UNION ALL SELECT composite_id, place::INT, 'left' FROM o WHERE own.box_left = list_min(list_transform(rest, lambda x: x.box_left))""")
def a12_sibling_union(spark, d):
    c = table(spark, d, "composites").select("composite_id", "children").distinct().where("size(children) > 2")
    corner = ("box_left", "box_bottom")
    found = [("cover", stats.sibling_cover(F.col("children"), corner)), ("equal", stats.sibling_union(F.col("children"), corner)), ("union", stats.sibling_union(F.col("children"))), ("left", stats.sibling_union(F.col("children"), ("box_left",)))]
    each = F.array(*[F.struct(F.lit(n).alias("relation"), places.alias("places")) for n, places in found])
    return c.select("composite_id", F.explode(each).alias("r")).select("composite_id", F.explode("r.places").alias("place"), "r.relation")


@query(f"WITH {IDF_SQL} SELECT file, code, round(avg(ax), 6) AS cx, round(avg(ay), 6) AS cy, round(max(az) - min(az), 3) AS rise FROM g WHERE abs(ax) < 1e9 AND abs(ay) < 1e9 AND abs(az) < 1e9 GROUP BY file, code")
def a13_centroids(spark, d):
    g = _idf(spark, d).where("abs(ax) < 1e9 and abs(ay) < 1e9 and abs(az) < 1e9")
    r = lambda c: F.round(c, 3)
    return g.groupBy("file", "code").agg(F.round(F.avg("ax"), 6).alias("cx"), F.round(F.avg("ay"), 6).alias("cy"), r(F.max("az") - F.min("az")).alias("rise"))


@query("SELECT floor(((value * 3.6::DOUBLE) % 180) / 5)::BIGINT * 5 AS bin, count(*) AS n FROM events WHERE value >= 0 GROUP BY 1")
def a14_angle_bins(spark, d):
    e = table(spark, d, "events").where("value >= 0")
    return e.groupBy((F.floor(F.pmod(F.col("value") * 3.6, F.lit(180.0)) / 5) * 5).alias("bin")).agg(F.count("*").alias("n"))


@query("""WITH v AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS u, embedding[4]::DOUBLE AS w FROM embeddings),
  t AS (SELECT * FROM (VALUES ('identity',1,0,0,1),('flip_x',-1,0,0,1),('flip_y',1,0,0,-1),('rotate_180',-1,0,0,-1),('swap',0,1,1,0),('swap_flip_x',0,-1,1,0),('swap_flip_y',0,1,-1,0),('swap_flip_both',0,-1,-1,0)) t(transform,a,b,c,d)),
  s AS (SELECT transform, label, ((a*x+b*y)*u + (c*x+d*y)*w) / sqrt((x*x+y*y)*(u*u+w*w)) AS cosine FROM v, t)
  SELECT transform, count(cosine) AS n, count(*) FILTER (cosine >= 0.9) AS n_inliers, count(DISTINCT label) FILTER (cosine >= 0.9) AS n_samples, round(avg(cosine), 6) AS mean FROM s GROUP BY 1""")
def a15_pose_inliers(spark, d):
    v = table(spark, d, "embeddings").select("label", *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyuw")])
    s = v.select("label", "u", "w", F.explode(geo.symmetric_images(F.col("x"), F.col("y"))).alias("i")).select("label", "i.transform", geo.cosine(F.col("i.x"), F.col("i.y"), F.col("u"), F.col("w")).alias("cosine"))
    return stats.inliers(s, "transform", "label", "cosine", 0.9).select("transform", "n", "n_inliers", "n_samples", F.round("mean", 6).alias("mean"))


@query("""SELECT line_key, sum(coalesce(abs(e - o), 99))::BIGINT AS residual FROM (SELECT line_key, pipe_count AS e, n AS o FROM
  (SELECT line_key, max(page) AS pipe_count FROM dxf_pages WHERE line_key IS NOT NULL GROUP BY 1) LEFT JOIN (SELECT line_key, count(DISTINCT page) AS n FROM pipe_candidates GROUP BY 1) USING (line_key)) GROUP BY 1""")
def a16_residuals(spark, d):
    expected = table(spark, d, "dxf_pages").where("line_key is not null").groupBy("line_key").agg(F.max("page").alias("e"))
    observed = table(spark, d, "pipe_candidates").groupBy("line_key").agg(F.countDistinct("page").alias("o"))
    return expected.join(observed, "line_key", "left").groupBy("line_key").agg(F.sum(F.coalesce(F.abs(F.col("e") - F.col("o")), F.lit(99))).alias("residual"))


@query("""SELECT coalesce(kind, 'unknown') AS kind, count(*) AS n_checked, count(*) FILTER (NOT hit) AS n_uncovered FROM (SELECT evidence_kind AS kind,
  coalesce(dxf_pipe IN (SELECT regexp_extract(trim(from_node, ' '), '^(.*:P[0-9]+):E[0-9]+$', 1) FROM graph_edges WHERE from_node IS NOT NULL), false) AS hit FROM pipe_candidates) GROUP BY 1""")
def a17_coverage_report(spark, d):
    known = table(spark, d, "graph_edges").select(F.regexp_extract(F.trim("from_node"), r"^(.*:P[0-9]+):E[0-9]+$", 1).alias("dxf_pipe")).where("dxf_pipe is not null").distinct()
    rows = table(spark, d, "pipe_candidates").select("evidence_kind", "dxf_pipe").join(known.withColumn("hit", F.lit(True)), "dxf_pipe", "left")
    return rows.groupBy(F.coalesce("evidence_kind", F.lit("unknown")).alias("kind")).agg(F.count("*").alias("n_checked"), F.count_if(F.col("hit").isNull()).alias("n_uncovered"))


@query("""SELECT line_key, count(DISTINCT idf_pipe) - count(DISTINCT dxf_pipe) AS difference, count(*) FILTER (evidence_kind LIKE 'independent%') AS independent, count(*) FILTER (evidence_kind LIKE 'conditional%') AS conditional FROM pipe_candidates GROUP BY 1""")
def a18_difference_ledger(spark, d):
    k = F.col("evidence_kind")
    return table(spark, d, "pipe_candidates").groupBy("line_key").agg(
        (F.countDistinct("idf_pipe") - F.countDistinct("dxf_pipe")).alias("difference"), F.count_if(k.like("independent%")).alias("independent"), F.count_if(k.like("conditional%")).alias("conditional")
    )


@query("""SELECT a.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: abs(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE))) / 64, 6) AS mad FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def a19_grid_difference(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(other, "vec_id").select("vec_id", F.round(stats.mean_absolute_difference(F.col("embedding"), F.col("other")), 6).alias("mad"))


@query("""SELECT skey, count(*) AS n, count(*) FILTER (uci IS NOT NULL AND regexp_full_match(uci, '\\{[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\\}') AND endpoint IS NOT NULL AND endpoint.bore > 0 AND component_identifier IS NOT NULL) AS n_passed FROM weld_blocks GROUP BY 1""".replace("\\\\", "\\"))
def a20_verification(spark, d):
    passed = tx.is_guid(F.col("uci")) & F.col("endpoint").isNotNull() & (F.col("endpoint.bore") > 0) & F.col("component_identifier").isNotNull()
    return table(spark, d, "weld_blocks").groupBy("skey").agg(F.count("*").alias("n"), F.count_if(passed).alias("n_passed"))


# Sequences.

_EV = "SELECT *, epoch(ts) / 86400.0 AS day FROM events"


@query("""SELECT user_id, block, count(*) AS n FROM (SELECT user_id, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS block FROM events) GROUP BY ALL""")
def w1_blocks(spark, d):
    return sequences.blocks(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup").groupBy("user_id", "block").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT drawing_id, graphic_ref, CASE WHEN graphic_ref - lag(graphic_ref) OVER w <= 1 THEN 0 ELSE 1 END AS b FROM (SELECT DISTINCT drawing_id, graphic_ref FROM psm_envelopes WHERE graphic_ref IS NOT NULL) WINDOW w AS (PARTITION BY drawing_id ORDER BY graphic_ref)),
  r AS (SELECT *, sum(b) OVER (PARTITION BY drawing_id ORDER BY graphic_ref)::BIGINT AS run FROM s)
  SELECT drawing_id, run, count(*) AS n, min(graphic_ref) AS first, max(graphic_ref) AS last FROM r GROUP BY 1, 2 HAVING count(*) >= 3""")
def w2_islands(spark, d):
    refs = table(spark, d, "psm_envelopes").select("drawing_id", "graphic_ref").distinct().withColumn("ident", F.col("graphic_ref"))
    return sequences.islands(refs, ["drawing_id"], "graphic_ref", "ident", 1, 3)


@query("""SELECT event_id, coalesce(max(event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), false) AS near_error FROM events""")
def w3_context(spark, d):
    return sequences.near(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", 4, 4, "near_error").select("event_id", "near_error")


@query("""WITH f AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events WHERE event_type IN ('error', 'purchase')) SELECT event_id, user_id FROM f WHERE event_type = 'purchase' AND before = 'error'""")
def w4_pending_marker(spark, d):
    t = F.col("event_type")
    return sequences.pending_marker(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], t == "error", t == "purchase").select("event_id", "user_id")


@query("""WITH s AS (SELECT line_key, page, count(DISTINCT dxf_pipe) AS n FROM pipe_candidates WHERE line_key IS NOT NULL AND page IS NOT NULL GROUP BY 1, 2)
  SELECT line_key, page, n, (sum(n) OVER w - n + 1)::BIGINT AS first, (sum(n) OVER w)::BIGINT AS last FROM s WINDOW w AS (PARTITION BY line_key ORDER BY page)""")
def w5_running_ranges(spark, d):
    sizes = table(spark, d, "pipe_candidates").where("line_key is not null and page is not null").groupBy("line_key", "page").agg(F.countDistinct("dxf_pipe").alias("n"))
    return sequences.running_ranges(sizes, ["line_key"], ["page"], "n")


@query("""WITH p AS (SELECT DISTINCT point_id, drawing_id, page, center_x, center_y FROM point_targets)
  SELECT point_id, 'W' || lpad(r::VARCHAR, greatest(3, len(r::VARCHAR))::INT, '0') AS label FROM (SELECT *, row_number() OVER (PARTITION BY drawing_id ORDER BY page NULLS LAST, center_y NULLS LAST, center_x NULLS LAST, point_id) AS r FROM p)""")
def w6_numbering(spark, d):
    p = table(spark, d, "point_targets").select("point_id", "drawing_id", "page", "center_x", "center_y").distinct()
    order = [F.col(c).asc_nulls_last() for c in ("page", "center_y", "center_x", "point_id")]
    return sequences.numbering(p, ["drawing_id"], order, "W").select("point_id", "label")


@query("""WITH s AS (SELECT idf_file, line_no - lag(line_no) OVER (PARTITION BY idf_file ORDER BY row_id) AS s FROM idf_lines)
  SELECT idf_file, count(*) AS n, coalesce(bool_and(s > 0), true) AS rises, count(*) FILTER (s < 0) AS n_falls, count(*) FILTER (s <> 1) AS n_jumps FROM s GROUP BY 1""")
def w7_transitions(spark, d):
    return sequences.transitions(table(spark, d, "idf_lines"), ["idf_file"], ["row_id"], "line_no")


@query(f"""WITH {IDF_SQL}, n AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY line_no, row) AS at, code FROM g)
  SELECT a.file, a.at AS start, k AS width, count(*) FILTER (b.code = 41) AS n_flagged FROM n a, (SELECT unnest([3, 4, 5]) AS k) w JOIN n b ON b.file = a.file AND b.at BETWEEN a.at AND a.at + k - 1 GROUP BY 1, 2, 3 HAVING count(*) = k""")
def w8_windows(spark, d):
    from pyspark.sql import Window

    n = _idf(spark, d).select("file", F.row_number().over(Window.partitionBy("file").orderBy("line_no", "row")).alias("at"), "code")
    return sequences.windows(n, ["file"], "at", F.col("code") == 41, 3, 5)


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def w9_last_per_key(spark, d):
    return ranking.first_per_key(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("""SELECT line_key, idf_pipe, dxf_pipe, round(score, 6) AS score, round(margin, 6) AS margin FROM (SELECT *, score - lead(score) OVER w AS margin, row_number() OVER w AS r FROM
  (SELECT line_key, idf_pipe, dxf_pipe, max(score) AS score FROM pipe_candidates WHERE score IS NOT NULL AND NOT isnan(score) AND dxf_pipe IS NOT NULL AND idf_pipe IS NOT NULL GROUP BY 1, 2, 3)
  WINDOW w AS (PARTITION BY line_key, idf_pipe ORDER BY score DESC, dxf_pipe)) WHERE r = 1""")
def w10_margin(spark, d):
    best = table(spark, d, "pipe_candidates").where("score is not null and not isnan(score) and dxf_pipe is not null and idf_pipe is not null").groupBy("line_key", "idf_pipe", "dxf_pipe").agg(F.max("score").alias("score"))
    return ranking.best_with_margin(best, ["line_key", "idf_pipe"], "score", "dxf_pipe").select("line_key", "idf_pipe", "dxf_pipe", F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_totalprice, o_orderkey) = 1")
def w11_lexicographic_least(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.min(F.struct("o_orderdate", "o_totalprice", "o_orderkey")).alias("m"))
    return o.select("o_custkey", "m.o_orderkey", "m.o_totalprice")


@query("SELECT s_suppkey, CASE WHEN (dense_rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) - 1) % 2 = 0 THEN 'left' ELSE 'right' END AS side FROM supplier")
def w12_alternate_sides(spark, d):
    return sequences.alternate_sides(table(spark, d, "supplier"), ["s_nationkey"], ["s_acctbal", "s_suppkey"]).select("s_suppkey", "side")


# Order and top-k.


@query("""WITH p AS (SELECT DISTINCT line_key, page_id, page FROM dxf_pages WHERE line_key IS NOT NULL), s AS (SELECT line_key, count(page) = count(*) AND min(page) = 1 AND max(page) = count(*) AND count(DISTINCT page) = count(*) AS ok FROM p GROUP BY 1)
  SELECT line_key, page_id, CASE WHEN ok THEN 'logical' ELSE 'physical' END AS order_basis, row_number() OVER (PARTITION BY line_key ORDER BY CASE WHEN ok THEN page ELSE page_id END NULLS LAST, page_id)::INT AS place FROM p JOIN s USING (line_key)""")
def o1_logical_order(spark, d):
    p = table(spark, d, "dxf_pages").where("line_key is not null").select("line_key", "page_id", "page").distinct()
    return ranking.logical_order(p, ["line_key"], "page", "page_id").select("line_key", "page_id", "order_basis", "place")


@query("SELECT doc_id, n_chars, rank FROM (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, lang NULLS LAST, doc_id)::INT AS rank FROM documents) WHERE rank <= 50")
def o2_review_queue(spark, d):
    top = table(spark, d, "documents").select("doc_id", "n_chars", "lang").orderBy(F.desc("n_chars"), F.col("lang").asc_nulls_last(), "doc_id").limit(50)
    from pyspark.sql import Window

    w = Window.orderBy(F.desc("n_chars"), F.col("lang").asc_nulls_last(), "doc_id")  # over the fifty rows kept
    return top.withColumn("rank", F.row_number().over(w)).select("doc_id", "n_chars", "rank")


@query("SELECT c_nationkey, c_custkey, rank FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)::INT AS rank FROM customer) WHERE rank <= 3")
def o3_top_per_group(spark, d):
    return ranking.top_per_group(table(spark, d, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")], 3).select("c_nationkey", "c_custkey", "rank")


@query("""SELECT user_id, n + 50 * k AS score FROM (SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS k FROM events GROUP BY 1) WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 95) ORDER BY score DESC, user_id LIMIT 20""")
def o4_weighted_sample(spark, d):
    e = table(spark, d, "events")
    rows = e.groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("k"))
    return ranking.weighted_sample(rows, e.where("event_type = 'signup' and value > 95"), "user_id", F.col("n"), F.col("k"), 20).select("user_id", "score")


@query("""WITH f AS (SELECT * FROM documents WHERE source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) = 1)
  SELECT source, lang, doc_id FROM f QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 2""")
def o5_representatives(spark, d):
    docs = table(spark, d, "documents").where("source is not null").select("source", "lang", "doc_id")
    return ranking.representatives(docs, ["source"], "lang", [F.asc("doc_id")], 2).select("source", "lang", "doc_id")


@query("SELECT tag, count(*) AS n FROM dynamic_attributes GROUP BY 1 ORDER BY n DESC, tag NULLS LAST LIMIT 5")
def o6_most_common(spark, d):
    return table(spark, d, "dynamic_attributes").groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.col("tag").asc_nulls_last()).limit(5)


@query("SELECT page_id, dxf_name FROM (SELECT DISTINCT page_id, dxf_name, exported_at FROM dxf_pages) ORDER BY exported_at DESC NULLS LAST, page_id DESC LIMIT 25")
def o7_recency(spark, d):
    p = table(spark, d, "dxf_pages").select("page_id", "dxf_name", "exported_at").distinct()
    return p.orderBy(F.col("exported_at").desc_nulls_last(), F.desc("page_id")).limit(25).select("page_id", "dxf_name")


# Sets.


@query("SELECT family, count(*) AS n FROM (SELECT 'envelope' AS family FROM psm_envelopes UNION ALL SELECT 'weld' FROM weld_blocks UNION ALL SELECT 'point' FROM point_targets) GROUP BY 1")
def u1_union_all(spark, d):
    parts = {"envelope": table(spark, d, "psm_envelopes").select(), "weld": table(spark, d, "weld_blocks").select(), "point": table(spark, d, "point_targets").select()}
    return sets.families(parts).groupBy("family").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT v AS value FROM (SELECT unnest([parent_ref, sheet_ref, root_ref]) AS v FROM composites) WHERE v IS NOT NULL")
def u2_distinct_union(spark, d):
    return sets.distinct_values(table(spark, d, "composites"), ["parent_ref", "sheet_ref", "root_ref"])


@query("SELECT drawing_id, graphic_ref FROM psm_envelopes INTERSECT SELECT drawing_id, graphic_ref FROM dynamic_attributes")
def u3_intersection(spark, d):
    return table(spark, d, "psm_envelopes").select("drawing_id", "graphic_ref").intersect(table(spark, d, "dynamic_attributes").select("drawing_id", "graphic_ref"))


@query("SELECT drawing_id, graphic_ref FROM psm_envelopes EXCEPT SELECT drawing_id, graphic_ref FROM dynamic_attributes")
def u4_difference(spark, d):
    return table(spark, d, "psm_envelopes").select("drawing_id", "graphic_ref").subtract(table(spark, d, "dynamic_attributes").select("drawing_id", "graphic_ref"))


@query("""SELECT tag, least(a, b)::BIGINT AS n_common, greatest(a - b, 0)::BIGINT AS n_extra FROM (SELECT tag, count(*) FILTER (deleted_at IS NULL) AS a, count(*) FILTER (deleted_at IS NOT NULL) AS b FROM dynamic_attributes GROUP BY tag)""")
def u5_multiset_difference(spark, d):
    a = table(spark, d, "dynamic_attributes")
    return sets.multiset_difference(a.where("deleted_at is null"), a.where("deleted_at is not null"), "tag")


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, count(*) AS c FROM lineitem WHERE l_linenumber BETWEEN 1 AND 7 GROUP BY 1, 2)
  SELECT l_orderkey, coalesce(array_to_string(list_sort(list_filter(range(1, 8), lambda i: NOT list_contains(list(l_linenumber), i))), ','), '') AS missing, coalesce(array_to_string(list_sort(list(l_linenumber) FILTER (c > 1)), ','), '') AS duplicates FROM c GROUP BY 1""")
def u6_universe_gaps(spark, d):
    gaps = sets.universe_gaps(table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber", 1, 7)
    return gaps.select("l_orderkey", F.array_join("missing", ",").alias("missing"), F.array_join("duplicates", ",").alias("duplicates"))


@query("SELECT line_key, max(lo) AS first, min(hi) AS last FROM (SELECT line_key, idf_pipe, min(page) AS lo, max(page) + 2 AS hi FROM pipe_candidates WHERE page IS NOT NULL GROUP BY 1, 2) GROUP BY 1 HAVING max(lo) <= min(hi)")
def u7_range_intersection(spark, d):
    r = table(spark, d, "pipe_candidates").where("page is not null").groupBy("line_key", "idf_pipe").agg(F.min("page").alias("lo"), (F.max("page") + 2).alias("hi"))
    return sets.range_intersection(r, ["line_key"], "lo", "hi")


# Record lines.

_IDF = ("idf_file", "line_no", "raw_line", "row_id")


@query(f"""WITH {IDF_SQL} SELECT file, line_no, row, 'I' || lpad(r::VARCHAR, greatest(3, len(r::VARCHAR))::INT, '0') AS label, round(length, 3) AS length FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_no, row) AS r FROM g WHERE code = 100)""")
def s6_pipe_scan(spark, d):
    return idf.numbered(_idf(spark, d)).select("file", "line_no", "row", "label", F.round("length", 3).alias("length"))


@query(f"""WITH {IDF_SQL}, c AS (SELECT *, upper(raw) AS t FROM idf_c WHERE code IS NOT NULL),
  n AS (SELECT *, coalesce(max(contains(t, 'FLOW')) OVER (w ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), false) AS flow, coalesce(max(code IN (35, 36)) OVER (w ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), false) AS elbow,
    coalesce(max(code IN (150, 151, 152)) OVER (w ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING), false) OR lead(code) OVER w IS NULL AS terminal, max(code IN (41, 42, 55)) OVER (PARTITION BY file) AS branched FROM c WINDOW w AS (PARTITION BY file ORDER BY line_no, row))
  SELECT file, line_no, row, flow, elbow, terminal FROM n WHERE code = 100 AND len(f) >= 8 AND len(list_filter(f[9:], lambda x: contains(x, ','))) > 0 AND NOT branched""")
def s7_chain_context(spark, d):
    return idf.chain_context(table(spark, d, "idf_lines"), *_IDF)


@query(f"""WITH {IDF_SQL} SELECT file, row, code, CASE WHEN code = 100 THEN 'I' ELSE 'W' END || lpad(r::VARCHAR, greatest(3, len(r::VARCHAR))::INT, '0') AS label FROM (SELECT *, row_number() OVER (PARTITION BY file, code ORDER BY line_no, row) AS r FROM g WHERE code IN (100, 120))""")
def s8_pipe_weld_numbers(spark, d):
    g = _idf(spark, d)
    return idf.numbered(g).unionByName(idf.numbered(g, 120, "W")).select("file", "row", "code", "label")


@query(f"WITH {IDF_SQL} SELECT file, count(*) AS n_pipes FROM g WHERE code = 100 GROUP BY 1")
def s9_pipe_count(spark, d):
    return _idf(spark, d).where("code = 100").groupBy("file").agg(F.count("*").alias("n_pipes"))


@query(f"""WITH {IDF_SQL}, m AS (SELECT *, code = 149 AND contains(raw, 'FLOW') AS mark FROM idf_c WHERE code = 100 OR (code = 149 AND contains(raw, 'FLOW'))), p AS (SELECT *, coalesce(lag(mark) OVER (PARTITION BY file ORDER BY line_no, row), false) AS pending FROM m),
  q AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_no, row)::INT AS serial FROM p WHERE NOT mark) SELECT file, serial FROM q WHERE pending""")
def s10_flow_marked(spark, d):
    return idf.flow_marked(table(spark, d, "idf_lines"), *_IDF)


@query(f"""WITH {IDF_SQL}, h AS (SELECT file, list_bool_and(list(len(f) = 14 AND list_bool_and(list_transform(f, lambda x: regexp_full_match(x, '[+-]?[0-9]+'))))) AND count(*) = 10 AS ok, flatten(list(f ORDER BY line_no, f)) AS v FROM idf_f WHERE line_no BETWEEN 1 AND 10 GROUP BY 1)
  SELECT file, CASE WHEN ok THEN 'whole' ELSE 'broken' END AS status, CASE WHEN ok THEN try_cast(v[42] AS INT) END AS viewpoint FROM h""")
def s11_switches(spark, d):
    return idf.switches(table(spark, d, "idf_lines"), "idf_file", "line_no", "raw_line")


@query("SELECT page_id, page_json IS NOT NULL AS has_text, len(coalesce(page_json, '')) AS n FROM dxf_pages QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY loaded_at DESC NULLS LAST, page_json DESC NULLS LAST) = 1")
def s15_last_row_per_key(spark, d):
    last = ranking.first_per_key(table(spark, d, "dxf_pages"), ["page_id"], [F.col("loaded_at").desc_nulls_last(), F.col("page_json").desc_nulls_last()])
    return last.select("page_id", F.col("page_json").isNotNull().alias("has_text"), F.length(F.coalesce("page_json", F.lit(""))).cast("long").alias("n"))


@query("""SELECT DISTINCT dxf_name, regexp_extract(dxf_name, '^([A-Z]+[0-9]+)', 1) AS line_key, try_cast(regexp_extract(dxf_name, '-([0-9]+)\\.[a-z]+$', 1) AS INT) AS page FROM dxf_pages WHERE dxf_name IS NOT NULL""".replace("\\\\", "\\"))
def s16_file_keys(spark, d):
    n = F.col("dxf_name")
    return table(spark, d, "dxf_pages").where("dxf_name is not null").select(n, F.regexp_extract(n, "^([A-Z]+[0-9]+)", 1).alias("line_key"), F.nullif(F.regexp_extract(n, r"-([0-9]+)\.[a-z]+$", 1), F.lit("")).try_cast("int").alias("page")).distinct()


QUERIES = {k: f for k, (f, _) in _ALL.items()}
SQL = {k: s for k, (_, s) in _ALL.items() if s}
