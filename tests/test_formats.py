import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from spoolmark.functions import text as tx
from spoolmark.operators import reports
from spoolmark.sources import compound, raster, records


def test_png_filters_and_broken_bytes():
    import struct
    import zlib

    rng = np.random.default_rng(1)
    grey = rng.integers(0, 256, (9, 7))
    assert (raster.read_png(raster.write_png(grey)) == grey).all()
    # The same image with every filter the format has.
    rows = b""
    for y in range(9):
        kind = y % 5
        line = bytearray([kind])
        for x in range(7):
            left = int(grey[y, x - 1]) if x else 0
            up = int(grey[y - 1, x]) if y else 0
            corner = int(grey[y - 1, x - 1]) if x and y else 0
            p = left + up - corner
            paeth = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
            line.append((int(grey[y, x]) - [0, left, up, (left + up) // 2, paeth][kind]) & 255)
        rows += bytes(line)
    whole = raster.write_png(grey)
    body = zlib.compress(rows)
    at = whole.index(b"IDAT") - 4
    filtered = whole[:at] + raster._chunk(b"IDAT", body) + whole[whole.index(b"IEND") - 4 :]
    assert (raster.read_png(filtered) == grey).all()
    for bad in (b"", b"junk", whole[:20], whole[:60], struct.pack(">I", 7) * 30):
        assert raster.read_png(bad) is None
    assert raster.ink(np.zeros((34, 48))).tolist() == [1.0] * (34 * 48) and raster.ink(np.full((10, 10), 250.0)).sum() == 0


def test_summaries_and_patches(spark):
    made = compound.write_summary({"title": "T é", "author": "", "create_time": 1_700_000_000_000_000})
    assert compound.read_summary(made) == {"title": "T é", "author": "", "create_time": "2023-11-14T22:13:20"}
    assert compound.read_summary(b"") is None and compound.read_summary(made[:40]) is None and compound.read_summary(b"xx" * 50) is None
    blob = compound.write_container({"a": b"1" * 5000, "b": b"2" * 5000})
    d = spark.createDataFrame([(bytearray(blob), "a", bytearray(b"zz")), (bytearray(blob), "none", bytearray(b"z")), (bytearray(b"bad"), "a", None), (None, "a", None)], "c binary, n string, r binary")
    got = [r[0] for r in d.select(compound.appended("c", "n", "r")).collect()]
    assert got[1:] == [None, None, None] and compound.read_streams(bytes(got[0])) == {"a": b"1" * 5000 + b"zz", "b": b"2" * 5000}


def test_audits_and_arrays(spark):
    a = spark.createDataFrame([("j", "left", 1, 1.0, 0.0), ("j", "left", 2, -1.0, 0.0), ("j", "right", 1, 1.0, 0.0), ("j", "right", 2, 0.0, 1.0), ("k", "left", 1, 0.0, 0.0)], "g string, side string, arm int, dx double, dy double")
    assert [tuple(r) for r in reports.arm_geometry(a, ["g"]).collect()] == [("j", 1.0, 0.0, "rejected")]
    l, r = spark.createDataFrame([("a",), ("b",), ("b",)], "g string"), spark.createDataFrame([("a",), ("c",)], "g string")
    assert {x.g: x.status for x in reports.anchor_comparison(l, r, ["g"]).collect()} == {"a": "unique_anchor", "b": "anchor_mismatch", "c": "anchor_mismatch"}
    pairs = spark.createDataFrame([([1, 2, 3],), ([1],), ([],), (None,)], "x array<int>").select(reports.array_pairs(F.col("x")).alias("p")).collect()
    assert [p.p and [tuple(q) for q in p.p] for p in pairs] == [[(1, 2), (1, 3), (2, 3)], None, None, None]
    t = spark.createDataFrame([("g", "7", 0.75, 0.01), ("g", "9", 0.77, 0.01), ("g", "x", 0.753, 0.01), ("h", "7", 0.75, 0.01), ("i", "7", 0.75, 0.5)], "g string, t string, x double, y double")
    fields = {"page": (0.745, 0.765, 0.753), "total": (0.765, 0.790, 0.773)}
    assert [tuple(r) for r in tx.positional_digits(t, ["g"], "t", "x", "y", fields, (0.0, 0.015)).collect()] == [("g", 7, 9)]


def test_styles_and_views(spark):
    from struct import pack

    s = spark.createDataFrame([("f", "Sheet6", bytearray(b"\x00" + pack("<4d", 0.84, 0.6, 0.7, 0))), ("f", "Sheet2", bytearray(b"x" * 300)), ("g", "Sheet2", None)], "path string, stream string, data binary")
    got = {(r.path, r.stream): (r.basis, round(r.width, 3)) for r in records.viewboxes(s).collect()}
    assert got == {("f", "Sheet6"): ("own", 14112.0), ("f", "Sheet2"): ("inherited", 14112.0), ("g", "Sheet2"): ("default", 16800.0)}
    assert records.scan_style_widths(records.pack_style_width(5, 0.001) + records.pack_style_width(0, 0.001) + records.pack_style_width(5, 0.5)) == [(0, 5, 16.8)]
    assert records.scan_style_widths(b"") == [] and records.scan_viewbox(b"abc") == []


def test_patched_containers_are_made_and_read_without_a_shuffle(spark):
    from spoolmark.queries import formats

    # A join of containers kept batches of them in memory, and a frame for each group and container took the time.
    made = formats.k4_patched_streams(spark, "/root/testdata/sf0.001")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "InPandas" in plan and "FlatMapGroupsInPandas" not in plan and "ArrowEvalPython" not in plan
    grown = {r.grown: r for r in made.groupBy("grown").agg(F.count("*").alias("n"), F.min("n_bytes").alias("least")).collect()}
    assert grown[True].least == 4096 + 56 and grown[False].least == 4096


def test_containers_are_handed_over_in_slices(spark):
    blob = compound.write_container({"a": b"1" * 5000, "b": b"2" * 9000})
    rows = [("p", bytearray(blob)), ("q", bytearray(b"bad")), ("r", bytearray(blob)), ("s", bytearray())]
    got = {(r.path, r.stream): (len(r.data or b""), r.status[:11]) for r in compound.streams(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got == {("p", "a"): (5000, "whole"), ("p", "b"): (9000, "whole"), ("r", "a"): (5000, "whole"), ("r", "b"): (9000, "whole"), ("q", None): (0, "unvalidated"), ("s", None): (0, "unvalidated")}
    # A chain that runs into itself is told, as is one that leaves the file.
    (fat,) = struct.unpack_from("<I", blob, 76)
    for target in (0, 10**6):
        broken = bytearray(blob)
        struct.pack_into("<I", broken, (fat + 1) * 512 + 4 * 3, target)
        with pytest.raises(compound.BrokenContainer):
            compound.read_streams(bytes(broken))
    assert compound.with_records(blob, "a", b"zz") is not None and compound.with_records(blob, "c", b"") is None and compound.with_records(b"bad", "a", b"") is None


def _moved(spark, tmp_path, name, **ids):
    """A folder with the rows of a table of the smallest data, its ids moved."""
    t = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
    t.withColumns({c: F.col(c) + by for c, by in ids.items()}).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def _as_sql(spark, d, name, tables):
    import duckdb

    import __spark_entry__ as entry

    c = duckdb.connect()
    for t in tables:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    made = entry.queries()[name](spark, d)
    plan = made._jdf.queryExecution().executedPlan().toString()
    got, want = sorted(tuple(r) for r in made.collect()), sorted(c.execute(entry.oracle_sql()[name]).fetchall())
    assert got == want and got
    return plan


def test_many_streams_are_scanned_at_once(spark):
    line = records.pack_line((7, 1, 2, 3), (0.1, 0.1, 0.2, 0.2))
    composite = records.pack_composite(1, 2, [(7, 1, 2, 3, 4, 2), (8, 0, 0, 1, 1, 9)])
    circle = records.pack_circle((4, 9, 2, 3), (0.5, 0.25, 0.01))
    # Records cut between two streams count in neither.
    bodies = [b"", line, b"x" + line + composite, line[:20], line[20:], composite[:40], composite[40:], circle[:60], circle[60:], circle * 2, b""]
    s = spark.createDataFrame([(f"p{k}", "s", bytearray(x)) for k, x in enumerate(bodies)] + [("null", "s", None)], "path string, stream string, data binary").coalesce(1)
    for family, scanner in (("line", records.scan_lines), ("composite", records.scan_composites), ("circle", records.scan_circles), ("companion", records.scan_companions)):
        want = [(f"p{k}", "s", *r) for k, x in enumerate(bodies) for r in scanner(x)]
        assert [tuple(r) for r in records.scan(s, family).collect()] == want and want
    assert [r[0] for r in records.scan_composites(b"x" + line + composite)] == [57, 57] and records.scan_composites(composite)[1][3:5] == (1, 8)


def test_lines_of_many_parts_and_wide_ids(spark, tmp_path):
    d = _moved(spark, tmp_path, "psm_envelopes", envelope_id=2**33 + 5)
    assert "FlatMapGroupsInPandas" not in _as_sql(spark, d, "s18_drawn_lines", ["psm_envelopes"])


def test_circles_of_wide_ids(spark, tmp_path):
    # Twice an id from 2**31 on has no room in a reference of 32 bits.
    for k, by in enumerate((2**31 - 700, 2**32 - 700, 2**33 + 7)):
        assert "FlatMapGroupsInPandas" not in _as_sql(spark, _moved(spark, tmp_path / str(k), "point_targets", point_id=by), "s21_circle_scan", ["point_targets"])


def test_closed_frames_in_one_pass(spark, tmp_path):
    square = [(0.1, 0.1, 0.2, 0.1), (0.2, 0.1, 0.2, 0.2), (0.2, 0.2, 0.1, 0.2), (0.1, 0.2, 0.1, 0.1)]
    rows = [("a", *s) for s in square] + [("b", *s) for s in square[:3]] + [("c", 1.1, 0.5, 1.1, 0.5)] + [(None, *s) for s in square]
    lines = spark.createDataFrame(rows, "g string, x1 double, y1 double, x2 double, y2 double")
    v = records.closed_frames(lines, ["g"])
    assert v.columns == ["g", "n_lines", "closed", "inside"] and sorted(tuple(r) for r in v.collect()) == [("a", 4, True, True), ("b", 3, False, True), ("c", 1, True, False)]
    plan = _as_sql(spark, _moved(spark, tmp_path, "psm_envelopes", envelope_id=2**33 + 5), "x11_closed_frames", ["psm_envelopes"])
    assert "Join" not in plan and "FlatMapGroupsInPandas" not in plan
