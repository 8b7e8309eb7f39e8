import math
import struct

import pytest
from pyspark.sql import functions as F

from spoolmark.sources import compound, pcf, records, sinks

STREAMS = "path string, stream string, data binary"


def streams(spark, **named):
    return spark.createDataFrame([("f", n, bytearray(b)) for n, b in named.items()] + [("f", "none", None), ("f", "empty", bytearray(b""))], STREAMS)


def test_container_round_trip(spark):
    want = {"Sheet1": b"a" * 5000, "JSite7/CONTENTS": b"BM" + b"x" * 9000, "JSite7/Info": b"y" * 4096, "deep/er/Sheet221": bytes(range(256)) * 40}
    blob = compound.write_container(want)
    assert compound.read_streams(blob) == want
    files = spark.createDataFrame([("ok", bytearray(blob)), ("bad", bytearray(b"junk")), ("short", bytearray(blob[:2000])), ("null", None)], "path string, content binary")
    rows = compound.streams(files).collect()
    assert {r.stream: bytes(r.data) for r in rows if r.path == "ok"} == want
    assert all(r.status.startswith("unvalidated") for r in rows if r.path != "ok") and {r.path for r in rows} == {"ok", "bad", "short"}
    assert [r.stream for r in compound.sheets(compound.streams(files)).collect()] == ["Sheet1"]
    # A chain that returns to itself is told, not followed.
    loop = bytearray(blob)
    fat_at = struct.unpack_from("<I", blob, 76)[0]
    struct.pack_into("<I", loop, 512 * (fat_at + 1), 0)
    with pytest.raises(compound.BrokenContainer):
        compound.read_streams(bytes(loop))


def test_records(spark):
    line = records.pack_line((11, 12, 13, 14), (0.1, 0.2, 0.3, 0.4))
    short = records.pack_line((21, 22, 23, 24), (0.1, 0.2, 0.1001, 0.2))
    outside = records.pack_line((1, 1, 1, 1), (0.1, 0.2, 3.0, 0.4))
    arc = struct.pack("<HIIIIHI5d", 0x61, 59, 1, 2, 3, 0, 4, 0.5, 0.5, 0.01, 0.0, math.pi / 2) + b"\x00"
    still = struct.pack("<HIIIIHI5d", 0x61, 59, 1, 2, 3, 0, 4, 0.5, 0.5, 0.01, 1.0, 1.0) + b"\x00"
    text = records.pack_text((1, 2, 3, 4), "焊口 W1", (0.5, 0.6, 1.0, 0.0))
    comp = records.pack_composite(7, 8, [(21, 1, 2, 3, 4, 2), (30, 5, 6, 7, 8, 5)])
    data = b"\x05" + line + short + outside + b"\x00" + arc + still + text + comp + comp[:-10]
    s = streams(spark, Sheet1=data)
    got = records.scan(s, "line").collect()
    assert [(r.child_ref, r.graphic_ref, r.layer_ref, r.style_ref, r.x2) for r in got] == [(11, 12, 13, 14, 0.3), (21, 22, 23, 24, 0.1001)]
    drawn = records.renderable_lines(records.scan(s, "line"), records.scan(s, "composite")).collect()
    assert {r.child_ref for r in drawn} == {11, 21}
    assert [round(r.sweep, 6) for r in records.scan(s, "arc").collect()] == [round(math.pi / 2, 6)]
    assert [(r.text, r.x) for r in records.scan(s, "text").collect()] == [("焊口 W1", 0.5)]
    assert [(r.parent_ref, r.place, r.child_ref, r.prim_type) for r in records.scan(s, "composite").collect()] == [(7, 0, 21, 2), (7, 1, 30, 5)]


def test_circles_attributes_nodes_envelopes(spark):
    circle = struct.pack("<HIIIIHI3d", 0x59, 0x2B, 5, 6, 7, 0, 8, 0.5, 0.5, 0.02)
    companion = bytearray(105)
    struct.pack_into("<HIII", companion, 0, 0x13, 99, 6, 6)
    struct.pack_into("<3d", companion, 35, 0.5, 0.5, 0.02)
    tlv = lambda k, v: b"\x10\x80" + struct.pack("<H", len(k) + len(v) + 2) + b"\x01" + k.encode() + b"\x00" + v.encode() + b"\x00"
    tail = b"\x89\x00" + struct.pack("<II", 20, 9) + b"\x00" * 8 + struct.pack("<I", 77) + b"\xff\xff\x00\x00"
    uci = "{0000071F-0000-0000-85D6-916C0D90AADE}"
    attribute = b"\x00" * 5 + b"PipeLine Info\x00"
    nodes = b"tseg" + b"\x00" * 8 + struct.pack("<4H", 1, 2, 1, 0) + struct.pack("<IH", 99, 201)
    prefixed = b"tseg" + b"\x00" * 8 + struct.pack("<HHH", 2, 5, 6) + struct.pack("<4H", 3, 4, 0, 1)
    run = records.pack_envelopes([(k, 10 * k, 10, 10 * k + 5, 20, 1) for k in (1, 2, 3)])
    s = streams(
        spark, Sheet1=circle + bytes(companion), attrs=attribute + tlv("UCI", uci) + tlv("Tag", "ELBOW") + tail + attribute + tail + attribute + tlv("UCI", "x") + tail + attribute,
        nodes=nodes, prefixed=prefixed, cut=nodes[:-3], psm=b"\xff" * 9 + run + b"\xff" * 9 + run[:28],
    )
    assert [(r.graphic_ref, r.companion_radius) for r in records.circles(s).collect()] == [(6, 0.02)]
    assert [(r.graphic_ref, r.record_kind, r.properties) for r in records.scan(s, "attribute").orderBy("offset").collect()] == [(77, "instance", f"UCI={uci}\nTag=ELBOW"), (77, "stub", ""), (77, "partial", "UCI=x")]
    found = {r.stream: (r.layout, r.status, r.node_id, r.ref) for r in records.scan(s.where("stream in ('nodes', 'prefixed', 'cut')"), "node").collect()}
    assert found == {"nodes": ("standard", "whole", 1, 99), "prefixed": ("prefixed", "whole", 3, None), "cut": (None, "partial", None, None)}
    assert [(r.run, r.graphic_ref) for r in records.scan(s.where("stream = 'psm'"), "envelope").collect()] == [(0, 1), (0, 2), (0, 3)]


def test_two_points_keep_the_last_copy(spark):
    head = lambda child, ref: struct.pack("<I7H", child, ref, 0, 1200, 0, 0, 5, 0)
    data = head(9, 1) + struct.pack("<4d", 0.1, 0.1, 0.2, 0.2) + head(9, 2) + struct.pack("<4d", 0.2, 0.2, 0.1, 0.1) + b"\x00" * 40
    assert [(r.object_ref, r.child_ref) for r in records.scan(streams(spark, Sheet1=data), "two_point").collect()] == [(2, 9)]


TEXT = """PIPELINE-REFERENCE L1
PIPE
    COMPONENT-IDENTIFIER    4
    END-POINT    1.0    2.0    3.0    50
    END-POINT    -5.0    2.0    3.0    50
    UCI    {A}
MATERIALS
    ITEM 1
WELD
    UCI    {B}
    END-POINT    -1.0    2.0    3.0    50.0
    WELD-REMARK-NUMBER    7
    WELD-REMARK-NUMBER    8
    SKEY    WW
    SKEY    WS
PIPE-FIXED
    COMPONENT-IDENTIFIER    5
"""


def test_component_text(spark, tmp_path):
    (tmp_path / "a.pcf").write_bytes(TEXT.replace("\n", "\r\n").encode())
    lines = pcf.read(spark, str(tmp_path / "*.pcf"))
    assert [(r.kind, r.id, r.uci, len(r.points)) for r in pcf.components(lines).collect()] == [("PIPE", 4, "{A}", 1)]
    weld = pcf.welds(lines).collect()
    assert [(r.uci, r.skey, r.endpoint.x, r.endpoint.bore) for r in weld] == [("{B}", "WS", -1.0, 50.0)]
    assert [(r.id, r.start.e, r.end.e) for r in pcf.pipes(lines).collect()] == [(4, 1.0, -5.0)]
    assert [(r.kind, r.weld_id) for r in pcf.diagnostics(lines).orderBy("block").collect()] == [("PIPE", None), ("WELD", "8")]
    blocks = pcf.blocks(lines, ["path"], ["pos"], pcf.any_header(F.col("line"))).where("line = 'WELD'").select("path", "block", F.lit("W01").alias("number"))
    text = pcf.whole_text(pcf.renumber(lines, blocks)).first()["value"]
    assert text == TEXT.replace("NUMBER    7", "NUMBER    W01")
    assert pcf.components(lines.limit(0)).count() == 0


def test_sinks(spark, tmp_path):
    files = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"2")), ("c", bytearray(b"1"))], "path string, content binary")
    where = str(tmp_path / "store")
    assert sinks.store_sources(files, where) == 2
    assert sinks.store_sources(files, where) == 0
    assert tuple(sinks.integrity(spark.read.parquet(where)).first()) == (2, 2, True)
    e = spark.createDataFrame([(1, 0, 2, 0.0, 0.0, 5.0, 5.0, "a<b"), (1, 0, 1, 1.0, 1.0, 2.0, 2.0, None)], "page int, layer int, ord int, x1 double, y1 double, x2 double, y2 double, label string")
    svg = sinks.svg_pages(e, ["page"], 10, 10).first()["value"]
    assert svg.index('x1="1"') < svg.index('x1="0"') and "a&lt;b" in svg
    sinks.write_csv(e.select("page", "label"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    sinks.write_json(e, str(tmp_path / "json"), ["page"])
    assert spark.read.json(str(tmp_path / "json")).count() == 2

    lines = sinks.report(e.select("page", "label"), "Labels")
    sinks.write_report(lines, str(tmp_path / "report"))
    whole = [r.value for r in spark.read.text(str(tmp_path / "report" / "markdown")).collect()]
    assert "# Labels" in whole and "| 1 | a<b |" in whole
