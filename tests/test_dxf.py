from spoolmark.sources import dxf, pcf


def test_entities_texts_and_polylines(spark):
    def e(*pairs):
        return "".join(f"  {c}\n{v}\n" for c, v in pairs)

    text = (
        e((0, "SECTION"), (2, "ENTITIES"))
        + e((0, "TEXT"), (5, "A1"), (8, "notes"), (10, 1.0), (20, 2.0), (1, "CONT. ON"))
        + e((0, "MTEXT"), (5, "A2"), (10, 4.0), (20, 2.0), (1, "DRG 7"))
        + e((0, "TEXT"), (5, "A3"), (10, 400.0), (20, 2.0), (1, "SHT 12"))
        + e((0, "LINE"), (5, "B1"), (10, 0.0), (20, 0.0), (11, 3.0), (21, 4.0))
        + e((0, "LWPOLYLINE"), (5, "B2"), (43, 0.5), (70, 0), (10, 0), (20, 0), (10, 1), (20, 0), (10, 1), (20, 1), (10, 0), (20, 0))
        + e((0, "POLYLINE"), (5, "B3"), (70, 1)) + e((0, "VERTEX"), (10, 5), (20, 6)) + e((0, "VERTEX"), (10, 7), (20, 8)) + e((0, "SEQEND"), (5, "z"))
        + e((0, "VERTEX"), (10, 9), (20, 9)) + e((0, "EOF"), ) + "  0"
    )
    lines = pcf.lines_of(spark.createDataFrame([("d", text), ("n", None), ("e", "")], "path string, value string"))
    labels = dxf.texts(lines)
    assert {(r.handle, r.target_page, r.continues) for r in labels.collect()} == {("A1", None, True), ("A2", 7, False), ("A3", 12, False)}
    assert [tuple(r) for r in dxf.paired_labels(labels).collect()] == [("d", "A1", "A2")]
    got = {r.handle: ([tuple(p) for p in r.points], r.closed, r.width) for r in dxf.polylines(lines).collect()}
    assert got == {
        "B1": ([(0, 0), (3, 4)], False, None), "B2": ([(0, 0), (1, 0), (1, 1)], True, 0.5), "B3": ([(5, 6), (7, 8)], True, None),
    }
    assert dxf.entities(lines.limit(0)).count() == 0
