"""Scanners of little-endian binary records inside byte streams.

Every family is found by numpy over the whole stream, framed by its declared
length and kept only if all bounds hold; a scanner is total: malformed or
truncated bytes give no row and never an error.  Streams (path, stream, data)
are scanned where they lie, one narrow pass without a shuffle.

Defined results: null or empty data gives no rows; overlapping signatures are
judged each on its own.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

PAGE_UNITS = 16_800
BOX_LIMIT = 16_800
_L, _D, _S, _I = T.LongType(), T.DoubleType(), T.StringType(), T.IntegerType()
_ARROW = {T.LongType: pa.int64(), T.DoubleType: pa.float64(), T.StringType: pa.string(), T.IntegerType: pa.int32()}


def _u16(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    return b[at].astype(np.int64) | b[at + 1].astype(np.int64) << 8


def _u32(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    return _u16(b, at) | _u16(b, at + 2) << 16


def _f64(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    if not len(at):
        return np.zeros(0)
    return np.ascontiguousarray(b[at[:, None] + np.arange(8)]).view("<f8").ravel()


def _find(data: bytes, mark: bytes, room: int) -> np.ndarray:
    """Offsets of a signature with ``room`` bytes after its start."""
    at = np.array([m.start() for m in re.finditer(b"(?=" + re.escape(mark) + b")", data)], np.int64)
    return at[at + room <= len(data)]


def _found(data: bytes, ends: np.ndarray, mark: bytes, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of a signature in streams that lie one behind the other up to ``ends``, and the stream of each; it and its ``room`` lie in one stream."""
    at = np.array([m.start() for m in re.finditer(b"(?=" + re.escape(mark) + b")", data)], np.int64)
    owner = np.searchsorted(ends, at, side="right")
    whole = at + room <= ends[owner]
    return at[whole], owner[whole]


def _within(at: np.ndarray, owner: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return at - np.concatenate(([0], ends))[owner]


def _alone(many: Callable, data: bytes) -> list[tuple]:
    """Records of one stream by a scanner of many."""
    return list(zip(*[c.tolist() for c in many(data, np.array([len(data)]))[1]])) if data else []


def many_lines(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    b, (at, owner) = np.frombuffer(data, np.uint8), _found(data, ends, b"\x18\x00\x32\x00\x00\x00", 56)
    xy = np.stack([_f64(b, at + 24 + 8 * k) for k in range(4)])
    ok = ((xy >= -0.03) & (xy <= 1.05)).all(axis=0)
    at, owner, xy = at[ok], owner[ok], xy[:, ok]
    return owner, [_within(at, owner, ends), *[_u32(b, at + k) for k in (6, 10, 14, 20)], *xy]


def scan_lines(data: bytes) -> list[tuple]:
    """18/32 two-point lines: (offset, child_ref, graphic_ref, layer_ref, style_ref, x1, y1, x2, y2), coordinates in -0.03..1.05."""
    return _alone(many_lines, data)


def scan_two_points(data: bytes) -> list[tuple]:
    """Two-point segments behind a 14-byte head of seven words, every second offset: (offset, object_ref, child_ref, x1, y1, x2, y2).

    Of segments with the same undirected ends (6 digits) and child the last one counts.
    """
    b = np.frombuffer(data, np.uint8)
    at = np.arange(0, max(0, len(b) - 46), 2)
    if not len(at):
        return []
    w = [_u16(b, at + 2 * k) for k in range(7)]
    ok = (w[1] == 0) & (w[3] == 0) & (w[4] == 0) & (w[6] == 0) & (w[2] >= 1100) & (w[2] <= 1500) & (w[5] >= 1) & (w[5] <= 1000)
    at, ref = at[ok], w[0][ok]
    xy = np.stack([_f64(b, at + 14 + 8 * k) for k in range(4)], axis=1) if len(at) else np.zeros((0, 4))
    size = np.hypot(xy[:, 2] - xy[:, 0], xy[:, 3] - xy[:, 1]) * PAGE_UNITS
    ok = ((xy >= 0.01) & (xy <= 1)).all(axis=1) & (size >= 4)
    unique: dict[tuple, tuple] = {}
    for o, r, p in zip(at[ok].tolist(), ref[ok].tolist(), xy[ok].tolist()):
        child = struct.unpack_from("<I", data, o - 4)[0] if o >= 4 else 0
        ends = tuple(sorted(((round(p[0], 6), round(p[1], 6)), (round(p[2], 6), round(p[3], 6)))))
        unique[(*ends, child)] = (o, r, child, *p)
    return list(unique.values())


def many_composites(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    b, (at, owner) = np.frombuffer(data, np.uint8), _found(data, ends, b"\x7b\x00", 34)
    length, count = _u32(b, at + 2), _u32(b, at + 22)
    ok = (count >= 1) & (count <= 100) & (length == 32 + 14 * count) & (at + 6 + length <= ends[owner])
    at, owner, count = at[ok], owner[ok], count[ok]
    each = np.repeat(np.arange(len(at)), count)
    place = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
    at, owner = at[each], owner[each]
    child = at + 34 + 14 * place
    return owner, [_within(at, owner, ends), _u32(b, at + 6), _u32(b, at + 10), place, _u32(b, child), *[_u16(b, child + 4 + 2 * k) for k in range(5)]]


def scan_composites(data: bytes) -> list[tuple]:
    """7B composites: (offset, parent_ref, sheet_ref, place, child_ref, left, bottom, right, top, prim_type), one row per child."""
    return _alone(many_composites, data)


def scan_arcs(data: bytes) -> list[tuple]:
    """61 arcs: (offset, primitive_ref, graphic_ref, layer_ref, style_ref, cx, cy, radius, start, end, sweep); sweep in [-pi, pi), none of 0."""
    b, at = np.frombuffer(data, np.uint8), _find(data, b"\x61\x00", 65)
    at = at[_u32(b, at + 2) == 59]
    v = np.stack([_f64(b, at + 24 + 8 * k) for k in range(5)], axis=1) if len(at) else np.zeros((0, 5))
    with np.errstate(invalid="ignore"):
        sweep = np.mod(v[:, 4] - v[:, 3] + math.pi, 2 * math.pi) - math.pi
        ok = (v[:, :2] >= 0).all(axis=1) & (v[:, :2] <= 1).all(axis=1) & (v[:, 2] > 0) & (v[:, 2] < 0.1) & np.isfinite(v).all(axis=1) & (np.abs(sweep) >= 1e-6)
    at, v, sweep = at[ok], v[ok], sweep[ok]
    return list(zip(at.tolist(), *[_u32(b, at + k).tolist() for k in (6, 10, 14, 20)], *v.T.tolist(), sweep.tolist()))


def many_circles(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    b, (at, owner) = np.frombuffer(data, np.uint8), _found(data, ends, b"\x59\x00\x2b\x00\x00\x00", 48)
    v = np.stack([_f64(b, at + 24 + 8 * k) for k in range(3)])
    ok = np.isfinite(v).all(axis=0)
    at, owner, v = at[ok], owner[ok], v[:, ok]
    return owner, [_within(at, owner, ends), *[_u32(b, at + k) for k in (6, 10, 14, 20)], *v]


def scan_circles(data: bytes) -> list[tuple]:
    """59/2B circles: (offset, primitive_ref, graphic_ref, layer_ref, style_ref, cx, cy, radius)."""
    return _alone(many_circles, data)


def many_companions(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    b, (at, owner) = np.frombuffer(data, np.uint8), _found(data, ends, b"\x13\x00\x63\x00\x00\x00", 105)
    v = np.stack([_f64(b, at + 35 + 8 * k) for k in range(3)])
    with np.errstate(invalid="ignore", over="ignore"):
        ok = (v[2] > 0) & (v[2] < 0.1) & np.isfinite(v[0] + v[1])
    at, owner, v = at[ok], owner[ok], v[:, ok]
    return owner, [_within(at, owner, ends), _u32(b, at + 6), _u32(b, at + 10), *v]


def scan_companions(data: bytes) -> list[tuple]:
    """13/63 circle companions of 99 bytes: (offset, primitive_ref, graphic_ref, cx, cy, radius), radius in (0, 0.1)."""
    return _alone(many_companions, data)


def scan_texts(data: bytes) -> list[tuple]:
    """4D texts in both frames: (offset, child_ref, secondary_ref, layer_ref, style_ref, text, x, y, dx, dy)."""
    rows = []
    for o in _find(data, b"\x4d\x00", 66).tolist():
        length = struct.unpack_from("<I", data, o + 2)[0]
        n = struct.unpack_from("<H", data, o + 28)[0]
        for start, frame in ((30, 60), (38, 68)):
            if length != frame + 2 * n or o + 6 + length > len(data) or not n:
                continue
            try:
                text = data[o + start : o + start + 2 * n].decode("utf-16-le")
            except UnicodeDecodeError:
                continue
            if o + start + 2 * n + 32 > len(data):
                continue
            xy = struct.unpack_from("<4d", data, o + start + 2 * n)
            if text.isprintable() and all(map(math.isfinite, xy)):
                rows.append((o, *[struct.unpack_from("<I", data, o + k)[0] for k in (6, 10, 14, 20)], text, *xy))
                break
    return rows


def scan_envelopes(data: bytes, least: int = 3) -> list[tuple]:
    """Runs of at least ``least`` adjacent 14-byte envelopes: (offset, run, place, graphic_ref, left, bottom, right, top, tag).

    All 14 alignments are judged at once: a record is plausible when its box is
    proper and inside the page; runs are the maximal chains of plausible
    records 14 bytes apart.  Where chains of two alignments overlap, the longer
    one counts, of equally long ones that with the smaller references and tags.
    """
    b = np.frombuffer(data, np.uint8)
    n = len(b) - 13
    if n <= 0:
        return []
    at = np.arange(n)
    left, bottom, right, top = (_u16(b, at + 4 + 2 * k) for k in range(4))
    ref = _u32(b, at)
    ok = (ref > 0) & (left < right) & (bottom < top) & (right <= BOX_LIMIT) & (top <= BOX_LIMIT)
    length = np.zeros(n + 14, np.int64)
    for o in np.flatnonzero(ok)[::-1].tolist():
        length[o] = length[o + 14] + 1
    heads = ok.copy()
    heads[14:] &= ~ok[:-14]
    heads &= length[:n] >= least
    word = _u16(b, at + 12) + ref
    cost = {o: int(word[o : o + 14 * int(length[o]) : 14].sum()) for o in np.flatnonzero(heads).tolist()}
    taken = np.zeros(n + 14, bool)
    kept = []
    for o in sorted(np.flatnonzero(heads).tolist(), key=lambda o: (-length[o], cost[o], o)):
        end = o + 14 * int(length[o])
        if not taken[o:end].any():
            taken[o:end] = True
            kept.append(o)
    rows = []
    for run, o in enumerate(sorted(kept)):
        for k in range(int(length[o])):
            p = o + 14 * k
            rows.append((p, run, k, int(ref[p]), int(left[p]), int(bottom[p]), int(right[p]), int(top[p]), int(_u16(b, np.array([p + 12]))[0])))
    return rows


_TLV = b"\x10\x80"
_TAIL = re.compile(rb"\x89\x00(....)(....)\x00{8}(....)\xff\xff\x00\x00", re.S)


def scan_attributes(data: bytes) -> list[tuple]:
    """Bounded dynamic attributes: (offset, space_ref, graphic_ref, uci, kind, properties as key=value lines).

    Properties (size-framed key and value texts) must run without a gap from
    the name to the tail.  kind is instance with a braced GUID as UCI, stub
    without properties, partial otherwise.
    """
    rows = []
    name = b"PipeLine Info\x00"
    for o in _find(data, name, len(name)).tolist():
        at, properties = o + len(name), []
        while data[at : at + 2] == _TLV and at + 5 <= len(data):
            size = struct.unpack_from("<H", data, at + 2)[0]
            body = data[at + 5 : at + 5 + size]
            key, sep, rest = body.partition(b"\x00")
            if len(body) != size or not sep or not rest.endswith(b"\x00"):
                break
            properties.append((key.decode("latin-1"), rest[:-1].decode("latin-1")))
            at += 5 + size
        tail = _TAIL.match(data, at)
        if not tail:
            continue
        _, space, graphic = (struct.unpack("<I", g)[0] for g in tail.groups())
        uci = next((v for k, v in properties if k == "UCI"), None)
        kind = "stub" if not properties else "instance" if uci and re.fullmatch(r"\{[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\}", uci) else "partial"
        rows.append((o, space, graphic, uci, kind, "\n".join(f"{k}={v}" for k, v in properties)))
    return rows


def _nodes(data: bytes, at: int) -> list[tuple] | None:
    rows = []
    while at < len(data):
        if at + 8 > len(data):
            return None
        node, kind, count, repeat = struct.unpack_from("<4H", data, at)
        at += 8
        if at + 6 * count > len(data):
            return None
        rows += [(node, kind, repeat, k, *struct.unpack_from("<IH", data, at + 6 * k)) for k in range(count)] or [(node, kind, repeat, None, None, None)]
        at += 6 * count
    return rows


def scan_nodes(data: bytes) -> list[tuple]:
    """Node tables: (layout, status, node_id, node_type, repeat, place, ref, relation).

    Layouts are tried in order, and the first that consumes the whole stream
    wins: ``standard`` (nodes after 12 bytes), ``prefixed`` (a counted list of
    words first).  Without one, a single row tells the status.
    """
    if data[:4] != b"tseg":
        return [(None, "no_table", None, None, None, None, None, None)]
    tries = [("standard", 12)]
    if len(data) >= 14:
        tries.append(("prefixed", 14 + 2 * struct.unpack_from("<H", data, 12)[0]))
    for layout, at in tries:
        rows = _nodes(data, at) if at <= len(data) else None
        if rows is not None:
            return [(layout, "whole", *r) for r in rows] or [(layout, "whole", None, None, None, None, None, None)]
    return [(None, "partial", None, None, None, None, None, None)]


def _fields(*pairs: tuple[str, T.DataType]) -> list[T.StructField]:
    return [T.StructField(n, t) for n, t in pairs]


_XY4 = (("x1", _D), ("y1", _D), ("x2", _D), ("y2", _D))
_REFS = (("primitive_ref", _L), ("graphic_ref", _L), ("layer_ref", _L), ("style_ref", _L))
_BOX = (("box_left", _I), ("box_bottom", _I), ("box_right", _I), ("box_top", _I))
FAMILIES: dict[str, tuple[Callable[[bytes], list[tuple]], list[T.StructField]]] = {
    "line": (scan_lines, _fields(("offset", _L), ("child_ref", _L), ("graphic_ref", _L), ("layer_ref", _L), ("style_ref", _L), *_XY4)),
    "two_point": (scan_two_points, _fields(("offset", _L), ("object_ref", _L), ("child_ref", _L), *_XY4)),
    "composite": (scan_composites, _fields(("offset", _L), ("parent_ref", _L), ("sheet_ref", _L), ("place", _I), ("child_ref", _L), *_BOX, ("prim_type", _I))),
    "arc": (scan_arcs, _fields(("offset", _L), *_REFS, ("cx", _D), ("cy", _D), ("radius", _D), ("start_angle", _D), ("end_angle", _D), ("sweep", _D))),
    "circle": (scan_circles, _fields(("offset", _L), *_REFS, ("cx", _D), ("cy", _D), ("radius", _D))),
    "companion": (scan_companions, _fields(("offset", _L), ("primitive_ref", _L), ("graphic_ref", _L), ("cx", _D), ("cy", _D), ("radius", _D))),
    "text": (scan_texts, _fields(("offset", _L), ("child_ref", _L), ("secondary_ref", _L), ("layer_ref", _L), ("style_ref", _L), ("text", _S), ("x", _D), ("y", _D), ("dx", _D), ("dy", _D))),
    "envelope": (scan_envelopes, _fields(("offset", _L), ("run", _I), ("place", _I), ("graphic_ref", _L), *_BOX, ("opaque_tag", _I))),
    "attribute": (scan_attributes, _fields(("offset", _L), ("space_ref", _L), ("graphic_ref", _L), ("uci", _S), ("record_kind", _S), ("properties", _S))),
    "node": (scan_nodes, _fields(("layout", _S), ("status", _S), ("node_id", _I), ("node_type", _I), ("repeat", _I), ("place", _I), ("ref", _L), ("relation", _I))),
}


#: Scanners of many streams at once: (data, ends) -> stream of each record, columns.
MANY: dict[str, Callable[[bytes, np.ndarray], tuple[np.ndarray, list[np.ndarray]]]] = {"line": many_lines, "composite": many_composites, "circle": many_circles, "companion": many_companions}
#: About so many bytes of streams are scanned and handed over at a time.
SLICE_BYTES = 4 << 20


def scan(streams: DataFrame, family: str) -> DataFrame:
    """Records of a family in ``streams(path, stream, data)``, each with its path and stream.

    Streams are scanned and handed over many at a time, as a call or a frame for each would cost more than its records.
    """
    scanner, fields = FAMILIES[family]
    schema = T.StructType([T.StructField("path", _S), T.StructField("stream", _S), *fields])
    many = MANY.get(family)
    kinds = [_ARROW[type(f.dataType)] for f in fields]

    def records_of(bodies: list[bytes]) -> tuple[list | np.ndarray, list]:
        if many:
            return many(b"".join(bodies), np.cumsum([len(x) for x in bodies]))
        owner, rows = [], []
        for k, data in enumerate(bodies):
            own = scanner(data) if data else []
            owner += [k] * len(own)
            rows += own
        return owner, list(zip(*rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, stream, data = (batch.column(k) for k in range(3))
            sizes = np.cumsum(pc.binary_length(data).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(sizes):
                before = sizes[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, side="right")))
                owner, columns = records_of(data.slice(at, end - at).to_pylist())
                if len(owner):
                    place = pa.array(np.asarray(owner, np.int64) + at)
                    yield pa.RecordBatch.from_arrays([path.take(place), stream.take(place), *[pa.array(c, kind) for c, kind in zip(columns, kinds)]], names=schema.names)
                at = end

    return streams.select("path", "stream", "data").where("data is not null").mapInArrow(run, schema)


def circles(streams: DataFrame) -> DataFrame:
    """Circles confirmed by a companion: same graphic, the next primitive, the same centre within 1e-9."""
    a, b = scan(streams, "circle").alias("a"), scan(streams, "companion").alias("b")
    same = (
        (F.col("a.path") == F.col("b.path")) & (F.col("a.stream") == F.col("b.stream")) & (F.col("a.graphic_ref") == F.col("b.graphic_ref"))
        & (F.col("b.primitive_ref") == F.col("a.primitive_ref") + 1) & (F.abs(F.col("a.cx") - F.col("b.cx")) <= 1e-9) & (F.abs(F.col("a.cy") - F.col("b.cy")) <= 1e-9)
    )
    return a.join(b, same).select("a.*", F.col("b.radius").alias("companion_radius"))


def renderable_lines(lines: DataFrame, composites: DataFrame, least: float = 4.0) -> DataFrame:
    """18/32 lines that are drawn: not of zero length, and short ones only as children of type 2."""
    size = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) * PAGE_UNITS
    strokes = composites.where("prim_type = 2").select("path", "stream", "child_ref").distinct().withColumn("__stroke", F.lit(True))
    d = lines.withColumn("length", size).where("length > 0").join(strokes, ["path", "stream", "child_ref"], "left")
    return d.where((F.col("length") >= least) | F.col("__stroke")).drop("__stroke")


# Writers of the same records.


def pack_composite(parent: int, sheet: int, children: list[tuple[int, int, int, int, int, int]]) -> bytes:
    head = struct.pack("<HIII", 0x7B, 32 + 14 * len(children), parent, sheet) + b"\x00" * 8 + struct.pack("<I", len(children)) + b"\x00" * 8
    return head + b"".join(struct.pack("<I5H", *c) for c in children) + b"\x00" * 4


def pack_envelopes(rows: list[tuple[int, int, int, int, int, int]]) -> bytes:
    return b"".join(struct.pack("<I5H", *r) for r in rows)


def pack_text(refs: tuple[int, int, int, int], text: str, xy: tuple[float, float, float, float]) -> bytes:
    body = text.encode("utf-16-le")
    return struct.pack("<HIIIIHI", 0x4D, 60 + len(body), *refs[:3], 0, refs[3]) + b"\x00" * 4 + struct.pack("<H", len(body) // 2) + body + struct.pack("<4dI", *xy, 0)


def pack_line(refs: tuple[int, int, int, int], xy: tuple[float, float, float, float]) -> bytes:
    return struct.pack("<HIIIIHI4d", 0x18, 50, *refs[:3], 0, refs[3], *xy)


def pack_two_point(child: int, ref: int, style: int, xy: tuple[float, float, float, float]) -> bytes:
    return struct.pack("<I7H4d", child, ref, 0, 1200, 0, 0, style, 0, *xy)


def pack_arc(refs: tuple[int, int, int, int], shape: tuple[float, float, float, float, float]) -> bytes:
    return struct.pack("<HIIIIHI5d", 0x61, 59, *refs[:3], 0, refs[3], *shape) + b"\x00"


def pack_circle(refs: tuple[int, int, int, int], shape: tuple[float, float, float]) -> bytes:
    """A circle and its companion, the next primitive of the same graphic."""
    companion = bytearray(105)
    struct.pack_into("<HIII", companion, 0, 0x13, 99, (refs[0] + 1) & 0xFFFFFFFF, refs[1])
    struct.pack_into("<3d", companion, 35, *shape)
    return struct.pack("<HIIIIHI3d", 0x59, 0x2B, *refs[:3], 0, refs[3], *shape) + bytes(companion)


def pack_attribute(space: int, graphic: int, properties: list[tuple[str, str]]) -> bytes:
    out = b"PipeLine Info\x00"
    for key, value in properties:
        body = key.encode("latin-1") + b"\x00" + value.encode("latin-1", "replace") + b"\x00"
        out += _TLV + struct.pack("<H", len(body)) + b"\x01" + body
    return out + b"\x89\x00" + struct.pack("<II", 20, space) + b"\x00" * 8 + struct.pack("<I", graphic) + b"\xff\xff\x00\x00"


def pack_nodes(nodes: list[tuple[int, int, int, list[tuple[int, int]]]], prefix: list[int] | None = None) -> bytes:
    """A node table of (node_id, node_type, repeat, [(ref, relation)]); with a counted list of words first if ``prefix`` is given."""
    out = b"tseg" + b"\x00" * 8
    if prefix is not None:
        out += struct.pack(f"<{1 + len(prefix)}H", len(prefix), *prefix)
    for node, kind, repeat, refs in nodes:
        out += struct.pack("<4H", node, kind, len(refs), repeat) + b"".join(struct.pack("<IH", *r) for r in refs)
    return out


def scan_style_widths(data: bytes) -> list[tuple]:
    """2E/36 line styles: (offset, style_ref, width in page units), references 1..1000, width ratios 0.00001..0.01."""
    b, at = np.frombuffer(data, np.uint8), _find(data, b"\x2e\x00\x36\x00", 48)
    if not len(at):
        return []
    ref, ratio = _u32(b, at + 20), _f64(b, at + 40)
    ok = (ref >= 1) & (ref <= 1000) & (ratio >= 0.00001) & (ratio <= 0.01)
    return list(zip(at[ok].tolist(), ref[ok].tolist(), (ratio[ok] * PAGE_UNITS).tolist()))


def pack_style_width(style: int, ratio: float) -> bytes:
    return b"\x2e\x00\x36\x00" + b"\x00" * 16 + struct.pack("<I", style) + b"\x00" * 16 + struct.pack("<d", ratio)


#: The bands of page width, height and upper edge that a sheet's header declares, in shares of the workspace.
WIDTH_BAND, HEIGHT_BAND, TOP_BAND, HEADER_BYTES = (0.82, 0.86), (0.58, 0.62), (0.68, 0.73), 240


def scan_viewbox(data: bytes) -> list[tuple]:
    """The declared extent of a sheet (left, bottom, width, height) in page units: the greatest double of each band in its header, at any offset."""
    b = np.frombuffer(data, np.uint8)
    values = _f64(b, np.arange(max(0, min(len(b) - 8, HEADER_BYTES))))
    picks = []
    for low, high in (WIDTH_BAND, HEIGHT_BAND, TOP_BAND):
        own = values[(values >= low) & (values <= high)]
        if not len(own):
            return []
        picks.append(float(own.max()))
    width, height, top = picks
    return [(0.0, max(0.0, top - height) * PAGE_UNITS, width * PAGE_UNITS, height * PAGE_UNITS)]


FAMILIES |= {
    "style_width": (scan_style_widths, _fields(("offset", _L), ("style_ref", _L), ("width", _D))),
    "viewbox": (scan_viewbox, _fields(("left", _D), ("bottom", _D), ("width", _D), ("height", _D))),
}


def viewboxes(streams: DataFrame, inherits_from: str = "Sheet6") -> DataFrame:
    """(path, stream, left, bottom, width, height, basis): each sheet's own extent, else that of the file's ``inherits_from``, else the whole workspace."""
    box = ("left", "bottom", "width", "height")
    own = scan(streams, "viewbox")
    shared = own.where(F.col("stream") == inherits_from).select("path", *[F.col(c).alias(f"i_{c}") for c in box])
    all_ = streams.select("path", "stream").join(own, ["path", "stream"], "left").join(shared, "path", "left")
    whole = dict(zip(box, (0.0, 0.0, float(PAGE_UNITS), float(PAGE_UNITS))))
    basis = F.when(F.col("width").isNotNull(), "own").when(F.col("i_width").isNotNull(), "inherited").otherwise("default")
    return all_.select("path", "stream", *[F.coalesce(c, f"i_{c}", F.lit(whole[c])).alias(c) for c in box], basis.alias("basis"))


def styled_lines(lines: DataFrame, styles: DataFrame) -> DataFrame:
    """18/32 lines with the width of their style in the same file, the last record of a style counting; null without one."""
    last = styles.groupBy("path", F.col("style_ref").alias("low_ref")).agg(F.max_by("width", "offset").alias("width"))
    return lines.withColumn("low_ref", F.col("style_ref").bitwiseAND(0xFFFF)).join(last, ["path", "low_ref"], "left").drop("low_ref")


def version_history(streams: DataFrame) -> DataFrame:
    """(path, stream, status, place, module, version, mode, changed_at) of NUL-delimited quadruples; an incomplete sequence is told by its status."""
    parts = F.filter(F.split(F.decode("data", "ISO-8859-1"), "\u0000"), lambda p: p != "")
    d = streams.withColumn("parts", parts)
    whole = (F.size("parts") > 0) & (F.size("parts") % 4 == 0)
    at = F.when(whole, F.sequence(F.lit(0), F.greatest((F.size("parts") / 4).cast("int") - 1, F.lit(0)))).otherwise(F.array(F.lit(None).cast("int")))
    rows = d.select("path", "stream", F.when(whole, "whole").otherwise("unvalidated").alias("status"), "parts", F.explode(at).alias("place"))
    return rows.select("path", "stream", "status", "place", *[F.get("parts", F.col("place") * 4 + k).alias(n) for k, n in enumerate(("module", "version", "mode", "changed_at"))])


def template_fields(texts: DataFrame, literals: DataFrame) -> DataFrame:
    """Texts that are a template's own: (path, stream, field, text, x, y), by an equal literal or its pattern.

    ``literals`` (field, literal, pattern) is the user's table of the template;
    a text that several rows name counts once for each.
    """
    t = texts.select("path", "stream", "text", "x", "y")
    equal = t.join(literals.where("literal is not null").select("field", "literal"), F.col("text") == F.col("literal")).select("path", "stream", "field", "text", "x", "y")
    patterns = [(r["field"], r["pattern"]) for r in literals.where("pattern is not null").select("field", "pattern").collect()]
    named = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(f)) for f, p in patterns])) if patterns else F.array().cast("array<string>")
    return equal.unionByName(t.select("path", "stream", F.explode(named).alias("field"), "text", "x", "y")).distinct()


def closed_frames(lines: DataFrame, by: list[str]) -> DataFrame:
    """(by..., n_lines, closed, inside): whether the lines of a group form closed rings inside the page.

    Every end, to six digits, is shared by exactly two lines of the group.
    """
    six = lambda c: F.round(c, 6)
    ends = lines.select(*by, F.explode(F.array(F.struct(six("x1").alias("x"), six("y1").alias("y")), F.struct(six("x2").alias("x"), six("y2").alias("y")))).alias("p"))
    met = ends.groupBy(*by, "p").agg(F.count("*").alias("n"))
    named = reduce(and_, [F.col(c).isNotNull() for c in by])
    in_page = F.col("p.x").between(0, 1) & F.col("p.y").between(0, 1)
    # A line has two ends, so the lines are counted by them and not read again.
    n_lines = F.expr("sum(n) div 2").alias("n_lines")
    return met.where(named).groupBy(*by).agg(n_lines, F.bool_and(F.col("n") == 2).alias("closed"), F.bool_and(in_page).alias("inside"))
