"""Reader of compound files (the container of the drawings): streams as (path, stream, data).

The container is a sector file system: a header, allocation chains (FAT), a
directory tree, and a second, finer allocation for small streams.  Chains are
walked with loop detection, and a container that does not hold together gives
a status instead of streams.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Fixed values of the public container format.
MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
FREE, END, FAT_SECTOR, DIFAT_SECTOR = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD, 0xFFFFFFFC
NO_ENTRY = 0xFFFFFFFF
STORAGE, STREAM, ROOT = 1, 2, 5


class BrokenContainer(ValueError):
    """The bytes are not a whole compound file."""


def _chain(table: list[int], start: int) -> list[int]:
    out: list[int] = []
    while start not in (END, FREE):
        # A chain without a loop is no longer than its table.
        if start >= len(table) or len(out) >= len(table):
            raise BrokenContainer("broken sector chain")
        out.append(start)
        start = table[start]
    return out


def read_streams(data: bytes) -> dict[str, bytes]:
    """{path of names joined by '/': bytes} of every stream."""
    if data[:8] != MAGIC or len(data) < 512:
        raise BrokenContainer("no container")
    shift, small_shift = struct.unpack_from("<HH", data, 30)
    n_fat, first_dir, _, cutoff, first_small, _, first_more, n_more = struct.unpack_from("<I I I I I I I I", data, 44)
    size, small = 1 << shift, 1 << small_shift

    def sector(i: int) -> bytes:
        out = data[(i + 1) * size : (i + 2) * size]
        if not out:
            raise BrokenContainer("sector beyond the end")
        return out

    fat_at = [x for x in struct.unpack_from("<109I", data, 76) if x != FREE]
    more = first_more
    for _ in range(n_more):
        words = struct.unpack(f"<{size // 4}I", sector(more))
        fat_at += [x for x in words[:-1] if x != FREE]
        more = words[-1]
    fat = [x for i in fat_at[:n_fat] for x in struct.unpack(f"<{size // 4}I", sector(i).ljust(size, b"\xff"))]

    def join(start: int) -> bytes:
        at = _chain(fat, start)
        if at and at[-1] - at[0] == len(at) - 1 and at == list(range(at[0], at[-1] + 1)):
            sector(at[-1])
            return data[(at[0] + 1) * size : (at[-1] + 2) * size]
        return b"".join(sector(i) for i in at)

    directory = join(first_dir)
    entries = []
    for o in range(0, len(directory) - 127, 128):
        n, kind = struct.unpack_from("<H", directory, o + 64)[0], directory[o + 66]
        left, right, child = struct.unpack_from("<III", directory, o + 68)
        start, length = struct.unpack_from("<IQ", directory, o + 116)
        entries.append((directory[o : o + max(0, n - 2)].decode("utf-16-le", "replace"), kind, left, right, child, start, length & 0xFFFFFFFF if shift == 9 else length))
    if not entries or entries[0][1] != ROOT:
        raise BrokenContainer("no root entry")
    mini = join(entries[0][5]) if entries[0][5] not in (END, FREE) else b""
    mini_fat = [x for i in _chain(fat, first_small) for x in struct.unpack(f"<{size // 4}I", sector(i))] if first_small not in (END, FREE) else []
    out: dict[str, bytes] = {}
    seen: set[int] = set()
    todo = [(entries[0][4], "")]
    while todo:
        i, prefix = todo.pop()
        if i == NO_ENTRY:
            continue
        if i >= len(entries) or i in seen:
            raise BrokenContainer("broken directory")
        seen.add(i)
        name, kind, left, right, child, start, length = entries[i]
        todo += [(left, prefix), (right, prefix)]
        if kind == STORAGE:
            todo.append((child, f"{prefix}{name}/"))
        elif kind == STREAM:
            if length < cutoff:
                body = b"".join(mini[k * small : (k + 1) * small] for k in _chain(mini_fat, start)) if length else b""
            else:
                body = join(start)
            if len(body) < length:
                raise BrokenContainer("short stream")
            out[prefix + name] = body[:length]
    return out


def write_container(streams: dict[str, bytes]) -> bytes:
    """A container with the given streams; all of them in full sectors, the directory as a right-leaning list."""
    size = 512
    nodes: list[dict] = [{"name": "Root Entry", "kind": ROOT, "kids": {}}]
    for path, body in streams.items():
        at = 0
        *folders, leaf = path.split("/")
        for name in folders:
            if name not in nodes[at]["kids"]:
                nodes.append({"name": name, "kind": STORAGE, "kids": {}})
                nodes[at]["kids"][name] = len(nodes) - 1
            at = nodes[at]["kids"][name]
        nodes.append({"name": leaf, "kind": STREAM, "body": body})
        nodes[at]["kids"][leaf] = len(nodes) - 1
    sectors: list[bytes] = []
    fat: list[int] = []

    def put(body: bytes) -> int:
        if not body:
            return END
        first, n = len(fat), -(-len(body) // size)
        sectors.append(body.ljust(n * size, b"\x00"))
        fat.extend(range(first + 1, first + n))
        fat.append(END)
        return first

    for n in nodes:
        n["start"] = put(n["body"].ljust(4096, b"\x00")) if n.get("body") else END
        n["right"] = n["child"] = NO_ENTRY
    for n in nodes:
        kids = list(n.get("kids", {}).values())
        if kids:
            n["child"] = kids[0]
        for a, b in zip(kids, kids[1:]):
            nodes[a]["right"] = b
    directory = b""
    for n in nodes:
        raw = n["name"].encode("utf-16-le")[:62]
        entry = raw.ljust(64, b"\x00") + struct.pack("<HBBIII", len(raw) + 2, n["kind"], 1, NO_ENTRY, n["right"], n["child"]) + b"\x00" * 36
        # Streams are padded to the size from which full sectors are used, and say so.
        directory += entry + struct.pack("<IQ", n["start"], max(4096, len(n["body"])) if n.get("body") else 0)
    first_dir = put(directory.ljust(-(-len(directory) // size) * size, b"\x00"))
    n_fat = 1
    while n_fat * (size // 4) < len(fat) + n_fat:
        n_fat += 1
    at = len(fat)
    table = fat + [FAT_SECTOR] * n_fat
    packed = struct.pack(f"<{len(table)}I", *table).ljust(n_fat * size, b"\xff")
    head = MAGIC + b"\x00" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\x00" * 10
    head += struct.pack("<IIIIIIII", n_fat, first_dir, 0, 4096, END, 0, END, 0)
    head += struct.pack("<109I", *[at + k for k in range(n_fat)], *[FREE] * (109 - n_fat))
    return head.ljust(size, b"\x00") + b"".join(sectors) + packed


#: About so many bytes of containers are handed over at a time: one alone costs a frame, a whole batch its memory again.
SLICE_BYTES = 4 << 20
STREAMS = T.StructType([T.StructField("path", T.StringType()), T.StructField("stream", T.StringType()), T.StructField("data", T.BinaryType()), T.StructField("status", T.StringType())])


def streams(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, stream, data, status) of containers; one row with the error as its status for a broken one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, size = [], 0
            for p, body in zip(pdf["path"], pdf["content"]):
                try:
                    rows += [(p, name, data, "whole") for name, data in read_streams(bytes(body)).items()]
                except (BrokenContainer, struct.error) as error:
                    rows.append((p, None, None, f"unvalidated: {error}"))
                size += len(body)
                if size >= SLICE_BYTES:
                    yield pd.DataFrame(rows, columns=STREAMS.names)
                    rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=STREAMS.names)

    return files.select(F.col(path).alias("path"), F.col(content).alias("content")).where("content is not null").mapInPandas(run, STREAMS)


def read(spark: SparkSession, location: str) -> DataFrame:
    """Streams of the container files at a location."""
    return streams(spark.read.format("binaryFile").load(location).select("path", "content"))


def sheets(all_streams: DataFrame, template: bool = False) -> DataFrame:
    """Physical sheets: streams named Sheet and a number, longer than 1,024 bytes; the template sheet 221 only on request."""
    keep = F.col("stream").rlike("^Sheet[0-9]+$") & (F.length("data") > 1024)
    return all_streams.where(keep if template else keep & (F.col("stream") != "Sheet221"))


def with_records(content: bytes | None, name: str | None, more: bytes) -> bytes | None:
    """The container with ``more`` at the end of a stream; none if it is broken or has no such stream."""
    try:
        own = read_streams(content) if content is not None else {}
    except (BrokenContainer, struct.error):
        return None
    return write_container({**own, name: own[name] + more}) if name in own else None


@F.pandas_udf(T.BinaryType())
def appended(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """(container, stream name, records) -> the container with the records at the end of the stream, all other streams unchanged.

    A container without the stream, or a broken one, gives null.
    """
    for content, stream, records in parts:
        out = [with_records(None if body is None else bytes(body), name, bytes(more or b"")) for body, name, more in zip(content, stream, records)]
        yield pd.Series(out, dtype=object)


#: Property numbers and types of a summary stream.
SUMMARY = {2: "title", 3: "subject", 4: "author", 5: "keywords", 6: "comments", 7: "template", 8: "last_saved_by", 9: "revision_number", 12: "create_time", 13: "last_saved_time", 18: "creating_application"}
_SHORT, _INT, _TEXT, _TIME = 2, 3, 30, 64
_EPOCH_1601 = 116_444_736_000_000_000


def read_summary(data: bytes) -> dict[str, str] | None:
    """Properties of a summary stream as text, times as ISO-8601; none for bytes that are no property set."""
    from datetime import datetime, timedelta, timezone

    try:
        if struct.unpack_from("<H", data)[0] != 0xFFFE:
            return None
        at = struct.unpack_from("<I", data, 44)[0]
        found = {}
        for k in range(struct.unpack_from("<I", data, at + 4)[0]):
            number, offset = struct.unpack_from("<II", data, at + 8 + 8 * k)
            kind = struct.unpack_from("<I", data, at + offset)[0]
            own, name = at + offset + 4, SUMMARY.get(number)
            if name is None:
                continue
            if kind == _TEXT:
                size = struct.unpack_from("<I", data, own)[0]
                found[name] = data[own + 4 : own + 4 + size].split(b"\x00")[0].decode("utf-8", "replace")
            elif kind == _TIME:
                ticks = struct.unpack_from("<Q", data, own)[0]
                found[name] = (datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=(ticks - _EPOCH_1601) // 10)).strftime("%Y-%m-%dT%H:%M:%S")
            elif kind in (_SHORT, _INT):
                found[name] = str(struct.unpack_from("<h" if kind == _SHORT else "<i", data, own)[0])
        return found
    except (struct.error, OverflowError):
        return None


def write_summary(properties: dict[str, str | int]) -> bytes:
    """A summary stream: texts as they are, integers as times in microseconds since 1970."""
    numbers = {name: number for number, name in SUMMARY.items()}
    values, table = b"", b""
    for name, value in properties.items():
        offset = 8 + 8 * len(properties) + len(values)
        table += struct.pack("<II", numbers[name], offset)
        if isinstance(value, int):
            values += struct.pack("<IQ", _TIME, value * 10 + _EPOCH_1601)
        else:
            raw = value.encode() + b"\x00"
            values += struct.pack("<II", _TEXT, len(raw)) + raw.ljust(-(-len(raw) // 4) * 4, b"\x00")
    section = struct.pack("<II", 8 + len(table) + len(values), len(properties)) + table + values
    return struct.pack("<HHI", 0xFFFE, 0, 0) + b"\x00" * 16 + struct.pack("<I", 1) + b"\x00" * 16 + struct.pack("<I", 48) + section


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def summary(streams: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in streams:
        yield pd.Series([None if b is None else read_summary(bytes(b)) for b in batch], dtype=object)
