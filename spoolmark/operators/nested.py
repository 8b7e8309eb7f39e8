"""Deeply nested JSON text to linked flat rows, by vectorised structural indexing.

For each text, numpy builds the bitmaps of escaped characters, quotes, brackets
and delimiters, takes nesting depth and string parity as prefix sums, and from
them the token list with each token's container.  Well-formedness is decided on
the same index: every token is judged by its kind, its predecessor and its
container, brackets must pair, and scalars and strings must be legal JSON.
Rows are then read off the spans; nothing is built as nested Python objects.

Defined results: a null, empty or malformed text, or one that is not an object,
gives no rows; of a repeated key the last value counts; a null list element
gives no row but keeps its place; a list field that holds no list counts as
absent; an element that is no object has absent fields; repeated pages come out
once; further columns are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

OPEN_OBJ, CLOSE_OBJ, OPEN_ARR, CLOSE_ARR, COLON, COMMA, STRING, SCALAR = range(8)
STRUCTURE = b"{}[]:,"
_KIND = np.full(256, -1, np.int8)
for _i, _c in enumerate(STRUCTURE):
    _KIND[_c] = _i
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r")] = True
_NUMBER = re.compile(rb"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_LEGAL_STRING = re.compile(rb'(?:[^\x00-\x1f\\]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+')


class Index:
    """Tokens of one JSON text: start, end, kind, container (token number of the open bracket) and mate."""

    def __init__(self, text: bytes):
        self.text = text
        b = np.frombuffer(text, np.uint8)
        n = len(b)
        backslash = b == 0x5C
        if backslash.any():
            # A character is escaped when an odd run of backslashes ends before it.
            at = np.arange(n)
            last_other = np.maximum.accumulate(np.where(backslash, -1, at))
            run = np.where(backslash, at - last_other, 0)
            escaped = np.zeros(n, bool)
            escaped[1:] = run[:-1] % 2 == 1
        else:
            escaped = np.zeros(n, bool)
        quote = (b == 0x22) & ~escaped
        parity = np.cumsum(quote) & 1
        self.ok = n > 0 and parity[-1] == 0
        if not self.ok:
            return
        inside = (parity == 1) | quote
        kind = np.where(inside, -1, _KIND[b])
        opens_string = quote & (parity == 1)
        loose = ~inside & (kind < 0) & ~_SPACE[b]
        starts_scalar = loose.copy()
        starts_scalar[1:] &= ~loose[:-1]
        ends_scalar = loose.copy()
        ends_scalar[:-1] &= ~loose[1:]

        token_at = np.flatnonzero((kind >= 0) | opens_string | starts_scalar)
        self.start = token_at
        k = kind[token_at].astype(np.int64)
        k[opens_string[token_at]] = STRING
        k[starts_scalar[token_at]] = SCALAR
        self.kind = k
        end = token_at + 1
        end[k == STRING] = np.flatnonzero(quote & (parity == 0)) + 1
        end[k == SCALAR] = np.flatnonzero(ends_scalar) + 1
        self.end = end
        self.ok = len(k) > 0 and self._containers() and self._legal()

    def _containers(self) -> bool:
        k = self.kind
        opens = (k == OPEN_OBJ) | (k == OPEN_ARR)
        closes = (k == CLOSE_OBJ) | (k == CLOSE_ARR)
        depth = np.cumsum(opens.astype(np.int64) - closes.astype(np.int64))
        if depth[-1] != 0 or depth.min() < 0:
            return False
        # Level of a bracket is the depth inside it, of another token the depth around it.
        level = depth + closes
        m = len(k)
        order = np.argsort(level, kind="stable")
        at = np.where(opens[order], np.arange(m), -1)
        last_open = np.maximum.accumulate(at)
        inside_of = np.full(m, -1, np.int64)
        known = last_open >= 0
        inside_of[order[known]] = order[last_open[known]]
        inside_of[level == 0] = -1
        self.mate = np.full(m, -1, np.int64)
        close_at = np.flatnonzero(closes)
        self.mate[inside_of[close_at]] = close_at
        if (k[close_at] - 1 != k[inside_of[close_at]]).any():
            return False
        # A bracket's own container is the last open one a level higher.
        container = inside_of.copy()
        open_at = np.flatnonzero(opens)
        container[open_at] = -1
        if len(open_at):
            by_level = np.argsort(level[open_at], kind="stable")
            starts = np.searchsorted(level[open_at][by_level], np.arange(1, level.max() + 2))
            for lv in range(2, int(level.max()) + 1):
                own = open_at[by_level[starts[lv - 1] : starts[lv]]]
                above = open_at[by_level[starts[lv - 2] : starts[lv - 1]]]
                container[own] = above[np.searchsorted(above, own) - 1]
        container[close_at] = container[inside_of[close_at]]
        self.container = container
        return True

    def _legal(self) -> bool:
        k, m = self.kind, len(self.kind)
        opens = (k == OPEN_OBJ) | (k == OPEN_ARR)
        closes = (k == CLOSE_OBJ) | (k == CLOSE_ARR)
        prev = np.full(m, -1, np.int64)
        prev[1:] = k[:-1]
        around = np.where(self.container >= 0, k[self.container], -1)
        # Container seen by what follows the previous token.
        first = np.zeros(m, bool)
        first[1:] = opens[:-1]
        in_obj, in_arr = around == OPEN_OBJ, around == OPEN_ARR
        value_start = opens | (k == STRING) | (k == SCALAR)
        after_value = (prev == CLOSE_OBJ) | (prev == CLOSE_ARR) | (prev == STRING) | (prev == SCALAR)
        nxt = np.full(m, -1, np.int64)
        nxt[:-1] = k[1:]
        key = in_obj & (k == STRING) & (first | (prev == COMMA))
        self.is_key = key
        was_key = np.zeros(m, bool)
        was_key[1:] = key[:-1]
        good = np.zeros(m, bool)
        good |= key & (nxt == COLON)
        good |= in_obj & value_start & ~key & (prev == COLON)
        good |= in_arr & value_start & (first | (prev == COMMA))
        good |= in_obj & (k == COLON) & was_key
        good |= (k == COMMA) & (in_obj | in_arr) & after_value & ~was_key
        good |= closes & (first | (after_value & ~was_key))
        top = self.container < 0
        good[0] = bool(value_start[0])
        if int((top & value_start).sum()) != 1 or not good.all():
            return False
        last = self.mate[0] if opens[0] else 0
        if last != m - 1:
            return False
        for i in np.flatnonzero(k == SCALAR).tolist():
            word = self.text[self.start[i] : self.end[i]]
            if word not in (b"true", b"false", b"null") and not _NUMBER.fullmatch(word):
                return False
        strings = np.flatnonzero(k == STRING)
        if b"\\" in self.text or (np.frombuffer(self.text, np.uint8) < 0x20).any():
            for i in strings.tolist():
                if not _LEGAL_STRING.fullmatch(self.text, self.start[i] + 1, self.end[i] - 1):
                    return False
        return True

    def word(self, i: int) -> bytes:
        return self.text[self.start[i] : self.end[i]]

    def scalar_text(self, i: int) -> str:
        """A value as text: strings decoded, null as '', numbers, flags and nested values as written."""
        if self.kind[i] == STRING:
            body = self.word(i)
            return json.loads(body) if b"\\" in body else body[1:-1].decode()
        if self.kind[i] == SCALAR:
            word = self.word(i)
            return "" if word == b"null" else word.decode()
        return self.text[self.start[i] : self.end[self.mate[i]]].decode()

    def members(self, wanted: dict[bytes, str]) -> dict[int, dict[str, int]]:
        """{object token: {name: value token}} of the members with wanted names, the last one of each name."""
        found: dict[int, dict[str, int]] = {}
        for i in np.flatnonzero(self.is_key).tolist():
            word = self.word(i)
            name = wanted.get(word) if b"\\" not in word else wanted.get(json.dumps(json.loads(word), ensure_ascii=False).encode("utf-8", "replace"))
            if name:
                found.setdefault(int(self.container[i]), {})[name] = i + 2
        return found

    def elements(self) -> dict[int, list[int]]:
        """{array token: first tokens of its elements in order}."""
        k = self.kind
        inside = np.where(self.container >= 0, k[self.container], -1) == OPEN_ARR
        value = (k == OPEN_OBJ) | (k == OPEN_ARR) | (k == STRING) | (k == SCALAR)
        found: dict[int, list[int]] = {}
        at = np.flatnonzero(inside & value)
        for i, c in zip(at.tolist(), self.container[at].tolist()):
            found.setdefault(c, []).append(i)
        return found


NAMES = (
    "pipes", "components", "kind", "endpoint_annotations", "source_vector_segments", "support", "weld", "handle",
    "title", "handles", "endpoints", "point", "by", "rule", "gap", "centre", "outline", "welds", "subpaths", "anchor", "of",
)
_WANTED = {f'"{n}"'.encode(): n for n in NAMES}


class Page:
    """The wanted members of a page's objects and the elements of its arrays; empty for a text that is no JSON object."""

    def __init__(self, text: str | None):
        self.members, self.lists, self.index = {}, {}, None
        try:
            index = Index(text.encode()) if text else None
        except UnicodeEncodeError:
            return
        if index is not None and index.ok and index.kind[0] == OPEN_OBJ:
            self.index, self.members, self.lists = index, index.members(_WANTED), index.elements()

    def value(self, owner: int, name: str) -> int | None:
        """Token of a member's value, none for null."""
        i = self.members.get(owner, {}).get(name)
        return None if i is None or self.index.word(i) == b"null" else i

    def elements(self, i: int | None) -> list[tuple[int, int]]:
        """(place, token) of the elements of an array that are not null."""
        if i is None or self.index.kind[i] != OPEN_ARR:
            return []
        return [(place, e) for place, e in enumerate(self.lists.get(i, ())) if self.index.word(e) != b"null"]

    def children(self, owner: int, name: str) -> list[tuple[int, int]]:
        return self.elements(self.value(owner, name))

    def text_of(self, owner: int, name: str) -> str:
        i = self.value(owner, name)
        return "" if i is None else self.index.scalar_text(i)

    def flag(self, owner: int, name: str) -> bool:
        i = self.value(owner, name)
        return i is not None and self.index.word(i) == b"true"

    def number(self, i: int) -> float | None:
        """A number, also one written as a string; none for anything else."""
        text = self.index.scalar_text(i).encode() if self.index.kind[i] in (STRING, SCALAR) else b""
        return float(text) if _NUMBER.fullmatch(text) else None

    def point(self, i: int) -> tuple[float | None, float | None]:
        """The first two elements of an array as numbers."""
        own = self.lists.get(i, ()) if self.index.kind[i] == OPEN_ARR else ()
        xy = [self.number(e) for e in own[:2]]
        return tuple(xy + [None] * (2 - len(xy)))


def page_items(text: str | None) -> list[tuple[str, str, str, str]]:
    """(item_kind, item_id, parent_id, val) of one page text."""
    page = Page(text)
    children, text_of, flag = page.children, page.text_of, page.flag
    rows = []
    for place, pipe in children(0, "pipes"):
        own = f"P{place:03d}"
        rows.append(("pipe", own, "", text_of(pipe, "kind")))
        for at, e in children(pipe, "endpoint_annotations"):
            both = flag(e, "support"), flag(e, "weld")
            val = {(True, True): "both", (True, False): "support", (False, True): "weld", (False, False): "empty"}[both]
            rows.append(("endpoint_annotation", f"{own}:E{at}", own, val))
        for at, e in children(pipe, "source_vector_segments"):
            rows.append(("source_vector_segment", f"{own}:V{at}", own, text_of(e, "handle")))
    for place, part in children(0, "components"):
        rows.append(("component", f"C{place:03d}", "", text_of(part, "kind")))
    return rows


def page_values(text: str | None) -> list[tuple[str, str, int | None, int | None, float | None, float | None, str | None]]:
    """(owner_id, field, place, part, x, y, val) of what the items of a page hold: handles, points, point lists, lists of them, titles and rules.

    ``owner_id`` is the item's id; a value that stands alone has no place.
    """
    page = Page(text)
    rows = []

    def scalar(own: str, owner: int | None, name: str, field: str) -> None:
        i = None if owner is None else page.value(owner, name)
        if i is not None:
            rows.append((own, field, None, None, None, None, page.index.scalar_text(i)))

    def point(own: str, owner: int | None, name: str, field: str) -> None:
        i = None if owner is None else page.value(owner, name)
        if i is not None:
            rows.append((own, field, None, None, *page.point(i), None))

    def handles(own: str, owner: int) -> None:
        rows.extend((own, "handles", k, None, None, None, page.index.scalar_text(e)) for k, e in page.children(owner, "handles"))

    def points(own: str, owner: int, name: str) -> None:
        rows.extend((own, name, k, None, *page.point(e), None) for k, e in page.children(owner, name))

    for place, pipe in page.children(0, "pipes"):
        own = f"P{place:03d}"
        handles(own, pipe)
        points(own, pipe, "endpoints")
        scalar(own, pipe, "title", "title")
        for at, e in page.children(pipe, "endpoint_annotations"):
            by = page.value(e, "by")
            point(f"{own}:E{at}", e, "point", "point")
            scalar(f"{own}:E{at}", by, "rule", "by.rule")
            scalar(f"{own}:E{at}", by, "gap", "by.gap")
        for at, e in page.children(pipe, "source_vector_segments"):
            points(f"{own}:V{at}", e, "endpoints")
    for place, part in page.children(0, "components"):
        own = f"C{place:03d}"
        handles(own, part)
        point(own, part, "centre", "centre")
        points(own, part, "outline")
        for name in ("welds", "subpaths"):
            for k, line in page.children(part, name):
                rows.extend((own, name, k, j, *page.point(e), None) for j, e in page.elements(line))
        anchor = page.value(part, "anchor")
        of = None if anchor is None else page.value(anchor, "of")
        point(own, anchor, "point", "anchor.point")
        scalar(own, of, "kind", "anchor.of.kind")
        scalar(own, of, "handle", "anchor.of.handle")
    return rows


ITEMS = T.StructType(
    [T.StructField("page_id", T.LongType())] + [T.StructField(c, T.StringType()) for c in ("item_kind", "item_id", "parent_id", "val")]
)


VALUES = T.StructType(
    [T.StructField("page_id", T.LongType()), T.StructField("owner_id", T.StringType()), T.StructField("field", T.StringType())]
    + [T.StructField(c, T.IntegerType()) for c in ("place", "part")]
    + [T.StructField(c, T.DoubleType()) for c in ("x", "y")]
    + [T.StructField("val", T.StringType())]
)
PIECE_ROWS = 50_000


def _each_page(schema: T.StructType, read):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for page, text in zip(pdf["page_id"].tolist(), pdf["page_json"].tolist()):
                rows += [(page, *item) for item in read(text)]
                if len(rows) >= PIECE_ROWS:
                    yield _frame(rows, schema)
                    rows = []
            yield _frame(rows, schema)

    return run


def _frame(rows: list[tuple], schema: T.StructType) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=schema.names).astype({f.name: "Int32" for f in schema if f.dataType == T.IntegerType()})


def _texts(pages: DataFrame, page_id: str, page_json: str) -> DataFrame:
    return pages.select(F.col(page_id).alias("page_id"), F.col(page_json).alias("page_json")).where(F.col("page_json").isNotNull())


def flatten_pages(pages: DataFrame, page_id: str, page_json: str) -> DataFrame:
    """Flat rows of pipes, endpoint annotations, vector segments and components, each with its owner's id."""
    return _texts(pages, page_id, page_json).mapInPandas(_each_page(ITEMS, page_items), ITEMS).distinct()


def page_fields(pages: DataFrame, page_id: str, page_json: str) -> DataFrame:
    """Flat rows of what the items hold (``page_values``), linked to ``flatten_pages`` by (page_id, owner_id = item_id)."""
    return _texts(pages, page_id, page_json).mapInPandas(_each_page(VALUES, page_values), VALUES).distinct()


def item_table(items: DataFrame, kind: str, value: str) -> DataFrame:
    """One flat table of the items of a kind, its value under a name of its own."""
    return items.where(F.col("item_kind") == kind).select("page_id", "item_id", "parent_id", F.col("val").alias(value))
