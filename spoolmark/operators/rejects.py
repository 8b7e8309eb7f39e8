"""Rows that fail to parse: typed records on one side, rejects with a reason on the other.

Every line is read once with Spark's permissive CSV reader under an explicit
schema, which keeps the raw text of what it cannot fit.  What the reader
rejects, and what it accepts though it is not plainly of the record grammar, is
classified again from its pieces: quoting first, then the number of fields,
then the casts.
Everything is a built-in expression, so the operator is one narrow pass over
the input without a shuffle, whatever its size or skew.

Grammar of a line (one trailing ``\\r`` is not part of it): fields are separated
by runs of blanks and tabs; a field that begins with ``"`` ends at the next
``"`` that is not doubled and must be followed by a separator or the end; other
fields hold no quote.  Lines 1 to 10 of a file are headers of 14 integers, all
others are geometry of ten fields.

Defined results: a null, empty or blank line has no fields (``column_count``);
a null ``line_no`` marks a geometry line; repeated rows come out as often as
they go in; an empty table gives two empty tables; further input columns are
carried along, and those that clash with a parsed name are kept under the
prefix ``src_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

HEADER_LINES = 10
HEADER_FIELDS = 14
GEOMETRY_FIELDS = 10
MAX_BORE = 3000.0
MOST_COLUMNS = 20_000

INTEGER = r"^[+-]?[0-9]+\z"
NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[Ee][+-]?[0-9]+)?\z"
CODE = r"^[0-9]{1,3}\z"

_PLAIN = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[Ee][+-]?[0-9]+)?"
_FIELD = r"(?:[^\t\"]+|\"[^\"]*(?:\"\"[^\"]*)*\")"
#: Lines up to this length are compared with a whole-line pattern; longer ones, for which a pattern may need a deep
#: stack, go straight to the classification from pieces, which judges every line alike.
SHORT = 1_000
PLAIN_HEADER = r"^[+-]?[0-9]+(?:\t[+-]?[0-9]+){13}\z"
PLAIN_GEOMETRY = rf"^[0-9]{{1,3}}(?:\t{_PLAIN}){{7}}\t{_FIELD}\t{_FIELD}\z"

COORDS = ("ax", "ay", "az", "bx", "by", "bz")
GEOMETRY = T.StructType(
    [T.StructField("code", T.IntegerType())]
    + [T.StructField(c, T.DoubleType()) for c in (*COORDS, "bore")]
    + [T.StructField("uci", T.StringType()), T.StructField("tail", T.StringType()), T.StructField("corrupt_raw", T.StringType())]
)
SWITCHES = T.StructType(
    [T.StructField(f"s{i:02d}", T.LongType()) for i in range(HEADER_FIELDS)] + [T.StructField("corrupt_raw", T.StringType())]
)
READER = {
    "sep": "\t", "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt_raw",
    "lineSep": "\u0001", "nullValue": "\u0002", "emptyValue": "", "maxCharsPerColumn": "-1",
}


def _line(raw: Column) -> Column:
    """The line without one trailing carriage return, null read as empty, outer separators trimmed."""
    text = F.coalesce(raw, F.lit(""))
    text = F.when(text.endswith("\r"), F.expr("substring({0}, 1, length({0}) - 1)".format("__raw"))).otherwise(text)
    return F.btrim(text, F.lit(" \t"))


def _inner(parts: Column) -> Column:
    """The pieces but the first and the last.

    Lambdas below see these elements only: a lambda that refers to the whole
    array would evaluate it again for every element of a long line.
    """
    return F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))


def _outside(i: Column) -> Column:
    """Whether the inner piece at place ``i`` lies outside quotes."""
    return i % 2 == 1


def well_quoted(parts: Column) -> Column:
    """Whether the pieces of a line split at ``"`` obey the quoting rules.

    Pieces at even places lie outside quotes.  Between two quotes an outside
    piece is either empty (a doubled quote) or starts and ends with a separator.
    """
    first, last = F.get(parts, F.lit(0)), F.element_at(parts, -1)
    inner = F.transform(_inner(parts), lambda s, i: ~_outside(i) | (s == "") | (s.rlike("^[ \t]") & s.rlike("[ \t]\\z")))
    return (F.size(parts) == 1) | (
        (F.size(parts) % 2 == 1) & ((first == "") | first.rlike("[ \t]\\z")) & ((last == "") | last.rlike("^[ \t]")) & F.forall(inner, lambda ok: ok)
    )


def _ends(parts: Column, piece) -> tuple[Column, Column]:
    """The first and the last piece rewritten; a single piece is first and has no last."""
    return piece(F.get(parts, F.lit(0))), F.when(F.size(parts) > 1, piece(F.element_at(parts, -1))).otherwise("")


def _fields(parts: Column) -> Column:
    """Unquoted field values of a well quoted line."""
    plain = lambda s: F.translate(s, "\u0000", "\ufffd")
    cut = lambda s: F.regexp_replace(plain(s), "[ \t]+", "\u0000")
    first, last = _ends(parts, cut)
    inner = F.transform(
        _inner(parts), lambda s, i: F.when(_outside(i), F.when(s == "", F.lit('"')).otherwise(cut(s))).otherwise(plain(s))
    )
    return F.split(F.concat(first, F.array_join(inner, ""), last), "\u0000", -1)


def _separators(parts: Column) -> Column:
    """Number of separators outside quotes."""
    outside = F.filter(parts, lambda s, i: i % 2 == 0)
    return F.regexp_count(F.array_join(outside, '"'), F.lit("[ \t]+"))


def _reader_text(parts: Column) -> Column:
    """The line with every run of separators outside quotes made one tab, for the permissive reader."""
    tab = lambda s: F.regexp_replace(s, "[ \t]+", "\t")
    first, last = _ends(parts, tab)
    inner = F.transform(_inner(parts), lambda s, i: F.when(_outside(i), tab(s)).otherwise(s))
    body = F.array_join(F.concat(F.array(first), inner, F.array(last)), '"')
    return F.when(F.size(parts) == 1, first).otherwise(body)


def _finite(text: Column) -> Column:
    value = text.try_cast("double")
    return F.coalesce(text.rlike(NUMBER) & (F.abs(value) < float("inf")), F.lit(False))


def _once(d: DataFrame, **columns: Column) -> DataFrame:
    """``d`` with further columns that are evaluated once per row.

    They pass through a one-element generator, which predicates and projections
    are not merged across; a filter on the last of a chain of columns would
    otherwise be rewritten to the expressions of all of them, many times over.
    """
    one = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("__one")
    return d.select("*", one).select(*d.columns, *[F.col(f"__one.{n}").alias(n) for n in columns])


def read_lines(lines: DataFrame, raw: str = "raw_line", line_no: str = "line_no") -> DataFrame:
    """``lines`` plus ``is_header``, ``geometry``, ``switches`` and ``reason`` (null for a valid line).

    ``geometry`` and ``switches`` come from the permissive reader and hold the
    raw text of a line it rejected in ``corrupt_raw``.  A line of more than
    ``MOST_COLUMNS`` tabs goes to the reader only if it is well quoted and has
    no more fields than a record, the other tabs being inside quotes; else they
    are null, and the line is rejected with its text in its own column.
    """
    taken = {"is_header", "geometry", "switches", "reason"}
    keep = lines.select([F.col(f"`{c}`").alias(f"src_{c}" if c in taken else c) for c in lines.columns])
    d = keep.withColumn("__raw", F.coalesce(F.col(raw), F.lit("")))
    d = _once(d, __line=_line(F.col("__raw")))
    d = _once(d, __parts=F.split("__line", '"', -1))
    header_line = F.coalesce((F.col(line_no) >= 1) & (F.col(line_no) <= HEADER_LINES), F.lit(False))
    d = _once(d, is_header=header_line, __text=_reader_text(F.col("__parts")))
    # The reader refuses more columns than it has room for; a line that has so many fields is rejected by its count below.
    few_tabs = F.length("__text") - F.length(F.replace("__text", F.lit("\t"), F.lit(""))) < MOST_COLUMNS
    text = F.when(few_tabs | (well_quoted(F.col("__parts")) & (_separators(F.col("__parts")) < HEADER_FIELDS)), F.col("__text"))
    d = _once(
        d, geometry=F.when(~F.col("is_header"), F.from_csv(text, F.lit(GEOMETRY.simpleString()), READER)),
        switches=F.when(F.col("is_header"), F.from_csv(text, F.lit(SWITCHES.simpleString()), READER)),
    )

    # What the reader accepted and the grammar does too: plain numbers in their places, values in their bounds.
    g = F.col("geometry")
    in_bounds = (g.code > 0) & (g.bore > 0) & (g.bore <= MAX_BORE) & ((g.code != 100) | F.contains(g.tail, F.lit(",")))
    for c in COORDS:
        in_bounds = in_bounds & (F.abs(g[c]) < float("inf"))
    short = F.length("__text") <= SHORT
    accepted = F.when(F.col("is_header"), F.col("switches.corrupt_raw").isNull() & short & F.col("__text").rlike(PLAIN_HEADER)).otherwise(
        g.corrupt_raw.isNull() & short & F.col("__text").rlike(PLAIN_GEOMETRY) & in_bounds
    )
    # Everything else is classified again from its pieces; for accepted lines these are null and cost nothing.
    d = _once(d, __accepted=F.coalesce(accepted, F.lit(False)))
    d = _once(d, __again=F.when(~F.col("__accepted"), F.col("__parts")))
    again, blank = F.col("__again"), F.col("__line") == ""
    d = _once(d, __quoted=well_quoted(again), __f=F.when(blank, F.array().cast("array<string>")).otherwise(_fields(again)))
    f = F.col("__f")
    at = lambda i: F.get(f, F.lit(i))
    header = (
        F.when(F.size(f) != HEADER_FIELDS, "column_count").when(~F.forall(f, lambda x: x.rlike(INTEGER)), "bad_switch")
    )
    coords = F.lit(True)
    for i in range(1, 7):
        coords = coords & _finite(at(i))
    bore = at(7).try_cast("double")
    geometry = (
        F.when(F.size(f) != GEOMETRY_FIELDS, "column_count")
        .when(~(at(0).rlike(CODE) & (at(0).try_cast("int") > 0)), "bad_code")
        .when(~coords, "bad_coord")
        .when(~(_finite(at(7)) & (bore > 0) & (bore <= MAX_BORE)), "bad_bore")
        .when((at(0).try_cast("int") == 100) & ~F.contains(at(9), F.lit(",")), "bad_tail")
    )
    judged = F.when(~F.col("__quoted"), "quoting").otherwise(F.when(F.col("is_header"), header).otherwise(geometry))
    d = _once(d, reason=F.when(~F.col("__accepted"), judged))
    return d.select(*keep.columns, "is_header", "geometry", "switches", "reason")


def split_lines(lines: DataFrame, raw: str = "raw_line", line_no: str = "line_no") -> tuple[DataFrame, DataFrame]:
    """(valid geometry records with typed columns, rejects with ``reason`` and the retained raw text)."""
    read = read_lines(lines, raw, line_no)
    own = [c for c in read.columns if c not in ("is_header", "geometry", "switches", "reason")]
    names = [f.name for f in GEOMETRY if f.name != "corrupt_raw"]
    good = read.where(F.col("reason").isNull() & ~F.col("is_header")).select(
        *[F.col(f"`{c}`").alias(f"src_{c}" if c in names else c) for c in own], *[F.col(f"geometry.{n}") for n in names]
    )
    bad = read.where(F.col("reason").isNotNull()).select(*own, "reason")
    return good, bad


def header_lines(lines: DataFrame, raw: str = "raw_line", line_no: str = "line_no") -> DataFrame:
    """Valid header records with typed switches; with ``split_lines`` they account for every line.

    A switch beyond 64 bits is null, and ``corrupt_raw`` then holds the line's text.
    """
    read = read_lines(lines, raw, line_no)
    own = [c for c in read.columns if c not in ("is_header", "geometry", "switches", "reason")]
    names = SWITCHES.names
    return read.where(F.col("reason").isNull() & F.col("is_header")).select(
        *[F.col(f"`{c}`").alias(f"src_{c}" if c in names else c) for c in own], *[F.col(f"switches.{n}") for n in names]
    )
