"""Scans of piping component text: lines (path, pos, line) to component, weld and pipe records.

A block starts at a header line and runs to the next one.  Which lines are
headers, and whether coordinates may be signed, differs between the scans, and
so do their results; the difference is kept.  Files are the unit of order:
one file's lines are sorted together, files are spread over tasks.

Defined results: lines before the first header, blocks without the required
attributes and null lines give no record; repeated blocks are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spoolmark.operators.sequences import blocks

#: The kinds that end a block in the pipe and diagnostic scans.
PHYSICAL = ["PIPE", "ELBOW", "WELD", "TEE", "FLANGE", "REDUCER", "VALVE", "CAP", "OLET", "BEND", "INSTRUMENT", "FILTER", "TRAP"]
UNSIGNED, SIGNED = r"[0-9.]+", r"[-0-9.]+"


def lines_of(files: DataFrame, path: str = "path", text: str = "value") -> DataFrame:
    """(path, pos, line) of whole texts."""
    return files.select(F.col(path).alias("path"), F.posexplode(F.split(F.col(text), r"\r\n|\n|\r")).alias("pos", "line"))


def read(spark: SparkSession, location: str) -> DataFrame:
    """(path, pos, line) of the files at a location, each read whole."""
    files = spark.read.text(location, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return lines_of(files)


def any_header(line: Column) -> Column:
    return F.coalesce(line.rlike("^[A-Z][A-Z-]+$") & (line != "MATERIALS"), F.lit(False))


def physical_header(line: Column) -> Column:
    return F.coalesce(line.isin(PHYSICAL), F.lit(False))


def _first(pattern: str, group: int = 1) -> Column:
    hit = F.regexp_extract("line", pattern, group)
    return F.min_by(F.when(F.col("line").rlike(pattern), hit), F.when(F.col("line").rlike(pattern), F.col("pos")))


def _last(name: str) -> Column:
    pattern = rf"^\s*{name} +(.*\S)\s*$"
    hit = F.when(F.col("line").rlike(pattern), F.regexp_extract("line", pattern, 1))
    return F.max_by(hit, F.when(F.col("line").rlike(pattern), F.col("pos")))


def _points(names: str, number: str, where: str = "") -> Column:
    pattern = rf"{where}(?:{names})\s+({number})\s+({number})\s+({number})"
    xyz = [F.regexp_extract("line", pattern, i).try_cast("double") for i in (1, 2, 3)]
    point = F.when(F.col("line").rlike(pattern), F.struct(F.col("pos"), F.struct(*[c.alias(n) for c, n in zip(xyz, ("e", "n", "el"))]).alias("p")))
    return F.transform(F.array_sort(F.collect_list(point)), lambda x: x.p)


def _blocked(lines: DataFrame, header: Column) -> DataFrame:
    return blocks(lines, ["path"], ["pos"], header).where("block > 0")


def components(lines: DataFrame) -> DataFrame:
    """(path, block, kind, id, uci, line_ref, continuation, points) of the blocks with an identifier and a UCI."""
    b = _blocked(lines, any_header(F.col("line"))).groupBy("path", "block").agg(
        F.min_by("line", "pos").alias("kind"), _first(r"COMPONENT-IDENTIFIER\s+([0-9]+)").try_cast("long").alias("id"),
        _first(r"UCI\s+(\{[^}]+\})").alias("uci"), _first(r"COMPONENT-ATTRIBUTE6\s+(\S+)").alias("line_ref"),
        F.bool_or(F.col("line").contains("CONTINUATION")).alias("continuation"), _points("END-POINT|CENTRE-POINT|BRANCH1-POINT", UNSIGNED).alias("points"),
    )
    return b.where("id is not null and uci is not null").withColumn("line_ref", F.coalesce("line_ref", F.lit("")))


def welds(lines: DataFrame) -> DataFrame:
    """Weld blocks with a UCI: the first endpoint of exactly four numbers, of other attributes the last value."""
    end = rf"^\s*END-POINT\s+({SIGNED})\s+({SIGNED})\s+({SIGNED})\s+({SIGNED})\s*$"
    names = ("x", "y", "z", "bore")
    point = F.struct(*[F.regexp_extract("line", end, i + 1).try_cast("double").alias(n) for i, n in enumerate(names)])
    hit = F.col("line").rlike(end)
    b = _blocked(lines, any_header(F.col("line"))).groupBy("path", "block").agg(
        F.min_by("line", "pos").alias("kind"), F.min("pos").alias("start"), _last("UCI").alias("uci"), _last("COMPONENT-IDENTIFIER").alias("component_identifier"),
        _last("MASTER-COMPONENT-IDENTIFIER").alias("master_component_identifier"), _last("SKEY").alias("skey"), _last("WELD-ATTRIBUTE8").alias("description"),
        _last("REPEAT-WELD-IDENTIFIER").alias("repeat_weld_identifier"), F.min_by(F.when(hit, point), F.when(hit, F.col("pos"))).alias("endpoint"),
    )
    return b.where("kind = 'WELD' and uci is not null")


def pipes(lines: DataFrame) -> DataFrame:
    """Straight pipes in the order of their file: an identifier and two different points."""
    b = _blocked(lines, physical_header(F.col("line"))).groupBy("path", "block").agg(
        F.min_by("line", "pos").alias("kind"), F.min("pos").alias("file_order"),
        F.max_by(F.regexp_extract("line", r"^\s*COMPONENT-IDENTIFIER.*?([0-9]+)\s*$", 1), F.when(F.col("line").rlike(r"^\s*COMPONENT-IDENTIFIER"), F.col("pos"))).try_cast("long").alias("id"),
        _points("END-POINT|BRANCH1-POINT", SIGNED, r"^\s*").alias("points"),
    )
    a, z = F.get("points", F.lit(0)), F.get("points", F.lit(1))
    return b.where((F.col("kind") == "PIPE") & F.col("id").isNotNull() & (F.size("points") >= 2) & (a != z)).select("path", "file_order", "id", a.alias("start"), z.alias("end"))


def diagnostics(lines: DataFrame) -> DataFrame:
    """(path, block, kind, points, weld_id): the remark number, else a repeat identifier other than 0."""
    b = _blocked(lines, physical_header(F.col("line"))).groupBy("path", "block").agg(
        F.min_by("line", "pos").alias("kind"), _points("END-POINT|CENTRE-POINT|BRANCH1-POINT", SIGNED, r"^\s*").alias("points"),
        _last("WELD-REMARK-NUMBER").alias("remark"), _last("REPEAT-WELD-IDENTIFIER").alias("repeat"),
    )
    weld = F.when(F.col("kind") == "WELD", F.coalesce("remark", F.nullif("repeat", F.lit("0"))))
    return b.select("path", "block", "kind", "points", weld.alias("weld_id"))


def renumber(lines: DataFrame, numbers: DataFrame) -> DataFrame:
    """``lines`` with the first WELD-REMARK-NUMBER line of each weld block given its number of ``numbers(path, block, number)``; all else unchanged."""
    mark = r"^(\s*WELD-REMARK-NUMBER\s+)\S.*$"
    b = blocks(lines, ["path"], ["pos"], any_header(F.col("line")))
    first = b.where(F.col("line").rlike(mark)).groupBy("path", "block").agg(F.min("pos").alias("pos"))
    target = first.join(numbers, ["path", "block"]).select("path", "pos", "number")
    new = F.concat(F.regexp_extract("line", mark, 1), F.col("number"))
    return lines.join(target, ["path", "pos"], "left").select("path", "pos", F.when(F.col("number").isNotNull(), new).otherwise(F.col("line")).alias("line"))


def whole_text(lines: DataFrame, end: str = "\n") -> DataFrame:
    """(path, value): the lines of each file joined in order."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "line")))
    return lines.groupBy("path").agg(F.array_join(F.transform(ordered, lambda x: F.coalesce(x.line, F.lit(""))), end).alias("value"))


def weld_text(rows: DataFrame) -> DataFrame:
    """(path, pos, line): weld records written as blocks, six to eight lines each, in the order of their ids."""
    put = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"    {name}    "), c.cast("string")))
    n = lambda c: F.call_function("format_number", F.col(f"endpoint.{c}"), F.lit("0.###"))
    ends = F.when(F.col("endpoint").isNotNull(), F.concat_ws("    ", F.lit("    END-POINT"), n("pos_x"), n("pos_y"), n("pos_z"), n("bore")))
    block = F.array_compact(F.array(
        F.lit("WELD"), ends, put("COMPONENT-IDENTIFIER", F.col("component_identifier")), put("MASTER-COMPONENT-IDENTIFIER", F.col("master_component_identifier")),
        put("UCI", F.nullif(F.trim("uci"), F.lit(""))), put("SKEY", F.nullif("skey", F.lit(""))), F.lit("    WELD-REMARK-NUMBER    0"),
    ))
    each = rows.select(F.col("pcf_file").alias("path"), "weld_id", F.posexplode(block).alias("at", "line"))
    return each.select("path", (F.col("weld_id") * 16 + F.col("at")).alias("pos"), "line")
