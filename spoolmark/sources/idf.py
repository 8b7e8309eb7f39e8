"""Scans of record lines (one row per line) as the matching tools read them.

The tools are lenient: a line counts when it splits at blanks into at least
eight fields, its code is an integer and its numbers parse; a pipe (code 100)
needs a comma in the fields after the eighth.  The strict reading with reasons
is ``operators.rejects``.  Lines repeat as often as they occur; null lines and
lines of other forms give no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spoolmark.functions.text import serial_label

PIPE, FLOW_MARK = 100, 149


def split_fields(raw: Column) -> Column:
    """Fields between runs of white space."""
    return F.filter(F.split(F.coalesce(raw, F.lit("")), r"[ \t\r\n\x0b\f]+"), lambda x: x != "")


def code_of(fields: Column) -> Column:
    first = F.get(fields, F.lit(0))
    return F.when(first.rlike("^-?[0-9]+$"), first.try_cast("int"))


def geometry(lines: DataFrame, file: str, line_no: str, raw: str, row: str) -> DataFrame:
    """(file, line_no, row, code, ax..bz, bore, length) of the geometry lines."""
    f = F.col("__f")
    # A single underscore between digits groups them.
    n = lambda i: F.regexp_replace(F.get(f, F.lit(i)), "(?<=[0-9])_(?=[0-9])", "").try_cast("double")
    d = lines.select(F.col(file).alias("file"), F.col(line_no).alias("line_no"), F.col(row).alias("row"), split_fields(F.col(raw)).alias("__f"))
    d = d.where(F.size(f) >= 8).select(
        "file", "line_no", "row", code_of(f).alias("code"),
        *[n(i + 1).alias(c) for i, c in enumerate(("ax", "ay", "az", "bx", "by", "bz", "bore"))],
        F.exists(F.slice(f, 9, F.greatest(F.size(f), F.lit(0))), lambda x: x.contains(",")).alias("comma"),
    )
    ok = F.col("code").isNotNull()
    for c in ("ax", "ay", "az", "bx", "by", "bz", "bore"):
        ok = ok & F.col(c).isNotNull()
    length = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2 + (F.col("az") - F.col("bz")) ** 2)
    return d.where(ok & ((F.col("code") != PIPE) | F.col("comma"))).withColumn("length", length).drop("comma")


def numbered(rows: DataFrame, code: int = PIPE, prefix: str = "I") -> DataFrame:
    """The lines of one code with a serial label per file in the order of the lines."""
    w = Window.partitionBy("file").orderBy("line_no", "row")
    return rows.where(F.col("code") == code).withColumn("label", serial_label(prefix, F.row_number().over(w)))


def chain_context(lines: DataFrame, file: str, line_no: str, raw: str, row: str) -> DataFrame:
    """Pipes with the marks around them; files with branch records (41, 42, 55) are not eligible and give no row."""
    d = lines.select(F.col(file).alias("file"), F.col(line_no).alias("line_no"), F.col(row).alias("row"), F.upper(raw).alias("text"), split_fields(F.col(raw)).alias("f"))
    d = d.withColumn("code", code_of(F.col("f"))).where("code is not null")
    w = Window.partitionBy("file").orderBy("line_no", "row")
    whole = Window.partitionBy("file")
    near = lambda flag, a, b: F.coalesce(F.max(flag).over(w.rowsBetween(a, b)), F.lit(False))
    d = d.select(
        "file", "line_no", "row", "code", "f",
        near(F.col("text").contains("FLOW"), -4, 4).alias("flow"),
        near(F.col("code").isin(35, 36), -3, 3).alias("elbow"),
        (near(F.col("code").isin(150, 151, 152), 1, 4) | F.lead("code").over(w).isNull()).alias("terminal"),
        F.max(F.col("code").isin(41, 42, 55)).over(whole).alias("branched"),
    )
    pipe = (F.col("code") == PIPE) & (F.size("f") >= 8) & F.exists(F.slice("f", 9, F.greatest(F.size("f"), F.lit(0))), lambda x: x.contains(","))
    return d.where(pipe & ~F.col("branched")).select("file", "line_no", "row", "flow", "elbow", "terminal")


def flow_marked(lines: DataFrame, file: str, line_no: str, raw: str, row: str) -> DataFrame:
    """(file, serial) of the pipes that a FLOW marker precedes; a marker serves the next pipe only."""
    d = lines.select(F.col(file).alias("file"), F.col(line_no).alias("line_no"), F.col(row).alias("row"), F.col(raw).alias("raw"), code_of(split_fields(F.col(raw))).alias("code"))
    mark = (F.col("code") == FLOW_MARK) & F.col("raw").contains("FLOW")
    d = d.where(mark | (F.col("code") == PIPE)).withColumn("mark", mark)
    w = Window.partitionBy("file").orderBy("line_no", "row")
    d = d.withColumn("pending", F.coalesce(F.lag("mark").over(w), F.lit(False))).where(~F.col("mark"))
    return d.withColumn("serial", F.row_number().over(w)).where("pending").select("file", "serial")


def switches(lines: DataFrame, file: str, line_no: str, raw: str) -> DataFrame:
    """(file, status, viewpoint): the header's 140 option switches are whole or not; the 42nd is the viewpoint."""
    f = split_fields(F.col(raw))
    head = lines.where(F.col(line_no).between(1, 10)).groupBy(F.col(file).alias("file")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(line_no).alias("n"), f.alias("f")))).alias("rows")
    )
    good = F.forall("rows", lambda r: (F.size(r.f) == 14) & F.forall(r.f, lambda x: x.rlike("^[+-]?[0-9]+$")))
    values = F.flatten(F.transform("rows", lambda r: r.f))
    return head.select(
        "file", F.when(good & (F.size(values) == 140), "whole").otherwise("broken").alias("status"),
        F.when(good & (F.size(values) == 140), F.get(values, F.lit(41)).try_cast("int")).alias("viewpoint"),
    )
