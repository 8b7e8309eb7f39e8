"""Keys as the sources spell them, brought to one form."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def uci_key(uci: Column) -> Column:
    """Upper case, without braces and surrounding blanks or tabs; null when nothing is left."""
    bare = F.upper(F.btrim(F.translate(uci, "{}", ""), F.lit(" \t")))
    return F.when(bare != "", F.concat(F.lit("u:"), bare))


def graphic_key(drawing: Column, ref: Column) -> Column:
    """A graphic reference is local to its drawing; null when either part is."""
    return F.concat(F.lit("g:"), drawing.cast("string"), F.lit(":"), ref.cast("string"))
