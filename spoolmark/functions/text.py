"""Text normalisation as column expressions; null in, null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def digit_family(text: Column) -> Column:
    """Runs of digits as one ``#``."""
    return F.regexp_replace(text, "[0-9]+", "#")


def stem_key(stem: Column) -> Column:
    """Lower case without trailing groups of a separator and a known suffix or number."""
    return F.regexp_replace(F.lower(stem), "(?:[-_.](?:pcf|sha|iso|[0-9]+))+$", "")


def common_prefix_length(a: Column, b: Column) -> Column:
    """Characters that two texts share from their start; 0 for a null."""
    n = F.least(F.length(a), F.length(b))
    places = F.filter(F.sequence(F.lit(1), n), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    return F.when(n.isNull() | (n == 0), 0).otherwise(F.coalesce(F.array_min(places) - 1, n)).cast("int")


def slug(text: Column, longest: int = 80, default: str = "project") -> Column:
    """A safe name: other signs as ``-``, none at the ends, at most ``longest`` long."""
    clean = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9._-]+", "-"), F.lit(".-"))
    return F.coalesce(F.nullif(F.left(clean, F.lit(longest)), F.lit("")), F.lit(default))


def starts_with_any(text: Column, prefixes: list[str]) -> Column:
    upper = F.upper(F.trim(text))
    return F.exists(F.array(*[F.lit(p) for p in prefixes]), lambda p: upper.startswith(p))


def page_target(text: Column) -> Column:
    """The page a continuation note points to, from ``SHT n`` or ``DRG n``; null without one."""
    found = F.regexp_extract(F.upper(text), r"\b(?:SHT\s+|DRG\s*)([0-9]+)\b", 1)
    return F.nullif(found, F.lit("")).try_cast("int")


def serial_label(prefix: str, number: Column) -> Column:
    """``I007`` and the like: three digits at least."""
    return F.concat(F.lit(prefix), F.when(number < 1000, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string")))


def serial_number(label: Column) -> Column:
    """The number of a label, so that ranges compare numerically."""
    return F.substring(label, 2, 18).try_cast("int")


def utf16_text(data: Column) -> Column:
    """Little-endian UTF-16 bytes as text."""
    return F.decode(data, "UTF-16LE")


def printable(text: Column, longest: int = 120) -> Column:
    """Whether a text is not empty, not too long and without control characters."""
    return F.coalesce((F.length(text) > 0) & (F.length(text) <= longest) & ~text.rlike(r"[\x00-\x08\x0b-\x1f\x7f]"), F.lit(False))


def joined_set(items: Column, sep: str = ",") -> Column:
    """Distinct items in order, joined; nulls left out."""
    return F.array_join(F.array_sort(F.array_distinct(F.array_compact(items))), sep)


def html_escape(text: Column) -> Column:
    out = text
    # The five signs that markup reserves, ampersand first.
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return out


def is_guid(text: Column) -> Column:
    """Whether a text is a braced GUID."""
    return F.coalesce(text.rlike(r"^\{[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\}$"), F.lit(False))


def xml_record(document: Column, path: str, back: int = 0) -> Column:
    """Text of the record at an XPath, ``back`` places from the last one; null when there is none."""
    records = F.xpath(document, F.lit(f"{path}/text()"))
    return F.try_element_at(records, F.lit(-1 - back))


def clean_sentinels(value: Column, *sentinels) -> Column:
    """Null for the values that stand for a missing one (999999, infinity, an empty text)."""
    out = value
    for s in sentinels:
        out = F.nullif(out, F.lit(s))
    return out


def xml_selected(document: Column, path: str, place: int | None = None, back: int = 0, default: Column | None = None) -> Column:
    """Text of the record at ``place`` from the first (from 0), or ``back`` places from the last; ``default`` when there is none or it is blank."""
    records = F.xpath(document, F.lit(f"{path}/text()"))
    found = F.get(records, F.lit(place)) if place is not None else F.try_element_at(records, F.lit(-1 - back))
    found = F.when(F.trim(found) != "", found)
    return found if default is None else F.coalesce(found, default)


def utc_stamp(at: Column) -> Column:
    """An instant (UTC) as ISO-8601 text to the second."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def positional_digits(texts: DataFrame, by: list[str], text: str, x: str, y: str, fields: dict[str, tuple[float, float, float]], y_band: tuple[float, float]) -> DataFrame:
    """Per group the all-digit texts that stand nearest to their fields' places: {name: (from x, to x, nearest x)}, ends of bands excluded.

    A group without one of the fields gives no row; of texts equally near the smaller counts.
    """
    d = texts.where(F.col(text).rlike(r"^[0-9]+\z") & (F.col(y) > y_band[0]) & (F.col(y) < y_band[1]))
    picks = []
    for name, (low, high, near) in fields.items():
        inside = (F.col(x) > low) & (F.col(x) < high)
        key = F.when(inside, F.struct(F.abs(F.col(x) - near).alias("gap"), F.col(text).try_cast("int").alias("value")))
        picks.append(F.min(key)["value"].alias(name))
    found = d.groupBy(*by).agg(*picks)
    whole = F.lit(True)
    for name in fields:
        whole = whole & F.col(name).isNotNull()
    return found.where(whole)


def free_text_anchor(text: Column, box: list[Column], anchor: list[Column], direction: list[Column], mapped: Column, adjusted: Column, cutoff: float, labels: str) -> Column:
    """Whether a text of the left region is free-standing: mapped by its envelope, upright, no label, no container, its envelope left below its anchor.

    ``box`` is (left, bottom, right, top) and ``anchor`` (x, y) in page units;
    ``labels`` is the pattern of texts that are labels of other kinds.
    """
    left, bottom, right, top = box
    height, width = top - bottom, right - left
    # Bounds of the anchor's place beside its envelope, and of a container, in page units.
    beside = (left - anchor[0]).between(-260, -40) & (bottom - anchor[1]).between(-280, -50)
    container = is_container(width, height, F.length(text))
    upright = (F.abs(direction[1]) <= 0.1) & (F.abs(direction[0] - 1) <= 0.1)
    return F.coalesce(mapped & ~adjusted & (anchor[0] < cutoff) & upright & ~text.rlike(labels) & ~container & beside, F.lit(False))


def text_category(text: Column) -> Column:
    """The kind of a text by its first sign: number, extract, log, table, blank, else prose; null for null."""
    kinds = F.when(text.rlike(r"\A[0-9 .-]+\z"), "number").when(text.rlike("(WELD|PIPE|ELBOW)\n"), "extract").when(text.rlike(r"\[[0-9]{4}-[0-9]{2}-[0-9]{2}"), "log")
    return F.when(text.isNotNull(), kinds.when(text.rlike(r"\|.*\|"), "table").when(F.trim(text) == "", "blank").otherwise("prose"))


def evidence_basis(kind: Column, score: Column, least: float = 10.0) -> Column:
    """The strongest basis that evidence gives: direct, derived, candidate (a score above ``least``), else unresolved."""
    scored = (score > least) & ~F.isnan(score)
    return F.when(kind.like("independent%"), "direct").when(kind == "matched_frame_incidence", "derived").when(scored, "candidate").otherwise("unresolved")


def frame_category(kind: Column) -> Column:
    """Frames by the kind of their edges: endpoint, crossing, else null."""
    return F.when(kind == "in_page_exact_endpoint", "endpoint").when(kind.like("cross_page%"), "crossing")


def is_container(width: Column, height: Column, n_chars: Column | int = 2) -> Column:
    """Whether a box is too large to be that of one text: higher than 320 units, or wider than its characters need."""
    chars = F.greatest(F.lit(2), n_chars if isinstance(n_chars, Column) else F.lit(n_chars))
    return (height > 320) | (width > height * chars * 2.2)
