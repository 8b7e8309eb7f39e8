"""Citations of records that do not exist, or do not exist at the time of citing.

1. One aggregate per key gathers the months in which it is cited and the whole
   months of its life spans; its rows are the dictionary that encodes keys as
   dense integers.
2. Deflated bitmaps per key range hold, for each month, the keys cited in it,
   the keys that begin and the keys that cease to be alive throughout it, and
   once the keys that any parent record has.
3. Month by month the keys alive are ``alive AND NOT ends OR begins``.
   ``cited AND NOT known`` leaves missing keys, ``cited AND NOT alive`` leaves
   the key-months that need a look at instants.  Only those bits are decoded.
4. Citations of decoded key-months are tested exactly against the life spans
   that touch the month only in part: the latest end of all spans begun so far
   must lie behind the citation.  That is a running maximum, so spans and
   citations of a key are never paired.

A key costs one row a task before the first shuffle, however many rows cite
it; the sets it gathers are bounded by the months and pairs of months of the
data.  A range costs three bitmaps of 4 KiB a month.  Citations of a key that
more than ``HOT_ROWS`` rows cite are split over several tasks, each with the
spans of the key.  No side is broadcast beyond what the optimizer measures,
and nothing is collected but the first and last month.

Defined results: a null or blank key is no citation; a null time of citing
matches no life span, so the verdict is ``missing`` or ``late`` with a null
month; a life span with a null start or one that ends before it starts holds
at no instant; repeated rows come out once; empty parents make every citation
``missing``; further columns of the inputs are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from spoolmark.functions.bitmaps import RANGE_BITS, key_bit, key_id, key_range, pack, set_bits, unpack
from spoolmark.plans.lineage import cut, release

NO_MONTH = -1
#: Fixed value: an instant behind all others.
FOREVER = "9999-12-31 23:59:59"
#: Rows that cite one key beyond which they are split.
HOT_ROWS = 200_000
#: What a bitmap of a range and month holds.
CITED, BEGINS, ENDS, KNOWN = 0, 1, 2, 3

SURVIVOR = T.StructType(
    [T.StructField("range", T.LongType()), T.StructField("bit", T.IntegerType()), T.StructField("month", T.IntegerType()), T.StructField("unknown", T.BooleanType())]
)


def month_number(at: Column) -> Column:
    """Months since year 0, or -1 for a null instant."""
    return F.coalesce(F.year(at) * 12 + F.month(at) - 1, F.lit(NO_MONTH)).cast("int")


def citations(rows: DataFrame, src_table: str, src_id: str, key: Column, at: str) -> DataFrame:
    """Rows of one citing table in the operator's form; citations without a key are left out."""
    return rows.select(
        F.lit(src_table).alias("src_table"), F.col(src_id).alias("src_id"), key.alias("key"), F.col(at).alias("at")
    ).where(F.col("key").isNotNull())


def lives(records: DataFrame, key: Column, created: str, deleted: str) -> DataFrame:
    """Life spans of the cited records in the operator's form."""
    return records.select(key.alias("key"), F.col(created).alias("created"), F.col(deleted).alias("deleted")).where(
        F.col("key").isNotNull()
    )


def _survivors(maps: pd.DataFrame) -> pd.DataFrame:
    """Bits of one range that survive ``cited AND NOT known`` or ``cited AND NOT alive``."""
    key_range = int(maps["range"].iloc[0])
    alive, known = np.zeros(RANGE_BITS // 8, np.uint8), np.zeros(RANGE_BITS // 8, np.uint8)
    for bits in maps.loc[maps["kind"] == KNOWN, "bits"]:
        known = unpack(bits)
    found = []
    for month, own in maps[maps["kind"] != KNOWN].groupby("month", sort=True):
        of = dict(zip(own["kind"], own["bits"]))
        if ENDS in of:
            alive = alive & ~unpack(of[ENDS])
        if BEGINS in of:
            alive = alive | unpack(of[BEGINS])
        if CITED in of:
            cited = unpack(of[CITED])
            for bits, unknown in ((cited & ~known, True), (cited & known & ~alive, False)):
                at = set_bits(bits).astype(np.int32)
                found.append(pd.DataFrame({"range": key_range, "bit": at, "month": np.int32(month), "unknown": unknown}))
    return pd.concat(found) if found else pd.DataFrame({f.name: [] for f in SURVIVOR})


def _dictionary(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """One row per key: its number, the months it is cited in, whole months of its spans, first start and citing rows."""
    start, end = F.col("created"), F.col("deleted")
    valid = start.isNotNull() & (end.isNull() | (end > start))
    # Whole months of a span: from the month after its start to the month before its end.
    first = month_number(start) + F.when(F.date_trunc("month", start) == start, 0).otherwise(1)
    last = F.when(end.isNotNull(), month_number(end) - 1)
    whole = F.when(valid & (end.isNull() | (first <= last)), F.struct(first.alias("first"), last.alias("last")))
    cited = rows.select("key", F.col("month").alias("cited"))
    lived = spans.select("key", whole.alias("whole"), F.col("created").alias("born"), F.lit(True).alias("known"))
    both = cited.unionByName(lived, True).groupBy("key")
    gathered = both.agg(
        F.collect_set("cited").alias("months"), F.collect_set("whole").alias("whole"), F.min("born").alias("born"),
        F.coalesce(F.max("known"), F.lit(False)).alias("known"), F.count("cited").alias("n_cites"),
    )
    return gathered.withColumn("kid", F.monotonically_increasing_id())


def _bitmaps(dictionary: DataFrame) -> DataFrame:
    """(range, month, kind, bits) of the cited months, the begins and ends of whole months alive, and the known keys."""
    horizon = dictionary.agg(F.min(F.array_min(F.filter("months", lambda m: m != NO_MONTH))).alias("lo"), F.max(F.array_max("months")).alias("hi")).first()
    lo, hi = (horizon["lo"], horizon["hi"]) if horizon["lo"] is not None else (0, -1)
    within = F.transform("whole", lambda w: F.struct(F.greatest(w["first"], F.lit(lo)).alias("first"), F.least(F.coalesce(w["last"], F.lit(hi)), F.lit(hi)).alias("last")))
    keyed = dictionary.withColumn("within", F.filter(within, lambda w: w["first"] <= w["last"]))
    # Spans of one key may overlap: their months are united first.
    lived = F.array_distinct(F.flatten(F.transform("within", lambda w: F.sequence(w["first"], w["last"]))))
    after, one = F.transform(lived, lambda m: m + 1), F.size("within") == 1
    begins = F.when(one, F.transform("within", lambda w: w["first"])).otherwise(F.array_except(lived, after))
    ends = F.when(one, F.transform("within", lambda w: w["last"] + 1)).otherwise(F.array_except(after, lived))
    tagged = lambda months, kind: F.transform(months, lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("month")))
    has = F.when(F.col("known"), F.array(F.lit(NO_MONTH))).otherwise(F.array().cast("array<int>"))
    events = F.concat(tagged(F.col("months"), CITED), tagged(begins, BEGINS), tagged(ends, ENDS), tagged(has, KNOWN))
    bits = keyed.select("kid", F.explode(events).alias("e")).select(key_range(F.col("kid")).alias("range"), "e.month", "e.kind", key_bit(F.col("kid")).alias("bit"))
    built = bits.groupBy("range", "month", "kind").agg(F.bitmap_construct_agg("bit").alias("bits"))
    return built.select("range", "month", "kind", pack("bits").alias("bits"))


def find_orphans(cites: list[DataFrame], parents: list[DataFrame], hot_rows: int = HOT_ROWS) -> DataFrame:
    """(src_table, src_id, verdict, ref_month) of every citation that does not hold."""
    rows = reduce(DataFrame.unionByName, cites).withColumn("month", month_number(F.col("at")))
    spans = reduce(DataFrame.unionByName, parents)
    dictionary = cut(_dictionary(rows, spans), "keys")
    left = _bitmaps(dictionary).groupBy("range").applyInPandas(_survivors, SURVIVOR)
    left = left.select(key_id(F.col("range"), F.col("bit")).alias("kid"), "month", "unknown")
    pieces = (1 + F.col("n_cites") / hot_rows).cast("int").alias("pieces")
    left = cut(left.join(dictionary.select("kid", "key", "born", pieces), "kid").drop("kid"), "left")
    release(dictionary)

    # The months that a span touches in part, each start with its latest end.
    start, end = F.col("created"), F.col("deleted")
    touched = F.array_distinct(F.filter(F.array(month_number(start), month_number(end)), lambda m: m != NO_MONTH))
    parts = (
        spans.where(start.isNotNull() & (end.isNull() | (end > start)))
        .select("key", F.explode(touched).alias("month"), start.alias("at"), F.coalesce(end, F.lit(FOREVER).cast("timestamp_ntz" if dict(spans.dtypes)["deleted"] == "timestamp_ntz" else "timestamp")).alias("until"))
        .groupBy("key", "month", "at").agg(F.max("until").alias("until"))
    )
    doubtful = left.where("not unknown").select("key", "month", "pieces")
    parts = parts.join(doubtful, ["key", "month"]).select("key", "month", "at", "until", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    suspects = rows.join(left, ["key", "month"]).withColumn("piece", F.pmod(F.xxhash64("src_id"), F.col("pieces")).cast("int")).drop("pieces")
    # A span that begins at the instant of a citation counts, so spans stand first.
    begun = Window.partitionBy("key", "month", "piece").orderBy("at", F.col("src_table").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    judged = suspects.unionByName(parts, True).withColumn("reach", F.max("until").over(begun)).where("src_table is not null")
    holds = ~F.col("unknown") & F.coalesce(F.col("reach") > F.col("at"), F.lit(False))
    verdict = F.when(F.col("unknown"), "missing").when(F.col("born") <= F.col("at"), "deleted").otherwise("late")
    return judged.where(~holds).select(
        "src_table", "src_id", verdict.alias("verdict"), F.substring(F.col("at").cast("string"), 1, 7).alias("ref_month")
    ).distinct()


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphans per table, period and verdict."""
    return orphans.groupBy("src_table", "ref_month", "verdict").agg(F.count("*").alias("n_orphans"))
