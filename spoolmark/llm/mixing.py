"""Mixing sources to target shares of all tokens, with a low-discrepancy schedule.

Each source's documents are shuffled by a hash and cut into blocks of about
``block_tokens`` tokens.  The mix is a sequence of slots of one block each: slot
j has the golden-ratio point ``frac(j / phi)``, and the cumulative target
weights map the point to a source.  The k-th slot of a source takes its block
``k mod blocks``, so a small source is repeated, pass by pass, and no document
is used more often than its source's cap.  The schedule ends at the first slot
that would exceed a cap, which makes the mix as large as the shares allow.

Sizes are tokens of a public byte-level vocabulary.  Running totals over a
source, and ranks over the slots, are two-level prefix sums: sums per bounded
bucket, prefix over the buckets, running sums inside a bucket.  So neither a
source with a third of all rows nor the whole schedule meets in one task.

Defined results: documents without text, id or source, and sources that the
targets do not list, are not used (the targets are the user's short list: more
than ``MAX_TARGETS`` rows are refused); a listed source without documents cannot
hold its share, so the others keep their proportions to each other and the
report shows 0 for it; a target with a null or non-positive share or cap gives
nothing; repeated rows of a document are one document; an empty table gives an
empty mix.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from spoolmark.plans.lineage import cut

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The split pattern of the vocabulary, and the golden ratio's fraction in 32 bits.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
GOLDEN_32 = 2_654_435_769

BLOCK_TOKENS = 256
BUCKET_DOCS = 20_000
CHUNK_SLOTS = 65_536
MAX_SLOTS = 1 << 31
MAX_TARGETS = 1_000
#: Longer texts are tokenized in pieces cut after a line break or blank that no token spans.
PIECE_CHARS = 100_000

SIZED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("n_tokens", T.LongType())])


def _encoder(folder: str):
    import tiktoken

    with open(os.path.join(folder, VOCABULARY), "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str) -> Iterator[str]:
    """The text in pieces whose token counts add up to its own: cuts lie between a non-blank and a single blank before a letter or digit."""
    at = 0
    while len(text) - at > PIECE_CHARS:
        end = at + PIECE_CHARS
        while end < len(text) - 1 and not (text[end] == " " and not text[end - 1].isspace() and text[end + 1].isalnum()):
            end += 1
        if end >= len(text) - 1:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def token_counts(docs: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents with text, id and source."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(tokenizers)
        for pdf in batches:
            sizes = [sum(len(encoder.encode_ordinary(p)) for p in pieces(t)) for t in pdf["text"].tolist()]
            yield pdf[["doc_id", "source"]].assign(n_tokens=pd.Series(sizes, index=pdf.index, dtype="int64"))

    used = docs.select("doc_id", "source", "text").where("doc_id is not null and source is not null and text is not null")
    return used.mapInPandas(count, SIZED).where("n_tokens > 0").groupBy("doc_id").agg(F.min_by("source", F.struct("source", "n_tokens")).alias("source"), F.min_by("n_tokens", F.struct("source", "n_tokens")).alias("n_tokens"))


def _prefix(rows: DataFrame, group: str, bucket: str, order: list[str], size: str, alias: str) -> DataFrame:
    """``rows`` with the sum of ``size`` over the earlier rows of their group, buckets being ordered and bounded."""
    sums = rows.groupBy(group, bucket).agg(F.sum(size).alias("__s"))
    over = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(group, bucket, F.coalesce(F.sum("__s").over(over), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(before, [group, bucket]).withColumn(alias, F.col("__before") + F.coalesce(F.sum(size).over(inside), F.lit(0))).drop("__before")


def blocks(sized: DataFrame, block_tokens: int, seed: int) -> DataFrame:
    """``sized`` with the block of each document in the shuffled order of its source."""
    n_buckets = max(1, -(-sized.count() // BUCKET_DOCS))
    mixed = F.xxhash64("doc_id", F.lit(seed))
    keyed = sized.withColumn("__h", mixed).withColumn("__b", F.floor((F.col("__h") / 2.0**64 + 0.5) * n_buckets))
    placed = _prefix(keyed, "source", "__b", ["__h", "doc_id"], "n_tokens", "__at")
    return placed.select("doc_id", "source", "n_tokens", F.floor(F.col("__at") / block_tokens).alias("__raw"))


def mix(docs: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, seed: int = 42, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(slot, source, doc_id, pass_no, n_tokens): the documents of the mix in the order of their slots."""
    spark = docs.sparkSession
    wanted = (
        targets.where("source_key is not null and target_share > 0 and max_repeats > 0")
        .groupBy(F.col("source_key").alias("source"))
        .agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap"))
    )
    if wanted.count() > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    listed = token_counts(docs, tokenizers).join(F.broadcast(wanted.select("source")), "source")
    listed = cut(listed, "sized")
    # Blocks grow with the corpus where the smallest ones would make more slots than a 32-bit point tells apart.
    most = listed.join(F.broadcast(wanted), "source").agg(F.sum(F.col("n_tokens") * F.col("cap"))).first()[0] or 0
    block_tokens = max(block_tokens, -(-most // (MAX_SLOTS // 4)))
    raw = cut(blocks(listed, block_tokens, seed), "raw")
    # A block that no document starts in (behind a long document) is no block: numbers are made dense.
    some = raw.select("source", "__raw").distinct().withColumn("__bucket", F.floor(F.col("__raw") / CHUNK_SLOTS)).withColumn("__one", F.lit(1))
    dense = _prefix(some, "source", "__bucket", ["__raw"], "__one", "block").select("source", "__raw", "block")
    placed = raw.join(dense, ["source", "__raw"]).select("source", "block", "doc_id", "n_tokens")
    capacity = raw.groupBy("source").agg(F.countDistinct("__raw").alias("n_blocks"), F.sum("n_tokens").alias("tokens")).join(wanted, "source")
    # Blocks of a source with long documents hold more tokens than others: slots are weighed by the mean size of a block.
    weight = F.col("share") / (F.col("tokens") / F.col("n_blocks"))
    plan = capacity.select("source", "n_blocks", "cap", weight.alias("w"))
    total = plan.agg(F.sum("w").alias("w"), F.min(F.col("cap") * F.col("n_blocks") / F.col("w")).alias("m")).first()
    if total["w"] is None:
        return spark.createDataFrame([], "slot long, source string, doc_id long, pass_no int, n_tokens long")
    # One slot more than the fullest source allows, and room for the discrepancy of the points.
    n_slots = int(total["m"] * total["w"]) + 64
    if n_slots >= MAX_SLOTS:
        raise ValueError(f"{n_slots} slots; raise block_tokens")
    # The table of sources has one row per target and is ordered as a whole; it is the user's list, not data.
    cum = Window.orderBy("source").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = cut(plan.withColumn("hi", F.sum("w").over(cum) / total["w"]).withColumn("lo", F.col("hi") - F.col("w") / total["w"]), "ranges")
    bounds = ranges.orderBy("lo").select("source", "lo", "cap", "n_blocks").collect()
    source = F.lit(bounds[0]["source"])
    for row in bounds[1:]:
        source = F.when(F.col("point") >= row["lo"], F.lit(row["source"])).otherwise(source)
    point = F.pmod(F.col("id") * F.lit(GOLDEN_32), F.lit(1 << 32)) / float(1 << 32)
    slots = (
        spark.range(n_slots).withColumn("point", point)
        .select(F.col("id").alias("slot"), source.alias("source"), F.floor(F.col("id") / CHUNK_SLOTS).alias("__chunk"), F.lit(1).alias("__one"))
    )
    ranked = _prefix(slots, "source", "__chunk", ["slot"], "__one", "k").join(F.broadcast(ranges.select("source", "n_blocks", "cap")), "source")
    ranked = cut(ranked.select("slot", "source", "k", "n_blocks", "cap"), "ranked")
    over = ranked.where(F.col("k") >= F.col("n_blocks") * F.col("cap")).agg(F.min("slot")).first()[0]
    end = n_slots if over is None else over
    used = ranked.where(F.col("slot") < end).select(
        "slot", "source", (F.col("k") % F.col("n_blocks")).alias("block"), F.floor(F.col("k") / F.col("n_blocks")).cast("int").alias("pass_no")
    )
    return used.join(placed, ["source", "block"]).select("slot", "source", "doc_id", "pass_no", "n_tokens")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and reached share of every listed source, its tokens, documents and greatest number of uses."""
    uses = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("uses"), F.sum("n_tokens").alias("tokens"))
    got = uses.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n_docs"), F.max("uses").alias("max_used"))
    got = cut(got, "got")
    total = got.agg(F.sum("tokens")).first()[0] or 0
    zero = lambda c: F.coalesce(c, F.lit(0))
    return targets.join(got, F.col("source_key") == F.col("source"), "left").select(
        "source_key", "target_share", "max_repeats",
        (zero(F.col("tokens")) / F.lit(float(total or 1))).alias("reached_share"),
        zero(F.col("tokens")).alias("tokens"), zero(F.col("n_docs")).alias("n_docs"), zero(F.col("max_used")).alias("max_used"),
    )
