"""Evaluation passages inside a training corpus, found with suffix arrays of corpus shards.

Texts are read as words (see ``words``).  Each task cuts its share of the
corpus into shards of a bounded number of words, builds the suffix array of
every shard by prefix doubling and binary-searches every suffix of every test
item in it, all suffixes at a time.  The range found holds every place of the
shard that agrees for at least ``MIN_WORDS`` words; the agreement is then
extended to the longest verbatim match.  The corpus is read once and never
shuffled; only the pairs found are.  Suffixes that hold a word no item has
within their first ``MIN_WORDS`` words cannot agree with any item and are left
out of the array.

The test items are indexed once, in blocks of at most ``BLOCK_CHARS`` characters,
and sent to all tasks, at most ``PASS_BLOCKS`` blocks at a time, so what is
broadcast is bounded whatever the size of the test set.  A task reads its texts
once for all blocks of a pass; a test set of more blocks takes more passes.

Defined results: null, empty and short texts on either side match nothing; a
document occurs once for each item it carries, with its longest match (ties:
first place in the document, then in the item); exact copies of a document
each occur under their own id; a repeated row counts once; further columns are
not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

MIN_WORDS = 13
SHARD_WORDS = 2_000_000
BLOCK_CHARS = 2_000_000
PASS_BLOCKS = 8

#: A word is one character U+4E00 to U+9FFF or a run of other letters and digits.
WORD = re.compile(r"[一-鿿]|[^\W_一-鿿]+")

FOUND = T.StructType(
    [
        T.StructField("item_id", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.IntegerType()),
        T.StructField("doc_word", T.IntegerType()),
        T.StructField("item_word", T.IntegerType()),
    ]
)


def words(text: str) -> list[str]:
    """Words of a text after NFKC and lower-casing."""
    return WORD.findall(unicodedata.normalize("NFKC", text).lower())


class Items:
    """Test items of one block as one array of word numbers, each item followed by a separator."""

    def __init__(self, rows: list[tuple[int, str]], min_words: int):
        self.vocabulary: dict[str, int] = {}
        stream, owner, place = [], [], []
        self.ids = []
        for item, text in rows:
            own = words(text)
            if len(own) < min_words:
                continue
            number = len(self.ids)
            self.ids.append(item)
            stream += [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in own] + [-2]
            owner += [number] * (len(own) + 1)
            place += range(len(own) + 1)
        # A run of separators at the end lets windows be read without bounds checks.
        self.min_words = min_words
        self.stream = np.array(stream + [-2] * min_words, np.int32)
        self.owner, self.place = np.array(owner + [0] * min_words, np.int32), np.array(place + [0] * min_words, np.int32)
        whole = np.concatenate([[0], np.cumsum(self.stream >= 0)])
        self.starts = np.flatnonzero(whole[min_words:] - whole[:-min_words] == min_words)

    def heads(self) -> np.ndarray:
        """The first words of every suffix that is searched for; made anew for each use, as they are many."""
        return np.lib.stride_tricks.sliding_window_view(self.stream, self.min_words)[self.starts].astype(np.int64)


def suffix_array(stream: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` in the order of the first ``depth`` words of their suffixes, by prefix doubling."""
    rank = stream - stream.min()
    n, step = len(stream), 1
    while step < depth:
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:]
        joint = rank * (rank.max() + 2) + after + 1
        _, rank = np.unique(joint, return_inverse=True)
        step *= 2
    return starts[np.argsort(rank[starts], kind="stable")]


def _bound(stream: np.ndarray, array: np.ndarray, heads: np.ndarray, after: bool) -> np.ndarray:
    """For each head, the first place of the suffix array whose suffix is not below (or is above) it."""
    lo, hi = np.zeros(len(heads), np.int64), np.full(len(heads), len(array), np.int64)
    reach = np.arange(heads.shape[1])
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) // 2
        suffix = stream[array[mid][:, None] + reach]
        differs = suffix != heads[open_]
        at = differs.argmax(axis=1)
        row = np.arange(len(open_))
        equal = ~differs[row, at]
        below = np.where(equal, after, suffix[row, at] < heads[open_][row, at])
        lo[open_] = np.where(below, mid + 1, lo[open_])
        hi[open_] = np.where(below, hi[open_], mid)


def search_shard(docs: list[int], texts: list[np.ndarray], items: Items, min_words: int) -> pd.DataFrame:
    """Longest match of every (item, document) of one shard with at least ``min_words`` words.

    ``texts`` holds the word numbers of each document, -1 for a word that no item has.
    """
    gap = np.array([-1])
    stream = np.concatenate([part for own in texts for part in (own, gap)] + [np.full(min_words, -1)])
    sizes = np.array([len(own) + 1 for own in texts])
    owner = np.repeat(np.arange(len(texts)), sizes)
    first = np.cumsum(sizes) - sizes
    known = np.concatenate([[0], np.cumsum(stream >= 0)])
    starts = np.flatnonzero(known[min_words:] - known[:-min_words] == min_words)
    empty = pd.DataFrame({f.name: pd.Series(dtype="int64" if i < 2 else "int32") for i, f in enumerate(FOUND)})
    if not len(starts) or not len(items.starts):
        return empty
    array = suffix_array(stream, starts, min_words)
    heads = items.heads()
    lo = _bound(stream, array, heads, False)
    hi = _bound(stream, array, heads, True)
    hit = np.flatnonzero(hi > lo)
    best: list[pd.DataFrame] = []
    for chunk in np.array_split(hit, max(1, int((hi - lo)[hit].sum() // 2_000_000))):
        count = (hi - lo)[chunk]
        if not count.sum():
            continue
        query = np.repeat(items.starts[chunk], count)
        offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        place = array[np.repeat(lo[chunk], count) + offset]
        # A match that could begin one word earlier is part of a longer one.
        longer = (query > 0) & (place > 0) & (items.stream[query - 1] >= 0) & (items.stream[query - 1] == stream[place - 1])
        query, place = query[~longer], place[~longer]
        length = np.full(len(query), min_words)
        going = np.arange(len(query))
        while len(going):
            a, b = query[going] + length[going], place[going] + length[going]
            more = (items.stream[a] >= 0) & (items.stream[a] == stream[b])
            going = going[more]
            length[going] += 1
        best.append(pd.DataFrame({"i": items.owner[query], "d": owner[place], "n": length, "p": place, "q": items.place[query]}))
    if not best:
        return empty
    top = pd.concat(best).sort_values(["i", "d", "n", "p", "q"], ascending=[True, True, False, True, True]).drop_duplicates(["i", "d"])
    d = top["d"].to_numpy()
    return pd.DataFrame(
        {
            "item_id": np.array(items.ids)[top["i"]], "doc_id": np.array(docs)[d], "n_words": top["n"].astype("int32").to_numpy(),
            "doc_word": (top["p"].to_numpy() - first[d]).astype("int32"), "item_word": top["q"].astype("int32").to_numpy(),
        }
    )


def _blocks(bench: DataFrame, item_id: str, item_text: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The test items in blocks of bounded size, read from one partition at a time."""
    rows, size = [], 0
    for row in bench.select(item_id, item_text).where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).distinct().toLocalIterator():
        if rows and size + len(row[1]) > block_chars:
            yield rows
            rows, size = [], 0
        rows.append((row[0], row[1]))
        size += len(row[1])
    if rows:
        yield rows


def find_leaks(
    docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text",
    min_words: int = MIN_WORDS, shard_words: int = SHARD_WORDS, block_chars: int = BLOCK_CHARS, pass_blocks: int = PASS_BLOCKS,
) -> DataFrame:
    """(item_id, doc_id, n_words, doc_word, item_word) of the longest match of every leaked pair."""
    spark = docs.sparkSession
    corpus = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")

    def searched(blocks: list[Items]) -> DataFrame:
        sent = [spark.sparkContext.broadcast(b) for b in blocks]

        def shard(ids: list[int], own: list[np.ndarray], known: dict[str, int]) -> Iterator[pd.DataFrame]:
            for block in sent:
                items = block.value
                # Words of the shard by their numbers in the block, -1 for those it lacks.
                number = np.array([items.vocabulary.get(w, -1) for w in known] or [-1], np.int64)
                yield search_shard(ids, [number[t] for t in own], items, min_words)

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, own, known, size = [], [], {}, 0
            for pdf in batches:
                for d, t in zip(pdf["doc_id"].tolist(), pdf["text"].tolist()):
                    ids.append(d)
                    own.append(np.array([known.setdefault(w, len(known)) for w in words(t)], np.int32))
                    size += len(own[-1]) + 1
                    if size >= shard_words:
                        yield from shard(ids, own, known)
                        ids, own, known, size = [], [], {}, 0
            if ids:
                yield from shard(ids, own, known)

        return corpus.mapInPandas(search, FOUND)

    found, held = [], []
    for block in _blocks(bench, item_id, item_text, block_chars):
        held.append(Items(block, min_words))
        if len(held) == pass_blocks:
            found.append(searched(held))
            held = []
    if held:
        found.append(searched(held))
    if not found:
        return spark.createDataFrame([], FOUND)
    order = F.struct(-F.col("n_words"), "doc_word", "item_word")
    return (
        reduce(DataFrame.unionAll, found)
        .groupBy("item_id", "doc_id")
        .agg(F.min_by(F.struct("n_words", "doc_word", "item_word"), order).alias("m"))
        .select("item_id", "doc_id", "m.n_words", "m.doc_word", "m.item_word")
    )


def clean_corpus(docs: DataFrame, leaks: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents that carry no test passage."""
    return docs.join(leaks.select(F.col("doc_id").alias("__leaked")).distinct(), F.col(doc_id) == F.col("__leaked"), "left_anti")
