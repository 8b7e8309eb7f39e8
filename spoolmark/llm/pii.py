"""Personal information inside free text: a skip-chain conditional random field.

Tokens of a document form a chain.  Words that may be part of a name, and pairs
of Han characters, are joined by skip edges to their previous occurrence in the
document, so that a name recognised from its surroundings in one place is
recognised elsewhere.  Observations are hashed features (``pii_tokens``).
Labels are begin and inside of each kind, and none.  Inference is loopy message
passing: forward-backward over all chains of a batch at once, messages across
the skip edges, repeated ``ROUNDS`` times, then the best path under the
messages.  The field alone decides what is found and where it begins and ends;
no pattern proposes, vetoes or moves a place.

Tokens whose best label other than none lies more than ``SURE`` (in nats)
below none, far more than a neighbour or a skip edge can add, are none
without inference; chains run over the others.

No table has labels, so the field is trained on a bounded sample of at most
``TRAIN_DOCS`` texts, chosen by hash, whose labels come from distant
supervision, and on ``TRAIN_MADE`` made-up texts (``pii_labels``).  In
training, words are hidden at random so that shape and surroundings carry a
name.  Training runs in one task and its result, a weight matrix of fixed
size, is what is broadcast.  All documents are read whole, in one narrow pass
without a shuffle.

Defined results: null, empty and blank texts have no places; offsets count
characters of the text as stored; places of a document do not overlap; rows of
a repeated document come out once; an empty table gives no rows; masking keeps
every other character and null texts.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from spoolmark.llm import pii_labels as labels
from spoolmark.llm.pii_labels import KINDS
from spoolmark.llm.pii_tokens import BITS, HAN, LETTER, LOWER_WORD, SIGN, Tokens, features, fold, word_codes

TRAIN_DOCS = 3_000
TRAIN_MADE = 4_000
ROUNDS = 2
EPOCHS = 4
SURE = 5.0
HIDE_UNCOMMON, HIDE_COMMON, HIDE_HAN = 0.6, 0.3, 0.2
#: Tokens of a training chain, after which it is cut at the next token without a label.
CHAIN = 24
LABELS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
N = len(LABELS)

FOUND = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("pii_kind", T.StringType()),
        T.StructField("start_pos", T.IntegerType()),
        T.StructField("end_pos", T.IntegerType()),
    ]
)


def skip_edges(t: Tokens, common: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of tokens (of those marked ``on``) that bear the same uncommon word, or the same pair of Han characters, each with the previous one."""
    doc = t.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    at = np.flatnonzero(on & (t.kind == LETTER) & (t.length > 1))
    at = at[~np.isin(t.word[at], common)]
    a, b = _previous(at, t.word[at] + doc[at])
    two = np.flatnonzero(on[:-1] & on[1:] & (t.kind[:-1] == HAN) & (t.kind[1:] == HAN) & (t.gap[1:] == 0) & (t.doc[1:] == t.doc[:-1])) if t.size > 1 else np.zeros(0, np.int64)
    c, d = _previous(two, t.word[two] * np.uint64(3) + t.word[np.minimum(two + 1, max(t.size - 1, 0))] + doc[two])
    return np.concatenate([a, c, c + 1]), np.concatenate([b, d, d + 1])


def _previous(at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    return at[order[:-1][same]], at[order[1:][same]]


class Chains:
    """Chains of a batch sorted by length, so that step k of all that reach it is one slice."""

    def __init__(self, first: np.ndarray):
        length = np.diff(first)
        order = np.argsort(-length, kind="stable")
        order = order[length[order] > 0]
        self.begin, length = first[:-1][order], length[order]
        steps = int(length[0]) if len(length) else 0
        self.active = np.searchsorted(-length, -np.arange(steps), side="left")
        self.last = self.begin + length - 1

    def __len__(self) -> int:
        return len(self.active)

    def at(self, step: int) -> np.ndarray:
        return self.begin[: self.active[step]] + step


def forward_backward(chains: Chains, e: np.ndarray, move: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward and backward values of all chains for emissions ``e`` (positive) and transitions ``move``."""
    a, b = np.empty_like(e), np.ones_like(e)
    for k in range(len(chains)):
        i = chains.at(k)
        v = e[i] * (begin if k == 0 else a[i - 1] @ move)
        a[i] = v / v.sum(axis=1, keepdims=True)
    for k in range(len(chains) - 2, -1, -1):
        i = chains.at(k + 1)
        v = (b[i] * e[i]) @ move.T
        b[i - 1] = v / v.sum(axis=1, keepdims=True)
    return a, b


def _normal(p: np.ndarray) -> np.ndarray:
    return p / p.sum(axis=1, keepdims=True)


def _emit(scores: np.ndarray) -> np.ndarray:
    return np.exp(scores - scores.max(axis=1, keepdims=True)) + 1e-30


def _best_paths(chains: Chains, log_e: np.ndarray, log_move: np.ndarray, log_begin: np.ndarray) -> np.ndarray:
    n = len(log_e)
    score, back, out = np.empty_like(log_e), np.zeros((n, N), np.int8), np.zeros(n, np.int64)
    for k in range(len(chains)):
        i = chains.at(k)
        if k == 0:
            score[i] = log_e[i] + log_begin
        else:
            reach = score[i - 1][:, :, None] + log_move
            back[i] = reach.argmax(axis=1)
            score[i] = log_e[i] + reach.max(axis=1)
    out[chains.last] = score[chains.last].argmax(axis=1)
    for k in range(len(chains) - 1, 0, -1):
        i = chains.at(k)
        out[i - 1] = back[i, out[i]]
    return out


def _barred() -> tuple[np.ndarray, np.ndarray]:
    """Transitions and beginnings that may not be: an inside label only follows its begin or itself."""
    move, begin = np.zeros((N, N)), np.zeros(N)
    for k in range(len(KINDS)):
        move[:, 2 + 2 * k] = -12
        move[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
    begin[2::2] = -12
    return move, begin


class Field:
    """Weights of features and transitions, the potential of skip edges, and the common words and name lists that features refer to."""

    def __init__(self, weights: np.ndarray, move: np.ndarray, begin: np.ndarray, skip: np.ndarray, common: np.ndarray):
        self.weights, self.move, self.begin, self.skip, self.common = weights, move, begin, skip, common
        self.known = {
            "common": common, "given": word_codes([w.lower() for g in labels.GIVEN for w in g.split("-")]), "family": word_codes([f.lower() for f in labels.FAMILY if f.isalpha()]),
            "han": word_codes(labels.HAN_FAMILY), "street": word_codes([s.lower() for s in labels.STREET_TYPES]), "title": word_codes([s.lower() for s in labels.TITLES]),
        }
        self.excess = (weights[:, 1:].max(axis=1) - weights[:, 0]).astype(np.float32) if len(weights) else weights

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, w=self.weights.astype(np.float16), m=self.move, b=self.begin, s=self.skip, c=self.common)
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> Field:
        z = np.load(io.BytesIO(data))
        return Field(z["w"].astype(np.float32), z["m"], z["b"], z["s"], z["c"])

    def scores(self, f: np.ndarray) -> np.ndarray:
        out = np.zeros((len(f), N), np.float32)
        for k in range(f.shape[1]):
            out += self.weights[f[:, k]]
        return out

    def label(self, t: Tokens, sure: float = SURE) -> np.ndarray:
        """Label of every token by loopy message passing over chains and skip edges."""
        out = np.zeros(t.size, np.int64)
        if not t.size:
            return out
        f = features(t, self.known)
        # The sum of the greatest excesses over none bounds the excess of every label.
        bound = np.zeros(t.size, np.float32)
        for k in range(f.shape[1]):
            bound += self.excess[f[:, k]]
        open_ = np.flatnonzero(bound > -sure)
        scores = self.scores(f[open_]).astype(np.float64)
        keep = scores[:, 1:].max(axis=1) - scores[:, 0] > -sure
        on, base = open_[keep], scores[keep]
        if not len(on):
            return out
        # Chains of neighbouring open tokens; what lies between them is none.
        first = np.flatnonzero(np.append(True, (np.diff(on) > 1) | (np.diff(t.doc[on]) > 0)))
        chains = Chains(np.append(first, len(on)))
        marked = np.zeros(t.size, bool)
        marked[on] = True
        a, b = (np.searchsorted(on, x) for x in skip_edges(t, self.common, marked))
        into = np.zeros((len(on), N))
        inner, begin = np.exp(self.move), self.begin + self.move[0]
        # The token behind a chain is none.
        base[chains.last] += self.move[:, 0]
        if len(a):
            to_b, to_a = np.full((len(a), N), 1 / N), np.full((len(a), N), 1 / N)
            for _ in range(ROUNDS):
                fa, ba = forward_backward(chains, _emit(base + into), inner, np.exp(begin))
                belief = _normal(fa * ba + 1e-30)
                # A message leaves out what came back over its own edge.
                to_b_next = _normal(_normal(belief[a] / np.maximum(to_a, 1e-6)) @ self.skip)
                to_a_next = _normal(_normal(belief[b] / np.maximum(to_b, 1e-6)) @ self.skip.T)
                to_a, to_b = to_a_next, to_b_next
                into = np.zeros((len(on), N))
                np.add.at(into, b, np.log(to_b * N))
                np.add.at(into, a, np.log(to_a * N))
        out[on] = _best_paths(chains, base + into, self.move, begin)
        return out


def _gold(t: Tokens, places: list[list[tuple[str, int, int]]], unsettled: list[list[tuple[int, int]]]) -> np.ndarray:
    """Label of every token; -1 where it is not settled."""
    y = np.zeros(t.size, np.int64)
    for d, (own, left) in enumerate(zip(places, unsettled)):
        a, b = t.first[d], t.first[d + 1]
        start, end = t.start[a:b], t.end[a:b]
        spans = [(s, e, -1, -1) for s, e in left] + [(s, e, 1 + 2 * KINDS.index(k), 2 + 2 * KINDS.index(k)) for k, s, e in own]
        for s, e, head, rest in spans:
            i, j = a + np.searchsorted(end, s, side="right"), a + np.searchsorted(start, e)
            if i < j:
                y[i], y[i + 1 : j] = head, rest
    return y


def _segments(t: Tokens, y: np.ndarray, rng: np.random.Generator) -> list[tuple[int, int]]:
    """Training chains: cut where no place goes on, without unsettled tokens; of those without a place a fifth."""
    out, begin = [], 0
    change = np.append(True, t.doc[1:] != t.doc[:-1]) if t.size else np.zeros(0, bool)
    for i in range(t.size + 1):
        ends = i == t.size or change[i] or y[i] < 0 or (i - begin >= CHAIN and y[i] == 0 and y[i - 1] <= 0)
        if ends:
            if i > begin and ((y[begin:i] > 0).any() or rng.random() < 0.2):
                out.append((begin, i))
            begin = i + 1 if i < t.size and y[i] < 0 else i
    return out


def train(texts: list[str], seed: int = 7, made: int = TRAIN_MADE, extra: list[tuple[str, list[tuple[str, int, int]]]] = ()) -> Field:
    """The field fitted to distantly labelled ``texts``, to made-up ones and to ``extra`` texts with given places."""
    maker, rng = labels.Maker(seed), np.random.default_rng(seed)
    invented = [maker.text() for _ in range(made)] + list(extra)
    folded = [fold(x) for x in texts]
    common = labels.common_words(folded) | labels.common_words([fold(x) for x, _ in invented], 6)
    codes = word_codes(common)
    words = labels.NameWords(folded, common)
    weak = [labels.weak_labels(x, words) for x in folded]
    all_texts = [*texts, *[x for x, _ in invented]]
    move, begin = _barred()
    field = Field(np.zeros((1 << BITS, N), np.float32), move, begin, np.ones((N, N)), codes)
    t = Tokens(all_texts)
    if not t.size:
        return field
    y = _gold(t, [p for p, _ in weak] + [p for _, p in invented], [o for _, o in weak] + [[] for _ in invented])
    chains = _segments(t, y, rng)
    # Seen once as they are, once with words hidden at random, by turns: uncommon ones as if never met, some common ones too.
    chance = np.select([t.kind == HAN, t.kind != LETTER, np.isin(t.word, codes)], [HIDE_HAN, 0.0, HIDE_COMMON], HIDE_UNCOMMON)
    views = [features(t, field.known, hidden=None if k == 0 else rng.random(t.size) < chance) for k in range(2)]
    g_w, g_m = np.full((1 << BITS, N), 1e-3, np.float32), np.full((N, N), 1e-3)
    learnt, seen, slots = np.zeros((N, N)), np.zeros(1 << BITS, bool), np.zeros(1 << BITS, np.int64)
    width = views[0].shape[1]
    for epoch in range(EPOCHS):
        order = rng.permutation(len(chains))
        for k, batch in enumerate(np.array_split(order, max(1, len(order) // 250))):
            spans = [chains[i] for i in batch]
            at = np.concatenate([np.arange(a, b) for a, b in spans]) if spans else np.zeros(0, np.int64)
            if not len(at):
                continue
            first = np.cumsum([0] + [b - a for a, b in spans])
            own, f = Chains(first), views[(k + epoch) % 2][at]
            gold = y[at]
            full = np.exp(learnt + move)
            e = _emit(field.scores(f).astype(np.float64))
            a, b = forward_backward(own, e, full, np.exp(begin))
            p = _normal(a * b + 1e-30)
            delta = p.astype(np.float32)
            delta[np.arange(len(at)), gold] -= 1
            inner = np.setdiff1d(np.arange(len(at)), first[:-1])
            pair = a[inner - 1][:, :, None] * full * (e[inner] * b[inner])[:, None, :]
            expected = (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            observed = np.zeros((N, N))
            np.add.at(observed, (gold[inner - 1], gold[inner]), 1)
            step = expected - observed
            g_m += step**2
            learnt -= 0.5 * step / np.sqrt(g_m)
            flat = f.ravel()
            seen[flat] = True
            touched = np.flatnonzero(seen)
            slots[touched] = np.arange(len(touched))
            slot = slots[flat]
            seen[touched] = False
            grad = np.stack([np.bincount(slot, np.repeat(delta[:, n], width), len(touched)) for n in range(N)], axis=1).astype(np.float32)
            g_w[touched] += grad**2
            field.weights[touched] -= 0.3 * grad / np.sqrt(g_w[touched])
    # Potential of a skip edge: how much more often two linked tokens bear two labels than by chance.
    a, b = skip_edges(t, codes, np.ones(t.size, bool))
    settled = (y[a] >= 0) & (y[b] >= 0)
    joint = np.full((N, N), 0.5)
    np.add.at(joint, (y[a][settled], y[b][settled]), 1)
    joint = (joint + joint.T) / joint.sum() / 2
    skip = np.clip(np.sqrt(joint / np.outer(joint.sum(axis=1), joint.sum(axis=0))), 0.2, 5.0)
    return Field(field.weights, learnt + move, begin, skip, codes)


def _spans(t: Tokens, y: np.ndarray) -> Iterator[tuple[int, str, int, int]]:
    """(document, kind, start, end) of the labelled spans; a name needs a given name or initial beside the family name."""
    kind = (y + 1) // 2
    head = (y > 0) & ((y % 2 == 1) | np.append(True, kind[1:] != kind[:-1]) | np.append(True, t.doc[1:] != t.doc[:-1]))
    for i in np.flatnonzero(head).tolist():
        j = i + 1
        while j < t.size and not head[j] and kind[j] == kind[i] and y[j] > 0 and t.doc[j] == t.doc[i]:
            j += 1
        # Closing signs are no part of a place, but for the dot of an abbreviation and a bracket opened in it.
        while j - 1 > i and t.kind[j - 1] == SIGN and chr(int(t.codes[t.at[j - 1]])) in ",;:<>|\"'。，；：、":
            j -= 1
        if kind[i] == 1:
            latin = (t.kind[i:j] == LETTER).sum()
            if latin == 1 or not latin and not 2 <= (t.kind[i:j] == HAN).sum() <= 4:
                continue
        yield int(t.doc[i]), KINDS[kind[i] - 1], int(t.start[i]), int(t.end[j - 1])


def places(field: Field, ids: list[int], texts: list[str]) -> pd.DataFrame:
    t = Tokens(texts)
    rows = [(ids[d], kind, s, e) for d, kind, s, e in _spans(t, field.label(t))] if t.size else []
    return pd.DataFrame(rows, columns=FOUND.names).astype({"start_pos": "int32", "end_pos": "int32"})


BATCH_CHARS = 500_000


def _fit(docs: DataFrame) -> bytes:
    """The field trained on the bounded sample, as bytes of bounded size."""
    texts = docs.select("text").where(F.length(F.trim("text")) > 0)
    # Only texts below a hash threshold are compared and ordered; four times the sample leaves room for copies.
    share = min(1.0, 4 * TRAIN_DOCS / max(1, texts.count()))
    below = texts.where(F.xxhash64("text") / 2.0**64 + 0.5 < share)
    sample = below.distinct().orderBy(F.xxhash64("text"), "text").limit(TRAIN_DOCS)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts = [x for pdf in batches for x in pdf["text"].tolist()]
        yield pd.DataFrame({"field": [train(texts).dump()]})

    row = sample.coalesce(1).mapInPandas(fit, T.StructType([T.StructField("field", T.BinaryType())])).first()
    return bytes(row[0]) if row else train([]).dump()


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: bytes | None = None) -> DataFrame:
    """(doc_id, pii_kind, start_pos, end_pos) of every place of personal information."""
    used = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    sent = docs.sparkSession.sparkContext.broadcast(model or _fit(used))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        field = Field.load(sent.value)
        for pdf in batches:
            ids, texts, size = [], [], 0
            for d, x in zip(pdf["doc_id"].tolist(), pdf["text"].tolist()):
                ids.append(d)
                texts.append(x)
                size += len(x)
                if size >= BATCH_CHARS:
                    yield places(field, ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield places(field, ids, texts)

    return used.mapInPandas(find, FOUND).distinct()


def mask_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: bytes | None = None) -> DataFrame:
    """(doc_id, text) with every place replaced by ``[KIND]`` and all other characters kept."""
    sent = docs.sparkSession.sparkContext.broadcast(model or _fit(docs.select(F.col(text).alias("text")).where("text is not null")))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])

    def mask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        field = Field.load(sent.value)
        for pdf in batches:
            texts = pdf["text"].tolist()
            cuts: list[list[tuple[int, int, str]]] = [[] for _ in texts]
            at, group, size = [], [], 0
            for i, x in enumerate([*texts, None]):
                if x is not None:
                    at.append(i)
                    group.append(x)
                    size += len(x)
                if group and (size >= BATCH_CHARS or i == len(texts)):
                    for row in places(field, at, group).itertuples(index=False):
                        cuts[row.doc_id].append((row.start_pos, row.end_pos, row.pii_kind))
                    at, group, size = [], [], 0
            for i, found in enumerate(cuts):
                for s, e, kind in sorted(found, reverse=True):
                    texts[i] = f"{texts[i][:s]}[{kind.upper()}]{texts[i][e:]}"
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": texts})

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(mask, schema)
