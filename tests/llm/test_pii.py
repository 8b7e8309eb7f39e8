import itertools
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from spoolmark.llm import pii, pii_labels as labels
from spoolmark.llm.pii_tokens import Tokens, fold, word_code

from . import held_out

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("pii_kind", T.StringType())])


@pytest.fixture(scope="module")
def field():
    return pii.Field.load(pii.train([], made=4_000).dump())


def score(field, docs):
    """Recall and precision of exact places."""
    got = pii.places(field, list(range(len(docs))), [t for t, _ in docs])
    found = {(r.doc_id, r.pii_kind, r.start_pos, r.end_pos) for r in got.itertuples()}
    truth = {(d, *p) for d, (_, places) in enumerate(docs) for p in places}
    return len(found & truth) / len(truth), len(found & truth) / max(1, len(found))


def test_made_up_texts_not_trained_on(field):
    maker = labels.Maker(12345)
    recall, precision = score(field, [maker.text() for _ in range(500)])
    assert recall >= 0.9 and precision >= 0.9


def test_wording_and_names_that_no_source_has(field):
    sources = " ".join((*labels.ENGLISH, *labels.GERMAN, *labels.CHINESE)).lower()
    for marked in (held_out.MARKED, held_out.SECOND):
        docs = held_out.texts(marked)
        assert not any(fold(t).lower() in sources for t, _ in docs)
        recall, precision = score(field, docs)
        assert recall >= 0.75 and precision >= 0.75


def test_field_differs_from_bare_patterns(field):
    docs = held_out.texts()
    words = labels.NameWords([], set())
    by_pattern = [(d, *p) for d, (t, _) in enumerate(docs) for p in labels.weak_labels(fold(t), words)[0]]
    people = {(d, *p) for d, (_, places) in enumerate(docs) for p in places if p[0] == "person"}
    got = pii.places(field, list(range(len(docs))), [t for t, _ in docs])
    found = {(r.doc_id, r.pii_kind, r.start_pos, r.end_pos) for r in got.itertuples()}
    assert len(people & found) > 2 * len(people & set(by_pattern))


def test_skip_edges_raise_the_score(field):
    docs = []
    for k in range(200):
        maker = labels.Maker(1000 + k)
        name = f"{maker.word()} {maker.word()}"
        first, (before, after) = f"Dear {name}, thank you for your letter. ", [("So ", " it was, more or less."), ("Then ", " once more, oddly.")][k % 2]
        spots = [5, len(first) + len(before)]
        docs.append((first + before + name + after, {("person", s, s + len(name)) for s in spots}))
    linked = score(field, docs)[0]
    without = pii.Field(field.weights, field.move, field.begin, np.ones((pii.N, pii.N)), field.common)
    assert linked > score(without, docs)[0] + 0.1


def test_sure_tokens_change_nothing(field):
    maker = labels.Maker(77)
    t = Tokens([maker.text()[0] for _ in range(300)])
    a, b = field.label(t), field.label(t, sure=1e9)
    assert (a != b).sum() <= 0.002 * (b > 0).sum()


def test_marginals_and_best_path_agree_with_enumeration():
    rng = np.random.default_rng(1)
    e, move, begin = rng.random((7, pii.N)), rng.random((pii.N, pii.N)), rng.random(pii.N)
    first = np.array([0, 3, 3, 7])
    chains = pii.Chains(first)
    a, b = pii.forward_backward(chains, e, move, begin)
    p = pii._normal(a * b)
    exact, best = np.zeros((3, pii.N)), (0, None)
    for y in itertools.product(range(pii.N), repeat=3):
        w = begin[y[0]] * e[0, y[0]] * move[y[0], y[1]] * e[1, y[1]] * move[y[1], y[2]] * e[2, y[2]]
        best = max(best, (w, y))
        for k in range(3):
            exact[k, y[k]] += w
    assert np.allclose(p[:3], exact / exact.sum(axis=1, keepdims=True))
    assert tuple(pii._best_paths(chains, np.log(e), np.log(move), np.log(begin))[:3]) == best[1]


def test_table_with_odd_texts(spark, field):
    maker = labels.Maker(4)
    texts = [maker.text()[0] for _ in range(20)] + [None, "", "   ", "x" * 300_000, "Tel. +44 7700 900 123; " * 3000, "Ｔｅｌ. ＋４４ ７７００ ９００ １２３", "😀 Approved by Sarah Thompson on Friday. 😀"]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(0, texts[0], "again"), (None, "Id no: 911-22-3333", "")]
    d = spark.createDataFrame(rows, DOCS).repartition(3)
    model = field.dump()
    got = pii.find_pii(d, model=model).collect()
    assert len(got) == len(set(got))
    assert not {r.doc_id for r in got} & {None, 20, 21, 22, 23}
    assert [(r.pii_kind, texts[26][r.start_pos : r.end_pos]) for r in got if r.doc_id == 26] == [("person", "Sarah Thompson")]
    masked = {r.doc_id: r.text for r in pii.mask_pii(d.where("doc_id is not null"), model=model).collect()}
    assert masked[20] is None and masked[21] == "" and masked[23] == texts[23]
    for i, text in enumerate(texts):
        if text:
            want = text
            for r in sorted((r for r in got if r.doc_id == i), key=lambda r: -r.start_pos):
                want = f"{want[: r.start_pos]}[{r.pii_kind.upper()}]{want[r.end_pos :]}"
            assert masked[i] == want
    assert pii.find_pii(d.limit(0)).count() == 0


def test_skip_edges_carry_a_label():
    # Node 0 is sure of label 1, node 3 is undecided; only the skip edge links them.
    t = Tokens(["Marla x y Marla"])
    on = np.ones(t.size, bool)
    assert [x.tolist() for x in pii.skip_edges(t, np.zeros(0, np.uint64), on)] == [[0], [3]]
    skip = np.ones((pii.N, pii.N))
    skip[1, 1] = 5
    f = pii.Field(np.zeros((1 << pii.BITS, pii.N), np.float32), np.zeros((pii.N, pii.N)), np.zeros(pii.N), skip, np.zeros(0, np.uint64))
    rows = pii.features(t, f.known)
    f.weights[np.setdiff1d(rows[0], rows[1:])] += np.eye(pii.N)[1] * 3
    f.weights[np.setdiff1d(rows[3], rows[:3])[:1], 0] += 0.3
    f = pii.Field(f.weights, f.move, f.begin, skip, f.common)
    assert f.label(t)[3] == 1
    f.skip = np.ones((pii.N, pii.N))
    assert f.label(t)[3] == 0


def test_han_pairs_have_skip_edges():
    t = Tokens(["签名:亓砚舟。图纸由于亓砚舟的意见。"])
    a, b = pii.skip_edges(t, np.zeros(0, np.uint64), np.ones(t.size, bool))
    assert sorted(zip(a.tolist(), b.tolist())) == [(3, 11), (4, 12), (4, 12), (5, 13)]


def test_tokens():
    text = "O'Neil's ＡＢ１２,x.y@z.exampleW4 \u3000王é😀\n\0 end"
    t = Tokens(["", text, None or " ", "a"])
    assert [text[s:e] for d, s, e in zip(t.doc, t.start, t.end) if d == 1] == ["O'Neil", "'", "s", "ＡＢ", "１２", ",", "x", ".", "y", "@", "z", ".", "example", "W", "4", "王", "é", "😀", "end"]
    assert int(t.word[0]) == word_code("o'neil") and t.doc[-1] == 3 and t.start[-1] == 0
    assert Tokens([]).size == 0 and Tokens([""]).size == 0


def test_resident_check_digit():
    good, bad = "11010519491231002X", "110105194912310021"
    t = Tokens([f"{good} {bad}".replace(" ", "; ")])
    t._runs()
    marks = t.checks()
    assert marks[0] == 1 and marks[-1] == 2


def test_folding_keeps_places():
    text = "Ａ　‑１２３ – ’"
    assert len(fold(text)) == len(text)


def test_unsettled_forms_are_left_out():
    texts = [fold("Checked by Marla Karrowin. ")] * 3 + ["Karrowin and Tobin Stell met. Passport 123456789. The next one in the drawer was 987654321."]
    common = labels.common_words(texts)
    places, open_ = labels.weak_labels(texts[3], labels.NameWords(texts, common))
    assert [texts[3][s:e] for _, s, e in places] == ["123456789"]
    assert {texts[3][s:e] for s, e in open_} >= {"Tobin Stell"}
