import itertools
import random

import numpy as np
import pytest

from spoolmark.operators import search

LEGS = "file string, id long, x double, y double"


def test_assignment_agrees_with_all_permutations():
    rng = np.random.default_rng(4)
    for k in range(300):
        n = int(rng.integers(2, 7))
        turns = rng.integers(0, 4, (2, n)) * np.pi / 2 if k % 2 else rng.random((2, n)) * 7
        cos = np.round(np.cos(turns[0][:, None] - turns[1][None, :]), 12)
        ranked = sorted(((-round(np.mean([cos[i, j] for i, j in enumerate(p)]), 9), -round(min(cos[i, j] for i, j in enumerate(p)), 9), p) for p in itertools.permutations(range(n))))
        best, slack = search._assign(-cos)
        got = search._first_of_ties(cos, best, slack)
        assert tuple(got.tolist()) == ranked[0][2]
        assert abs(search._runner_up(-cos, got) / n - ranked[1][0]) < 1e-8


def test_large_and_unequal_groups(spark):
    rng = random.Random(1)
    turns = [rng.random() * 6 for _ in range(30)]
    left = [("even", i, float(np.cos(a)), float(np.sin(a))) for i, a in enumerate(turns)] + [("odd", i, 1.0, 0.0) for i in range(5)]
    right = [("even", 100 - i, float(np.cos(a)), float(np.sin(a))) for i, a in enumerate(turns)] + [("odd", i, 1.0, 0.0) for i in range(6)]
    rows = search.assign_directions(spark.createDataFrame(left, LEGS), spark.createDataFrame(right, LEGS), "file").collect()
    assert [(r.file, r.mean_cosine) for r in rows] == [("even", 1.0)]
    assert rows[0].pairs == ";".join(f"{i}={100 - i}" for i in range(30))


def test_long_sequences_are_aligned_whole(spark):
    rng = random.Random(5)
    # The sixty left landmarks of ``long`` match only behind 1,500 others.
    long = [("long", k, k, "other", 1) for k in range(1_500)] + [("long", k, k, f"k{k}", 1) for k in range(1_500, 1_560)]
    left, right = list(long), [(f, p - 1_500, i, k, c) for f, p, i, k, c in long if k != "other"]
    for g in range(20):
        for side in (left, right):
            side += [(f"g{g}", k, k, rng.choice(["a", "b", None]), rng.choice([1, 2, None])) for k in range(rng.randrange(1, 9))]
    schema = "file string, place int, id long, kind string, links int"
    got = {r.file: r for r in search.aligned_landmarks(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "file").collect()}
    assert got["long"].score == 60 * 3 - 2 * 1_500 and not got["long"].truncated
    assert got["long"].pairs == ";".join(f"{k}={k}" for k in range(1_500, 1_560))

    def best(x, y):
        if not x or not y:
            return -2 * (len(x) + len(y))
        (_, _, _, k, c), (_, _, _, q, d) = x[0], y[0]
        whole = [best(x[1:], y) - 2, best(x, y[1:]) - 2]
        if k is not None and k == q:
            whole.append(best(x[1:], y[1:]) + (3 if c == d and c is not None else -3))
        return max(whole)

    for g in range(20):
        x, y = ([r for r in side if r[0] == f"g{g}"] for side in (left, right))
        assert got[f"g{g}"].score == best(x, y)


def test_short_segments_seed_poses(spark):
    rng = random.Random(8)
    at = lambda big: [rng.uniform(-900, 900) for _ in range(2)] + [rng.uniform(-900, 900) * big for _ in range(2)]
    short, schema = [at(0.3) for _ in range(20)], "file string, id long, x1 double, y1 double, x2 double, y2 double"
    source = [("f", i, *v) for i, v in enumerate(short + [at(9) for _ in range(14)])]
    # The short ones stand on the other side turned by a right angle; the long ones have no partner.
    target = [("f", i, -y1 + 10, x1, -y2 + 10, x2) for i, (x1, y1, x2, y2) in enumerate(short)] + [("f", 20 + i, *at(9)) for i in range(14)]
    got = search.poses(spark.createDataFrame(source, schema), spark.createDataFrame(target, schema), "file", 0.5).collect()
    assert len(got) == 12 and (got[0].score, got[0].n_matched, got[0].scale, got[0].turn, got[0].mirrored) == (220.0, 20, 1.0, 90.0, False)


def best_mappings(left, right, links, other):
    """Every mapping, scored."""
    found = []

    def visit(k, mapping, score):
        if k == len(left):
            if mapping:
                told = 0
                for a, b in (tuple(sorted(x)) for x in links):
                    if a in mapping and b in mapping:
                        told += 3 if frozenset((mapping[a], mapping[b])) in other else -3
                at = lambda nodes, i: next((x, y) for n, _, _, x, y in nodes if n == i)
                pairs = [(at(left, i), at(right, j)) for i, j in mapping.items()]
                votes, _ = search.axis_votes([p for p in pairs if None not in (*p[0], *p[1])])
                found.append((round(score + told + max(-3, min(3, votes)), 6), sorted(mapping.items())))
            return
        i, kind, degree, *_ = left[k]
        visit(k + 1, mapping, score - 2)
        for j, other_kind, other_degree, *_ in right:
            gain = search.local_gain(kind, degree, other_kind, other_degree)
            if gain is not None and j not in mapping.values():
                visit(k + 1, {**mapping, i: j}, score + gain)

    visit(0, {}, 0.0)
    return sorted(found, key=lambda x: (-x[0], x[1]))


@pytest.mark.parametrize("seed", range(6))
def test_skeletons_agree_with_all_mappings(seed):
    rng = random.Random(seed)

    def graph(prefix, n):
        ids = [f"{prefix}{k}" for k in range(n)]
        links = {frozenset(rng.sample(ids, 2)) for _ in range(n + 1)}
        return [(i, rng.choice(["a", "b", None]), sum(i in x for x in links), rng.choice([None, *range(5)]), rng.randrange(5)) for i in ids], links

    (left, la), (right, lb) = graph("l", 5), graph("r", 5)
    got, whole = search.match_skeletons(left, right, la, lb, 6, 10**6)
    want = best_mappings(left, right, la, lb)[:6]
    assert whole and [(round(s, 6), sorted(m.items())) for s, _, _, m in got] == want
    assert search.match_skeletons(left, right, la, lb, 6, 3)[1] is False or not want


def test_skeleton_table(spark):
    nodes, links = "g string, id string, kind string, x double, y double, pairs string", "g string, a string, b string"
    l = spark.createDataFrame([("s", "1", "k", 0.0, 0.0, "c"), ("s", "2", "k", 1.0, 0.0, "c"), ("s", "3", "m", 0.0, 1.0, "c"), ("s", None, "m", 0.0, 1.0, "c"), ("e", "1", None, None, None, "c")], nodes)
    r = spark.createDataFrame([("s", "x", "k", 0.0, 0.0, "c"), ("s", "y", "k", 0.0, 1.0, "c"), ("s", "z", "m", -1.0, float("nan"), "c")], nodes)
    ll, rl = spark.createDataFrame([("s", "1", "3"), ("s", "2", "2")], links), spark.createDataFrame([("s", "x", "z")], links)
    got = search.skeleton_matches(l, r, ll, rl, "g").where("rank = 1").collect()
    assert [(x.g, x.pairs, x.topology, x.status) for x in got] == [("s", "1=x;2=y;3=z", 12.0, "complete")]
    few = search.skeleton_matches(l, r, ll, rl, "g", budget=2).collect()
    assert {(x.g, x.status) for x in few} >= {("s", "unresolved")}
