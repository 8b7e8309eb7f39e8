import random

import pytest

from spoolmark.operators import hierarchy

SCHEMA = "drawing_id long, parent_ref long, children array<struct<child_ref: long>>, depth string"


def brute(owner):
    nodes = set(owner)
    out = {}
    for n in nodes:
        chain, at = [n], owner[n]
        while at is not None and at not in chain:
            chain.append(at)
            at = owner[at]
        if at is None:
            out[n] = ("tree", chain[-1], len(chain) - 1, "/".join(str(x) for x in reversed(chain)))
        else:
            out[n] = ("cycle" if at == n else "below_cycle", -1, -1, "")
    below = dict.fromkeys(nodes, 0)
    for n in nodes:
        if out[n][0] == "tree":
            at = owner[n]
            while at is not None:
                below[at] += 1
                at = owner[at]
    return {n: (*v, below[n] if v[0] == "tree" else -1) for n, v in out.items()}


def made(seed, n):
    rng = random.Random(seed)
    refs = rng.sample(range(1, 10_000), n)
    owner = {r: None for r in refs}
    for i, r in enumerate(refs[1:], 1):
        x = rng.random()
        if x < 0.6:
            owner[r] = refs[i - 1]
        elif x < 0.95:
            owner[r] = refs[rng.randrange(i)]
    ring = rng.sample(refs, 5)
    for a, b in zip(ring, ring[1:] + ring[:1]):
        owner[a] = b
    owner[rng.choice(refs)] = None
    return owner


@pytest.mark.parametrize("part_nodes", [100_000, 40, 12])
def test_agrees_with_walking_up(spark, part_nodes):
    rows, want = [], {}
    for d, n in ((1, 150), (2, 60), (3, 7), (None, 20)):
        owner = made(d or 9, n)
        self_owner = next(iter(owner))
        owner[self_owner] = self_owner
        if d is not None:
            want |= {(d, k): v for k, v in brute(owner).items()}
        kids = {}
        for k, o in owner.items():
            kids.setdefault(o, []).append(k)
        for o, ks in kids.items():
            if o is None:
                rows += [(d, k, None if k % 2 else [], "clash") for k in ks]
            else:
                rows += [(d, o, [(ks[0],), (None,), (ks[0],)], "clash"), (d, o, [(k,) for k in ks], "clash")]
    rows += rows[:20] + [(1, None, [(None,)], "x"), (4, None, None, "x")]
    owned = hierarchy.ownership(spark.createDataFrame(rows, SCHEMA), "drawing_id", "parent_ref", "children", "child_ref")
    got = hierarchy.hierarchies(owned, part_nodes).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.verdict, r.root, r.depth, r.path, r.n_below) == want[r.domain, r.node]


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert hierarchy.hierarchies(hierarchy.ownership(none, "drawing_id", "parent_ref", "children", "child_ref")).count() == 0


def test_long_chain_over_many_parts(spark):
    n = 3_000
    owned = spark.range(n).selectExpr("1L as domain", "(id * 7919) % 3001 as node", "case when id > 0 then ((id - 1) * 7919) % 3001 end as owner")
    got = hierarchy.hierarchies(owned, 200).selectExpr("sum(depth) d", "sum(n_below) b", "max(length(path) - length(replace(path, '/', ''))) p", "count(distinct root) r").first()
    assert (got.d, got.b, got.p, got.r) == (n * (n - 1) // 2, n * (n - 1) // 2, n - 1, 1)


def test_paths_of_a_part_are_handed_on_in_pieces():
    import pandas as pd

    n = 20_000
    nodes = pd.DataFrame({"part": 0, "domain": 1, "node": range(n), "owner": pd.array([None, *range(n - 1)], "Int64"), "step": [0] + [1] * (n - 1), "label": [str(i) for i in range(n)], "weight": 1, "kind": hierarchy.NODE, "home": None})
    for c in ("root", "depth", "path", "total", "state"):
        nodes[c] = None
    seen, longest = 0, 0
    for piece in hierarchy._expanded(iter([nodes])):
        seen += len(piece)
        longest = max(longest, piece["path"].str.len().sum())
    assert seen == n and longest < 3 * hierarchy.PIECE_CHARS
