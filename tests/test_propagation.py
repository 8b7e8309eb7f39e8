import math
import random
from collections import Counter, defaultdict

import pytest

from spoolmark.operators import propagation

ARMS = "g string, frame string, kind string, pipe string, dx double, dy double, rule string"
NAMES = ["E", "NE", "N", "NW", "W", "SW", "S", "SE"]


def side(arms):
    a = {}
    for g, f, k, p, dx, dy, _ in arms:
        if f is not None and p is not None:
            key = (g, f, p)
            kind, d = a.get(key, (None, None))
            a[key] = (min(kind, k or "") if kind is not None else k or "", d if d is not None else (dx, dy))
    degree = Counter((g, f) for g, f, _ in a)
    ends = defaultdict(list)
    for (g, f, p), (k, _) in a.items():
        ends[g, p].append(f"{k}:{degree[g, f]}")
    rows = []
    for (g, f, p), (k, (dx, dy)) in a.items():
        n = degree[g, f]
        rest = sorted(ends[g, p])
        rest.remove(f"{k}:{n}")
        octant = None
        if dx is not None and (dx or dy):
            octant = NAMES[int((math.degrees(math.atan2(dy, dx)) % 360 + 22.5) % 360 // 45)]
        rows.append({"g": g, "frame": f, "pipe": p, "kind": k, "n": n, "octant": octant, "other": "|".join(rest), "ends": "|".join(sorted(ends[g, p]))})
    return rows


def single(rows, key, value):
    groups = defaultdict(list)
    for r in rows:
        groups[key(r)].append(value(r))
    return {k: v[0] for k, v in groups.items() if len(v) == 1}


def certain(found):
    a, b = Counter(x[:2] for x in found), Counter((x[0], x[2]) for x in found)
    return {x for x in found if a[x[:2]] == 1 and b[x[0], x[2]] == 1}


def brute(left, right, pipes):
    l, r = side(left), side(right)
    state = {"pipe": certain({s for s in pipes if any(x["g"] == s[0] and x["pipe"] == s[1] for x in l) and any(x["g"] == s[0] and x["pipe"] == s[2] for x in r)}), "frame": set()}
    while True:
        pm, fm = state["pipe"], state["frame"]
        free = lambda rows, m, i, item: [x for x in rows if (x["g"], x[item]) not in {(s[0], s[i]) for s in m}]
        lp, rp, lf, rf = free(l, pm, 1, "pipe"), free(r, pm, 2, "pipe"), free(l, fm, 1, "frame"), free(r, fm, 2, "frame")
        to_right, to_left = {(g, a): b for g, a, b in fm}, {(g, a): b for g, a, b in pm}
        new_p, new_f = set(), set()
        for like, need in ((lambda x: (), None), (lambda x: x["other"], None), (lambda x: x["octant"], "octant")):
            a = single([x for x in lp if (x["g"], x["frame"]) in to_right and (not need or x[need])], lambda x: (x["g"], to_right[x["g"], x["frame"]], like(x)), lambda x: x["pipe"])
            b = single([x for x in rp if not need or x[need]], lambda x: (x["g"], x["frame"], like(x)), lambda x: x["pipe"])
            new_p |= {(k[0], a[k], b[k]) for k in a if k in b}
        alone = lambda rows, item, like: single([dict(t) for t in {tuple(sorted({"g": x["g"], "item": x[item], "like": like(x)}.items())) for x in rows}], lambda x: (x["g"], x["like"]), lambda x: x["item"])
        a, b = alone(lp, "pipe", lambda x: x["ends"]), alone(rp, "pipe", lambda x: x["ends"])
        new_p |= {(k[0], a[k], b[k]) for k in a if k in b}
        at = [(x, to_left[x["g"], x["pipe"]]) for x in lf if (x["g"], x["pipe"]) in to_left]
        a, b = single(at, lambda t: (t[0]["g"], t[1]), lambda t: t[0]), single(rf, lambda x: (x["g"], x["pipe"]), lambda x: x)
        new_f |= {(k[0], a[k]["frame"], b[k]["frame"]) for k in a if k in b and (a[k]["kind"], a[k]["n"]) == (b[k]["kind"], b[k]["n"])}
        shared = Counter()
        for x, q in at:
            for y in rf:
                if y["g"] == x["g"] and y["pipe"] == q:
                    shared[x["g"], x["frame"], y["frame"], x["n"], y["n"]] += 1
        new_f |= {k[:3] for k, s in shared.items() if k[3] == k[4] and s >= 2 and s >= k[3] - 1}

        def corners(rows):
            around = defaultdict(list)
            for x in rows:
                around[x["g"], x["frame"], x["kind"], x["n"]].append(x["other"])
            return [{"g": k[0], "frame": k[1], "like": (k[2], k[3], "/".join(sorted(v)))} for k, v in around.items()]

        a, b = single(corners(lf), lambda x: (x["g"], x["like"]), lambda x: x["frame"]), single(corners(rf), lambda x: (x["g"], x["like"]), lambda x: x["frame"])
        new_f |= {(k[0], a[k], b[k]) for k in a if k in b}
        new_p, new_f = certain(new_p), certain(new_f)
        if not new_p and not new_f:
            return state
        state = {"pipe": pm | new_p, "frame": fm | new_f}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_agrees_with_rules_applied_one_by_one(spark, seed):
    rng = random.Random(seed)
    left = []
    for g in ("L1", "L2"):
        for i in range(22):
            a, b = rng.randrange(12), rng.randrange(12)
            for f in {a, b}:
                turn = rng.choice([None, rng.randrange(8)])
                d = (None, None) if turn is None else (math.cos(turn * math.pi / 4), math.sin(turn * math.pi / 4))
                left.append((g, f"f{f}", rng.choice("ab") if f % 3 else "c", f"p{i}", *d, "clash"))
    kinds = {}
    left = [(g, f, kinds.setdefault((g, f), k), p, dx, dy, x) for g, f, k, p, dx, dy, x in left]
    right = [(g, f"R{f}", k, f"R{p}", dx, dy, x) for g, f, k, p, dx, dy, x in left if rng.random() > 0.12]
    left += left[:3] + [("L1", None, "a", "p1", None, None, ""), ("L1", "f1", None, None, None, None, "")]
    seeds = [(g, f"p{i}", f"Rp{i}") for g in ("L1", "L2") for i in range(22) if rng.random() < 0.25] + [("L1", "none", "Rp1"), ("L2", "p0", "Rp2")]
    got = propagation.propagate(spark.createDataFrame(left, ARMS), spark.createDataFrame(right, ARMS), ["g"], pipes=spark.createDataFrame(seeds, "g string, a string, b string")).collect()
    want = brute(left, right, set(seeds))
    for what in ("pipe", "frame"):
        assert {(r.g, r.a, r.b) for r in got if r.what == what} == want[what]
    assert len({r["round"] for r in got}) > 1


def test_empty_sides(spark):
    none = spark.createDataFrame([], ARMS)
    assert propagation.propagate(none, none, ["g"]).count() == 0
