import itertools
import math
import random

from spoolmark.operators import graph, search


def test_cover_agrees_with_every_choice(spark):
    rng = random.Random(4)
    rows, universe = [], []
    for g in range(6):
        n = rng.randint(4, 8)
        universe.append((f"L{g}", n))
        for page in range(1, 4):
            for _ in range(3):
                a = rng.randint(1, n)
                rows.append((f"L{g}", page, a, rng.randint(a, n), float(rng.randint(1, 60))))
            third = n // 3 or 1
            rows += [(f"L{g}", page, (page - 1) * third + 1, page * third if page < 3 else n, float(s)) for s in (20 + page, 25)]
    got = {r.g: r for r in search.cover(spark.createDataFrame(rows, "g string, page int, first int, last int, score double"), spark.createDataFrame(universe, "g string, n int"), "g").collect()}
    for g, n in universe:
        pages = [[r for r in rows if r[0] == g and r[1] == p] for p in (1, 2, 3)]
        best, exact = -math.inf, []
        for pick in itertools.product(*pages):
            seen = [x for r in pick for x in range(r[2], r[3] + 1)]
            bad = n - len(set(seen)) + len({x for x in seen if seen.count(x) > 1})
            best = max(best, sum(r[4] for r in pick) - 1000 * bad)
            if not bad:
                exact.append(sum(r[4] for r in pick))
        assert got[g].objective == best and not got[g].truncated
        exact.sort(reverse=True)
        assert got[g].margin == (exact[0] - exact[1] if len(exact) > 1 else None)


def test_callouts_do_not_overlap_and_stay_near(spark):
    rng = random.Random(7)
    rows = [("d", i, rng.uniform(0, 3000), rng.uniform(0, 3000)) for i in range(120)] + [("e", 0, 1.0, float("inf")), ("e", 1, 5.0, 5.0)]
    got = search.place_callouts(spark.createDataFrame(rows, "g string, id int, px double, py double"), "g", "id", 300.0, 120.0, 150.0).collect()
    at = {(g, i): (x, y) for g, i, x, y in rows}
    placed = [r for r in got if r.x is not None]
    assert len(got) == 121 and len(placed) > 100
    for a, b in itertools.combinations([r for r in placed if r.g == "d"], 2):
        assert abs(a.x - b.x) >= 300 - 1e-2 or abs(a.y - b.y) >= 120 - 1e-2
    for r in placed:
        assert abs(math.dist((r.x, r.y), at[r.g, r.id]) - 150 * r.ring) < 1e-2


def test_chain_order_finds_the_path(spark):
    rng = random.Random(3)
    path = [(0.0, 0.0)]
    for _ in range(12):
        path.append((path[-1][0] + rng.uniform(50, 90), path[-1][1] + rng.uniform(-20, 20)))
    ids = rng.sample(range(100), 12)
    rows = []
    for k, i in enumerate(ids):
        a, b = path[k], path[k + 1]
        rows.append(("line", i, *(a + b if rng.random() < 0.5 else b + a)))
    rows += [("gap", 1, 0.0, 0.0, 1.0, 0.0), ("gap", 2, 500.0, 0.0, 501.0, 0.0)]
    rows += [("fork", k, 0.0, 0.0, 10.0 * math.cos(k * 2), 10.0 * math.sin(k * 2)) for k in range(1, 5)]
    d = spark.createDataFrame(rows, "g string, id int, x1 double, y1 double, x2 double, y2 double")
    got = {}
    for r in graph.chain_order(d, "g", "id").collect():
        got.setdefault(r.g, []).append(r)
    order = [r.id for r in sorted(got["line"], key=lambda r: r.place)]
    assert order in (ids, ids[::-1]) and got["line"][0].total == 0.0
    assert {r.reason for r in got["gap"]} == {"gap"} and {r.place for r in got["gap"]} == {None}
    assert {r.reason for r in got["fork"]} <= {"branching", None}
