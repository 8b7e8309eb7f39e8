import random
from collections import deque

from spoolmark.operators import graph


def reach(edges, marks):
    """Breadth first from every landmark, stopping at landmarks."""
    out = {}
    for line, source in marks:
        queue, seen = deque([(source, 0)]), {source}
        while queue:
            node, hops = queue.popleft()
            for key, x, y in edges:
                for p, q in ((x, y), (y, x)):
                    if key == line and p == node and q is not None and q not in seen:
                        seen.add(q)
                        if (line, q) in marks:
                            out[line, source, q] = hops + 1
                        else:
                            queue.append((q, hops + 1))
    return out


def test_landmarks_are_reached_at_any_distance(spark):
    rng = random.Random(3)
    far = [("far", f"n{i}", f"n{i + 1}") for i in range(7)]
    # The landmark n1 of the ring is one hop away and, the other way round, six.
    ring = [("ring", f"n{i}", f"n{(i + 1) % 7}") for i in range(7)]
    dense = [("dense", f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(17)]
    edges = far + ring + dense + [("far", None, "n3")]
    marks = {("far", "n0"), ("far", "n7"), ("ring", "n0"), ("ring", "n1"), ("dense", "n0"), ("dense", "n5"), ("dense", "n9")}
    e = spark.createDataFrame(edges, "line string, x string, y string")
    m = spark.createDataFrame(sorted(marks), "line string, node string")
    got = {(r.line, r.source, r.target): r.hops for r in graph.landmark_reach(e, m, ["line"], "x", "y").collect()}
    assert got == reach(edges, marks) and got["far", "n0", "n7"] == 7 and got["ring", "n0", "n1"] == 1
    short = graph.landmark_reach(e, m, ["line"], "x", "y", 2).collect()
    assert {(r.line, r.source, r.target) for r in short} == {k for k, n in got.items() if n <= 2}
