"""Graph operators: components, incidence, paths and one-to-one propagation.

Ambiguity yields no row: a step that could go two ways is not taken.
"""

from __future__ import annotations

import math

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from spoolmark.functions import geometry as geo
from spoolmark.plans.lineage import cut, release

MAX_ROUNDS = 100


def components(edges: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """(by..., node, component): the smallest node each node is connected to inside its group.

    Every round takes the smallest label among a node and its neighbours and
    then the label of that label, so long chains close in a logarithmic number
    of rounds.  Edges with a null end are left out.
    """
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, F.col(a).alias("x"), F.col(b).alias("y"))
    both = cut(e.union(e.select(*by, "y", "x")).distinct(), "links")
    labels = cut(both.groupBy(*by, F.col("x").alias("node")).agg(F.least("node", F.min("y")).alias("label")), "labels")
    for _ in range(MAX_ROUNDS):
        around = both.join(labels.withColumnRenamed("node", "y"), [*by, "y"]).groupBy(*by, F.col("x").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(around, [*by, "node"]).select(*by, "node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(*by, F.col("node").alias("label"), F.col("label").alias("next"))
        nearer = cut(lower.join(jump, [*by, "label"]).select(*by, "node", "old", F.least("label", "next").alias("label")), "labels")
        changed = nearer.where("old != label").limit(1).count()
        release(labels)
        labels = nearer
        if not changed:
            return labels.select(*by, "node", F.col("label").alias("component"))
    raise RuntimeError("labels still change")


def ends(segments: DataFrame, by: Sequence[str], ident: str, digits: int = 3) -> DataFrame:
    """(by..., ident, code, point) of both ends of 3D segments, points as text of rounded coordinates."""
    key = lambda p: F.concat_ws(",", *[F.col(p + c).cast(f"decimal(18,{digits})").cast("string") for c in "xyz"])
    size = sum((F.abs(F.col(p + c)) for p in "ab" for c in "xyz"), F.lit(0.0))
    finite = segments.where(size < 1e12)
    return finite.select(*by, ident, "code", key("a").alias("point")).unionAll(finite.select(*by, ident, "code", key("b")))


def hyperedges(incidence: DataFrame, by: Sequence[str], hub: str, member: str, least: int = 2) -> DataFrame:
    """Hubs with at least ``least`` distinct members, and their degree."""
    return incidence.groupBy(*by, hub).agg(F.array_sort(F.collect_set(member)).alias("members")).where(F.size("members") >= least).withColumn("degree", F.size("members"))


def branch_classes(incidence: DataFrame, by: Sequence[str], point: str, ident: str, branch: int = 41) -> DataFrame:
    """Points where a branch record ends: ``junction`` with at least three other records, else ``outlet_leg``."""
    n = incidence.groupBy(*by, point).agg(
        F.countDistinct(F.when(F.col("code") != branch, F.col(ident))).alias("n_others"), F.max((F.col("code") == branch).cast("int")).alias("has")
    )
    return n.where("has = 1").select(*by, point, "n_others", F.when(F.col("n_others") >= 3, "junction").otherwise("outlet_leg").alias("class"))


def turns(pairs: DataFrame, a: Sequence[str], b: Sequence[str], straight: float = 0.995) -> Column:
    """``turn`` for two directions that are not straight on, else ``straight``; null without a direction."""
    c = geo.cosine(*[F.col(x) for x in (*a, *b)])
    return F.when(F.abs(c) < straight, "turn").when(c.isNotNull(), "straight")


def simple_paths(edges: DataFrame, by: Sequence[str], a: str, b: str, length: int) -> DataFrame:
    """All simple paths of ``length`` edges of each group, once in their smaller direction, as ``path``."""
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(*by, F.col(a).alias("x"), F.col(b).alias("y"))
    both = cut(e.union(e.select(*by, "y", "x")).distinct(), "links")
    paths = both.select(*by, F.array("x", "y").alias("path"))
    for _ in range(length - 1):
        step = both.select(*by, F.col("x").alias("tail"), F.col("y").alias("next"))
        grown = paths.withColumn("tail", F.element_at("path", -1)).join(step, [*by, "tail"])
        paths = grown.where(~F.array_contains("path", F.col("next"))).select(*by, F.concat("path", F.array("next")).alias("path"))
    back = F.reverse("path")
    return paths.where(F.array_join("path", "\x00") <= F.array_join(back, "\x00"))


def landmark_reach(edges: DataFrame, landmarks: DataFrame, by: Sequence[str], a: str, b: str, hops: int | None = None) -> DataFrame:
    """(by..., source, target, hops): landmarks reached from landmarks through other nodes only, fewest hops, at most ``hops`` if given.

    The front holds each (source, node) once, so it never outgrows sources times nodes met.  Links have no
    direction, so a node met before is in one of the last two fronts; landmarks met again lose by their hops.
    """
    e = edges.select(*by, F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x != y")
    both = cut(e.union(e.select(*by, "y", "x")).distinct(), "links")
    mark = landmarks.select(*by, F.col("node")).distinct().withColumn("is_mark", F.lit(True))
    front = mark.select(*by, F.col("node").alias("source"), "node")
    before, found, k = front.limit(0), None, 0
    while hops is None or k < hops:
        k += 1
        step = front.join(both.withColumnRenamed("x", "node"), [*by, "node"]).select(*by, "source", F.col("y").alias("node")).where("node != source").distinct()
        step = cut(step.join(front.union(before), [*by, "source", "node"], "left_anti").join(mark, [*by, "node"], "left").select(*by, "source", "node", "is_mark"), "front")
        hit = step.where("is_mark").select(*by, "source", F.col("node").alias("target"), F.lit(k).alias("hops"))
        found = hit if found is None else found.unionAll(hit)
        before, front = front, step.where("is_mark is null").select(*by, "source", "node")
        if front.isEmpty():
            break
    return found.groupBy(*by, "source", "target").agg(F.min("hops").alias("hops"))


def page_path(links: DataFrame, pages: DataFrame, by: Sequence[str], a: str, b: str, page: str) -> DataFrame:
    """Per group whether its directed page links are one path over all pages: ``path`` or the reason why not.

    One root, no page with two successors or two predecessors, and as many
    links as pages less one leave nothing but a path.
    """
    own = pages.select(*by, F.col(page).alias("p")).distinct()
    l = links.where(F.col(a) != F.col(b)).select(*by, F.col(a).alias("x"), F.col(b).alias("y")).distinct()
    out = l.groupBy(*by, F.col("x").alias("p")).agg(F.count("*").alias("n_out"))
    into = l.groupBy(*by, F.col("y").alias("p")).agg(F.count("*").alias("n_in"))
    d = own.join(out, [*by, "p"], "left").join(into, [*by, "p"], "left").fillna(0, ["n_out", "n_in"])
    s = d.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("n_in") == 0).alias("roots"), F.max("n_out").alias("most"), F.max("n_in").alias("most_in"), F.sum("n_out").alias("links"))
    status = (
        F.when(F.col("most") > 1, "branching").when(F.col("most_in") > 1, "merging").when(F.col("roots") == 0, "no_root").when(F.col("roots") > 1, "several_roots")
        .when(F.col("links") == F.col("n") - 1, "path").otherwise("cycle")
    )
    return s.select(*by, F.col("n").alias("n_pages"), status.alias("status"))


def unique_pairs(pairs: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """Pairs that are the only one of both their ends."""
    distinct = pairs.select(*by, a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct()
    na = F.count("*").over(Window.partitionBy(*by, a))
    nb = F.count("*").over(Window.partitionBy(*by, b))
    return distinct.withColumn("__a", na).withColumn("__b", nb).where("__a = 1 and __b = 1").drop("__a", "__b")


def propagate_pairs(candidates: DataFrame, by: Sequence[str], a: str, b: str, most_rounds: int = 1000) -> DataFrame:
    """(by..., a, b, round): one-to-one matches grown from mutual uniqueness, until no pair is unique any more.

    All pairs that are unique for both ends are taken at once; their ends leave
    the candidates; the next round may find new unique pairs.  The outcome does
    not depend on any order, and both columns stay unique.  Raises if pairs are
    still found after ``most_rounds``.
    """
    left = cut(candidates.select(*by, a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct(), "left")
    out = None
    for k in range(1, most_rounds + 1):
        taken = cut(unique_pairs(left, by, a, b).withColumn("round", F.lit(k)), "taken")
        if taken.limit(1).count() == 0:
            return taken if out is None else out
        out = taken if out is None else out.unionByName(taken)
        rest = left.join(taken.select(*by, a), [*by, a], "left_anti").join(taken.select(*by, b), [*by, b], "left_anti")
        before, left = left, cut(rest, "left")
        release(before)
    raise RuntimeError(f"pairs are still found after {most_rounds} rounds")


def seeds(distances: DataFrame, by: Sequence[str], a: str, b: str, gap: str, near: float = 1.0, lead: float = 2.0, exact: float = 0.15) -> DataFrame:
    """Pairs whose nearest partner is within ``exact``, or within ``near`` with the runner-up at least ``lead`` farther."""
    w = Window.partitionBy(*by, a).orderBy(gap, b)
    d = distances.withColumn("__r", F.row_number().over(w)).withColumn("__next", F.lead(gap).over(w)).where("__r = 1")
    clear = F.col("__next").isNull() | (F.col("__next") - F.col(gap) >= lead)
    return d.where((F.col(gap) <= exact) | ((F.col(gap) <= near) & clear)).select(*by, a, b, gap)


ORDERED = "place int, total double, reason string"


def chain_order(points: DataFrame, by: str, ident: str, limit: float = 40.0) -> DataFrame:
    """(by, ident, place, total, reason): segments (x1, y1, x2, y2) of a group in the order of the path they form.

    A minimum spanning tree over end gaps is grown one segment at a time; a gap
    over ``limit`` or a segment with three neighbours gives the reason and no
    places.  A group is one drawing line, whose size the drawing bounds; groups
    are spread over tasks.
    """
    schema = T.StructType([points.schema[by], points.schema[ident], T.StructField("place", T.IntegerType()), T.StructField("total", T.DoubleType()), T.StructField("reason", T.StringType())])

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ident).reset_index(drop=True)
        n = len(pdf)
        end = pdf[["x1", "y1", "x2", "y2"]].to_numpy(float).reshape(n, 2, 2)

        def gaps(i: int) -> np.ndarray:
            d = np.sqrt(((end[i][None, :, None, :] - end[:, None, :, :]) ** 2).sum(-1))
            return np.round(d.reshape(n, -1).min(axis=1), 6)

        best, parent, inside = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool)
        links, total, reason = [[] for _ in range(n)], 0.0, None
        at = 0
        for _ in range(n - 1):
            inside[at] = True
            g = gaps(at)
            closer = ~inside & (g < best)
            best[closer], parent[closer] = g[closer], at
            at = int(np.where(inside, np.inf, best).argmin())
            total += best[at]
            if best[at] > limit:
                reason = "gap"
            links[at].append(int(parent[at]))
            links[parent[at]].append(at)
        if reason is None and any(len(x) > 2 for x in links):
            reason = "branching"
        place = pd.array([pd.NA] * n, dtype="Int32")
        if reason is None:
            at, before = min((i for i in range(n) if len(links[i]) < 2), default=0), -1
            for k in range(n):
                place[at] = k
                at, before = next((x for x in links[at] if x != before), -1), at
        return pd.DataFrame({by: pdf[by], ident: pdf[ident], "place": place, "total": round(total, 3), "reason": reason})

    finite = F.lit(True)
    for c in ("x1", "y1", "x2", "y2"):
        finite = finite & (F.abs(F.col(c)) < float("inf"))
    return points.where(finite).select(by, ident, "x1", "y1", "x2", "y2").groupBy(by).applyInPandas(order, schema)


def leader_trace(segments: DataFrame, anchors: DataFrame, by: str, ident: str, seed: float = 25.0, join: float = 0.25, budget: float = 80.0) -> DataFrame:
    """(by, ident, reached, cost): farthest end of the thin strokes an anchor's leader runs along, by bounded shortest paths.

    Strokes start within ``seed`` of the anchor, continue within ``join`` of an
    end, and cost their length up to ``budget`` in all.  ``segments`` has
    (by, x1, y1, x2, y2), ``anchors`` (by, ident, px, py).
    """
    import heapq

    schema = T.StructType([anchors.schema[by], anchors.schema[ident], T.StructField("reached_x", T.DoubleType()), T.StructField("reached_y", T.DoubleType()), T.StructField("cost", T.DoubleType())])

    def trace(key: tuple, a: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        rows = []
        seg = s[["x1", "y1", "x2", "y2"]].to_numpy(float)
        size = np.hypot(seg[:, 2] - seg[:, 0], seg[:, 3] - seg[:, 1]) if len(seg) else np.zeros(0)
        both = np.concatenate([seg[:, :2], seg[:, 2:]]) if len(seg) else np.zeros((0, 2))
        n = len(seg)
        # Ends by cells as wide as the join distance: those near an end lie in its cell and the eight around it.
        cells: dict[tuple[int, int], list[int]] = {}
        place = np.floor(both / join).astype(np.int64)
        for i, (u, v) in enumerate(place.tolist()):
            cells.setdefault((u, v), []).append(i)
        for ident_, px, py in a.sort_values(ident)[[ident, "px", "py"]].itertuples(index=False):
            start = np.hypot(both[:, 0] - px, both[:, 1] - py)
            heap = [(float(start[i]), int(i)) for i in np.flatnonzero(start <= seed)]
            heapq.heapify(heap)
            done: dict[int, float] = {}
            while heap:
                cost, i = heapq.heappop(heap)
                if i in done:
                    continue
                done[i] = cost
                other = i + n if i < n else i - n
                if cost + size[i % n] <= budget:
                    heapq.heappush(heap, (cost + float(size[i % n]), other))
                u, v = place[i]
                around = [j for du in (-1, 0, 1) for dv in (-1, 0, 1) for j in cells.get((u + du, v + dv), ())]
                for j in sorted(around):
                    if j not in done and math.hypot(both[j, 0] - both[i, 0], both[j, 1] - both[i, 1]) <= join:
                        heapq.heappush(heap, (cost, j))
            if done:
                far = max(done.items(), key=lambda x: (x[1], -x[0]))
                rows.append((key[0], ident_, float(both[far[0], 0]), float(both[far[0], 1]), round(far[1], 3)))
        return pd.DataFrame(rows, columns=schema.names)

    return anchors.groupBy(by).cogroup(segments.groupBy(by)).applyInPandas(trace, schema)


def connectors(incidence: DataFrame, by: Sequence[str], pipe_code: int = 100) -> DataFrame:
    """Connected groups of records other than pipes: (by..., connector, codes, n_records, n_pipes), with the pipes that touch them.

    ``incidence`` is the output of ``ends``; its ident column is ``row``.
    """
    rest = incidence.where(F.col("code") != pipe_code)
    hub = rest.groupBy(*by, "point").agg(F.min("row").alias("hub"))
    label = components(rest.join(hub, [*by, "point"]).select(*by, "row", "hub"), by, "row", "hub").withColumnRenamed("node", "row")
    own = rest.join(label, [*by, "row"])
    touch = own.select(*by, "component", "point").distinct().join(incidence.where(F.col("code") == pipe_code).select(*by, "point", F.col("row").alias("pipe")), [*by, "point"])
    pipes = touch.groupBy(*by, "component").agg(F.countDistinct("pipe").alias("n_pipes"))
    groups = own.select(*by, "component", "row", "code").distinct().groupBy(*by, "component").agg(
        F.array_join(F.array_sort(F.collect_list("code")), ",").alias("codes"), F.count("*").alias("n_records")
    )
    return groups.join(pipes, [*by, "component"], "left").withColumn("n_pipes", F.coalesce("n_pipes", F.lit(0))).withColumnRenamed("component", "connector")


def elbow_links(connected: DataFrame) -> DataFrame:
    """``connected`` with its kind: one 35 and one 36 between two pipes is an ``elbow``, one record between two pipes ``direct``, else null."""
    two = F.col("n_pipes") == 2
    return connected.withColumn("kind", F.when(two & (F.col("codes") == "35,36"), "elbow").when(two & (F.col("n_records") == 1), "direct"))
