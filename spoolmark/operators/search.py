"""Bounded searches and assignments, one group (a drawing line or a page) at a time.

Groups are spread over tasks; inside a group the search is bounded by its
parameters, and results that a bound may have cut are told so.  Ties are
broken by identifiers, so every result is repeatable.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

_L, _D, _S, _I, _B = T.LongType(), T.DoubleType(), T.StringType(), T.IntegerType(), T.BooleanType()


def _schema(*pairs) -> T.StructType:
    return T.StructType([p if isinstance(p, T.StructField) else T.StructField(*p) for p in pairs])


def cover(candidates: DataFrame, universe: DataFrame, by: str, beam: int = 4000, per_page: int = 5) -> DataFrame:
    """One range per page covering 1..n once: (by, status, objective, score, margin, ranges, truncated).

    ``candidates`` (by, page, first, last, score), ``universe`` (by, n).  The
    objective is the score less 1000 for each place missed or covered twice.
    Status: ``partial``, ``weak`` (score below 50), ``ambiguous`` (next exact
    cover less than 10 behind), else ``unique``; ``no_candidate`` without pages.
    Equal coverages are merged page by page, which loses nothing; only where
    more than ``beam`` different ones are left, or a page has more than
    ``per_page`` candidates, the least are dropped, and ``truncated`` tells.
    """
    schema = _schema(candidates.schema[by], ("status", _S), ("objective", _D), ("score", _D), ("margin", _D), ("ranges", _S), ("truncated", _B))

    def solve(key: tuple, c: pd.DataFrame, u: pd.DataFrame) -> pd.DataFrame:
        if c.empty or u.empty:
            return pd.DataFrame([(key[0], "no_candidate", None, None, None, None, False)], columns=schema.names)
        n = int(u["n"].iloc[0])
        full = (1 << n) - 1
        # Choices that cover the same places, and the same ones twice, have one future: the two best of them suffice for best and margin.
        layer: dict[tuple[int, int], list[tuple[float, tuple]]] = {(0, 0): [(0.0, ())]}
        cut_any = False
        best_first = lambda x: (-x[0], x[1])
        for page, g in c.groupby("page", sort=True):
            own = sorted(zip(-g["score"], g["first"], g["last"]))
            cut_any |= len(own) > per_page
            following: dict[tuple[int, int], list[tuple[float, tuple]]] = {}
            for loss, first, last in own[:per_page]:
                bits = ((1 << int(last - first + 1)) - 1) << int(first - 1)
                for (once, twice), kept in layer.items():
                    more = [(score - loss, (*picks, (int(page), int(first), int(last)))) for score, picks in kept]
                    following.setdefault((once | bits, twice | once & bits), []).extend(more)
            layer = {key: sorted(kept, key=best_first)[:2] for key, kept in following.items()}
            if len(layer) > beam:
                cut_any = True
                worth = sorted(layer, key=lambda k: (1000 * k[1].bit_count() - layer[k][0][0], -k[0].bit_count(), layer[k][0][1]))
                layer = {key: layer[key] for key in worth[:beam]}
        ranked = sorted(
            ((score - 1000 * ((full & ~once).bit_count() + twice.bit_count()), score, once, twice, picks) for (once, twice), kept in layer.items() for score, picks in kept),
            key=lambda x: (-x[0], -x[1], x[4]),
        )
        objective, score, covered, twice, picks = ranked[0]
        exact = [x for x in ranked if x[2] & full == full and not x[3]]
        margin = exact[0][1] - exact[1][1] if len(exact) > 1 else None
        if covered & full != full or twice:
            status = "partial"
        else:
            status = "weak" if score < 50 else "ambiguous" if margin is not None and margin < 10 else "unique"
        text = ";".join(f"{p}:{a}-{b}" for p, a, b in picks)
        return pd.DataFrame([(key[0], status, float(objective), float(score), margin, text, cut_any)], columns=schema.names)

    return candidates.groupBy(by).cogroup(universe.groupBy(by)).applyInPandas(solve, schema)


def _assign(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The column of each row in an assignment of least cost, by shortest augmenting paths, and the reduced costs."""
    n = len(cost)
    u, v = np.zeros(n + 1), np.zeros(n + 1)
    row_of = np.zeros(n + 1, int)
    for i in range(1, n + 1):
        row_of[0] = i
        at, low, way, done = 0, np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while row_of[at]:
            done[at] = True
            slack = cost[row_of[at] - 1] - u[row_of[at]] - v[1:]
            better = ~done[1:] & (slack < low[1:])
            low[1:][better], way[1:][better] = slack[better], at
            open_ = np.where(done, np.inf, low)
            at_next = int(open_.argmin())
            step = open_[at_next]
            u[row_of[done]] += step
            v[done] -= step
            low[~done] -= step
            at = at_next
        while at:
            row_of[at] = row_of[way[at]]
            at = way[at]
    out = np.zeros(n, int)
    out[row_of[1:] - 1] = np.arange(n)
    return out, cost - u[1:, None] - v[None, 1:]


def _rematch(allowed: np.ndarray, column: list[int], row: int, free: int, first: int) -> list[int] | None:
    """``column`` with ``row`` matched anew, ``free`` the column left open; rows before ``first`` keep theirs."""
    owner = {j: i for i, j in enumerate(column) if i != row}
    fixed = {column[i] for i in range(first)}
    came, queue = {}, [row]
    for i in queue:
        for j in np.flatnonzero(allowed[i]).tolist():
            if j in came or j in fixed:
                continue
            came[j] = i
            if j == free:
                out = list(column)
                while True:
                    i = came[j]
                    out[i], j = j, column[i]
                    if i == row:
                        return out
            queue.append(owner[j])
    return None


def _matching(allowed: np.ndarray) -> list[int] | None:
    """A column for every row among the allowed pairs, None if there is none."""
    owner: dict[int, int] = {}
    for row in range(len(allowed)):
        came, queue, end = {}, [row], None
        for i in queue:
            for j in np.flatnonzero(allowed[i]).tolist():
                if j not in came:
                    came[j] = i
                    if j not in owner:
                        end = j
                        break
                    queue.append(owner[j])
            if end is not None:
                break
        if end is None:
            return None
        column = {i: j for j, i in owner.items()}
        while end is not None:
            i = came[end]
            owner[end] = i
            end = column.get(i) if i != row else None
    return [j for _, j in sorted((i, j) for j, i in owner.items())]


def _first_of_ties(cos: np.ndarray, column: np.ndarray, slack: np.ndarray) -> np.ndarray:
    """Of the assignments as good as ``column``: the one of highest least cosine, then the first in order."""
    column, rows = column.tolist(), list(range(len(column)))
    allowed = slack <= 1e-9
    while (better := _matching(allowed & (cos > cos[rows, column].min() + 1e-9))) is not None:
        column = better
    allowed = allowed & (cos > cos[rows, column].min() - 1e-9)
    for i in rows:
        for j in np.flatnonzero(allowed[i, :]).tolist():
            if j == column[i]:
                break
            if j in column[:i]:
                continue
            other, tried = column.index(j), list(column)
            tried[i] = j
            tried = _rematch(allowed, tried, other, column[i], i + 1)
            if tried is not None:
                column = tried
                break
    return np.array(column)


def _runner_up(cost: np.ndarray, best: np.ndarray) -> float:
    """Least cost of an assignment other than ``best``: it differs by one cycle, the cheapest of the exchange graph.

    Moving row ``i`` to the column of row ``j`` costs ``gain[i, j]``; the potentials
    of an optimum leave no negative cycle, so shortest paths are exact.
    """
    n = len(cost)
    gain = cost[:, best] - cost[np.arange(n), best][:, None]
    np.fill_diagonal(gain, np.inf)
    for k in range(n):
        gain = np.minimum(gain, gain[:, k, None] + gain[None, k, :])
    return float(cost[np.arange(n), best].sum() + max(0.0, gain.diagonal().min()))


def assign_directions(left: DataFrame, right: DataFrame, by: str) -> DataFrame:
    """Best one-to-one assignment of unit directions by mean cosine, with its margin over the next.

    ``left`` and ``right`` (by, id, x, y), of any number.  Groups of unequal or
    zero size and vectors of no length give no row.  Of assignments of equal
    mean the one of the highest least cosine is given, then the first in order.
    """
    schema = _schema(left.schema[by], ("pairs", _S), ("mean_cosine", _D), ("min_cosine", _D), ("margin", _D), ("status", _S))

    def solve(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("id"), b.sort_values("id")
        u, v = a[["x", "y"]].to_numpy(float), b[["x", "y"]].to_numpy(float)
        if len(u) != len(v) or not len(u):
            return pd.DataFrame(columns=schema.names)
        nu, nv = np.hypot(*u.T), np.hypot(*v.T)
        if not (nu.all() and nv.all()):
            return pd.DataFrame(columns=schema.names)
        cos = (u / nu[:, None]) @ (v / nv[:, None]).T
        ids = b["id"].tolist()
        p = _first_of_ties(cos, *_assign(-cos))
        at = cos[np.arange(len(p)), p]
        mean, least = float(at.mean()), float(at.min())
        margin = round(mean + _runner_up(-cos, p) / len(p), 5) if len(p) > 1 else None
        status = "accepted" if mean >= 0.9 and (margin is None or margin >= 0.05) else "unresolved"
        text = ";".join(f"{i}={ids[j]}" for i, j in zip(a["id"].tolist(), p))
        return pd.DataFrame([(key[0], text, round(mean, 5), round(least, 5), margin, status)], columns=schema.names)

    return left.groupBy(by).cogroup(right.groupBy(by)).applyInPandas(solve, schema)


def align(left: DataFrame, right: DataFrame, by: str) -> DataFrame:
    """Forward and reverse alignment of two sequences of one length by relative size.

    ``left`` and ``right`` (by, place, size).  A pair scores max(0, 3 - 12 *
    |difference of its shares of the whole|); the higher direction wins, its
    lead decides the confidence.  All of it is two ranks, two joins and sums.
    """
    def shared(d: DataFrame, name: str) -> DataFrame:
        whole = Window.partitionBy(by)
        w = Window.partitionBy(by).orderBy("place")
        return d.select(by, F.row_number().over(w).alias("slot"), F.count("*").over(whole).alias("n"), (F.col("size") / F.sum("size").over(whole)).alias(name))

    a, b = shared(left, "a"), shared(right, "b").withColumnRenamed("n", "m")
    pair = lambda r: F.greatest(F.lit(0.0), 3 - 12 * F.abs(F.col("a") - F.col(r)))
    ahead = a.join(b, [by, "slot"]).where("n = m").groupBy(by).agg(F.sum(pair("b")).alias("forward"), F.first("n").alias("n"))
    back = b.select(by, (F.col("m") - F.col("slot") + 1).alias("slot"), "m", "b")
    behind = a.join(back, [by, "slot"]).where("n = m").groupBy(by).agg(F.sum(pair("b")).alias("reverse"))
    margin = F.abs(F.col("forward") - F.col("reverse"))
    return ahead.join(behind, by).select(
        by, "n", F.round("forward", 3).alias("forward"), F.round("reverse", 3).alias("reverse"),
        F.when(F.col("forward") >= F.col("reverse"), "forward").otherwise("reverse").alias("direction"),
        F.when(margin >= 3, "high").when(margin >= 1, "medium").otherwise("unresolved").alias("confidence"),
    )


def poses(source: DataFrame, target: DataFrame, by: str, tolerance: float, keep: int = 12) -> DataFrame:
    """Similarity poses that carry source segments onto target segments, the best ``keep`` distinct ones.

    Each source segment is laid onto each target segment, both ways round and
    mirrored; a pose scores 10 for each source segment with a partner within
    ``tolerance``, 1 for each further pair, less 6 for repeated partners.
    Partners are looked up along one direction in which few ends coincide.
    ``source`` and ``target`` have (by, id, x1..y2).
    """
    schema = _schema(source.schema[by], ("rank", _I), ("score", _D), ("n_matched", _I), ("scale", _D), ("turn", _D), ("mirrored", _B))
    cols = ["x1", "y1", "x2", "y2"]
    slant = complex(math.cos(1), -math.sin(1))

    def solve(key: tuple, s: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        def load(d: pd.DataFrame) -> np.ndarray:
            v = d.sort_values("id")[cols].to_numpy(float)
            z = v[:, 0] + 1j * v[:, 1], v[:, 2] + 1j * v[:, 3]
            return np.stack(z, axis=1)[np.isfinite(v).all(axis=1) & (np.abs(z[1] - z[0]) > 1e-9)]

        a, b = load(s), load(t)
        both = np.concatenate([b, b[:, ::-1]])
        along = (both[:, 0] * slant).real
        order = np.argsort(along, kind="stable")
        along, reach = along[order], 2 * tolerance * (1 + 1e-9)
        found: set[tuple] = set()
        for i, mirror in itertools.product(range(len(a) if len(b) else 0), (False, True)):
            p = np.conj(a) if mirror else a
            m = (both[:, 1] - both[:, 0]) / (p[i, 1] - p[i, 0])
            image = both[:, :1, None] + m[:, None, None] * (p - p[i, 0])[None]
            image = image.reshape(-1, 2)
            place = (image[:, 0] * slant).real
            low, high = np.searchsorted(along, place - reach), np.searchsorted(along, place + reach, "right")
            which = np.repeat(np.arange(len(image)), high - low)
            other = order[np.arange(len(which)) - np.repeat(np.cumsum(high - low) - high, high - low)]
            error = np.abs(image[which] - both[other]).sum(axis=1) / 2
            near = error <= tolerance
            which, other, error = which[near], other[near] % len(b), error[near]
            first = np.lexsort((other, error, which))
            first = first[np.diff(which[first], prepend=-1) > 0]
            pose = which[first] // len(a)
            n = np.bincount(pose, minlength=len(m))
            unique = np.bincount(np.unique(pose * len(b) + other[first]) // len(b), minlength=len(m))
            score = 10.0 * unique + n - 6 * (n - unique)
            turn = np.round(np.degrees(np.angle(m)) % 360, 2)
            found.update(zip(score.tolist(), n.tolist(), np.round(np.abs(m), 4).tolist(), turn.tolist(), itertools.repeat(mirror)))
        best = sorted(found, key=lambda x: (-x[0], -x[1], x[2:]))[:keep]
        return pd.DataFrame([(key[0], k + 1, *x) for k, x in enumerate(best)], columns=schema.names)

    return source.groupBy(by).cogroup(target.groupBy(by)).applyInPandas(solve, schema)


def aligned_landmarks(left: DataFrame, right: DataFrame, by: str) -> DataFrame:
    """Largest order-preserving match of two landmark sequences: (by, pairs, score, truncated).

    ``left`` and ``right`` (by, place, id, kind, links).  A pair of one kind
    scores 3 when it has as many links on both sides and -3 otherwise, a
    skipped landmark costs 2.  Null kinds match nothing.  The whole table is
    filled, so ``truncated`` is never true.  Matches that cross are
    not sought here but by ``skeleton_matches``.
    """
    schema = _schema(left.schema[by], ("pairs", _S), ("score", _I), ("truncated", _B))

    def solve(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x = a.sort_values(["place", "id"])[["id", "kind", "links"]].values.tolist()
        y = b.sort_values(["place", "id"])[["id", "kind", "links"]].values.tolist()
        n, m = len(x), len(y)
        kinds, links = np.array([k for _, k, _ in y], object), np.array([c for _, _, c in y], object)
        gain = lambda i: np.where(links == x[i][2], 3, -3)
        same = lambda i: kinds == x[i][1] if x[i][1] is not None else np.zeros(m, bool)
        # best[i][j]: best score of the rest; the order constraint makes the search a table.
        best = np.zeros((n + 1, m + 1), np.int32)
        best[:, m] = -2 * np.arange(n, -1, -1)
        best[n, :] = -2 * np.arange(m, -1, -1)
        steps = 2 * np.arange(m + 1, dtype=np.int32)
        for i in range(n - 1, -1, -1):
            row = best[i]
            row[:m] = np.maximum(best[i + 1, :m] - 2, np.where(same(i), best[i + 1, 1:] + gain(i), -(1 << 30)))
            # Skips on the right: the best of all places further on, less 2 for each step there.
            row[:] = np.maximum.accumulate((row - steps)[::-1])[::-1] + steps
        i = j = 0
        pairs = []
        while i < n and j < m:
            if x[i][1] is not None and x[i][1] == y[j][1] and best[i, j] == best[i + 1, j + 1] + (3 if x[i][2] == y[j][2] else -3):
                pairs.append(f"{x[i][0]}={y[j][0]}")
                i, j = i + 1, j + 1
            elif best[i, j] == best[i + 1, j] - 2:
                i += 1
            else:
                j += 1
        return pd.DataFrame([(key[0], ";".join(pairs), int(best[0, 0]), False)], columns=schema.names)

    return left.groupBy(by).cogroup(right.groupBy(by)).applyInPandas(solve, schema)


def correspondence_scores(pairs: DataFrame, by: list[str], a: str, b: str, incidence: str, cosine: str, anchored: str) -> DataFrame:
    """8 per frame incidence, 2 * max(0, cosine) where known, 20 with an independent anchor; rank, margin and status per ``a``."""
    score = 8 * F.coalesce(incidence, F.lit(0)) + 2 * F.greatest(F.lit(0.0), F.coalesce(cosine, F.lit(0.0))) + F.when(F.col(anchored), 20).otherwise(0)
    w = Window.partitionBy(*by, a).orderBy(F.desc("score"), b)
    d = pairs.withColumn("score", score).withColumn("rank", F.row_number().over(w)).withColumn("margin", F.col("score") - F.lead("score").over(w))
    status = F.when(F.col("rank") > 1, "candidate").when(F.col("margin").isNull() | (F.col("margin") >= 4), "leading").otherwise("ambiguous")
    return d.withColumn("status", status)


def place_callouts(targets: DataFrame, by: str, ident: str, width: float, height: float, step: float, tries: int = 24) -> DataFrame:
    """Labels placed near their targets one after another without overlap: (by, ident, x, y, ring), null when no place is free.

    ``targets`` (by, ident, px, py).  Places are tried on rings of growing
    radius; occupied boxes are kept in a grid, so a try looks at few of them.
    """
    schema = _schema(targets.schema[by], targets.schema[ident], ("x", _D), ("y", _D), ("ring", _I))
    around = [(math.cos(math.pi * k / 4), math.sin(math.pi * k / 4)) for k in range(8)]

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        grid: dict[tuple[int, int], list[tuple[float, float]]] = {}
        rows = []
        for key, ident_, px, py in pdf.sort_values(["py", "px", ident])[[by, ident, "px", "py"]].itertuples(index=False):
            put = (None, None, None)
            for ring, (dx, dy) in ((r, d) for r in range(1, tries + 1) for d in around):
                x, y = px + dx * step * ring, py + dy * step * ring
                i, j = int(x // width), int(y // height)
                if all(abs(x - u) >= width or abs(y - v) >= height for k in (-1, 0, 1) for m in (-1, 0, 1) for u, v in grid.get((i + k, j + m), ())):
                    grid.setdefault((i, j), []).append((x, y))
                    put = (round(x, 3), round(y, 3), ring)
                    break
            rows.append((key, ident_, *put))
        return pd.DataFrame(rows, columns=schema.names).astype({"ring": "Int32"})

    finite = (F.abs(F.col("px")) < float("inf")) & (F.abs(F.col("py")) < float("inf"))
    return targets.where(finite).select(by, ident, "px", "py").groupBy(by).applyInPandas(place, schema)


def promote(audit: DataFrame, stable: DataFrame, handles: str, status: str) -> DataFrame:
    """Complete, high-confidence audit rows with the stable id of the same handle set; a stable id used twice promotes nothing."""
    good = audit.where(F.col(status) == "high").withColumn("__set", F.array_sort(F.array_distinct(handles)))
    known = stable.withColumn("__set", F.array_sort(F.array_distinct(handles))).drop(handles)
    joined = good.join(known, "__set").drop("__set")
    n = F.count("*").over(Window.partitionBy("stable_id"))
    return joined.withColumn("__n", n).where("__n = 1").drop("__n")


#: What a skipped landmark costs, what a relation counts that the other side shares or lacks, and the bound of the geometry's share.
SKIP, RELATION, GEOMETRY = 2.0, 3.0, 3.0
#: The eight symmetries of the plane as matrices (xx, xy, yx, yy), by name.
SYMMETRIES = {
    "identity": (1, 0, 0, 1), "flip_x": (-1, 0, 0, 1), "flip_y": (1, 0, 0, -1), "flip_xy": (-1, 0, 0, -1),
    "swap": (0, 1, 1, 0), "swap_flip_x": (0, -1, 1, 0), "swap_flip_y": (0, 1, -1, 0), "swap_flip_xy": (0, -1, -1, 0),
}


def local_gain(kind_a, degree_a, kind_b, degree_b) -> float | None:
    """What a pair of landmarks of one kind counts: more with equal degrees; none for other or unknown kinds."""
    if kind_a is None or kind_a != kind_b:
        return None
    return 3.0 if degree_a == degree_b else 1.0


def axis_votes(pairs: list[tuple[tuple[float, float], tuple[float, float]]]) -> tuple[float, str | None]:
    """The symmetry under which directions between matched landmarks agree best, with the sum of their cosines."""
    best = (0.0, None)
    for name, (a, b, c, d) in SYMMETRIES.items():
        total = 0.0
        for (p, q), (r, s) in itertools.combinations(pairs, 2):
            u, v = (r[0] - p[0], r[1] - p[1]), (s[0] - q[0], s[1] - q[1])
            w = (a * u[0] + b * u[1], c * u[0] + d * u[1])
            size = math.hypot(*w) * math.hypot(*v)
            total += (w[0] * v[0] + w[1] * v[1]) / size if size else 0.0
        if best[1] is None or (total, name) > best:
            best = (total, name)
    return best


def match_skeletons(left: list[tuple], right: list[tuple], left_links: set[frozenset], right_links: set[frozenset], keep: int, budget: int) -> tuple[list[tuple[float, float, str, dict]], bool]:
    """The ``keep`` best mappings (score, topology, symmetry, {left: right}) of landmarks (id, kind, degree, x, y), and whether the search came to its end.

    Every landmark of the left is mapped to one of its kind or skipped; the
    search is exact, and a branch is left when even its best completion with
    the best geometry lies below the mappings kept.
    """
    options = {}
    for i, kind, degree, *_ in left:
        own = [(local_gain(kind, degree, k, g), j) for j, k, g, *_ in right]
        options[i] = sorted(((s, j) for s, j in own if s is not None), key=lambda x: (-x[0], x[1]))
    order = sorted(options, key=lambda i: (len(options[i]), i))
    at = {i: k for k, i in enumerate(order)}
    # Relations of a landmark to those before it in the order.
    before = {i: [j for link in left_links if i in link and len(link) == 2 for j in link - {i} if at.get(j, len(at)) < at[i]] for i in order}
    rest = [0.0] * (len(order) + 1)
    for k in range(len(order) - 1, -1, -1):
        i = order[k]
        rest[k] = rest[k + 1] + max(-SKIP, (options[i][0][0] if options[i] else -SKIP) + RELATION * len(before[i]))
    where_l, where_r = {i: (x, y) for i, _, _, x, y in left}, {j: (x, y) for j, _, _, x, y in right}
    kept: list[tuple[float, float, str, dict]] = []
    visits, mapping, used = 0, {}, set()

    def settle(score: float) -> None:
        own = [(where_l[i], where_r[j]) for i, j in mapping.items()]
        votes, name = axis_votes([p for p in own if None not in (*p[0], *p[1])])
        kept.append((score + min(GEOMETRY, max(-GEOMETRY, votes)), score, name or "identity", dict(mapping)))
        kept.sort(key=lambda r: (-round(r[0], 9), sorted(r[3].items())))
        del kept[keep:]

    # (depth, next option, score): option -1 skips the landmark, which is tried last.
    stack = [[0, 0, 0.0]]
    while stack:
        visits += 1
        if visits > budget:
            return kept, False
        k, option, score = stack[-1]
        if k == len(order):
            if mapping and not (len(kept) == keep and score + GEOMETRY < kept[-1][0] - 1e-9):
                visits += len(mapping) ** 2
                settle(score)
            stack.pop()
            continue
        i = order[k]
        if option == 0 and len(kept) == keep and score + rest[k] + GEOMETRY < kept[-1][0] - 1e-9 or option > len(options[i]):
            if option > 0 and i in mapping:
                used.discard(mapping.pop(i))
            stack.pop()
            continue
        if i in mapping:
            used.discard(mapping.pop(i))
        stack[-1][1] = option + 1
        if option == len(options[i]):
            stack.append([k + 1, 0, score - SKIP])
            continue
        gain, j = options[i][option]
        if j in used:
            continue
        told = sum(RELATION if frozenset((j, mapping[o])) in right_links else -RELATION for o in before[i] if o in mapping)
        mapping[i] = j
        used.add(j)
        stack.append([k + 1, 0, score + gain + told])
    return kept, True


def skeleton_matches(left: DataFrame, right: DataFrame, left_links: DataFrame, right_links: DataFrame, by: str, keep: int = 20, budget: int = 20_000) -> DataFrame:
    """(by, rank, score, topology, symmetry, pairs, margin, status) of the best common subgraphs of two landmark graphs per group.

    ``left`` and ``right`` have (by, id, kind, x, y), the links (by, a, b); the
    degree of a landmark is the number of its links.  A group whose symmetric
    landmarks need more than ``budget`` steps (a step tries one landmark, or
    compares two pairs' directions) gives one row ``unresolved`` without pairs:
    it is never forced.
    """
    schema = _schema(left.schema[by], ("rank", _I), ("score", _D), ("topology", _D), ("symmetry", _S), ("pairs", _S), ("margin", _D), ("status", _S))
    def packed(d: DataFrame, side: str, node: bool) -> DataFrame:
        own = [F.lit(side).alias("side"), *[(F.col(c) if node else F.lit(None)).cast("string").alias(c) for c in ("id", "kind")], *[(F.col(c) if node else F.lit(None)).cast("double").alias(c) for c in ("x", "y")], *[(F.lit(None) if node else F.col(c)).cast("string").alias(c) for c in ("a", "b")]]
        return d.select(by, *own).where("id is not null" if node else "a is not null and b is not null and a != b").distinct()

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        def graph(side: str) -> tuple[list[tuple], set[frozenset]]:
            n, e = pdf[pdf["side"] == side], pdf[pdf["side"] == side + "_link"]
            links = {frozenset((a, b)) for a, b in zip(e["a"], e["b"])}
            degree: dict[str, int] = {}
            for link in links:
                for x in link:
                    degree[x] = degree.get(x, 0) + 1
            real = lambda v: None if v is None or not math.isfinite(v) else float(v)
            nodes = [(i, k, degree.get(i, 0), real(x), real(y)) for i, k, x, y in n.sort_values("id")[["id", "kind", "x", "y"]].drop_duplicates("id").itertuples(index=False)]
            return nodes, links

        (a, la), (b, lb) = graph("left"), graph("right")
        found, whole = match_skeletons(a, b, la, lb, keep, budget)
        group = pdf[by].iloc[0]
        if not whole:
            return pd.DataFrame([(group, 1, None, None, None, None, None, "unresolved")], columns=schema.names)
        rows = []
        for k, (score, topology, name, mapping) in enumerate(found):
            margin = round(score - found[k + 1][0], 3) if k + 1 < len(found) else None
            rows.append((group, k + 1, round(score, 3), round(topology, 3), name, ";".join(f"{i}={j}" for i, j in sorted(mapping.items())), margin, "complete"))
        return pd.DataFrame(rows, columns=schema.names)

    both = packed(left, "left", True).unionByName(packed(right, "right", True)).unionByName(packed(left_links, "left_link", False)).unionByName(packed(right_links, "right_link", False))
    return both.groupBy(by).applyInPandas(solve, schema)
