"""Matches of two incidence graphs, grown from seeds by local rules until nothing more is certain.

Both sides are tables of arms: a pipe that touches a frame, with the frame's
kind and, where known, the arm's direction.  From matched frames follow pipes
(``remaining_arm``, ``arm_signature``, ``arm_direction``), from matched pipes
frames (``continuation``, ``degree2_frame``, ``complete_frame``), and what is
unlike all else of its group follows without a neighbour (``corridor``,
``anchor_pipe``).  All rules are joins on keys with counts; no rule pairs the
arms of a frame with each other.

Every round all rules propose at once; a proposal stands if it is the only one
of both its ends, and both ends leave the open ones.  So the outcome depends on
no order, and a match is never taken back.

Defined results: arms with a null frame or pipe are left out; repeated arms
count once; seeds whose ends do not exist or occur twice are left out; a null
kind equals a null kind; without arms on one side nothing is matched.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from spoolmark.functions.geometry import bearing, octant
from spoolmark.plans.lineage import cut, release


def _side(arms: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., frame, pipe, kind, n, octant, other): arms with the degree of their frame and what stands at the pipe's other end."""
    a = arms.where("frame is not null and pipe is not null").groupBy(*by, "frame", "pipe").agg(
        F.min(F.coalesce("kind", F.lit(""))).alias("kind"), F.min(F.struct("dx", "dy")).alias("d")
    )
    n = a.groupBy(*by, "frame").agg(F.count("*").alias("n"))
    d = a.join(n, [*by, "frame"]).withColumn("octant", F.when((F.col("d.dx") != 0) | (F.col("d.dy") != 0), octant(bearing(F.col("d.dx"), F.col("d.dy")))))
    # What a pipe joins: the kinds and degrees of its frames, the own one taken out once.
    label = F.concat_ws(":", "kind", "n")
    ends = d.groupBy(*by, "pipe").agg(F.array_sort(F.collect_list(label)).alias("ends"))
    joined = d.join(ends, [*by, "pipe"])
    at = F.array_position("ends", label)
    rest = F.concat(F.slice("ends", 1, (at - 1).cast("int")), F.slice("ends", (at + 1).cast("int"), F.size("ends")))
    return joined.select(*by, "frame", "pipe", "kind", "n", "octant", F.array_join(rest, "|").alias("other"), F.array_join("ends", "|").alias("ends"))


def _single(d: DataFrame, keys: Sequence[str], value: str, alias: str) -> DataFrame:
    """The value of every key that has exactly one."""
    return d.groupBy(*keys).agg(F.count("*").alias("__n"), F.min(value).alias(alias)).where("__n = 1").drop("__n")


def _arms_alike(left: DataFrame, right: DataFrame, frames: DataFrame, by: Sequence[str], like: Sequence[str], rule: str) -> DataFrame:
    """Open arms of matched frames that are the only ones with their features, on both sides."""
    a = _single(left.join(frames.select(*by, F.col("a").alias("frame"), F.col("b").alias("__g")), [*by, "frame"]), [*by, "__g", *like], "pipe", "a")
    b = _single(right.withColumnRenamed("frame", "__g"), [*by, "__g", *like], "pipe", "b")
    return a.join(b, [*by, "__g", *like]).select(*by, "a", "b", F.lit(rule).alias("rule"))


def _alone_alike(left: DataFrame, right: DataFrame, by: Sequence[str], item: str, like: Sequence[str], rule: str) -> DataFrame:
    """Open items that are the only ones of their group with their features, on both sides."""
    a = _single(left.select(*by, item, *like).distinct(), [*by, *like], item, "a")
    b = _single(right.select(*by, item, *like).distinct(), [*by, *like], item, "b")
    return a.join(b, [*by, *like]).select(*by, "a", "b", F.lit(rule).alias("rule"))


def _certain(proposals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Proposals that are the only ones of both their ends, with the first of their rules by name."""
    p = proposals.groupBy(*by, "a", "b").agg(F.min("rule").alias("rule"))
    once = lambda c: F.count("*").over(Window.partitionBy(*by, c))
    return p.withColumn("__a", once("a")).withColumn("__b", once("b")).where("__a = 1 and __b = 1").drop("__a", "__b")


def _seeded(seeds: DataFrame | None, left: DataFrame, right: DataFrame, by: Sequence[str], item: str) -> DataFrame:
    real = lambda s, c: s.select(*by, F.col(item).alias(c)).distinct()
    if seeds is None:
        return real(left, "a").where("false").select(*by, "a", F.col("a").alias("b"), F.lit("seed").alias("rule"))
    own = seeds.select(*by, "a", "b", F.lit("seed").alias("rule")).join(real(left, "a"), [*by, "a"], "left_semi").join(real(right, "b"), [*by, "b"], "left_semi")
    return _certain(own, by).select(*by, "a", "b", "rule")


def propagate(left: DataFrame, right: DataFrame, by: Sequence[str], pipes: DataFrame | None = None, frames: DataFrame | None = None, most_rounds: int = 1000) -> DataFrame:
    """(by..., what, a, b, rule, round) of matched pipes and frames; seeds have round 0.

    ``left`` and ``right`` have (by..., frame, kind, pipe, dx, dy), the seeds
    ``pipes`` and ``frames`` (by..., a, b).  Raises if rules still apply after
    ``most_rounds``.
    """
    by = list(by)
    l, r = cut(_side(left, by), "left"), cut(_side(right, by), "right")
    state = {
        "pipe": cut(_seeded(pipes, l, r, by, "pipe").withColumn("round", F.lit(0)), "pipes"),
        "frame": cut(_seeded(frames, l, r, by, "frame").withColumn("round", F.lit(0)), "frames"),
    }
    for k in range(1, most_rounds + 1):
        pm, fm = state["pipe"].select(*by, "a", "b"), state["frame"].select(*by, "a", "b")
        key = lambda d, c, item: d.select(*by, F.col(c).alias(item))
        free = lambda side, m, c, item: side.join(key(m, c, item), [*by, item], "left_anti")
        lp, rp = free(l, pm, "a", "pipe"), free(r, pm, "b", "pipe")
        lf, rf = free(l, fm, "a", "frame"), free(r, fm, "b", "frame")
        pipe_rules = [
            _arms_alike(lp, rp, fm, by, [], "remaining_arm"),
            _arms_alike(lp, rp, fm, by, ["other"], "arm_signature"),
            _arms_alike(lp.where("octant is not null"), rp.where("octant is not null"), fm, by, ["octant"], "arm_direction"),
            _alone_alike(lp, rp, by, "pipe", ["ends"], "anchor_pipe"),
        ]
        # From a matched pipe on: its only open frame on both sides, if of one kind and degree.
        at_pipe = lf.join(pm.select(*by, F.col("a").alias("pipe"), F.col("b").alias("q")), [*by, "pipe"])
        a = at_pipe.groupBy(*by, "q").agg(F.count("*").alias("na"), F.min(F.struct("frame", "kind", "n")).alias("x")).where("na = 1")
        b = rf.withColumnRenamed("pipe", "q").groupBy(*by, "q").agg(F.count("*").alias("nb"), F.min(F.struct("frame", "kind", "n")).alias("y")).where("nb = 1")
        onward = a.join(b, [*by, "q"]).where("x.kind = y.kind and x.n = y.n").select(*by, F.col("x.frame").alias("a"), F.col("y.frame").alias("b"), F.lit("continuation").alias("rule"))
        # Frames that share matched pipes: all of them, or all but one of a branch.
        shared = at_pipe.select(*by, "q", F.col("frame").alias("a"), F.col("n").alias("na")).join(rf.select(*by, F.col("pipe").alias("q"), F.col("frame").alias("b"), F.col("n").alias("nb")), [*by, "q"])
        full = shared.groupBy(*by, "a", "b").agg(F.count("*").alias("s"), F.first("na").alias("na"), F.first("nb").alias("nb")).where("na = nb and s >= 2 and s >= na - 1")
        rule = F.when(F.col("na") == 2, "degree2_frame").otherwise("complete_frame")
        frame_rules = [onward, full.select(*by, "a", "b", rule.alias("rule")), _alone_alike(_cornered(lf, by), _cornered(rf, by), by, "frame", ["kind", "n", "around"], "corridor")]
        new = {what: cut(_certain(reduce(DataFrame.unionByName, rules), by).withColumn("round", F.lit(k)), "new") for what, rules in (("pipe", pipe_rules), ("frame", frame_rules))}
        found = 0
        for what, more in new.items():
            if n := more.count():
                old, state[what] = state[what], cut(state[what].unionByName(more), what)
                release(old)
                found += n
            release(more)
        if not found:
            break
    else:
        raise RuntimeError(f"rules still apply after {most_rounds} rounds")
    release(l)
    release(r)
    return reduce(DataFrame.unionByName, [d.withColumn("what", F.lit(what)) for what, d in state.items()]).select(*by, "what", "a", "b", "rule", "round")


def _cornered(arms: DataFrame, by: Sequence[str]) -> DataFrame:
    """Frames with what stands at the other ends of all their arms."""
    around: Column = F.array_join(F.array_sort(F.collect_list("other")), "/")
    return arms.groupBy(*by, "frame", "kind", "n").agg(around.alias("around"))
