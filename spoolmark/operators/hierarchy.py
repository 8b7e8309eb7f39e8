"""Parent-child links of unknown depth to full hierarchies, by contraction.

Nodes are spread over parts of bounded size, whatever domain (drawing) they
belong to: the first level cuts the nodes into ranges of (domain, reference),
so that most links stay inside a part and a domain of any size is split.  Each
part contracts its parent chains to fragment exits, that is to the first owner
that lies in another part.  The exits, with the path, length and weight of the
chains between them, form a smaller quotient forest, which is solved by the
same procedure; its answers go back to the parts that hold or name an exit and
are expanded along the local fragments.  A chain that returns to itself inside
a part is a local cycle; one that closes only in the quotient marks its members
there, and the expansion marks every node between them.

Deeper levels spread their nodes at random with owners drawing some of their
nodes along, which removes about a quarter of any chain at every level, until
the quotient fits one part.  Only owners of at most ``FEW`` nodes draw, so that
no part grows with the children of one node; a node with more children loses
those that own nothing at the next level anyway.

Paths are written in pieces while walking down the fragments; a part holds
the labels of one path at a time, not the paths of all its nodes.

Defined results: rows with a null domain are dropped, as references are local
to it; null references are no nodes; a node named with several owners keeps
the smallest (the data model allows one); a node that owns itself is a cycle;
empty input gives an empty result; repeated rows count once; further columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from spoolmark.plans.lineage import cut, release

TREE, CYCLE, BELOW = 0, 1, 2
PART_NODES = 100_000
#: Owners of at most so many nodes may draw them into their own part.
FEW = 16
#: Rows and characters of paths after which a piece of the result is handed on.
PIECE_ROWS = 20_000
PIECE_CHARS = 8_000_000

#: Answers of the quotient as they go back to the parts: ``OWN`` about an exit of the part, ``UP`` about the owner of a fragment.
NODE, OWN, UP = 0, 1, 2

_LONG = ("home", "domain", "node", "root", "depth")
SOLVED = T.StructType(
    [T.StructField(c, T.LongType()) for c in _LONG]
    + [T.StructField("path", T.StringType()), T.StructField("total", T.LongType()), T.StructField("state", T.IntegerType())]
)
FRAGMENT = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("part", "domain", "node", "exit")]
    + [T.StructField(c, T.BooleanType()) for c in ("top", "is_exit")]
    + [T.StructField("length", T.LongType()), T.StructField("segment", T.StringType()), T.StructField("total", T.LongType()), T.StructField("state", T.IntegerType())]
)


class Part:
    """The chains of one part: links, order from the leaves up, states and subtree weights."""

    def __init__(self, nodes: pd.DataFrame, own: pd.DataFrame | None = None):
        self.n = n = len(nodes)
        self.domain, self.node, self.label = nodes["domain"].tolist(), nodes["node"].tolist(), nodes["label"].tolist()
        where = dict(zip(zip(self.domain, self.node), range(n)))
        has_owner = nodes["owner"].notna().tolist()
        owner = nodes["owner"].fillna(0).astype("int64").tolist()
        self.up = up = [where.get((d, o), -1) if h else -1 for d, o, h in zip(self.domain, owner, has_owner)]
        #: The owner of a top node that lies in another part.
        self.outer = [o if h and j < 0 else None for o, h, j in zip(owner, has_owner, up)]
        self.step = nodes["step"].tolist()

        pending = [0] * n
        for j in up:
            if j >= 0:
                pending[j] += 1
        self.order, ready = [], [i for i in range(n) if not pending[i]]
        while ready:
            i = ready.pop()
            self.order.append(i)
            j = up[i]
            if j >= 0:
                pending[j] -= 1
                if not pending[j]:
                    ready.append(j)
        self.state = [CYCLE] * n
        for i in self.order:
            self.state[i] = TREE

        self.total, self.marked = nodes["weight"].tolist(), [False] * n
        if own is not None:
            for d, x, below, state in zip(own["domain"].tolist(), own["node"].tolist(), own["total"].tolist(), own["state"].tolist()):
                i = where[d, x]
                self.total[i] += int(below)
                self.marked[i] = state == CYCLE
        for i in self.order:
            j = up[i]
            if j >= 0 and self.state[j] == TREE:
                self.total[j] += self.total[i]
                self.marked[j] = self.marked[j] or self.marked[i]

        self.length, self.top = list(self.step), list(range(n))
        for i in reversed(self.order):
            j = up[i]
            if j < 0:
                continue
            if self.state[j] != TREE:
                self.state[i] = BELOW
            else:
                self.length[i] += self.length[j]
                self.top[i] = self.top[j]

    def segment(self, i: int) -> str:
        """Labels from the top of the fragment to a node."""
        labels = [self.label[i]]
        while self.up[i] >= 0:
            i = self.up[i]
            labels.append(self.label[i])
        return "/".join(reversed(labels))

    def walk(self) -> Iterator[tuple[int, list[str]]]:
        """Every node of a fragment after its owner, with the labels from the top to it; the list is used again."""
        kids: list[list[int]] = [[] for _ in range(self.n)]
        stack = []
        for i in range(self.n):
            if self.state[i] == TREE:
                if self.up[i] < 0:
                    stack.append((i, 0))
                else:
                    kids[self.up[i]].append(i)
        trail: list[str] = []
        while stack:
            i, depth = stack.pop()
            del trail[depth:]
            trail.append(self.label[i])
            yield i, trail
            stack += [(k, depth + 1) for k in kids[i]]


def _pieces(rows: Iterator[tuple], names: list[str], text: int) -> Iterator[pd.DataFrame]:
    """Rows as frames of a bounded number of rows and characters of the column at place ``text``."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[text] or "")
        if len(held) >= PIECE_ROWS or size >= PIECE_CHARS:
            yield pd.DataFrame(held, columns=names)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=names)


def _typed(frames: Iterator[pd.DataFrame], integers: list[str]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield f.astype(dict.fromkeys(integers, "Int64"))


def _contracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Exits of other parts' fragments, and the tops of fragments, with the chain from the exit above them."""
    nodes = pd.concat(batches, ignore_index=True)
    part, here, is_exit = int(nodes["part"].iloc[0]), Part(nodes), nodes["is_exit"].eq(True).tolist()

    def rows() -> Iterator[tuple]:
        for i in range(here.n):
            is_top = here.outer[i] is not None
            if is_exit[i] or is_top:
                tree = here.state[i] == TREE
                yield (
                    part, here.domain[i], here.node[i], here.outer[here.top[i]] if tree else None, is_top, is_exit[i],
                    here.length[i], here.segment(i) if is_exit[i] and tree else "", here.total[i], here.state[i],
                )

    yield from _typed(_pieces(rows(), FRAGMENT.names, 7), ["exit"])


def _expanded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The full answer for every node of a part, from its chains and the answers about its exits."""
    rows = pd.concat(batches, ignore_index=True)
    own, above = rows[rows["kind"] == OWN], rows[rows["kind"] == UP]
    nodes = rows[rows["kind"] == NODE].reset_index(drop=True)
    here, home = Part(nodes, own), nodes["home"].astype("Int64").tolist()
    up = {(d, x): (r, k, p, s) for d, x, r, k, p, s in above[["domain", "node", "root", "depth", "path", "state"]].itertuples(index=False)}

    def answers() -> Iterator[tuple]:
        for i in range(here.n):
            if here.state[i] != TREE:
                yield home[i], here.domain[i], here.node[i], None, here.length[i], "", here.total[i], here.state[i]
        for i, trail in here.walk():
            top = here.top[i]
            if here.marked[i]:
                yield home[i], here.domain[i], here.node[i], None, 0, "", here.total[i], CYCLE
            elif here.outer[top] is None:
                # At deeper levels a label is a piece of path, whose first reference is the root.
                root = int(here.label[top].split("/", 1)[0])
                yield home[i], here.domain[i], here.node[i], root, here.length[i], "/".join(trail), here.total[i], TREE
            else:
                root, depth, path, state = up[here.domain[i], here.outer[top]]
                if state != TREE:
                    yield home[i], here.domain[i], here.node[i], None, 0, "", here.total[i], BELOW
                else:
                    yield home[i], here.domain[i], here.node[i], root, depth + here.length[i], f"{path}/{'/'.join(trail)}", here.total[i], TREE

    yield from _typed(_pieces(answers(), SOLVED.names, 5), ["home", "root", "depth"])


def _placed(nodes: DataFrame, n_parts: int, level: int) -> DataFrame:
    """``nodes`` with a part: ranges of (domain, node) on the first level, at random with owners drawing nodes below it."""
    if level == 0:
        spread = nodes.repartitionByRange(n_parts, "domain", "node")
    else:
        few = nodes.groupBy("domain", "owner").agg(F.count("*").alias("kids")).where(F.col("kids") <= FEW)
        coin = lambda c: F.pmod(F.xxhash64(c, F.lit(level)), F.lit(2))
        follows = F.col("kids").isNotNull() & (coin("node") == 0) & (coin("owner") == 1)
        key = F.when(follows, F.col("owner")).otherwise(F.col("node"))
        drawn = nodes.join(few, ["domain", "owner"], "left").withColumn("__key", F.xxhash64("domain", key, F.lit(-1 - level)))
        spread = drawn.repartition(n_parts, "__key")
    return spread.select(F.spark_partition_id().cast("long").alias("part"), "home", "domain", "node", "owner", "step", "label", "weight")


def _solve(nodes: DataFrame, part_nodes: int, level: int) -> tuple[DataFrame, list[DataFrame]]:
    """nodes(home, domain, node, owner, step, label, weight) -> (home, domain, node, root, depth, path, total, state).

    The second value lists the tables that the first one reads.
    """
    n = nodes.count()
    least = 2 * nodes.sparkSession.sparkContext.defaultParallelism if level == 0 else 1
    n_parts = max(least, math.ceil(n / part_nodes))
    placed = cut(_placed(nodes, n_parts, level), "parts")
    read = [placed]
    nothing = F.lit(None)
    answers = placed.select("part", F.lit(NODE).alias("kind"), *placed.columns[1:], *[nothing.cast(t).alias(c) for c, t in (("root", "long"), ("depth", "long"), ("path", "string"), ("total", "long"), ("state", "int"))])
    if level == 0 or n_parts > 1:
        # Owners that a part does not hold are exits; a part names each of them once, so a node with many children costs one row a part.
        owners = placed.where("owner is not null").select("part", "domain", F.col("owner").alias("node")).distinct()
        tops = cut(owners.join(placed.select("part", "domain", "node"), ["part", "domain", "node"], "left_anti"), "tops")
        exits = tops.select("domain", "node").distinct()
        flagged = placed.join(exits.withColumn("is_exit", F.lit(True)), ["domain", "node"], "left")
        fragments = cut(flagged.repartition(n_parts, "part").groupBy("part").applyInPandas(_contracted, FRAGMENT), "fragments")
        # What hangs below an exit in other parts: the fragments whose top node it owns.
        hanging = fragments.where("top and exit is not null").groupBy("domain", F.col("exit").alias("node")).agg(F.sum("total").alias("weight"))
        quotient = cut(
            fragments.where("is_exit").withColumn("owner", F.when(F.col("state") != TREE, F.col("node")).otherwise(F.col("exit")))
            .join(hanging, ["domain", "node"])
            .select(F.col("part").alias("home"), "domain", "node", "owner", F.col("length").alias("step"), F.col("segment").alias("label"), "weight"),
            "quotient",
        )
        answer, spent = _solve(quotient, part_nodes, level + 1)
        solved = cut(answer, "solved")
        read += [tops, solved]
        told = ["domain", "node", "root", "depth", "path", "total", "state"]
        own = solved.select(F.col("home").alias("part"), F.lit(OWN).alias("kind"), *told)
        above = tops.join(solved.select(*told), ["domain", "node"]).select("part", F.lit(UP).alias("kind"), *told)
        answers = answers.unionByName(own, True).unionByName(above, True)
        for table in (fragments, quotient, *spent):
            release(table)
    return answers.repartition(n_parts, "part").groupBy("part").applyInPandas(_expanded, SOLVED), read


def ownership(records: DataFrame, domain: str, parent: str, children: str, child_ref: str) -> DataFrame:
    """(domain, node, owner) of every reference that records name as parent or inside ``children``."""
    d, p = F.col(domain).alias("domain"), F.col(parent)
    own = records.select(d, p.alias("node"), F.lit(None).cast("long").alias("owner"))
    below = records.select(d, p.alias("owner"), F.explode(F.col(children)).alias("c")).select("domain", F.col(f"c.{child_ref}").alias("node"), "owner")
    return (
        own.unionByName(below)
        .where(F.col("domain").isNotNull() & F.col("node").isNotNull())
        .groupBy("domain", "node")
        .agg(F.min("owner").alias("owner"))
    )


def hierarchies(owned: DataFrame, part_nodes: int = PART_NODES) -> DataFrame:
    """(domain, node, verdict, root, depth, path, n_below) of every node of ``owned(domain, node, owner)``.

    Every owner has a row of its own, as ``ownership`` makes it.
    """
    nodes = owned.select(
        F.lit(None).cast("long").alias("home"), "domain", "node", "owner", F.when(F.col("owner").isNull(), 0).otherwise(1).cast("long").alias("step"),
        F.col("node").cast("string").alias("label"), F.lit(1).cast("long").alias("weight"),
    )
    nodes = cut(nodes, "nodes")
    solved, _ = _solve(nodes, part_nodes, 0)
    release(nodes)
    tree = F.col("state") == TREE
    return solved.select(
        "domain", "node",
        F.when(tree, "tree").when(F.col("state") == CYCLE, "cycle").otherwise("below_cycle").alias("verdict"),
        F.when(tree, F.col("root")).otherwise(-1).alias("root"),
        F.when(tree, F.col("depth")).otherwise(-1).cast("int").alias("depth"),
        F.when(tree, F.col("path")).otherwise("").alias("path"),
        F.when(tree, F.col("total") - 1).otherwise(-1).cast("int").alias("n_below"),
    )
