"""Connected components of an undirected graph by union-find and alternating stars.

Each task first reduces its links to a forest by union-find with path halving, in memory
that is bounded by ``MOST_NODES``.  If no more than ``FEW_LINKS`` are left of all tasks'
forests, counted, one more union-find ends the work; else the forests are joined by large
and small stars: every round is two aggregations over the links that remain; nothing is collected but
a count of changes.  Rounds grow with the logarithm of the longest path, and each
round's links are checkpointed, so a lost executor never replays more than one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_dir

#: Nodes that a task holds in union-find; then it begins anew, which keeps links whole.
MOST_NODES = 1_000_000
#: Links whose nodes one task may hold in union-find.
FEW_LINKS = 200_000


def _directed(links: DataFrame) -> DataFrame:
    return links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


class Sets:
    """Union-find with path halving; a set's root is its smallest node."""

    def __init__(self):
        self.parent: dict = {}

    def root(self, x):
        parent = self.parent
        while (above := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(above, above)
        return x

    def join(self, a, b) -> bool:
        """Whether the two were apart."""
        x, y = self.root(a), self.root(b)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True


def spanning_forest(links: DataFrame) -> DataFrame:
    """Links (a, b) that join the same nodes as ``links`` do, a task's nodes by a forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets()
        for batch in batches:
            pairs = zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())
            yield batch.take(pa.array([at for at, (a, b) in enumerate(pairs) if sets.join(a, b)], pa.int64()))
            if len(sets.parent) > MOST_NODES:
                sets = Sets()

    links = links.select("a", "b")
    return links.mapInArrow(run, links.schema)


def _at_once(links: DataFrame) -> DataFrame:
    """The components of few links, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, kind = Sets(), None
        for batch in batches:
            kind = batch.column("a").type
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                sets.join(a, b)
        nodes = list(sets.parent)
        for at in range(0, len(nodes), 50_000):
            some = nodes[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, kind), pa.array([sets.root(x) for x in some], kind)], ["node", "component"])

    schema = links.select(links["a"].alias("node"), links["b"].alias("component")).schema
    return links.coalesce(1).mapInArrow(run, schema)


def _large_star(links: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of its neighbourhood."""
    both = _directed(links)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    own = least.select("a", F.col("m").alias("b"))
    others = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return own.union(others).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for all nodes of ``links`` (a, b of one kind); the component is its
    smallest node.  Self-links and repeated links change nothing; without links the
    result is empty."""
    scratch_dir(links.sparkSession)
    now = spanning_forest(links.where("a <> b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    if now.count() <= FEW_LINKS:
        return _at_once(now)
    before = None
    while True:
        now = _small_star(_large_star(now)).checkpoint()
        # A star forest is stable: as many links as nodes hang from roots, same sums.
        state = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    roots = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
