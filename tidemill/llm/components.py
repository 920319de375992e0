"""Connected components of a graph given as an edge table.

Every task first reduces a bounded number of edges to a spanning forest; what is
left is contracted by large-star and small-star rounds until each node points at its
component's smallest node. Nodes with many neighbours are joined by broadcast (few
can exist), so no key gathers in one task and nothing reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import join_by_group, materialize, prepare, release

EDGE = "a long, b long"


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of their component) of the given edges."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = at[: len(a)], at[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        ra, rb = parent[ia], parent[ib]
        differ = ra != rb
        if not differ.any():
            return nodes, nodes[parent]
        low, high = np.minimum(ra, rb)[differ], np.maximum(ra, rb)[differ]
        np.minimum.at(parent, high, low)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def _forests(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    batches = [b for b in it if b.num_rows]
    if batches:
        nodes, roots = forest(*(np.concatenate([b.column(k).to_numpy() for b in batches]) for k in (0, 1)))
        own = nodes != roots
        yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(roots[own])], ["a", "b"])


def _contract(edges: DataFrame, edges_per_task: int) -> DataFrame:
    """Spanning forests of bounded shares of the edges, as (node, smaller node)."""
    n = edges.count()
    dealt = edges.repartition(max(1, -(-n // edges_per_task)))
    return materialize(dealt.mapInArrow(_forests, EDGE), "forest")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round. Large star: each node's larger neighbours point at its smallest
    neighbour (or itself). Small star: a node and its smaller neighbours point at the
    smallest of them."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.filter("b < a")
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    joined = join_by_group(both, least, ["a"], "n", 2 * edges.count())
    if large:
        joined = joined.filter("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
    else:
        joined = joined.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return joined.filter("a <> b").distinct()


def _is_star(edges: DataFrame) -> bool:
    """Whether each node has one parent and no parent has a parent."""
    parents = edges.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"))
    if not parents.filter("low <> high").isEmpty():
        return False
    return edges.select("b").distinct().join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi").isEmpty()


def connected_components(edges: DataFrame, edges_per_task: int = 1_000_000) -> DataFrame:
    """(node, component) for every node of `edges` (a, b) that is not its component's
    smallest node; component is the smallest node reachable. Edges may repeat, be
    listed either way round, or join a node to itself; an empty table gives an empty
    result. edges should be a materialized table."""
    prepare(edges.sparkSession)
    found = _contract(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b"), edges_per_task)
    while not _is_star(found):
        large = materialize(_star(found, large=True), "large-star")
        small = materialize(_star(large, large=False), "small-star")
        release(found, large)
        found = _contract(small, edges_per_task)
        release(small)
    return found.select(F.col("a").alias("node"), F.col("b").alias("component")).distinct()
