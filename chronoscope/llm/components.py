"""Connected components by alternating large and small stars.

Each round is two aggregations and two joins on edges; hubs are handled by
partial aggregation and by joins whose skewed partitions Spark splits. Before
the rounds, and after each, every task gives the edges it holds, a bounded block
at a time, the form of stars, and the rounds end when all edges have it: few
edges take no round. The edges are written to the shared folder after each step,
which cuts the lineage and survives lost executors. Nothing is collected but two
counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Connects each node's larger (or not larger) neighbours to its least neighbour or itself."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


#: Edges that a task holds at once.
BLOCK = 1 << 18


def least_nodes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of a block's edges but the least of each component, with that least node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    least = np.arange(len(nodes))
    while (least[x] != least[y]).any():
        u, v = least[x], least[y]  # roots: they join the least root that an edge leads to
        low = np.minimum(u, v)
        np.minimum.at(least, u, low)
        np.minimum.at(least, v, low)
        while (least[least] != least).any():
            least = least[least]
    leaf = least != np.arange(len(nodes))
    return nodes[leaf], nodes[least[leaf]]


def _blocks(size: int):
    """A task's edges, ``size`` at a time, as stars around the least node of each component within the block."""

    def given(held):
        a, b = (np.concatenate([x.column(x.schema.names.index(c)).to_numpy(zero_copy_only=False) for x in held]) for c in ("a", "b"))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in least_nodes(a, b)], ["a", "b"])

    def run(batches):
        held, n = [], 0
        for x in (b.slice(at, size) for b in batches for at in range(0, b.num_rows, size)):
            if n + x.num_rows > size:
                yield given(held)
                held, n = [], 0
            held.append(x)
            n += x.num_rows
        if held:
            yield given(held)

    return run


def _state(edges: DataFrame) -> tuple[int, bool]:
    """How many edges there are, and whether these are stars: each larger node has one other, which is nobody's larger node."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("to")), F.struct(F.col("b").alias("node"), F.lit(None).cast("long").alias("to")))).alias("x")).select("x.*")
    nodes = ends.groupBy("node").agg(F.count("to").alias("n"), F.min("to").alias("least"), F.max("to").alias("last"), F.count_if(F.col("to").isNull()).alias("led"))
    broken = (F.col("least") < F.col("last")) | (F.col("n") > 0) & (F.col("led") > 0)
    n, bad = nodes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(broken)).first()
    return n, not bad


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (its least node) for every node of an edge; no edges give no rows."""
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    n, stars = _state(edges)
    while not stars:
        edges = stored(edges.coalesce(-(-n // BLOCK)).mapInArrow(_blocks(BLOCK), "a long, b long"), "edges")
        n, stars = _state(edges)
        if not stars:
            edges = stored(_star(_star(edges, True), False), "edges")
            n, stars = _state(edges)
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
