"""Connected components over an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import materialize, remove

#: Edges that one task folds together at a time; bounds its memory, not the result.
FOLD_EDGES = 400_000
#: A label standing for more nodes than this is sent to the edges instead of shuffling them to it.
HEAVY_DEGREE = 200_000
#: At most so many labels are sent that way (16 bytes each); the rest is shuffled.
HEAVY_LABELS = 10_000


def spanning_forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges (node, least node of its component) of the given edges, each node once."""
    nodes, index = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = index[: len(u)], index[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    while not np.array_equal(label, label[label]):
        label = label[label]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0

    def out() -> pa.RecordBatch:
        u, v = spanning_forest(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        count += batch.num_rows
        if count >= FOLD_EDGES:
            yield out()
            held, count = [], 0
    if held:
        yield out()


def _folded(edges: DataFrame) -> DataFrame:
    return edges.mapInArrow(_fold, "u long, v long")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for each node of ``edges``; component is the least node in it.

    Each round first folds the edges of every task into a spanning forest (whatever the degree
    of a hot node, a task passes on fewer edges than it has nodes), then hooks every node to the
    least neighbour and every label to the least label seen (the large-star and small-star steps),
    and writes the new forest to the shared folder. Rounds end when no edge changes any more, a
    number that grows with the logarithm of the longest path.

    Nulls on either side drop the edge; self-loops give a component of one node; an empty table
    gives an empty one. Nodes must be integers.
    """
    given = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).dropna()
    loops = given.where("u = v").select(F.col("u").alias("node")).distinct()
    loops = materialize(loops, "loops")
    forest = materialize(_folded(given.where("u <> v")).distinct(), "forest")
    while True:
        # forest rows are (node, a lesser node); a node may have several while it is not done
        least = forest.groupBy("u").agg(F.min("v").alias("low"), F.count("v").alias("n"))
        several = materialize(least.where("n > 1").select("u", "low"), "several")
        parents = least.select(F.col("u").alias("v"), F.col("low").alias("up"))
        # a parent that itself has a parent must be replaced; both steps keep every link
        heavy = (
            forest.groupBy("v").count().where(F.col("count") > HEAVY_DEGREE)
            .orderBy(F.desc("count")).limit(HEAVY_LABELS).select("v")
        )
        marked = forest.join(F.broadcast(heavy.withColumn("hot", F.lit(True))), "v", "left")
        hot_parents = parents.join(F.broadcast(heavy), "v", "left_semi")
        hot = marked.where("hot").drop("hot").join(F.broadcast(hot_parents), "v", "left")
        cold = marked.where("hot is null").drop("hot").join(parents, "v", "left")
        jumped = hot.unionByName(cold)
        if several.isEmpty() and jumped.where("up is not null").isEmpty():
            remove(several)
            break
        linked = jumped.select("u", F.coalesce("up", "v").alias("v")).unionByName(
            # node's other parents stay linked to the least of them
            forest.join(several, "u").where("v <> low")
            .select(F.col("v").alias("u"), F.col("low").alias("v"))
        )
        rewritten = linked.where("u <> v").select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
        )
        following = materialize(_folded(rewritten.distinct()).distinct(), "forest")
        remove(forest)
        remove(several)
        forest = following
    named = forest.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = named.select(F.col("component").alias("node")).distinct()
    alone = loops.join(named.select("node"), "node", "left_anti").join(roots, "node", "left_anti")
    return named.unionByName(roots.unionByName(alone).select("node", F.col("node").alias("component")))


def star_edges(df: DataFrame, node: str, key: str) -> DataFrame:
    """Edges ``a, b`` that join all ``node`` values with the same ``key`` to the least of them.

    The least is found with map-side combining and only keys of two or more nodes are joined
    back, so a key holding a third of all rows sends few rows. Null nodes or keys give no edge.
    """
    pairs = df.select(F.col(node).alias("a"), F.col(key).alias("k")).dropna().distinct()
    pairs = materialize(pairs, "star")
    low = pairs.groupBy("k").agg(F.min("a").alias("b"), F.count("a").alias("n")).where("n > 1")
    low = materialize(low.select("k", "b"), "starlow")
    return pairs.join(low, "k").where("a <> b").select("a", "b")
