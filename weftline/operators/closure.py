"""Inheritance closures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.session import materialize, scratch


def ancestor_paths(nodes: DataFrame, edges: DataFrame, levels: int = 100) -> DataFrame:
    """``node, ancestor, path``: every node with itself and each ancestor once, at its first visit.

    ``nodes`` has ``node``, ``edges`` has ``node, base, ord``. The path is the array of base
    ordinals; the least path is the first visit in depth-first order. Cycles end where they close;
    bases that are no node are followed no further but listed. One join per level of the hierarchy:
    only visits that come before all earlier ones of the same node and ancestor are kept and followed,
    since whatever a later visit leads to has been seen from the earlier one.
    """
    spark = nodes.sparkSession
    e = edges.select(F.col("node").alias("ancestor"), F.col("base"), F.col("ord").cast("int").alias("ord")).dropna()
    with scratch(spark) as keep:
        own = nodes.select("node", F.col("node").alias("ancestor"), F.array().cast("array<int>").alias("path"), F.array("node").alias("trail"))
        level = best = materialize(own.distinct(), "closure")
        for _ in range(levels):
            step = level.join(e, "ancestor").where(~F.array_contains("trail", F.col("base"))).select(
                "node", F.col("base").alias("ancestor"), F.concat("path", F.array("ord")).alias("path"),
                F.concat("trail", F.array("base")).alias("trail"),
            )
            first = step.groupBy("node", "ancestor").agg(F.min(F.struct("path", "trail")).alias("v")).select("node", "ancestor", "v.*")
            seen = best.select("node", "ancestor", F.col("path").alias("known"))
            level = first.join(seen, ["node", "ancestor"], "left").where("known is null or path < known").drop("known")
            level = materialize(level, "closure")
            if level.isEmpty():
                break
            both = best.unionByName(level).groupBy("node", "ancestor").agg(F.min(F.struct("path", "trail")).alias("v"))
            best = materialize(both.select("node", "ancestor", "v.*"), "closure")
        else:
            raise ValueError(f"the hierarchy is deeper than {levels} levels")
        keep(best)
    return best.drop("trail")


def inherited_set(paths: DataFrame, members: DataFrame) -> DataFrame:
    """G1: ``node, name``: all names of a node and its ancestors; ``members`` has ``node, name``."""
    own = members.select(F.col("node").alias("ancestor"), "name")
    return paths.join(own, "ancestor").select("node", "name").distinct()


def nearest_wins(paths: DataFrame, members: DataFrame) -> DataFrame:
    """``node, name, value``: the node's own value, else that of the earliest base."""
    own = members.select(F.col("node").alias("ancestor"), "name", "value")
    return paths.join(own, "ancestor").groupBy("node", "name").agg(F.min_by("value", "path").alias("value"))


def last_base_wins(paths: DataFrame, members: DataFrame) -> DataFrame:
    """``node, name, owner``: the node itself, else the last base whose subtree has the name.

    Over first visits, the winner has the least path with all ordinals negated: a prefix comes
    before what it leads to, and of siblings the later one comes first.
    """
    own = members.select(F.col("node").alias("ancestor"), "name").distinct()
    preference = F.transform("path", lambda x: -x)
    return paths.join(own, "ancestor").groupBy("node", "name").agg(F.min_by("ancestor", preference).alias("owner"))


def inherited_use(accessed: Column, own: Column, receivers: Column, visible: Column) -> tuple[Column, Column]:
    """Whether any variable accessed, and any call receiver, is visible but not own."""
    return (
        F.size(F.array_except(accessed, own)) > 0,
        F.exists(receivers, lambda r: F.array_contains(visible, r) & ~F.array_contains(own, r)),
    )


def project_root(path: Column, parts: int = 4) -> Column:
    """The first parts of a path."""
    return F.substring_index(path, "/", parts)
