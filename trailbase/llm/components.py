"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def connected_components(work: Workspace, edges: DataFrame, name: str) -> DataFrame:
    """(id, component) for every id of the edges (a, b); component is the least id reachable.

    Each round hangs the neighbours of a node under their least neighbour and
    is written; the depth of what is left halves, so rounds grow with the
    logarithm of the longest path.  Ids are counted with map-side minima, and
    no node's neighbours are ever collected.
    """
    edges = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = work.keep(edges, f"{name}0")
    number = 0
    while True:
        # Large star: larger neighbours of a hang under the least of a and its neighbours.
        both = edges.select("a", "b").union(edges.select("b", "a"))
        # Minima are written before the join, as a join right above an aggregate can't split a hot node.
        least = work.keep(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), f"{name}-up{number}")
        large = both.join(least.hint("merge"), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        # Small star: smaller neighbours of a, and a itself, hang under the least of them.
        down = work.keep(large, f"{name}-large{number}")
        least = work.keep(down.groupBy("a").agg(F.min("b").alias("m")), f"{name}-down{number}")
        small = down.join(least.hint("merge"), "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).filter("a != b").distinct()
        number += 1
        edges = work.keep(small, f"{name}{number}")
        # Done when every node hangs under one other, and no node has both a node above and one below.
        n, nodes = edges.agg(F.count("*"), F.countDistinct("a")).first()
        if n == nodes and edges.join(edges.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
            break
        work.drop(*(f"{name}{x}{number - 1}" for x in ("", "-up", "-large", "-down")))
    work.drop(*(f"{name}{x}{number - 1}" for x in ("", "-up", "-large", "-down")))
    stars = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return stars.union(stars.select("component", "component").distinct())
