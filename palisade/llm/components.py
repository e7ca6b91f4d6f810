"""Connected components of a large graph by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import discard, materialize


#: Edges, two integers each, up to which one task forms the components; more are dealt over tasks.
FEW_EDGES = 100_000


def _smallest(pairs: DataFrame, few: bool) -> DataFrame:
    """``pairs(u, v)`` with ``m``, the smallest of u and all its v. The join splits hot u; a few pairs are in one task already."""
    if few:
        return pairs.select("u", "v", F.least("u", F.min("v").over(Window.partitionBy("u"))).alias("m"))
    least = pairs.groupBy("u").agg(F.min("v").alias("least"))
    return pairs.join(least, "u").select("u", "v", F.least("u", "least").alias("m"))


def _is_forest_of_stars(edges: DataFrame, few: bool) -> bool:
    """Each u has one edge, and it leads to a node that has none; as v < u, that is the smallest of its component."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("above"), F.lit(0).alias("below")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("above"), F.lit(1).alias("below")))
    nodes = _together(ends, few).groupBy("node").agg(F.sum("above").alias("above"), F.max("below").alias("below"))
    return nodes.filter("above > 1 or (above = 1 and below = 1)").isEmpty()


def _together(df: DataFrame, few: bool) -> DataFrame:
    """A few rows in one partition, so that what follows needs no shuffle; else ``df``."""
    return df.coalesce(1) if few else df


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for each node of ``edges(u, v)``; the component is its smallest node.

    Every round keeps one row per node and star, so hot nodes never meet all pairs of their neighbours. The rounds grow as the
    logarithm of the components' size. Edges to oneself keep a node that has no other edge; an empty table gives no rows.
    Rounds over up to FEW_EDGES edges take one task and no shuffle, as a shuffle costs the driver more than it saves there.
    """
    n = edges.count()
    few, rows = n <= FEW_EDGES, 2 * n
    loops = edges.filter("u = v").select("u", "v")
    now = _together(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), few)
    now = materialize(now.distinct(), "edges", rows)
    while not _is_forest_of_stars(now, few):
        both = _together(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), few)
        large = _smallest(both, few).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        stars = _smallest(large, few)
        small = stars.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(stars.select("u", F.col("m").alias("v")))
        after = materialize(_together(small.filter("u != v"), few).distinct(), "stars", rows)
        discard(now)
        now = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    alone = loops.select(F.col("u").alias("node"), F.col("u").alias("component"))
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).unionByName(alone)
    return _together(found, few).groupBy("node").agg(F.min("component").alias("component"))


def merged_components(groups: DataFrame | None, links: DataFrame) -> DataFrame:
    """connected_components() of ``links(u, v)`` and of those behind ``groups(node, component)``, the components so far; None: none yet.

    The rounds run over components only: each is one node, however many it holds, and links inside one are gone.
    """
    if groups is None:
        return connected_components(links)
    at = lambda end: groups.select(F.col("node").alias(end), F.col("component").alias(f"{end}_component"))
    ends = links.join(at("u"), "u", "left").join(at("v"), "v", "left")
    ends = materialize(ends.select(F.coalesce("u_component", "u").alias("u"), F.coalesce("v_component", "v").alias("v")).distinct(), "ends", links.count())
    between = materialize(connected_components(ends), "merged")
    discard(ends)
    larger = between.select(F.col("node").alias("component"), F.col("component").alias("larger"))
    old = groups.join(larger, "component", "left").select("node", F.coalesce("larger", "component").alias("component"))
    return old.unionByName(between.join(groups, "node", "left_anti"))
