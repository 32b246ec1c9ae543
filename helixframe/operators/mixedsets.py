"""Compatible mixed sets in trees: two disjoint sides of different splits that each hold leaves of several patterns.

Trees are rows (tree, child, parent); every inner edge splits its tree's leaves into those below and the rest. Two sides of different splits are
disjoint in two ways only: what lies below two edges neither of which is above the other, or what lies below one edge and outside another above it.
So the search is counts by node and two joins on the ancestor table, and no pair of splits is formed that is not one of these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from helixframe.operators import tree as trees
from helixframe.session import stored


def sides(edges: DataFrame, patterns: DataFrame, tree: str, child: str, parent: str, leaf: str, pattern: str, support: str | None = None, least_support: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(edges with the leaves below and in all, ``below_mixed`` and ``outside_mixed``; the (tree, node, ancestor) table). Patterns that are null count for none; edges below ``least_support`` are no splits."""
    name = lambda c: F.struct(F.col(tree).alias("t"), F.col(c).alias("n"))
    keyed = edges.select(name(child).alias("child"), name(parent).alias("parent"))
    above = stored(trees.ancestors(keyed, "child", "parent", 4).select(F.col("node.t").alias("tree"), F.col("node.n").alias("node"), F.col("ancestor.n").alias("ancestor")), "ancestors")
    known = patterns.where(F.col(pattern).isNotNull()).select(F.col(tree).alias("tree"), F.col(leaf).alias("node"), F.col(pattern).alias("pattern")).distinct()
    own = known.select("tree", F.col("node").alias("edge"), "pattern")
    below = own.unionByName(known.join(above, ["tree", "node"]).select("tree", F.col("ancestor").alias("edge"), "pattern")).groupBy("tree", "edge", "pattern").agg(F.count("*").alias("n"))
    whole = known.groupBy("tree", "pattern").agg(F.count("*").alias("all"))
    kinds = whole.groupBy("tree").agg(F.count("*").alias("kinds"))
    used = below.join(whole, ["tree", "pattern"]).groupBy("tree", "edge").agg(F.count("*").alias("here"), F.count_if(F.col("n") == F.col("all")).alias("only_here"))
    splits = edges.where(F.col(support).isNull() | (F.col(support) >= least_support)) if support else edges
    every = splits.select(F.col(tree).alias("tree"), F.col(child).alias("edge"), F.col(parent).alias("parent")).distinct()
    # an edge above a node with one child splits as the edge below it does
    single = edges.select(F.col(tree).alias("tree"), F.col(parent).alias("edge"), F.col(child)).distinct().groupBy("tree", "edge").agg(F.count("*").alias("n")).where("n = 1")
    every = every.join(single, ["tree", "edge"], "left_anti")
    got = every.join(used, ["tree", "edge"], "left").join(kinds, "tree")
    nodes = edges.select(F.col(tree).alias("tree"), F.col(child).alias("node")).distinct()
    ends = nodes.join(edges.select(F.col(tree).alias("tree"), F.col(parent).alias("node")), ["tree", "node"], "left_anti")
    many = ends.select("tree", F.col("node").alias("edge")).unionByName(ends.join(above, ["tree", "node"]).select("tree", F.col("ancestor").alias("edge"))).groupBy("tree", "edge").agg(F.count("*").alias("leaves"))
    got = got.join(many, ["tree", "edge"]).join(ends.groupBy("tree").agg(F.count("*").alias("all_leaves")), "tree")
    here, gone = F.coalesce("here", F.lit(0)), F.coalesce("only_here", F.lit(0))
    return got.select("tree", "edge", "parent", "leaves", "all_leaves", (here > 1).alias("below_mixed"), (F.col("kinds") - gone > 1).alias("outside_mixed")), above


def mixed_set_proofs(edges: DataFrame, patterns: DataFrame, tree: str, child: str, parent: str, leaf: str, pattern: str, support: str | None = None, least_support: float = 0.0) -> DataFrame:
    """(tree, first, second, kind) with one proof a tree that has any: ``apart`` (below both edges) before ``nested`` (below the first, outside the second), then the least names.

    The two edges of a root with two children are one split and prove nothing together.
    """
    found, above = sides(edges, patterns, tree, child, parent, leaf, pattern, support, least_support)
    found = stored(found, "sides")
    mixed = found.where("below_mixed")
    # lowest mixed edges: none of them is above another, so any two are apart
    covers = mixed.join(above.select("tree", F.col("node").alias("edge"), F.col("ancestor").alias("_top")), ["tree", "edge"]).select("tree", F.col("_top").alias("edge")).distinct()
    lowest = mixed.join(covers, ["tree", "edge"], "left_anti")
    # the two least; if they have all leaves between them they are one split, and there is no third
    first = lowest.groupBy("tree").agg(F.min(F.struct("edge", "leaves")).alias("_a"))
    second = lowest.join(first, "tree").where(F.col("edge") > F.col("_a.edge")).groupBy("tree", "_a", "all_leaves").agg(F.min(F.struct("edge", "leaves")).alias("_b"))
    apart = second.where(F.col("_a.leaves") + F.col("_b.leaves") < F.col("all_leaves")).select("tree", F.col("_a.edge").alias("first"), F.col("_b.edge").alias("second"), F.lit("apart").alias("kind"))
    outer = found.where("outside_mixed").select("tree", F.col("edge").alias("second"))
    nested = mixed.select("tree", F.col("edge").alias("first")).join(above.select("tree", F.col("node").alias("first"), F.col("ancestor").alias("second")), ["tree", "first"]).join(outer, ["tree", "second"])
    nested = nested.groupBy("tree").agg(F.min(F.struct("first", "second")).alias("s")).select("tree", "s.*", F.lit("nested").alias("kind"))
    return apart.unionByName(nested).groupBy("tree").agg(F.min(F.struct("kind", "first", "second")).alias("p")).select("tree", "p.first", "p.second", "p.kind")
