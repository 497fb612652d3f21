"""Hierarchies and renames: closures by doubling and classes by pointer jumping, so a chain of depth d takes about log2(d) rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratica.storage import drop_stored, stored


def closure(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """(node, above, distance): every node that can be reached upwards, with the least number of steps.

    Edges with a null end are left out.  Circles end, as only least distances are kept; a node of a circle reaches itself.
    Semi-naive doubling: pairs of exactly ``width`` steps are one power of the edges, and in each round only that power
    meets the pairs known so far (all of distance up to ``width``), which gives all of distance up to twice that.  So a pair
    is made once for each of its shortest ways, not once for every way to cut it in two.  Rounds are stored.
    """
    first = edges.where(F.col(child).isNotNull() & F.col(parent).isNotNull()).select(F.col(child).alias("node"), F.col(parent).alias("above"), F.lit(1).alias("distance")).distinct()
    reach, width = stored(first, "reach"), 1
    while True:
        power = reach.where(F.col("distance") == width).select(F.col("node").alias("_low"), F.col("above").alias("_high"))
        far = reach.join(power, F.col("above") == F.col("_low")).select("node", F.col("_high").alias("above"), (F.col("distance") + width).alias("distance"))
        fresh = stored(far.groupBy("node", "above").agg(F.min("distance").alias("distance")).join(reach.select("node", "above"), ["node", "above"], "left_anti"), "reach")
        if fresh.isEmpty():
            return reach
        reach, width = reach.unionByName(fresh), 2 * width


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root): the smallest node that each can be reached from, whatever the direction of edges; no list of pairs.

    Every node points to the smallest neighbour of its own and its root's, and pointers are then shortened to their roots'
    (pointer jumping), until nothing moves: the number of rounds is about the logarithm of the longest way.  Edges are
    reduced to pairs of different roots each round, so what is inside a class no longer takes part.  Each step is stored,
    the one before it deleted, so what lies on disk does not grow with the rounds.
    """
    pairs = edges.where(F.col(left).isNotNull() & F.col(right).isNotNull()).select(F.col(left).alias("a"), F.col(right).alias("b"))
    # a node hooks to smaller ones alone, so one direction of a link is enough
    links = stored(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    roots = stored(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), "roots")
    while not links.where("a <> b").isEmpty():
        # links are between roots: hook each to its smallest neighbour if that is smaller
        hooked = stored(links.where("a <> b").groupBy("a").agg(F.min("b").alias("b")), "hooks")
        while True:  # shorten chains of hooks
            next_ = hooked.select(F.col("a").alias("b"), F.col("b").alias("_c"))
            shorter = stored(hooked.join(next_, "b", "left").select("a", F.coalesce("_c", "b").alias("b"), F.col("_c").isNotNull().alias("_moved")), "hooks")
            drop_stored(hooked)
            hooked = shorter
            if shorter.where("_moved").isEmpty():
                break
            hooked = shorter.select("a", "b")
        to = hooked.select(F.col("a").alias("root"), F.col("b").alias("_root"))
        following = stored(roots.join(to, "root", "left").select("node", F.coalesce("_root", "root").alias("root")), "roots")
        side = lambda c, df: df.join(hooked.select(F.col("a").alias(c), F.col("b").alias("_n")), c, "left").withColumn(c, F.coalesce("_n", c)).drop("_n")
        fewer = stored(side("b", side("a", links)).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
        drop_stored(roots, links, hooked)
        roots, links = following, fewer
    drop_stored(links)
    return roots


def cut_circles(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """The edges without the one that leaves the smallest node of each circle (one parent a node)."""
    reach = closure(edges, child, parent)
    on_circle = reach.where("node = above").select("node")
    # what a node of a circle reaches is the circle itself, as each has one parent
    smallest = reach.join(on_circle, "node").groupBy("node").agg(F.min("above").alias("_least")).where("node = _least").select(F.col("node").alias(child))
    return edges.join(smallest, child, "left_anti")


def below(reach: DataFrame) -> DataFrame:
    """(above, level, n): how many nodes stand at each level below a node."""
    return reach.groupBy("above", F.col("distance").alias("level")).agg(F.count("*").alias("n"))


def totals(reach: DataFrame) -> DataFrame:
    """(above, n): the size of the tree below each node, itself not counted."""
    return reach.where("node <> above").groupBy("above").agg(F.count("*").alias("n"))


def changes(old: DataFrame, new: DataFrame, key: str, parent: str, fields: list[str]) -> DataFrame:
    """joined, left, moved (another parent) or changed (another field) for every key that differs between two captures."""
    both = old.select(key, F.struct(parent, *fields).alias("_a")).join(new.select(key, F.struct(parent, *fields).alias("_b")), key, "full_outer")
    same = lambda c: F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}"))
    different = F.lit(False)
    for c in fields:
        different = different | ~same(c)
    kind = F.when(F.col("_a").isNull(), "joined").when(F.col("_b").isNull(), "left").when(~same(parent), "moved").when(different, "changed")
    return both.select(key, kind.alias("kind")).where("kind is not null")
