"""Bounded traversals over edges(source, target, confidence).

A traversal is a loop of at most `depth` frontier joins (never over rows). Each hop reduces to one
row per newly reached node before it is checked against those seen, and is written out where a
checkpoint folder is set, so the plan stays short and a lost executor costs a hop. Results are
order-free: the least depth of a node, and over the paths of that depth the largest of the paths'
least confidences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plexigraph.model import WEAK_CAP, WEAK_KINDS
from plexigraph.session import hold


def bfs(edges: DataFrame, starts: DataFrame, depth: int, hold_after: int = 2, held: bool = False) -> DataFrame:
    """(id, depth, confidence) of nodes reached from starts(id) within `depth` hops, starts at depth 0.

    Beyond `hold_after` hops fronts are written, each in a job of its own, so the edges are written
    first, unless they are `held` already: a job then reads them instead of deriving them anew.
    """
    if depth > hold_after and not held:
        edges = hold(edges.select("source", "target", "confidence"))
    seen = starts.select("id").distinct().select("id", F.lit(0).alias("depth"), F.lit(1.0).alias("confidence"))
    front = seen
    for d in range(1, depth + 1):
        step = front.select(F.col("id").alias("source"), F.col("confidence").alias("__c")).join(edges.select("source", "target", "confidence"), "source")
        reached = step.groupBy(F.col("target").alias("id")).agg(F.max(F.least("__c", "confidence")).alias("confidence"))
        front = reached.join(seen.select("id"), "id", "left_anti").select("id", F.lit(d).alias("depth"), "confidence")
        if d > hold_after:
            front = hold(front)
            if front.isEmpty():
                break
        seen = seen.unionByName(front)
    return seen


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("target").alias("source"), F.col("source").alias("target"), *[c for c in edges.columns if c not in ("source", "target")])


def bfs_both(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(id, direction, depth, confidence): down before up, one row per node and the nearer direction."""
    down = bfs(edges, starts, depth).withColumn("direction", F.lit("down"))
    up = bfs(reverse(edges), starts, depth).withColumn("direction", F.lit("up"))
    both = down.unionByName(up)
    first = both.groupBy("id").agg(F.min(F.struct("depth", "direction", (-F.col("confidence")).alias("c"))).alias("m"))
    return first.select("id", F.col("m.direction").alias("direction"), F.col("m.depth").alias("depth"), (-F.col("m.c")).alias("confidence"))


def paths(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, id, depth, path, confidence): every simple path of 2 to `depth` edges; path is ids joined by '>'."""
    e = edges.select(F.col("source").alias("at"), F.col("target").alias("next"), F.col("confidence").alias("__c"))
    now = starts.select(F.col("id").alias("start"), F.col("id").alias("at"), F.array("id").alias("nodes"), F.lit(1.0).alias("confidence"))
    out = None
    for d in range(1, depth + 1):
        now = now.join(e, "at").filter(~F.array_contains("nodes", F.col("next"))).select("start", F.col("next").alias("at"), F.array_append("nodes", F.col("next")).alias("nodes"), F.least("confidence", "__c").alias("confidence"))
        if d > 1:
            rows = now.select("start", F.col("at").alias("id"), F.lit(d).alias("depth"), F.array_join(F.transform("nodes", lambda x: x.cast("string")), ">").alias("path"), "confidence")
            out = rows if out is None else out.unionByName(rows)
    return out


def unreachable(nodes: DataFrame, reached: DataFrame) -> DataFrame:
    return nodes.join(reached.select("id"), "id", "left_anti")


def workspace_impact(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(id, depth, confidence, via) along edges(source, target, kind, confidence).

    `contains` is followed from the start only; weak kinds are recorded at a confidence capped at
    WEAK_CAP and not followed further.
    """
    weak = F.col("kind").isin(WEAK_KINDS)
    e = edges.select("source", "target", "kind", F.when(weak, F.least("confidence", F.lit(WEAK_CAP))).otherwise(F.col("confidence")).alias("confidence"), weak.alias("weak"))
    seen = starts.select("id").distinct().select("id", F.lit(0).alias("depth"), F.lit(1.0).alias("confidence"), F.lit("start").alias("via"), F.lit(False).alias("weak"))
    front = seen
    for d in range(1, depth + 1):
        own = front.filter(~F.col("weak")).select(F.col("id").alias("source"), F.col("confidence").alias("__c"))
        follow = e if d == 1 else e.filter("kind <> 'contains'")
        step = own.join(follow, "source").withColumn("c", F.least("__c", "confidence"))
        best = step.groupBy(F.col("target").alias("id")).agg(F.max(F.struct(~F.col("weak"), "c", "kind", "weak")).alias("m"))
        front = best.join(seen.select("id"), "id", "left_anti").select("id", F.lit(d).alias("depth"), F.col("m.c").alias("confidence"), F.col("m.kind").alias("via"), F.col("m.weak").alias("weak"))
        seen = seen.unionByName(front)
    return seen.drop("weak")


def two_cycles(edges: DataFrame) -> DataFrame:
    """(a, b) with a < b and edges both ways."""
    one = edges.filter("source < target").select(F.col("source").alias("a"), F.col("target").alias("b")).distinct()
    back = edges.filter("source > target").select(F.col("target").alias("a"), F.col("source").alias("b")).distinct()
    return one.join(back, ["a", "b"], "left_semi")


def three_cycles(edges: DataFrame) -> DataFrame:
    """(a, b, c): a -> b -> c -> a, rotated so that a is the smallest."""
    e = edges.filter("source <> target").select("source", "target").distinct()
    ab = e.filter("source < target").toDF("a", "b")
    bc = e.toDF("b", "c")
    ca = e.filter("source > target").toDF("c", "a")
    return ab.join(bc, "b").filter("c > a and c <> b").join(ca, ["c", "a"], "left_semi").select("a", "b", "c")


def ancestors(parents: DataFrame, depth: int) -> DataFrame:
    """(id, ancestor, distance) of parents(id, parent) up to `depth`."""
    now = parents.select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("distance"))
    out = now
    for d in range(2, depth + 1):
        now = now.select("id", F.col("ancestor").alias("__a")).join(parents.select(F.col("id").alias("__a"), F.col("parent").alias("ancestor")), "__a").select("id", "ancestor", F.lit(d).alias("distance"))
        out = out.unionByName(now)
    return out
