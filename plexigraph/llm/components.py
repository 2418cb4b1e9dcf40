"""Connected components by alternating large and small stars, on DataFrames only.

Ids are longs. Edges with a null end and loops say nothing and are left out; repeated edges and either
direction count once. An id without an edge isn't in the result. No edges give no rows. Other columns
are ignored. Ties don't arise: a component is named by its smallest id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plexigraph.llm._common import stash

EDGES = "a long, b long"
#: Contracted edges (16 bytes each) up to which one task labels them all; more go through rounds of stars.
ONE_TASK = 1_000_000


def label_least(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, least id that each reaches) of edges (a, b), in numpy."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while len(x):
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    while not (label[label] == label).all():
        label = label[label]
    return ids, ids[label]


def _forest(batches):
    """Per batch of edges, a star per component: fewer edges with the same reachability."""
    for batch in batches:
        ids, least = label_least(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        far = ids != least
        yield pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(least[far])], ["a", "b"])


def _labels(batches):
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if held:
        ids, least = label_least(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(least)], ["id", "component"])


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(id, component): for every id of an edge (a, b), the smallest id that it reaches.

    Edges are contracted to stars per batch first. What then has at most `one_task` edges, counted,
    is labelled by one executor task. Beyond that, rounds: each round ends in a written table, so lineage stays short and a lost executor costs one
    round. Sums of minima are formed on the map side; a hub is a hot key of joins that adaptive
    execution can split.
    """
    now = stash(edges.select("a", "b").filter("a <> b").mapInArrow(_forest, EDGES).filter("a > b").distinct(), "edges")
    if now.limit(one_task + 1).count() <= one_task:
        return stash(now.repartition(1).mapInArrow(_labels, "id long, component long"), "components")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        new = stash(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        seen = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if seen == mark or not seen[0]:
            break
        now, mark = new, seen
    return new.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(new.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
