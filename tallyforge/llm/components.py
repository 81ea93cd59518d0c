"""Connected components as rounds of joins; nothing is gathered anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import remove, settle


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of an edge (src, dst), of any type with an order; component: the smallest id.

    Each round, every node hooks onto the neighbour of least priority (itself
    included) and the graph is contracted along the hooks, until no edge is
    left. The first round's priority is the id, so stars around their smallest
    node end at once; later rounds take a fresh random order, so that chains
    shrink by a constant share too, whatever their ids. All edges of a hub
    combine before they are shuffled, and joins against the small hook table
    can be split where a hub is hot. Loops, repeated edges and edges with a
    null end are dropped; an empty table has no components. A round's tables
    are removed when the next one's are written.
    """
    spark = edges.sparkSession
    edges = settle(edges.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct(), "edges")
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    if edges.isEmpty():
        return edges.select(F.col("src").alias("id"), F.col("dst").alias("component"))
    labels, turn = None, 0
    while turn == 0 or not edges.isEmpty():
        both = edges.union(edges.select("dst", "src"))
        order = (lambda c: F.col(c)) if turn == 0 else (lambda c, k=turn: F.xxhash64(F.col(c), F.lit(k)))
        near = both.groupBy("src").agg(F.min(F.struct(order("dst").alias("p"), F.col("dst").alias("v"))).alias("near"))
        own = F.struct(order("src").alias("p"), F.col("src").alias("v"))
        hook = settle(near.select("src", F.least(own, "near").getField("v").alias("to")), "hooks")
        old = [] if turn == 0 else [edges.settled_at, hook.settled_at]
        if turn:  # one more step along the hooks
            hook = settle(hook.alias("a").join(hook.alias("b"), F.col("a.to") == F.col("b.src")).select("a.src", "b.to"), "hooks")
        if labels is None:
            labels, first = hook.select(F.col("src").alias("id"), F.col("to").alias("label")), hook.settled_at
        else:
            old.append(first if turn == 1 else labels.settled_at)
            labels = labels.join(hook, labels.label == hook.src, "left").select("id", F.coalesce("to", "label").alias("label"))
            labels = settle(labels, "labels")
        moved = edges.join(hook, "src").select(F.col("to").alias("a"), "dst").join(hook.select(F.col("src").alias("dst"), F.col("to").alias("b")), "dst")
        edges = settle(moved.where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(), "edges")
        for path in (*old, *([hook.settled_at] if turn else [])):
            remove(spark, path)
        turn += 1
    if turn == 1:  # hooks onto smaller ids without edges between them: the labels are the smallest ids
        return labels.select("id", F.col("label").alias("component"))
    least = settle(labels.groupBy("label").agg(F.min("id").alias("component")), "least")
    return nodes.join(labels, "id").join(least, "label").select("id", "component")
