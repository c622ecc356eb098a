"""Containment closure, container paths and bottom-up order."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.graph import whole
from stepweave.session import materialize, size_by_rows


def _closed(table: pa.Table) -> dict:
    ids = whole.Ids(table, "node_id", "ancestor_id")
    node, top, dist = ids.closed(ids.of["node_id"], ids.of["ancestor_id"])
    return {"graph_id": ids.graph_of(node), "node_id": ids.name(node), "ancestor_id": ids.name(top), "dist": pa.array(dist)}


def ancestors(members: DataFrame) -> DataFrame:
    """``(graph_id, node_id, ancestor_id, dist)`` for every container above every node, with the shortest distance.

    Small graphs are closed in the task they are dealt to, the others in rounds (see :func:`ancestors_in_rounds`).
    A node that is its own ancestor is part of a cycle.
    """
    size_by_rows(members)
    links = members.select("graph_id", F.col("child_id").alias("node_id"), F.col("parent_id").alias("ancestor_id"))
    kinds = dict(links.dtypes)
    if kinds["node_id"] != kinds["ancestor_id"]:
        return ancestors_in_rounds(members)
    done, left = whole.in_tasks({"links": links}, _closed, f"graph_id {kinds['graph_id']}, node_id {kinds['node_id']}, ancestor_id {kinds['ancestor_id']}, dist bigint")
    loose = materialize(links.filter("graph_id is null").distinct().withColumn("dist", F.lit(1).cast("bigint")))
    done = done if loose.isEmpty() else done.unionByName(loose)
    return done if left.isEmpty() else done.unionByName(ancestors_in_rounds(members.join(left, "graph_id", "left_semi")))


def ancestors_in_rounds(members: DataFrame) -> DataFrame:
    """As :func:`ancestors`, for graphs of any size.

    Each round doubles the distance covered, so a tree of depth d takes log2(d) rounds.
    Pairs that are known already are not added again, which ends the loop on cycles too;
    a node that is its own ancestor is part of one.
    """
    known = materialize(members.select(
        "graph_id", F.col("child_id").alias("node_id"), F.col("parent_id").alias("ancestor_id"),
        F.lit(1).cast("bigint").alias("dist")).distinct())
    parts, frontier = [known], known
    while True:
        upper = known.select("graph_id", F.col("node_id").alias("ancestor_id"),
                             F.col("ancestor_id").alias("_far"), F.col("dist").alias("_more"))
        longer = frontier.join(upper, ["graph_id", "ancestor_id"]).groupBy(
            "graph_id", "node_id", F.col("_far").alias("ancestor_id")).agg(F.min(F.col("dist") + F.col("_more")).alias("dist"))
        new = materialize(longer.join(known, ["graph_id", "node_id", "ancestor_id"], "left_anti"))
        if new.isEmpty():
            return known
        parts.append(new)
        known = reduce(DataFrame.unionByName, parts)
        reach = 2 ** (len(parts) - 1)
        frontier = new.filter(F.col("dist") == reach)
        if frontier.isEmpty():
            return known


def cyclic_nodes(closure: DataFrame) -> DataFrame:
    return closure.filter("node_id = ancestor_id").select("graph_id", "node_id")


def depths(nodes: DataFrame, closure: DataFrame) -> DataFrame:
    """Number of containers above each node."""
    n = closure.groupBy("graph_id", "node_id").agg(F.count(F.lit(1)).alias("depth"))
    return nodes.join(n, ["graph_id", "node_id"], "left").withColumn(
        "depth", F.coalesce("depth", F.lit(0).cast("bigint")))


def bottom_up(nodes: DataFrame, closure: DataFrame) -> DataFrame:
    """Deeper nodes first: every node comes after all it contains.

    ``visit`` is a pair to sort by (minus depth, then position), not a global number, so no
    graph has to be numbered in one place.
    """
    return depths(nodes, closure).withColumn("visit", F.struct((-F.col("depth")).alias("level"), "ord"))


def container_paths(nodes: DataFrame, members: DataFrame, closure: DataFrame) -> DataFrame:
    """``root[key][key]`` for nodes inside containers, the plain name for the others.

    ``members`` has ``key``, the place of the child in its container.
    """
    keys = members.select("graph_id", F.col("child_id").alias("step_id"), "key")
    itself = nodes.select("graph_id", "node_id", F.col("node_id").alias("step_id"), F.lit(0).cast("bigint").alias("dist"))
    line = itself.unionByName(closure.select("graph_id", "node_id", F.col("ancestor_id").alias("step_id"), "dist"))
    names = nodes.select("graph_id", F.col("node_id").alias("step_id"), "attr_name")
    steps = line.join(keys, ["graph_id", "step_id"], "left").join(names, ["graph_id", "step_id"], "left")
    path = steps.groupBy("graph_id", "node_id").agg(
        F.max_by("attr_name", "dist").alias("_root"),
        F.array_sort(F.collect_list(F.when(F.col("key").isNotNull(), F.struct(
            (-F.col("dist")).alias("d"), F.concat(F.lit("["), F.col("key"), F.lit("]")).alias("k"))))).alias("_keys"))
    return path.select("graph_id", "node_id", F.concat("_root", F.array_join(F.transform("_keys", lambda k: k["k"]), "")).alias("display_name"))
