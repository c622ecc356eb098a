"""Grouping of scope members: floating operators into containers, helpers, call-site runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.graph.edges import longest_path_ranks
from stepweave.operators.chunks import Chunked, chunked, previous_row, running
from stepweave.session import materialize, size_by_rows


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge seen from both ends: ``(graph_id, node_id, peer_id)``."""
    ends = F.array(F.struct(F.col("src_id").alias("node_id"), F.col("dst_id").alias("peer_id")),
                   F.struct(F.col("dst_id").alias("node_id"), F.col("src_id").alias("peer_id")))
    return edges.select("graph_id", F.explode(ends).alias("e")).select("graph_id", "e.*").distinct()


def _smallest_reached(keys: list[str]):
    """Within a batch of links ``(*keys, a, b)``: the smallest node that each one reaches."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for links in batches:
            n = len(links)
            graph = links.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
            codes, ids = pd.factorize(np.concatenate([links["a"].to_numpy(), links["b"].to_numpy()]), sort=True)
            names, first, place = np.unique(np.concatenate([graph, graph]) * np.int64(len(ids) + 1) + codes, return_index=True, return_inverse=True)
            a, b = place[:n], place[n:]  # within a graph, places rise with ids
            root = np.arange(len(names))
            while True:
                low = np.minimum(root[a], root[b])
                if (root[a] == low).all() and (root[b] == low).all():
                    break
                for end in (a, b):
                    np.minimum.at(root, root[end], low)
                    np.minimum.at(root, end, low)
                root = root[root]
            name = ids[codes[first]]
            out = links[keys].iloc[first % n].reset_index(drop=True).assign(a=name, b=name[root])
            yield out[out["a"] != out["b"]]

    return run


def contracted(links: DataFrame, keys: list[str]) -> DataFrame:
    """Links ``(*keys, a, b)`` replaced by stars: per batch, each node with the smallest node it reaches there.

    Graphs lie together and most fit in a batch, so that nothing of them is left to do; a large one loses all links but
    one per node and batch.
    """
    numeric = dict(links.dtypes)["a"] in ("bigint", "int")
    stretch = [F.expr("a div 65536")] if numeric else []  # a large graph goes to many tasks, by stretches of its ids
    near = links.select(*keys, "a", "b").repartition(*keys, *stretch).sortWithinPartitions(*keys)
    kinds = ", ".join(f"{c} {t}" for c, t in near.dtypes)
    return near.mapInPandas(_smallest_reached(keys), kinds)


def components(nodes: DataFrame, links: DataFrame, keys: tuple[str, ...] = ("graph_id",)) -> DataFrame:
    """Connected components as ``(*keys, node_id, component)``, named by the smallest id.

    Links are contracted within batches first.  After that each round hangs every component below its smallest
    neighbour, follows that one step further, and goes on with the links that still join different components.
    Graphs that are done drop out, and the node table is read once, at the end.
    """
    keys = list(keys)
    size_by_rows(nodes)
    star = materialize(contracted(links.select(*keys, F.col("node_id").alias("a"), F.col("peer_id").alias("b")).filter("a < b"), keys))
    # what one batch settled is settled, unless a node has another root, or its root is below a root of its own
    up = star.groupBy(*keys, "a").agg(F.min("b").alias("to"), F.max("b").alias("_other"))
    below = up.select(*keys, F.col("a").alias("to"), F.lit(True).alias("_goes_on"))
    up = materialize(up.join(below, [*keys, "to"], "left"))
    torn = materialize(up.filter("to <> _other or _goes_on").select(*keys).distinct())
    steps = [up.select(*keys, "a", "to")]
    if not torn.isEmpty():
        ends = [star.join(torn, keys, "left_semi").select(*keys, "a", "b"), star.join(torn, keys, "left_semi").select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))]
        open_ = materialize(ends[0].unionByName(ends[1]).distinct())
        steps = [up.join(torn, keys, "left_anti").select(*keys, "a", "to")]
        while not open_.isEmpty():
            near = materialize(open_.groupBy(*keys, "a").agg(F.min("b").alias("to")).filter("to < a"))
            hop = near.select(*keys, F.col("a").alias("to"), F.col("to").alias("_next"))
            step = materialize(near.join(hop, [*keys, "to"], "left").select(*keys, "a", F.coalesce("_next", "to").alias("to")))
            steps.append(step)
            for end in ("a", "b"):
                open_ = open_.join(step.select(*keys, F.col("a").alias(end), F.col("to").alias("_to")), [*keys, end], "left").withColumn(
                    end, F.coalesce("_to", end)).drop("_to")
            open_ = materialize(open_.select(*keys, "a", "b").filter("a <> b").distinct())
    labels = nodes.select(*keys, "node_id", F.col("node_id").alias("component"))
    for step in steps:
        labels = labels.join(step.withColumnRenamed("a", "component"), [*keys, "component"], "left").select(
            *keys, "node_id", F.coalesce("to", "component").alias("component"))
    return materialize(labels)


def innermost_containers(closure: DataFrame) -> DataFrame:
    """Container with the fewest descendants around each node."""
    sizes = closure.groupBy("graph_id", "ancestor_id").agg(F.count(F.lit(1)).alias("_n"))
    return closure.join(sizes, ["graph_id", "ancestor_id"]).groupBy("graph_id", "node_id").agg(
        F.min_by("ancestor_id", F.struct("_n", "dist", "ancestor_id")).alias("container_id"))


def floating_components(floating: DataFrame, edges: DataFrame, closure: DataFrame) -> DataFrame:
    """:func:`scope_fates` of graphs that are one scope each; ``closure`` has the containers around each node."""
    homes = innermost_containers(closure).withColumn("scope_id", F.lit(""))
    return scope_fates(floating.select("graph_id", F.lit("").alias("scope_id"), "node_id"), edges, homes).drop("scope_id")


def scope_fates(floating: DataFrame, edges: DataFrame, homes: DataFrame) -> DataFrame:
    """Floating nodes ``(graph_id, scope_id, node_id)`` with their component in the scope and the fate of it.

    ``homes``: the innermost container of the scope around a node, ``(graph_id, scope_id, node_id, container_id)``.

    A floating node cannot move into a container when it touches a node that is neither floating in its scope nor
    inside a container of its scope, and then none of the nodes it is connected to can either: the whole component is
    ``dropped``.  Otherwise a component whose outside neighbours all sit in one innermost container is ``absorbed`` by
    it; one without outside neighbours, or between several containers, ``stays``.
    """
    scope = ["graph_id", "scope_id"]
    floating = materialize(floating.select(*scope, "node_id").distinct())
    touching = floating.join(both_ways(edges), ["graph_id", "node_id"])
    peers = floating.select(*scope, F.col("node_id").alias("peer_id"), F.lit(True).alias("_floats"))
    home = homes.select(*scope, F.col("node_id").alias("peer_id"), "container_id")
    met = materialize(touching.join(peers, [*scope, "peer_id"], "left").join(home, [*scope, "peer_id"], "left"))
    labels = components(floating, met.filter("_floats"), scope)
    targets = met.filter("_floats is null").join(labels, [*scope, "node_id"]).groupBy(*scope, "component").agg(
        F.bool_or(F.col("container_id").isNull()).alias("_loose"), F.min("container_id").alias("_a"), F.max("container_id").alias("_b"))
    one = F.col("_a") == F.col("_b")
    fate = F.when(F.col("_loose"), "dropped").when(one, "absorbed").otherwise("stays")
    return labels.join(targets, [*scope, "component"], "left").select(
        *scope, "node_id", "component", fate.alias("fate"), F.when(~F.col("_loose") & one, F.col("_a")).alias("container_id"))


def surviving_nodes(fates: DataFrame) -> DataFrame:
    return fates.filter("fate <> 'dropped'").select("graph_id", "node_id")


# ---------------------------------------------------------------- synthetic groups

def is_plain() -> Column:
    """Functional operators and native modules may be grouped."""
    return (F.col("attr_kind") == "functional") | F.coalesce("is_native", F.lit(False))


def helper_frame(frames: Column) -> Column:
    """Frame right after the last ``forward``; NULL when that was entered through ``__call__``."""
    names = F.transform(frames, lambda f: f["function_name"])
    back = F.array_position(F.reverse(names), "forward")
    last = F.size(names) - back + 1  # 1-based position of the last "forward"
    entered = F.when(last > 1, F.element_at(names, (last - 1).cast("int")))
    helper = F.when((back > 1) & (F.coalesce(entered, F.lit("")) != "__call__"), F.get(frames, last.cast("int")))
    return F.when(F.coalesce(helper["function_name"], F.lit("")) != "__call__", helper)


def helper_groups(scoped: DataFrame) -> DataFrame:
    """Members of each helper function, where all of them are functional or native."""
    helper = helper_frame(F.col("call_loc")["frames"])
    rows = scoped.withColumn("_h", helper).filter("_h is not null").select(
        "graph_id", "scope_id", "node_id", "ord", F.col("_h.function_name").alias("group_name"),
        F.col("_h.file").alias("file"), F.col("_h.line").alias("line"), is_plain().alias("_plain"))
    groups = rows.groupBy("graph_id", "scope_id", "group_name").agg(
        F.bool_and("_plain").alias("_all"), F.count(F.lit(1)).alias("n_members"),
        F.min_by("node_id", "ord").alias("first_id"), F.min_by("file", "ord").alias("file"),
        F.min_by("line", "ord").alias("line"), F.min("ord").alias("ord"))
    return groups.filter("_all").drop("_all")


def call_site_runs(scoped: DataFrame, rows: int | None = None) -> DataFrame:
    """Maximal runs of at least two plain nodes with the same file and innermost function.

    ``scoped`` is in scope order by ``ord``.  A run that is the whole scope is no group.
    """
    key = ["graph_id", "scope_id"]
    frames = F.col("call_loc")["frames"]
    usable = is_plain() & F.col("call_loc").isNotNull() & (F.size(F.coalesce(frames, F.array().cast(
        "array<struct<file:string,line:bigint,function_name:string>>"))) > 0)
    site = F.when(usable, F.struct(F.col("call_loc")["file"].alias("file"), F.element_at(frames, -1)["function_name"].alias("func")))
    base = scoped.select(*key, "node_id", "ord", F.col("call_loc")["line"].alias("line"), site.alias("_site"))
    c = previous_row(chunked(base, key, "ord", rows), ["ord"], ["_site"], "_before")
    same = F.col("_site").isNotNull() & F.coalesce(F.col("_before")["_site"] == F.col("_site"), F.lit(False))
    c = Chunked(c.frame.withColumn("_start", F.when(~same, F.col("ord"))), c.keys, c.split)
    runs = running(c, ["ord"], {"_run": "_start"}, "max").frame
    sizes = scoped.groupBy(*key).agg(F.count(F.lit(1)).alias("_scope"))
    grouped = runs.filter("_site is not null").groupBy(*key, "_run").agg(
        F.count(F.lit(1)).alias("n_members"), F.min("line").alias("_lo"), F.max("line").alias("_hi"),
        F.min("_site.func").alias("_f"), F.min_by("node_id", "ord").alias("first_id"), F.max("ord").alias("last_ord"))
    return grouped.join(sizes, key).filter("n_members >= 2 and n_members < _scope").select(
        *key, F.format_string("%s:%d~%d", "_f", "_lo", "_hi").alias("group_name"), "first_id",
        F.col("_run").alias("ord"), "last_ord", "n_members")


def scope_order(scoped: DataFrame, edges: DataFrame) -> DataFrame:
    """Position key of each node: data-flow level first where plain and other nodes mix.

    Levels are longest paths inside the scope; scopes of one kind of node keep their list order.
    """
    mixed = scoped.groupBy("graph_id", "scope_id").agg(
        (F.bool_or(is_plain()) & F.bool_or(~is_plain())).alias("_mixed"))
    place = scoped.select("graph_id", "scope_id", "node_id")
    local = edges.select("graph_id", "src_id", "dst_id").join(
        place.withColumnRenamed("node_id", "src_id"), ["graph_id", "src_id"]).join(
        place.withColumnsRenamed({"node_id": "dst_id", "scope_id": "_s2"}), ["graph_id", "dst_id"]).filter("scope_id = _s2")
    level = longest_path_ranks(scoped.select("graph_id", "node_id", "ord"), local).select("graph_id", "node_id", "rank")
    return scoped.join(mixed, ["graph_id", "scope_id"]).join(level, ["graph_id", "node_id"]).withColumn(
        "level", F.when(F.col("_mixed"), F.col("rank")).otherwise(F.lit(0).cast("bigint"))).drop("rank", "_mixed")


def substitute_groups(scoped: DataFrame, grouped: DataFrame) -> DataFrame:
    """Scope lists with members replaced by their group at the place of the first member.

    ``grouped`` has graph_id, scope_id, node_id, group_id.
    """
    place = scoped.select("graph_id", "scope_id", "node_id", "ord").join(
        grouped, ["graph_id", "scope_id", "node_id"], "left")
    return place.groupBy("graph_id", "scope_id", F.coalesce("group_id", F.col("node_id").cast("string")).alias("item_id")).agg(
        F.min("ord").alias("ord"), F.count(F.lit(1)).alias("n_members"), F.bool_or(F.col("group_id").isNotNull()).alias("is_group"))


def induced_edges(edges: DataFrame, grouped: DataFrame) -> DataFrame:
    """Edges with both ends in the same group; the edges themselves do not change."""
    g = grouped.select("graph_id", "group_id", "node_id")
    return edges.join(g.withColumnRenamed("node_id", "src_id"), ["graph_id", "src_id"]).join(
        g.withColumnRenamed("node_id", "dst_id"), ["graph_id", "group_id", "dst_id"])
