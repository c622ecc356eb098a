"""Edges: adjacency, bundles, routing, lifting to visible groups, ranks, focus."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.graph import whole
from stepweave.operators.chunks import chunked, running
from stepweave.session import materialize, size_by_rows


def adjacency(edges: DataFrame) -> DataFrame:
    """Edges per node and side, as rows: ``(graph_id, node_id, side, edge columns)``."""
    out = edges.withColumns({"node_id": F.col("src_id"), "side": F.lit("out")})
    return out.unionByName(edges.withColumns({"node_id": F.col("dst_id"), "side": F.lit("in")}))


def degrees(edges: DataFrame) -> DataFrame:
    return adjacency(edges).groupBy("graph_id", "node_id").agg(
        F.count_if(F.col("side") == "in").alias("n_in"), F.count_if(F.col("side") == "out").alias("n_out"))


# The widest offset, the offset of a single edge, and what each further parallel adds.
WIDEST, NARROWEST, PER_EDGE = 18.0, 7.0, 1.2


def edge_bundles(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """Index and size of each edge among its parallels, fan-out and fan-in, and the draw offset.

    Fans are counted by aggregation: a hub would otherwise be one window of its own.
    """
    edges = materialize(edges)  # read for the totals, the split points, the chunks and their sums
    total = materialize(edges.groupBy("graph_id", "src_id", "dst_id").agg(F.count(F.lit(1)).alias("bundle_total")))
    fan_out = total.groupBy("graph_id", "src_id").agg(F.sum("bundle_total").alias("source_fanout"))
    fan_in = total.groupBy("graph_id", "dst_id").agg(F.sum("bundle_total").alias("target_fanin"))
    # one row per pair, written so that its size is known: edges between few nodes are not dealt by these nodes again
    pairs = materialize(total.join(fan_out, ["graph_id", "src_id"]).join(fan_in, ["graph_id", "dst_id"]))
    spread = F.greatest("source_fanout", "target_fanin", "bundle_total")
    base = F.when(F.col("bundle_total") <= 1, F.lit(0.0)).otherwise(
        F.col("bundle_index") - (F.col("bundle_total") - 1) / 2)
    one = chunked(edges.withColumn("_one", F.lit(1)), ["graph_id", "src_id", "dst_id"], "edge_ord", rows)
    numbered = running(one, ["edge_ord"], {"bundle_index": "_one"}, "sum").frame
    return (
        numbered.withColumn("bundle_index", F.col("bundle_index") - 1).drop("_one", "chunk")
        .join(pairs, ["graph_id", "src_id", "dst_id"])
        .withColumn("bundle_offset", base * F.least(F.lit(WIDEST), F.lit(NARROWEST) + spread * F.lit(PER_EDGE)))
    )


def route_edges(edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges between known end points, violations).

    ``ids`` has one row per node id: ``is_point`` for end points, ``is_seen`` for what was at least serialized.
    Containment edges drop out.  An edge with an unknown end drops out when that end was at
    least serialized or the edge carries flows; otherwise it is a violation.  The first edge of
    each pair stays (see :func:`with_endpoints`).  Edges meet flags only: they pass the joins with a few bytes each.
    """
    e = edges.filter(~F.coalesce("is_containment", F.lit(False))).select("graph_id", "src_id", "dst_id", "edge_ord", "has_flows")
    for side in ("src", "dst"):
        flags = ids.select("graph_id", F.col("node_id").alias(f"{side}_id"), F.col("is_point").alias(f"_{side}_point"), F.col("is_seen").alias(f"_{side}_seen"))
        e = e.join(flags, ["graph_id", f"{side}_id"], "left")
    point = lambda side: F.coalesce(f"_{side}_point", F.lit(False))
    excused = lambda side: F.coalesce(f"_{side}_seen", F.lit(False)) | F.col("has_flows")
    bad = (
        F.when(~point("src"), F.when(~excused("src"), F.col("src_id")))
        .when(~point("dst") & ~excused("dst"), F.col("dst_id")))
    violations = e.withColumn("node_id", bad).filter("node_id is not null").select(
        "graph_id", F.lit("edge end not in node index").alias("rule"), "node_id")
    first = e.filter(point("src") & point("dst")).groupBy("graph_id", "src_id", "dst_id").agg(F.min("edge_ord").alias("edge_ord"))
    return first, violations


def with_endpoints(routed: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Routed edges with one end point of each id attached, as ``src_node`` and ``dst_node``."""
    one = endpoints.groupBy("graph_id", "node_id").agg(F.first(F.struct("attr_name", "class_name", "call_loc")).alias("_node"))
    for side in ("src", "dst"):
        routed = routed.join(one.select("graph_id", F.col("node_id").alias(f"{side}_id"), F.col("_node").alias(f"{side}_node")), ["graph_id", f"{side}_id"])
    return routed


# ---------------------------------------------------------------- lifting

def collapsed_by_default(groups: DataFrame) -> DataFrame:
    """Groups at depth 2 and below, native ones and synthetic ones start collapsed."""
    flag = (
        (F.col("depth") >= 2) | F.coalesce("is_native", F.lit(False))
        | F.coalesce(F.col("synthetic_type").isin("function_group", "callloc_group"), F.lit(False)))
    return groups.withColumn("collapsed", flag)


def lift_to_collapsed(edges: DataFrame, closure: DataFrame, collapsed: DataFrame) -> DataFrame:
    """Edges between the outermost collapsed groups of their ends, with how many each stands for."""
    shut = collapsed.filter("collapsed").select("graph_id", F.col("node_id").alias("ancestor_id"))
    outer = closure.join(shut, ["graph_id", "ancestor_id"], "left_semi").groupBy("graph_id", "node_id").agg(
        F.max_by("ancestor_id", "dist").alias("_to"))
    # Sum parallel edges before the joins.
    e = edges.groupBy("graph_id", "src_id", "dst_id").agg(F.count(F.lit(1)).alias("_n"))
    for side in ("src", "dst"):
        to = outer.select("graph_id", F.col("node_id").alias(f"{side}_id"), F.col("_to").alias(f"_{side}"))
        e = e.join(to, ["graph_id", f"{side}_id"], "left").withColumn(f"_{side}", F.coalesce(f"_{side}", f"{side}_id"))
    return e.filter("_src <> _dst").groupBy(
        "graph_id", F.col("_src").alias("src_id"), F.col("_dst").alias("dst_id")).agg(F.sum("_n").alias("n_edges"))


def lift_to_siblings(edges: DataFrame, members: DataFrame, closure: DataFrame) -> DataFrame:
    """For every group, the distinct edges between its children that carry data between them."""
    self_or_above = closure.select("graph_id", "node_id", F.col("ancestor_id").alias("child_id")).unionByName(
        members.select("graph_id", F.col("child_id").alias("node_id"), "child_id").distinct())
    under = members.select("graph_id", F.col("parent_id").alias("group_id"), "child_id").join(
        self_or_above, ["graph_id", "child_id"])
    side = lambda s: under.select("graph_id", "group_id", F.col("node_id").alias(f"{s}_id"), F.col("child_id").alias(f"{s}_child"))
    return (
        edges.select("graph_id", "src_id", "dst_id").distinct()
        .join(side("src"), ["graph_id", "src_id"]).join(side("dst"), ["graph_id", "group_id", "dst_id"])
        .filter("src_child <> dst_child").select("graph_id", "group_id", "src_child", "dst_child").distinct()
    )


# ---------------------------------------------------------------- ranks

#: Rows (nodes and edges) of a graph that one task ranks in memory; larger graphs go in rounds over all of Spark.
GRAPH_ROWS = 500_000


def _levels(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Longest path to each of ``n`` nodes; -1 on and behind cycles."""
    rank = np.full(n, -1, np.int64)
    waits = np.bincount(dst, minlength=n)
    by_src = np.argsort(src, kind="stable")
    to, start = dst[by_src], np.searchsorted(src[by_src], np.arange(n + 1))
    ready, level = np.flatnonzero(waits == 0), 0
    while len(ready):
        rank[ready] = level
        size = start[ready + 1] - start[ready]
        met = to[np.repeat(start[ready] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        np.subtract.at(waits, met, 1)
        ready, level = np.unique(met[waits[met] == 0]), level + 1
    return rank


def _ranked_graphs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ranks of whole graphs; rows come graph by graph, nodes with a NULL ``to_id``, edges with a NULL ``ord``.

    All graphs that end in a batch are ranked together; ``rank`` is NULL for the nodes of a graph with a cycle.
    """
    def solved(rows: pd.DataFrame) -> pd.DataFrame:
        is_node = rows["to_id"].isna().to_numpy()
        nodes, edges = rows[is_node].reset_index(drop=True), rows[~is_node]
        place = pd.Series(np.arange(len(nodes)), index=pd.MultiIndex.from_frame(nodes[["graph_id", "node_id"]]))
        at = lambda c: place.reindex(pd.MultiIndex.from_arrays([edges["graph_id"], edges[c].astype(nodes["node_id"].dtype)])).to_numpy(dtype="float64", na_value=-1)
        src, dst = (at(c).astype(np.int64) if len(edges) else np.empty(0, np.int64) for c in ("node_id", "to_id"))
        known = (src >= 0) & (dst >= 0)
        rank = _levels(len(nodes), src[known], dst[known])
        cyclic = nodes["graph_id"].isin(nodes["graph_id"][rank < 0].unique())
        return nodes[["graph_id", "node_id", "ord"]].assign(rank=pd.array(rank, dtype="Int64")).assign(rank=lambda d: d["rank"].mask(cyclic))

    held: list[pd.DataFrame] = []
    for batch in batches:
        last = (batch["graph_id"] != batch["graph_id"].iloc[-1]).to_numpy() if len(batch) else np.empty(0, bool)
        if not last.any():
            if held and len(batch) and held[-1]["graph_id"].iloc[-1] != batch["graph_id"].iloc[0]:
                yield solved(pd.concat(held))
                held = []
            if len(batch):
                held.append(batch)
            continue
        yield solved(pd.concat([*held, batch[last]]))
        held = [batch[~last]]
    if held:
        yield solved(pd.concat(held))


def longest_path_ranks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(graph_id, node_id, rank, in_cycle)``: longest path from a node without predecessors.

    Graphs of up to ``GRAPH_ROWS`` rows without a cycle are ranked in memory, many to a task; the others take the way over rounds (see
    :func:`ranks_in_rounds`), which has no bound.
    """
    nodes, edges = nodes.select("graph_id", "node_id", "ord"), edges.select("graph_id", "src_id", "dst_id").filter("src_id <> dst_id").distinct()
    to = F.lit(None).cast(dict(edges.dtypes)["dst_id"]).alias("to_id")
    rows = nodes.select("graph_id", "node_id", "ord", to).unionByName(
        edges.select("graph_id", F.col("src_id").alias("node_id"), F.lit(None).cast(dict(nodes.dtypes)["ord"]).alias("ord"), F.col("dst_id").alias("to_id")))
    size_by_rows(rows)
    rows = materialize(rows)
    large = materialize(rows.groupBy("graph_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > GRAPH_ROWS).select("graph_id"))
    small = rows if large.isEmpty() else rows.join(large, "graph_id", "left_anti")
    kinds = dict(rows.dtypes)
    near = small.repartition("graph_id").sortWithinPartitions("graph_id")
    known = materialize(near.mapInPandas(_ranked_graphs, f"graph_id {kinds['graph_id']}, node_id {kinds['node_id']}, ord {kinds['ord']}, rank long"))
    done = known.filter("rank is not null").select("graph_id", "node_id", "rank", F.lit(False).alias("in_cycle"))
    open_ = materialize(known.filter("rank is null").select("graph_id").distinct().unionByName(large))
    if open_.isEmpty():
        return done
    left = rows.join(open_, "graph_id", "left_semi")
    return done.unionByName(ranks_in_rounds(left.filter("to_id is null").select("graph_id", "node_id", "ord"),
                                            left.filter("to_id is not null").select("graph_id", F.col("node_id").alias("src_id"), F.col("to_id").alias("dst_id"))))


def ranks_in_rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """As :func:`longest_path_ranks`, for graphs of any size.

    Every round takes off the nodes whose predecessors are all ranked, in all graphs at once;
    what is left shrinks each time.  Nodes on a cycle, or between cycles, are never taken off: they get
    the largest known predecessor rank plus one, or else their list position.  Nodes behind them rank after all their
    predecessors.  ``in_cycle`` marks both.
    """
    edges = materialize(edges.select("graph_id", "src_id", "dst_id").filter("src_id <> dst_id").distinct())
    waits = edges.groupBy("graph_id", F.col("dst_id").alias("node_id")).agg(F.count(F.lit(1)).alias("_waits"))
    left = materialize(nodes.select("graph_id", "node_id", "ord").join(waits, ["graph_id", "node_id"], "left").withColumn(
        "_waits", F.coalesce("_waits", F.lit(0).cast("bigint"))))
    ranked, rank = [], 0
    while True:
        ready = left.filter("_waits = 0").select("graph_id", "node_id", F.lit(rank).cast("bigint").alias("rank"))
        if ready.isEmpty():
            break
        ranked.append(ready)
        if len(ranked) > 16:  # keep the plan short on deep graphs
            ranked = [materialize(reduce(DataFrame.unionByName, ranked))]
        met = ready.select("graph_id", F.col("node_id").alias("src_id")).join(edges, ["graph_id", "src_id"]).groupBy(
            "graph_id", F.col("dst_id").alias("node_id")).agg(F.count(F.lit(1)).alias("_met"))
        left = materialize(left.filter("_waits > 0").join(met, ["graph_id", "node_id"], "left").select(
            "graph_id", "node_id", "ord", (F.col("_waits") - F.coalesce("_met", F.lit(0))).alias("_waits")))
        rank += 1
    none = left.select("graph_id", "node_id", F.lit(0).cast("bigint").alias("rank")).limit(0)
    done = reduce(DataFrame.unionByName, ranked, none)
    done = done.withColumn("in_cycle", F.lit(False))
    return done if left.isEmpty() else _ranks_past_cycles(left, edges, done)


def _ranks_past_cycles(stuck: DataFrame, edges: DataFrame, done: DataFrame) -> DataFrame:
    """Ranks of the nodes on or behind a cycle, added to ``done``."""
    key = ["graph_id", "node_id"]
    onward = edges.select("graph_id", F.col("src_id").alias("node_id"), F.col("dst_id").alias("to_id"))
    core = stuck
    while True:  # take off what leads to nothing in the core
        inside = core.select("graph_id", F.col("node_id").alias("to_id"))
        less = materialize(core.join(onward.join(inside, ["graph_id", "to_id"], "left_semi"), key, "left_semi"))
        if core.join(less, key, "left_anti").isEmpty():
            break
        core = less

    def after(known: DataFrame) -> DataFrame:
        return edges.join(known.select("graph_id", F.col("node_id").alias("src_id"), "rank"), ["graph_id", "src_id"]).groupBy(
            "graph_id", F.col("dst_id").alias("node_id")).agg((F.max("rank") + 1).alias("_after"))

    ranked = lambda rows, known: rows.join(after(known), key, "left").select(
        "graph_id", "node_id", F.coalesce("_after", "ord").alias("rank"), F.lit(True).alias("in_cycle"))
    known = materialize(done.unionByName(ranked(core, done)))
    rest = materialize(stuck.join(core, key, "left_anti"))
    while not rest.isEmpty():
        waiting = onward.join(rest.select(*key), key, "left_semi").select("graph_id", F.col("to_id").alias("node_id")).distinct()
        ready = rest.join(waiting, key, "left_anti")
        known = materialize(known.unionByName(ranked(ready, known)))
        rest = materialize(rest.join(waiting, key, "left_semi"))
    return known


# ---------------------------------------------------------------- focus

def _focus_sets(table: pa.Table) -> dict:
    ids = whole.Ids(table, "node_id", "src_id", "dst_id", "ancestor_id")
    of = lambda name, *columns: [ids.of[c][(pc.equal(table["_table"], name)).to_numpy()] for c in columns]
    (focus,), (src, dst), (low, high), (io,) = of("focus", "node_id"), of("edges", "src_id", "dst_id"), of("closure", "node_id", "ancestor_id"), of("io", "node_id")
    f, inner = ids.matches(focus, high)
    within, inside = np.concatenate([focus, focus[f]]), np.concatenate([focus, low[inner]])
    w, end = ids.matches(inside, np.concatenate([src, dst]))
    f, e = whole.distinct_pairs(within[w], end % max(len(src), 1))
    src, dst = src[e], dst[e]
    src_io, dst_io = (np.isin(x, io) & ids.known(x) for x in (src, dst))
    either = src_io | dst_io
    picked = lambda of_src, of_dst: (np.concatenate([f[of_src], f[of_dst]]), np.concatenate([src[of_src], dst[of_dst]]))
    shown, climb = picked(~either | src_io, ~either | dst_io), picked(~src_io, ~either | src_io)
    start, node = whole.distinct_pairs(np.concatenate([climb[0], focus]), np.concatenate([climb[1], focus]))
    n, up = ids.matches(node, low)
    at, node = whole.distinct_pairs(np.concatenate([shown[0], start[n], focus]), np.concatenate([shown[1], high[up], focus]))
    return {"graph_id": ids.graph_of(at), "focus_id": ids.name(at), "node_id": ids.name(node)}


def focus_sets(focus: DataFrame, edges: DataFrame, closure: DataFrame, io_nodes: DataFrame) -> DataFrame:
    """Nodes to highlight around each focused node: ``(graph_id, focus_id, node_id)``.

    Edges that touch the focused node, or anything inside it, bring in their ends and the
    groups around them; an input or output end brings in only the groups of its peer.
    Small graphs are done in the task they are dealt to, the others by joins (see :func:`focus_sets_by_joins`).
    """
    focus, edges, closure, io_nodes = (t.select("graph_id", *columns) for t, columns in (
        (focus, ["node_id"]), (edges, ["src_id", "dst_id"]), (closure, ["node_id", "ancestor_id"]), (io_nodes, ["node_id"])))
    kinds = dict(focus.dtypes)
    if len({t for df in (focus, edges, closure, io_nodes) for c, t in df.dtypes if c != "graph_id"}) > 1:
        return focus_sets_by_joins(focus, edges, closure, io_nodes)
    done, left = whole.in_tasks({"focus": focus, "edges": edges, "closure": closure, "io": io_nodes}, _focus_sets,
                                f"graph_id {kinds['graph_id']}, focus_id {kinds['node_id']}, node_id {kinds['node_id']}")
    done = done.unionByName(focus.filter("graph_id is null").select("graph_id", F.col("node_id").alias("focus_id"), "node_id").distinct())
    if left.isEmpty():
        return done
    return done.unionByName(focus_sets_by_joins(*[t.join(left, "graph_id", "left_semi") for t in (focus, edges, closure, io_nodes)]))


def focus_sets_by_joins(focus: DataFrame, edges: DataFrame, closure: DataFrame, io_nodes: DataFrame) -> DataFrame:
    """As :func:`focus_sets`, for graphs of any size."""
    io = io_nodes.select("graph_id", F.col("node_id").alias("_io")).distinct()
    within = focus.select("graph_id", F.col("node_id").alias("focus_id"), "node_id").unionByName(
        focus.withColumnRenamed("node_id", "focus_id").join(
            closure.withColumnRenamed("ancestor_id", "focus_id"), ["graph_id", "focus_id"]).select("graph_id", "focus_id", "node_id"))
    touched = within.join(edges.withColumn("node_id", F.explode(F.array("src_id", "dst_id"))).select(
        "graph_id", "node_id", "src_id", "dst_id"), ["graph_id", "node_id"]).select(
        "graph_id", "focus_id", "src_id", "dst_id").distinct()
    for side in ("src", "dst"):
        touched = touched.join(io.select("graph_id", F.col("_io").alias(f"{side}_id"), F.lit(True).alias(f"_{side}_io")),
                               ["graph_id", f"{side}_id"], "left").withColumn(f"_{side}_io", F.coalesce(f"_{side}_io", F.lit(False)))
    either = F.col("_src_io") | F.col("_dst_io")
    ends = F.when(~either, F.array("src_id", "dst_id")).otherwise(F.array_compact(F.array(
        F.when(F.col("_src_io"), F.col("src_id")), F.when(F.col("_dst_io"), F.col("dst_id")))))
    climbers = F.when(~either, F.array("src_id", "dst_id")).when(F.col("_src_io"), F.array("dst_id")).otherwise(F.array("src_id"))
    shown = touched.select("graph_id", "focus_id", F.explode(ends).alias("node_id"))
    climb = touched.select("graph_id", "focus_id", F.explode(climbers).alias("node_id")).unionByName(
        focus.select("graph_id", F.col("node_id").alias("focus_id"), "node_id")).distinct()
    groups = climb.join(closure, ["graph_id", "node_id"]).select("graph_id", "focus_id", F.col("ancestor_id").alias("node_id"))
    own = focus.select("graph_id", F.col("node_id").alias("focus_id"), "node_id")
    return shown.unionByName(groups).unionByName(own).distinct()
