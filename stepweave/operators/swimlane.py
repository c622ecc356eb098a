"""Module calls of one step laid out in lanes: filtering, packing, hot names, who calls whom."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.functions.labels import is_wrapper, module_label, percent
from stepweave.operators.chunks import Chunked, chunked, running
from stepweave.operators.device import top
from stepweave.operators.intervals import clip_to_window
from stepweave.operators.nesting import OUTER_FIRST, enclosing_events
from stepweave.operators.trace_dims import choose_step, process_labels, thread_names
from stepweave.plans.tables import TraceTables
from stepweave.schema import THREAD_KEY
from stepweave.session import materialize

LANE = list(THREAD_KEY)

# Share of the median duration left free between events of a track, and its limits.
GAP_SHARE, GAP_MIN_NS, GAP_MAX_NS = 0.1, 20_000, 500_000


def module_events(events: DataFrame, include_all: bool = False, min_dur_ns: int = 0) -> DataFrame:
    """Module calls with a clean name; only runtime wrappers unless ``include_all``."""
    out = events.filter(F.col("cat") == "python_function").select(
        *LANE, "idx", module_label(F.col("name")).alias("name"), "ts_ns",
        F.coalesce("dur_ns", F.lit(0).cast("bigint")).alias("dur_ns"), "call_from", "py_id", "py_parent_id"
    ).filter("name is not null")
    if not include_all:
        out = out.filter(is_wrapper(F.col("name")))
    return out.filter(F.col("dur_ns") >= min_dur_ns) if min_dur_ns else out


def in_step(calls: DataFrame, step: DataFrame) -> DataFrame:
    """Calls cut to the chosen step of their trace."""
    window = step.select("trace_id", F.col("ts_ns").alias("_w0"), F.col("end_ns").alias("_w1"))
    return clip_to_window(calls.join(window, "trace_id"), F.col("_w0"), F.col("_w1")).drop("_w0", "_w1")


def lane_gaps(calls: DataFrame, rows: int | None = None) -> DataFrame:
    """Free time to keep after an event, per lane, from its upper median duration.

    The median is read off the running count over distinct durations.
    """
    counts = calls.groupBy(*LANE, "dur_ns").agg(F.count(F.lit(1)).alias("_n"))
    c = running(chunked(counts, LANE, "dur_ns", rows), ["dur_ns"], {"_upto": "_n"}, "sum")
    size = counts.groupBy(*LANE).agg(F.sum("_n").alias("_size"))
    median = c.frame.join(size, LANE).filter(F.expr("_upto > _size div 2")).groupBy(*LANE).agg(
        F.min("dur_ns").alias("_med"))
    gap = F.greatest(F.lit(float(GAP_MIN_NS)), F.least(F.col("_med") * F.lit(GAP_SHARE), F.lit(float(GAP_MAX_NS))))
    return median.select(*LANE, gap.alias("gap_ns"))


def _first_fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """First track whose last event ended at least a gap ago; batches arrive sorted."""
    group, ends = None, []
    for batch in batches:
        if batch.empty:
            continue
        rows = []
        for key, ts, dur, gap in zip(
            zip(*[batch[c] for c in [*LANE, "island"]]), batch["ts_ns"].tolist(), batch["dur_ns"].tolist(), batch["gap_ns"].tolist()
        ):
            if key != group:
                group, ends = key, []
            row = next((i for i, end in enumerate(ends) if ts - end >= gap), len(ends))
            if row == len(ends):
                ends.append(0)
            ends[row] = ts + dur
            rows.append(row)
        out = batch[[*LANE, "idx"]].copy()
        out["sub_row"] = rows
        yield out


def pack_lanes(calls: DataFrame, rows: int | None = None) -> DataFrame:
    """``(trace_id, pid, tid, idx, sub_row)``: first free track of the lane for each call.

    A call that starts when every track is free starts an island; nothing before it matters.
    Islands are packed independently of each other, each as a sorted stream.
    """
    spaced = calls.select(*LANE, "idx", "ts_ns", "dur_ns", (-F.col("dur_ns")).alias("_minus_dur"),
                          (F.col("ts_ns") + F.col("dur_ns")).alias("_end")).join(lane_gaps(calls, rows), LANE)
    order = ["ts_ns", "_minus_dur", "idx"]
    c = running(chunked(spaced, LANE, "ts_ns", rows), order, {"_reach": "_end"}, "max", before=True)
    opens = F.col("_reach").isNull() | (F.col("ts_ns") - F.col("_reach") >= F.col("gap_ns"))
    c = Chunked(c.frame.withColumn("_open", F.when(opens, F.col("ts_ns"))), c.keys, c.split)
    islands = running(c, order, {"island": "_open"}, "max").frame.select(
        *LANE, "island", *order, "dur_ns", "gap_ns")
    types = dict(calls.dtypes)
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in LANE], "idx bigint", "sub_row bigint"])
    return islands.repartition(*LANE, "island").sortWithinPartitions(*LANE, "island", *order).mapInPandas(_first_fit, schema)


def module_stats(calls: DataFrame) -> DataFrame:
    return calls.groupBy("trace_id", "name").agg(F.sum("dur_ns").alias("dur_ns"), F.count(F.lit(1)).alias("n_calls"))


def module_thread_counts(calls: DataFrame) -> DataFrame:
    return calls.groupBy("trace_id", "name", "tid").agg(F.count(F.lit(1)).alias("n_calls"))


def hot_modules(calls: DataFrame, step: DataFrame, top_k: int = 8) -> DataFrame:
    """Longest module names of the step with their share of it."""
    hot = top(module_stats(calls), ["trace_id"], [F.col("dur_ns").desc(), F.col("name")], top_k)
    length = step.select("trace_id", F.col("dur_ns").alias("_step"))
    return hot.join(length, "trace_id").select(
        "trace_id", "rank", "name", "dur_ns", "n_calls",
        F.coalesce(percent(F.col("dur_ns"), F.col("_step")), F.lit(0.0)).alias("step_pct"))


def call_edges(calls: DataFrame, rows: int | None = None) -> DataFrame:
    """Caller -> callee counts between differently named modules.

    Python ids link caller and callee; the last event with an id owns it.  A trace without
    a single such link falls back to nesting on the same thread.
    """
    owners = calls.filter("py_id is not null").groupBy("trace_id", F.col("py_id").alias("py_parent_id")).agg(
        F.max_by("name", "idx").alias("source"))
    linked = calls.select("trace_id", "py_parent_id", F.col("name").alias("target")).join(
        owners, ["trace_id", "py_parent_id"]).filter("source <> target")
    direct = linked.groupBy("trace_id", "source", "target").agg(F.count(F.lit(1)).alias("n_calls"))
    direct = materialize(direct)
    rest = calls.join(direct.select("trace_id").distinct(), "trace_id", "left_anti")
    inside = enclosing_events(rest.withColumn("cat", F.lit("module")), closed=False, order=OUTER_FIRST, rows=rows)
    names = rest.select("trace_id", F.col("idx").alias("parent_idx"), F.col("name").alias("source"))
    nested = (
        inside.filter("parent_idx is not null").join(names, ["trace_id", "parent_idx"])
        .join(rest.select("trace_id", "idx", F.col("name").alias("target")), ["trace_id", "idx"])
        .filter("source <> target").groupBy("trace_id", "source", "target").agg(F.count(F.lit(1)).alias("n_calls"))
    )
    return direct.unionByName(nested)


def top_call_edges(edges: DataFrame, k: int = 15) -> DataFrame:
    return top(edges, ["trace_id"], [F.col("n_calls").desc(), F.col("source"), F.col("target")], k)


class Swimlane:
    """The calls of one step per trace and the tables drawn from them."""

    def __init__(self, t: TraceTables, step: int | None = None, top_k: int = 8, min_dur_ns: int = 0,
                 include_all: bool = False):
        self.events = t.events
        self.top_k = top_k
        self.step = materialize(choose_step(t.steps, step))
        self.calls = materialize(in_step(module_events(t.events, include_all, min_dur_ns), self.step))

    def hot(self) -> DataFrame:
        return hot_modules(self.calls, self.step, self.top_k)

    def lane_events(self) -> DataFrame:
        """Calls relative to the step start, with their track and a hot flag."""
        hot = self.hot().select("trace_id", "name", F.lit(True).alias("_hot"))
        start = self.step.select("trace_id", F.col("ts_ns").alias("_start"))
        return (
            self.calls.join(pack_lanes(self.calls), [*LANE, "idx"]).join(start, "trace_id")
            .join(hot, ["trace_id", "name"], "left")
            .select(*LANE, "idx", "name", (F.col("ts_ns") - F.col("_start")).alias("rel_ns"), "dur_ns", "sub_row",
                    F.coalesce("_hot", F.lit(False)).alias("hot"), "call_from")
        )

    def lanes(self) -> DataFrame:
        """One row per thread: label, names, number of calls and of tracks."""
        packed = pack_lanes(self.calls).groupBy(*LANE).agg(
            F.count(F.lit(1)).alias("n_calls"), (F.max("sub_row") + 1).alias("n_sub_rows"))
        label = F.concat(F.when(F.col("tid") == F.col("pid"), "[MAIN] ").otherwise(""), F.lit("thread "), F.col("tid"))
        fallback = F.concat(F.lit("pid="), F.col("pid"), F.lit(" tid="), F.col("tid"))
        return (
            packed.join(thread_names(self.events), LANE, "left")
            .join(process_labels(self.events).drop("first_idx"), ["trace_id", "pid"], "left")
            .select(*LANE, label.alias("label"), F.coalesce("thread_name", fallback).alias("thread_name"),
                    F.coalesce("label", F.lit("")).alias("process_label"), "n_calls", "n_sub_rows")
        )

    def edges(self) -> DataFrame:
        return top_call_edges(call_edges(self.calls))
