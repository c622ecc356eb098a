"""Forward/backward flow arrows and the kernels they connect."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.functions.labels import is_backward_stack, runtime_module
from stepweave.operators.chunks import chunked, previous_row
from stepweave.operators.intervals import join_points_to_intervals, last_mark_at
from stepweave.operators.nesting import is_module_event
from stepweave.operators.stacks import distinct_stacks, kernel_stacks, stack_frames, user_frames
from stepweave.plans.tables import TraceTables
from stepweave.session import materialize


def flow_pairs(events: DataFrame) -> DataFrame:
    """Start and end of each flow id; the last row wins on each side and both are needed."""
    side = lambda ph, name: F.max_by(
        F.when(F.col("ph") == ph, F.struct("ts_ns", "tid")), F.when(F.col("ph") == ph, F.col("idx"))).alias(name)
    arrows = events.filter((F.col("cat") == "fwdbwd") & F.col("flow_id").isNotNull() & F.col("ph").isin("s", "f"))
    return (
        arrows.groupBy("trace_id", "flow_id").agg(side("s", "s"), side("f", "f"), F.min("idx").alias("first_idx"))
        .filter("s is not null and f is not null")
        .select("trace_id", "flow_id", F.col("s.ts_ns").alias("fwd_ts"), F.col("s.tid").alias("fwd_tid"),
                F.col("f.ts_ns").alias("bwd_ts"), F.col("f.tid").alias("bwd_tid"), "first_idx")
    )


def enclosing_op(points: DataFrame, events: DataFrame, at: str, tid: str, id_columns: Sequence[str]) -> DataFrame:
    """Shortest host operation on ``tid`` that contains the time (both ends included)."""
    ops = events.filter((F.col("cat") == "cpu_op") & F.col("dur_ns").isNotNull()).select(
        "trace_id", F.col("tid").alias(tid), F.col("idx").alias("op_idx"),
        F.col("ts_ns").alias("op_start"), (F.col("ts_ns") + F.col("dur_ns")).alias("op_end"))
    hits = join_points_to_intervals(
        points.select("trace_id", tid, at, *id_columns), ops, ["trace_id", tid], at, "op_start", "op_end", closed_end=True)
    shortest = F.struct((F.col("op_end") - F.col("op_start")).alias("d"), "op_start", "op_idx")
    return hits.groupBy("trace_id", *id_columns).agg(
        F.min_by(F.struct("op_idx", "op_start", "op_end"), shortest).alias("_o")).select("trace_id", *id_columns, "_o.*")


def backward_scopes(pairs: DataFrame, events: DataFrame, rows: int | None = None) -> DataFrame:
    """Time windows on backward threads, each owned by one flow.

    A flow owns its backward operation from its own arrow until the next arrow into the
    same operation, so windows of one operation do not overlap.
    """
    op = enclosing_op(pairs, events, "bwd_ts", "bwd_tid", ["flow_id"])
    owned = pairs.join(op, ["trace_id", "flow_id"]).withColumns(
        {"_minus_ts": -F.col("bwd_ts"), "_minus_first": -F.col("first_idx")})
    c = chunked(owned, ["trace_id", "bwd_tid", "op_idx"], "_minus_ts", rows)
    frame = previous_row(c, ["_minus_ts", "_minus_first"], ["bwd_ts"], "_next").frame
    return frame.select(
        "trace_id", "flow_id", "bwd_tid", "bwd_ts", "first_idx", "fwd_ts", "fwd_tid",
        F.col("bwd_ts").alias("scope_start"),
        F.coalesce("_next.bwd_ts", F.col("op_end") + 1).alias("scope_end"))


def forward_scope(kernels: DataFrame, pairs: DataFrame, events: DataFrame) -> DataFrame:
    """``(trace_id, idx, flow_id, fwd_tid, fwd_start, fwd_end)`` for kernels inside a backward scope.

    The latest flow wins; a kernel whose flow starts outside every host operation drops out.
    """
    scopes = backward_scopes(pairs, events).filter("scope_end > scope_start").withColumnRenamed("bwd_tid", "tid")
    hits = join_points_to_intervals(
        kernels.select("trace_id", "tid", "idx", "ts_ns"), scopes, ["trace_id", "tid"],
        "ts_ns", "scope_start", "scope_end", closed_end=False)
    latest = hits.groupBy("trace_id", "idx").agg(F.max_by("flow_id", F.struct("bwd_ts", "first_idx")).alias("flow_id"))
    forward = enclosing_op(pairs, events, "fwd_ts", "fwd_tid", ["flow_id", "fwd_tid"]).select(
        "trace_id", "flow_id", "fwd_tid", F.col("op_start").alias("fwd_start"), F.col("op_end").alias("fwd_end"))
    return latest.join(forward, ["trace_id", "flow_id"])


def nearest_in_scope(scoped: DataFrame, donors: DataFrame, rows: int | None = None) -> DataFrame:
    """Donor kernel in the forward scope that is nearest in time to each scoped kernel.

    ``scoped``: trace_id, idx, ts_ns, fwd_tid, fwd_start, fwd_end.  ``donors``: trace_id, idx, tid, ts_ns.
    The nearest donor in a window is the last one before or the first one after the time
    clamped to the window: two as-of joins.  The earlier donor wins a tie.
    """
    donors = donors.groupBy("trace_id", F.col("tid").alias("fwd_tid"), F.col("ts_ns").alias("donor_ts")).agg(
        F.min("idx").alias("donor_idx"))
    probes = scoped.withColumn("_at", F.least(F.greatest("ts_ns", "fwd_start"), F.col("fwd_end")))
    keys = ["trace_id", "fwd_tid"]
    probes = last_mark_at(probes, donors, keys, "_at", "donor_ts", "_before", rows)
    negated = donors.select(*keys, (-F.col("donor_ts")).alias("donor_neg"))
    probes = last_mark_at(probes.withColumn("_minus_at", -F.col("_at")), negated, keys, "_minus_at", "donor_neg",
                          "_after_neg", rows)
    before = F.when(F.col("_before") >= F.col("fwd_start"), F.col("_before"))
    after = F.when(-F.col("_after_neg") <= F.col("fwd_end"), -F.col("_after_neg"))
    gap = lambda c: F.abs(c - F.col("ts_ns"))
    pick = F.when(after.isNull() | (gap(before) <= gap(after)), before).otherwise(after)
    return probes.withColumn("donor_ts", F.coalesce(pick, after)).join(donors, [*keys, "donor_ts"]).select(
        "trace_id", "idx", "donor_idx")


def _kernels(events: DataFrame) -> DataFrame:
    return events.filter((F.col("cat") == "kernel") & (F.col("dur_ns") > 0))


def module_of_kernels(t: TraceTables, kernels: DataFrame) -> DataFrame:
    """Module by external id, else by the enclosing module; ``via`` tells which."""
    by_id = t.id_modules.withColumnRenamed("module", "_by_id")
    names = t.events.filter(is_module_event()).select(
        "trace_id", F.col("idx").alias("module_idx"), F.col("name").alias("_by_parent"))
    up = t.parents.select("trace_id", "idx", "module_idx").filter("module_idx is not null").join(
        names, ["trace_id", "module_idx"]).drop("module_idx")
    return (
        kernels.select("trace_id", "idx", "external_id")
        .join(by_id, ["trace_id", "external_id"], "left").join(up, ["trace_id", "idx"], "left")
        .select("trace_id", "idx", F.coalesce("_by_id", "_by_parent").alias("module"),
                F.when(F.col("_by_id").isNotNull(), "external_id").when(F.col("_by_parent").isNotNull(), "parent").alias("via"))
    )


def kernels_with_chains(events: DataFrame, sources: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """Kernels with at least one stack that has a frame in the user's sources; ``frames``: those of all stacks, if known."""
    own = user_frames(stack_frames(distinct_stacks(events)) if frames is None else frames, sources).select("stack_key").distinct()
    return kernel_stacks(events).join(own, "stack_key", "left_semi").select("trace_id", "idx").distinct()


def kernel_stack_costs(t: TraceTables, sources: DataFrame) -> DataFrame:
    """One row per kernel: phase, where its stack comes from, and the module if it has none.

    ``source`` is the rung that matched: own stack, stack borrowed from the nearest forward
    kernel in the forward scope, module by external id, enclosing module, or none.
    """
    kernels = _kernels(t.events)
    pairs = t.flow_pairs
    bwd_tids = pairs.select("trace_id", F.col("bwd_tid").alias("tid")).distinct().withColumn("_bwd_tid", F.lit(True))
    chains = kernels_with_chains(t.events, sources, t.frames).withColumn("_chains", F.lit(True))
    facts = (
        kernels.select("trace_id", "idx", "tid", "ts_ns", "dur_ns", "external_id",
                       (F.size(F.coalesce("stack_traces", F.array().cast("array<string>"))) > 0).alias("has_stack"),
                       is_backward_stack(F.col("stack_traces")).alias("bwd_stack"))
        .join(bwd_tids, ["trace_id", "tid"], "left").join(chains, ["trace_id", "idx"], "left")
        .withColumns({"is_bwd": F.col("bwd_stack") | F.coalesce("_bwd_tid", F.lit(False)),
                      "has_chains": F.coalesce("_chains", F.lit(False))})
        .drop("_bwd_tid", "_chains")
    )
    facts = materialize(facts)
    borrowers = facts.filter("not has_stack and is_bwd").select("trace_id", "idx", "tid", "ts_ns")
    scoped = borrowers.drop("tid").join(forward_scope(borrowers, pairs, t.events), ["trace_id", "idx"])
    donors = facts.filter("not is_bwd and has_chains").select("trace_id", "idx", "tid", "ts_ns")
    lent = nearest_in_scope(materialize(scoped), materialize(donors))
    module = module_of_kernels(t, kernels)
    joined = facts.join(lent, ["trace_id", "idx"], "left").join(module, ["trace_id", "idx"], "left")
    source = (
        F.when(F.col("has_stack"), "stack").when(F.col("donor_idx").isNotNull(), "borrowed")
        .otherwise(F.coalesce("via", F.lit("none"))))
    named = F.col("source").isin("external_id", "parent")
    phase = F.when(F.col("has_stack"), F.col("bwd_stack")).otherwise(F.col("is_bwd"))
    return joined.withColumn("source", source).select(
        "trace_id", "idx", "dur_ns", F.when(phase, "bwd").otherwise("fwd").alias("phase"), "source", "donor_idx",
        F.when(named, runtime_module(F.col("module"))["class_name"]).alias("module_class"),
        (F.col("source") == "none").alias("unmatched"))
