"""Forward, backward and optimizer phases inside the profiler steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepweave.functions.labels import phase_of_label
from stepweave.operators.intervals import join_overlapping, overlap_length
from stepweave.operators.nesting import main_thread_tree
from stepweave.operators.trace_dims import STEP_LABEL
from stepweave.session import materialize

PHASES = ("forward", "backward", "optimize")  # also the order in which ties are settled


def _tree_rows(events: DataFrame, tree: DataFrame | None) -> DataFrame:
    tree = main_thread_tree(events) if tree is None else tree
    facts = events.select("trace_id", "idx", "cat", "name", "ts_ns", "dur_ns")
    return tree.select("trace_id", "idx", "parent_idx").join(facts, ["trace_id", "idx"])


def annotated_steps(rows: DataFrame) -> DataFrame:
    """Profiler steps on the main thread that enclose anything, with their longest child."""
    steps = rows.filter(F.col("name").startswith(STEP_LABEL) & (F.col("cat") == "user_annotation")).select(
        "trace_id", F.col("idx").alias("parent_idx"), F.col("name").alias("step_name"),
        F.col("ts_ns").alias("step_start"), (F.col("ts_ns") + F.col("dur_ns")).alias("step_end"),
        F.col("dur_ns").alias("_step_dur"))
    longest = rows.filter("parent_idx is not null").groupBy("trace_id", "parent_idx").agg(
        F.max_by("idx", F.struct("dur_ns", -F.col("ts_ns"), -F.col("idx"))).alias("body_idx"))
    order = Window.partitionBy("trace_id").orderBy("step_start", F.col("_step_dur").desc(), "parent_idx")
    return steps.join(longest, ["trace_id", "parent_idx"]).select(
        "trace_id", (F.row_number().over(order) - 1).cast("bigint").alias("step_no"),
        "step_name", "step_start", "step_end", "body_idx")


def step_phases(events: DataFrame, tree: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(steps, phases): the annotated steps and the phase intervals inside each."""
    rows = materialize(_tree_rows(events, tree))
    steps = annotated_steps(rows)
    child = lambda prefix: rows.select(
        "trace_id", F.col("parent_idx").alias(f"{prefix}parent"), F.col("idx").alias(f"{prefix}idx"),
        F.col("name").alias("label"), F.col("ts_ns").alias("phase_start"),
        (F.col("ts_ns") + F.col("dur_ns")).alias("phase_end"))
    second = steps.select("trace_id", "step_no", F.col("body_idx").alias("b_parent")).join(
        child("b_"), ["trace_id", "b_parent"])
    is_loop = F.lower("label").contains("forward_backward")
    tail = ["trace_id", "step_no", "phase", "phase_start", "phase_end", "label"]
    optimize = second.filter(~is_loop).withColumn("phase", phase_of_label(F.col("label"))).filter(
        "phase = 'optimize'").select(*tail)
    third = second.filter(is_loop).select("trace_id", "step_no", F.col("b_idx").alias("c_parent")).join(
        child("c_"), ["trace_id", "c_parent"])
    passes = third.withColumn("phase", phase_of_label(F.col("label"))).filter(
        "phase in ('forward', 'backward')").select(*tail)
    return steps.drop("body_idx"), passes.unionByName(optimize)


def phase_of_spans(spans: DataFrame, steps: DataFrame, phases: DataFrame) -> DataFrame:
    """``(trace_id, idx, phase)``: phase with the largest overlap in the first touching step.

    ``spans`` has trace_id, idx, start_ns, end_ns.  No overlap with any phase is "other".
    """
    spans = spans.select("trace_id", "idx", "start_ns", "end_ns")
    touching = join_overlapping(
        spans, steps.select("trace_id", "step_no", "step_start", "step_end"), ["trace_id"],
        "start_ns", "end_ns", "step_start", "step_end", closed=True)
    first = touching.groupBy("trace_id", "idx").agg(
        F.min("step_no").alias("step_no"), F.first("start_ns").alias("start_ns"), F.first("end_ns").alias("end_ns"))
    shared = overlap_length(F.col("start_ns"), F.col("end_ns"), F.col("phase_start"), F.col("phase_end"))
    sums = first.join(phases, ["trace_id", "step_no"]).groupBy("trace_id", "idx").agg(
        *[F.sum(F.when(F.col("phase") == p, shared).otherwise(0)).alias(p) for p in PHASES])
    most = F.greatest(*PHASES)
    best = F.when(most > 0, F.coalesce(*[F.when(F.col(p) == most, p) for p in PHASES]))
    return spans.select("trace_id", "idx").join(sums, ["trace_id", "idx"], "left").select(
        "trace_id", "idx", F.coalesce(best, F.lit("other")).alias("phase"))
