"""Kernel time per module instance: attribution, roll-up along call sites, panels, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave.functions.labels import is_backward_stack, runtime_module, wide_sum
from stepweave.operators.device import top
from stepweave.operators.flows import _kernels, forward_scope, module_of_kernels
from stepweave.operators.phases import PHASES, phase_of_spans
from stepweave.operators.stacks import instance_keys, kernel_stacks, leaf_instances, locate_lines, user_frames
from stepweave.plans.tables import TraceTables
from stepweave.session import materialize

KEY = ["class", "site_file", "site_line", "ancestors"]
ALL_PHASES = (*PHASES, "other")
_SITES = "array<struct<file:string,line:bigint>>"


def kernel_attribution(t: TraceTables, sources: DataFrame, spans: DataFrame) -> DataFrame:
    """Weights of module instances per kernel; ``n_hits / n_total`` sums to 1 for a kernel.

    Every stack of a kernel votes for its innermost instance.  A kernel without a vote
    goes whole to the runtime module that launched it, or keeps one row with a NULL key.
    """
    kernels = _kernels(t.events)
    leaves = leaf_instances(instance_keys(user_frames(t.frames, sources), spans))
    votes = materialize(kernel_stacks(t.events).join(leaves, "stack_key").groupBy("trace_id", "idx", *KEY).agg(
        F.count(F.lit(1)).alias("n_hits")))
    totals = votes.groupBy("trace_id", "idx").agg(F.sum("n_hits").alias("n_total"))
    facts = kernels.select(
        "trace_id", "idx", "tid", "ts_ns", "dur_ns", is_backward_stack(F.col("stack_traces")).alias("is_bwd")
    ).join(totals, ["trace_id", "idx"], "left")
    columns = ["trace_id", "idx", "ts_ns", "dur_ns", "is_bwd", *KEY, "n_hits", "n_total", "rung"]
    voted = facts.filter("n_total is not null").join(votes, ["trace_id", "idx"]).withColumn("rung", F.lit("stack"))
    info = runtime_module(F.col("module"))
    # the call site if the name has one, else the runtime index as a negative line
    line = F.coalesce(info["callsite"], -F.coalesce(info["runtime_index"], F.lit(0)))
    has_class = F.coalesce(info["class_name"], F.lit("")) != ""
    rest = facts.filter("n_total is null").join(module_of_kernels(t, kernels), ["trace_id", "idx"], "left").withColumns({
        "class": F.when(has_class, info["class_name"]),
        "site_file": F.when(has_class, F.lit("<wrapped>")),
        "site_line": F.when(has_class, line).cast("bigint"),
        "ancestors": F.when(has_class, F.array().cast(_SITES)),
        "n_hits": F.lit(1).cast("bigint"), "n_total": F.lit(1).cast("bigint"),
        "rung": F.when(has_class, "wrapped").otherwise("none")})
    return voted.select(*columns).unionByName(rest.select(*columns))


def attribution_counters(t: TraceTables, attribution: DataFrame) -> DataFrame:
    """Per trace: kernels by how they were attributed, and total kernel time, as a decimal."""
    per_kernel = attribution.groupBy("trace_id", "idx").agg(
        F.first("rung").alias("rung"), F.first("is_bwd").alias("is_bwd"), F.first("dur_ns").alias("dur_ns"))
    backward = t.events.select("trace_id", "idx", "tid", "ts_ns").join(
        per_kernel.filter("rung = 'stack' and is_bwd"), ["trace_id", "idx"], "left_semi")
    narrowed = forward_scope(backward, t.flow_pairs, t.events).select("trace_id", "idx").withColumn("_n", F.lit(True))
    count = lambda cond, name: F.count_if(F.expr(cond)).alias(name)
    return per_kernel.join(narrowed, ["trace_id", "idx"], "left").groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("total_kernels"),
        count("rung = 'stack' and not is_bwd", "fwd_attributed"), count("rung = 'stack' and is_bwd", "bwd_attributed"),
        count("rung = 'wrapped'", "wrapped_fallback"),
        count("rung = 'none' and not is_bwd", "fwd_unattributed"), count("rung = 'none' and is_bwd", "bwd_unattributed"),
        count("coalesce(_n, false)", "bwd_via_flow_narrowed"), wide_sum("dur_ns").alias("total_kernel_ns"))


def _whole(over: str, by: str) -> Column:
    """Whole part of the quotient of two whole numbers of any size."""
    wide = lambda c: f"cast({c} as decimal(38,0))"
    return F.expr(f"cast(({wide(over)} - {wide(over)} % {wide(by)}) / cast({by} as decimal(19,0)) as decimal(38,0))")


def in_ns(df: DataFrame) -> DataFrame:
    """Exact times (whole billionths of a ns, as the functions here add them up) as ns."""
    ns = lambda c: F.expr(f"cast(({c} - {c} % 1000000000) / 1000000000 as double) + cast({c} % 1000000000 as double) / 1e9")
    return df.select(*[ns(c).alias(c) if d == "decimal(38,0)" else F.col(c) for c, d in df.dtypes])


def self_times(attribution: DataFrame, steps: DataFrame, phases: DataFrame) -> DataFrame:
    """Time per instance and phase from its own kernels, per step, in whole billionths of a ns.

    Each share is cut to a whole number once; all sums that follow are exact and do not depend on row order.
    """
    keyed = attribution.filter("class is not null")
    spans = keyed.select("trace_id", "idx", F.col("ts_ns").alias("start_ns"),
                         (F.col("ts_ns") + F.col("dur_ns")).alias("end_ns")).distinct()
    rest = "(dur_ns % n_total) * n_hits"
    share = F.expr(f"cast((dur_ns div n_total) * n_hits + {rest} div n_total as decimal(28,0)) * cast(1000000000 as decimal(10,0))"
                   f" + ({rest} % n_total) * 1000000000 div n_total").cast("decimal(38,0)")
    n = steps.groupBy("trace_id").agg(F.count(F.lit(1)).alias("_n"))
    sums = keyed.join(phase_of_spans(spans, steps, phases), ["trace_id", "idx"]).groupBy("trace_id", *KEY).agg(
        *[F.coalesce(F.sum(F.when(F.col("phase") == p, share)), F.lit(0)).cast("decimal(38,0)").alias(p) for p in ALL_PHASES])
    return sums.join(n, "trace_id", "left").select("trace_id", *KEY, *[_whole(p, "coalesce(_n, 1)").alias(f"self_{p}") for p in ALL_PHASES])


def _rises(selfs: DataFrame, spans: DataFrame, rollup: str) -> DataFrame:
    """Every (instance, instance above it) pair, the instance itself included.

    The sites of an instance are its ancestors plus its own call site.  The instance at level j is
    called at site j and has the class that contains site j+1.  The climb stops at the first
    site outside every class; in "one_level" mode it also stops above an instance that has
    no kernels of its own.
    """
    own = selfs.withColumn("_key", F.sha2(F.to_json(F.struct(*KEY)), 256)).withColumn(
        "_sites", F.concat("ancestors", F.array(F.struct(F.col("site_file").alias("file"), F.col("site_line").alias("line")))))
    sites = own.select("trace_id", "_key", F.posexplode("_sites").alias("_pos", "_site"))
    found = locate_lines(sites.select("_site.file", "_site.line"), spans).select("file", "line", "class")
    # at position p: the class of the instance one level up (p - 1)
    up = sites.select("trace_id", "_key", "_pos", F.col("_site.file").alias("file"), F.col("_site.line").alias("line")).join(
        found, ["file", "line"], "left").filter("_pos > 0").select(
        "trace_id", "_key", (F.col("_pos") - 1).alias("_pos"), F.col("class").alias("up_class"))
    levels = own.select("trace_id", "_key", "_sites", F.posexplode("_sites").alias("_pos", "_site")).filter(
        F.col("_pos") < F.size("_sites") - 1).join(up, ["trace_id", "_key", "_pos"])
    above = levels.select(
        "trace_id", "_key", "_pos", F.col("up_class").alias("class"), F.col("_site.file").alias("site_file"),
        F.col("_site.line").alias("site_line"), F.slice("_sites", F.lit(1), F.col("_pos")).alias("ancestors"))
    real = selfs.select("trace_id", *KEY).withColumn("_real", F.lit(True))
    above = above.join(real, ["trace_id", *KEY], "left")
    blocked = F.col("class").isNull()
    below = Window.partitionBy("trace_id", "_key").orderBy(F.col("_pos").desc())
    gone = F.max(blocked.cast("int")).over(below)  # this level or one nearer the instance is unresolved
    above = above.withColumn("_gone", gone)
    if rollup == "one_level":
        invented = F.col("_real").isNull().cast("int")
        past = below.rowsBetween(Window.unboundedPreceding, -1)
        above = above.withColumn("_gone", F.greatest("_gone", F.coalesce(F.max(invented).over(past), F.lit(0))))
    reached = above.filter("_gone = 0")
    time = own.select("trace_id", "_key", *[f"self_{p}" for p in ALL_PHASES])
    climbs = reached.select("trace_id", "_key", *KEY).join(time, ["trace_id", "_key"])
    itself = own.select("trace_id", "_key", *KEY, *[f"self_{p}" for p in ALL_PHASES])
    return itself.unionByName(climbs)


def instance_times(
    selfs: DataFrame, spans: DataFrame, roots: Sequence[str] = (), rollup: str = "transitive"
) -> DataFrame:
    """Self and inclusive time per instance and phase.

    Instances whose parent cannot be found are orphans; their inclusive time is added to the primary
    root of the trace: the smallest instance of a root class entered from ``<root>``, else the
    smallest instance of any root class.  ``selfs`` is read several times: materialize it first.
    """
    inclusive = _rises(selfs, spans, rollup).groupBy("trace_id", *KEY).agg(
        *[F.sum(f"self_{p}").alias(f"inclusive_{p}") for p in ALL_PHASES])
    table = inclusive.join(selfs, ["trace_id", *KEY], "left").withColumns({
        **{f"self_{p}": F.coalesce(f"self_{p}", F.lit(0)) for p in ALL_PHASES},
        "synthesized": F.col("self_other").isNull()})
    sites = table.filter((F.size("ancestors") > 0) & (F.col("site_file") != "<wrapped>"))
    found = locate_lines(sites.select(F.col("site_file").alias("file"), F.col("site_line").alias("line")), spans).select(
        F.col("file").alias("site_file"), F.col("line").alias("site_line"), F.lit(True).alias("_resolved"))
    table = table.join(found, ["site_file", "site_line"], "left")
    linked = (F.size("ancestors") > 0) & F.coalesce("_resolved", F.lit(False))
    if rollup == "one_level":
        linked = linked & ~F.col("synthesized")
    table = table.withColumn("is_orphan", ~linked).drop("_resolved")
    if not roots:
        return table.select("trace_id", *KEY, *_time_columns(), "synthesized", "is_orphan")
    table = materialize(table)
    order = F.struct((F.col("site_file") != "<root>").alias("_not_root"), "class", "site_file", "site_line", "ancestors")
    primary = table.filter(F.col("class").isin(*roots)).groupBy("trace_id").agg(F.min(order).alias("_p")).select(
        "trace_id", *[F.col(f"_p.{k}").alias(k) for k in KEY], F.lit(True).alias("is_primary_root"))
    table = table.join(primary, ["trace_id", *KEY], "left").withColumn(
        "is_primary_root", F.coalesce("is_primary_root", F.lit(False)))
    extra = table.filter("is_orphan and not is_primary_root").groupBy("trace_id").agg(
        *[F.sum(f"inclusive_{p}").alias(f"_x_{p}") for p in ALL_PHASES])
    add = lambda p: F.col(f"inclusive_{p}") + F.when(
        F.col("is_primary_root"), F.coalesce(f"_x_{p}", F.lit(0))).otherwise(F.lit(0))
    return table.join(extra, "trace_id", "left").withColumns(
        {f"inclusive_{p}": add(p).cast(dict(table.dtypes)[f"inclusive_{p}"]) for p in ALL_PHASES}
    ).select("trace_id", *KEY, *_time_columns(), "synthesized", "is_orphan")


def _time_columns() -> list[str]:
    return [f"{kind}_{p}" for kind in ("self", "inclusive") for p in ALL_PHASES]


def timing_panel(times: DataFrame) -> DataFrame:
    """Display rows: name, self and inclusive totals, sorted by class and call site."""
    shown = (F.col("site_file") != "<wrapped>") & (F.col("site_line") > 0)
    base = F.element_at(F.split("site_file", "/"), -1)
    name = F.when(shown, F.concat("class", F.lit("@"), base, F.lit(":"), F.col("site_line").cast("string"))).otherwise(F.col("class"))
    total = lambda kind: sum((F.col(f"{kind}_{p}") for p in ALL_PHASES[1:]), F.col(f"{kind}_{ALL_PHASES[0]}")).cast(dict(times.dtypes)[f"{kind}_other"])
    out = times.select(
        "trace_id", "class", name.alias("instance_name"), "site_file",
        F.when(F.col("site_line") > 0, F.col("site_line")).alias("site_line"), "ancestors",
        *[F.col(f"self_{p}").alias(f"{p}_ns") for p in ALL_PHASES], total("self").alias("self_ns"),
        F.col("inclusive_forward").alias("inclusive_forward_ns"), F.col("inclusive_backward").alias("inclusive_backward_ns"),
        total("inclusive").alias("inclusive_ns"), F.col("site_line").alias("_line"))
    w = Window.partitionBy("trace_id", "class").orderBy(
        "site_file", F.coalesce("site_line", F.lit(0)), "instance_name", "_line", "ancestors")
    return out.withColumn("ord", F.row_number().over(w).cast("bigint")).drop("_line")


def class_times(panel: DataFrame) -> DataFrame:
    """Sum of the instances' inclusive times; nested instances of one class count twice."""
    return panel.groupBy("trace_id", "class").agg(
        F.sum("inclusive_ns").alias("inclusive_ns"), F.sum("inclusive_forward_ns").alias("forward_ns"),
        F.sum("inclusive_backward_ns").alias("backward_ns"), F.count(F.lit(1)).alias("n_instances"))


def instance_summary(counters: DataFrame, steps: DataFrame, times: DataFrame) -> DataFrame:
    """Kernel time per step and the part no instance accounts for, in whole billionths of a ns; ``times`` has self times, rolled up or not."""
    n = steps.groupBy("trace_id").agg(F.count(F.lit(1)).alias("_n"))
    own = times.groupBy("trace_id").agg(
        F.sum(F.col("self_forward") + F.col("self_backward") + F.col("self_optimize") + F.col("self_other")).cast("decimal(38,0)").alias("_own"))
    per_step = _whole("cast(total_kernel_ns as decimal(28,0)) * cast(1000000000 as decimal(10,0))", "coalesce(_n, 1)")
    exact = counters.join(n, "trace_id", "left").join(own, "trace_id", "left").select(
        "trace_id", per_step.alias("step_kernel_ns"), F.coalesce("_own", F.lit(0)).cast("decimal(38,0)").alias("attributed_ns"))
    return exact.withColumn("unattributed_ns", F.greatest(F.lit(0), F.col("step_kernel_ns") - F.col("attributed_ns")).cast("decimal(38,0)"))


def _number(name: str):
    return F.coalesce(F.col(name).cast("string").try_cast("double"), F.lit(0.0))


def timed_groups(groups: DataFrame) -> DataFrame:
    """Sub-groups (depth > 0) with a ``timed`` flag; values that are not numbers count as 0."""
    depth = F.coalesce(F.col("depth").cast("string").try_cast("int"), F.lit(0))
    return groups.filter(depth > 0).withColumns({"kernel_us": _number("kernel_us"), "total_us": _number("total_us")}).withColumn(
        "timed", (F.col("kernel_us") > 0) | (F.col("total_us") > 0))


def timing_coverage(groups: DataFrame, keys: Sequence[str] = ("graph_id",)) -> DataFrame:
    """Per graph: sub-groups, timed ones and their share (0 when there are none)."""
    n, timed = F.count("timed"), F.coalesce(F.count_if("timed"), F.lit(0))
    every = groups.select(*keys).distinct()
    return every.join(timed_groups(groups), list(keys), "left").groupBy(*keys).agg(
        n.alias("total_instances"), timed.alias("timed_instances"),
        F.when(n > 0, timed / n).otherwise(F.lit(0.0)).alias("coverage_rate"))


def untimed_groups(groups: DataFrame, keys: Sequence[str] = ("graph_id",)) -> DataFrame:
    text = lambda *names: F.coalesce(*[F.nullif(F.col(n).cast("string"), F.lit("")) for n in names], F.lit(""))
    return timed_groups(groups).filter("not timed").select(
        *keys, text("class_name", "label").alias("class_name"), text("attr_name", "id").alias("instance_key"),
        "kernel_us", "total_us")


def top_timed(items: DataFrame, k: int = 5, keys: Sequence[str] = ("graph_id",)) -> DataFrame:
    """Nodes and groups with timing, by percentage."""
    return top(items.filter("has_timing"), keys, [F.col("pct").desc(), F.col("id")], k)
