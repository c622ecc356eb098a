"""Device-side analyses: hot kernels, idle gaps, host origin, overlap of copies and collectives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave.functions.labels import namespace_op, percent, wide_sum
from stepweave.operators.chunks import chunked, previous_row
from stepweave.operators.intervals import join_overlapping, union_overlaps
from stepweave.operators.nesting import is_module_event
from stepweave.operators.trace_dims import clipped_in_steps, step_at_start
from stepweave.plans.tables import TraceTables
from stepweave.schema import DEVICE_CATS, THREAD_KEY

def _zero() -> Column:
    return F.lit(0).cast("bigint")


def top(df: DataFrame, group: Sequence[str], by: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group, numbered from 1.

    Spark pushes the limit below the shuffle, so each task sends at most ``k`` rows per group.
    """
    w = Window.partitionBy(*group).orderBy(*by)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k).withColumn(
        out, F.col(out).cast("bigint"))


def primary_stream_ops(t: TraceTables) -> DataFrame:
    primary = t.threads.filter("is_primary_stream").select(*THREAD_KEY)
    return t.events.filter((F.col("ph") == "X") & F.col("cat").isin(*DEVICE_CATS)).join(
        primary, list(THREAD_KEY), "left_semi").withColumn("dur_ns", F.coalesce("dur_ns", _zero()))


def _per_step(total: Column, n_steps: Column) -> Column:
    return total.cast("double") / F.greatest(n_steps, F.lit(1))


def device_timeline(t: TraceTables) -> DataFrame:
    """Per trace: kernel time and count per step, mean device step, utilization in percent."""
    marks = t.device_steps
    ops = clipped_in_steps(primary_stream_ops(t), marks)
    active = ops.groupBy("trace_id").agg(
        wide_sum("clipped_ns").alias("_active"), F.count(F.lit(1)).alias("_n"))
    step = marks.groupBy("trace_id").agg(
        F.sum("dur_ns").alias("_d"), F.count(F.lit(1)).alias("n_device_steps"))
    out = active.join(t.summary, "trace_id").join(step, "trace_id", "left")
    kernel_ns = _per_step(F.col("_active"), F.col("n_steps"))
    step_ns = F.coalesce(F.col("_d").cast("double") / F.col("n_device_steps"), F.lit(0.0))
    return out.select(
        "trace_id", kernel_ns.alias("kernel_ns"), step_ns.alias("device_step_ns"),
        F.coalesce(percent(kernel_ns, step_ns), F.lit(0.0)).alias("utilization_pct"),
        F.expr("_n div greatest(n_steps, 1)").alias("n_kernels"),
        F.coalesce("n_device_steps", _zero()).alias("n_device_steps"))


def top_kernels(t: TraceTables, k: int = 30) -> DataFrame:
    """Kernels of the primary stream by time per step, cut to the device steps."""
    ops = primary_stream_ops(t).select(
        "trace_id", "idx", "name", "ts_ns", "dur_ns")
    ops = clipped_in_steps(ops, t.device_steps)
    by_name = ops.groupBy("trace_id", "name").agg(
        wide_sum("clipped_ns").alias("_ns"), F.count(F.lit(1)).alias("_n"))
    n = F.greatest(F.col("n_steps"), F.lit(1))
    rows = by_name.join(t.summary, "trace_id").select(
        "trace_id", "name", _per_step(F.col("_ns"), F.col("n_steps")).alias("dur_ns"),
        F.when(F.col("_n") >= n, F.expr("_n div greatest(n_steps, 1)")).otherwise(F.col("_n")).alias("n_calls"),
        F.col("_ns"))
    return top(rows, ["trace_id"], [F.col("_ns").desc(), F.col("name")], k).drop("_ns")


def kernel_gaps(t: TraceTables, rows: int | None = None) -> DataFrame:
    """Idle time before each operation of the primary stream (end of the row just before it).

    Gaps are not cut to steps; ``within_step`` tells those that lie inside one host step.
    """
    ops = primary_stream_ops(t).select(
        *THREAD_KEY, "idx", "name", "ts_ns", "dur_ns")
    c = chunked(ops, THREAD_KEY, "ts_ns", rows)
    frame = previous_row(c, ["ts_ns", "idx"], ["ts_ns", "dur_ns", "name"], "before").frame
    gap = F.col("ts_ns") - F.col("before.ts_ns") - F.col("before.dur_ns")
    gaps = step_at_start(frame.withColumn("gap_ns", gap).filter("gap_ns > 0"), t.steps)
    within = F.coalesce(F.col("ts_ns") - F.col("gap_ns") >= F.col("step_start"), F.lit(False))
    return gaps.select(
        "trace_id", "idx", "gap_ns", within.alias("within_step"), F.col("before.name").alias("before_name"),
        F.col("before.dur_ns").alias("before_dur_ns"), F.col("name").alias("after_name"),
        F.col("dur_ns").alias("after_dur_ns"))


def top_gaps(gaps: DataFrame, k: int = 15) -> DataFrame:
    return top(gaps, ["trace_id"], [F.col("gap_ns").desc(), F.col("idx")], k)


def gap_per_step(gaps: DataFrame, summary: DataFrame) -> DataFrame:
    total = gaps.groupBy("trace_id").agg(wide_sum("gap_ns").alias("_g"), F.count(F.lit(1)).alias("n_gaps"))
    return total.join(summary, "trace_id").select(
        "trace_id", "n_gaps", _per_step(F.col("_g"), F.col("n_steps")).alias("gap_ns"))


def last_host_ops(events: DataFrame) -> DataFrame:
    """External id -> the last host operation that carries it."""
    return (
        events.filter((F.col("cat") == "cpu_op") & (F.col("ph") == "X") & F.col("external_id").isNotNull())
        .groupBy("trace_id", "external_id").agg(F.max("idx").alias("idx"))
    )


def kernel_host_modules(
    t: TraceTables,
) -> DataFrame:
    """Time of each primary-stream kernel by the module that launched it, as a decimal."""
    modules = t.events.filter(is_module_event()).select(
        "trace_id", F.col("idx").alias("module_idx"),
        F.replace(F.col("name"), F.lit("nn.Module: "), F.lit("")).alias("module"))
    launched = (
        last_host_ops(t.events)
        .join(t.parents.select("trace_id", "idx", "module_idx"), ["trace_id", "idx"])
        .join(modules, ["trace_id", "module_idx"])
        .select("trace_id", "external_id", "module")
    )
    # Sum per external id first: the join then sees one row per (id, kernel name).
    kernels = primary_stream_ops(t).groupBy("trace_id", "external_id", "name").agg(
        wide_sum("dur_ns").alias("dur_ns"))
    return kernels.join(launched, ["trace_id", "external_id"]).groupBy("trace_id", "name", "module").agg(
        wide_sum("dur_ns").alias("dur_ns"))


def hot_kernel_modules(top_table: DataFrame, host_modules: DataFrame) -> DataFrame:
    """Modules of the hot kernels, longest first; a kernel without any keeps one NULL row."""
    joined = top_table.select("trace_id", "name").join(host_modules, ["trace_id", "name"], "left")
    w = Window.partitionBy("trace_id", "name").orderBy(F.col("dur_ns").desc(), "module")
    return joined.withColumn("module_rank", F.row_number().over(w).cast("bigint"))


def device_host_totals(t: TraceTables) -> DataFrame:
    """Host and device time per step: in total, by category and by operation name.

    ``total_ns`` is a decimal: all operations of a trace together may exceed 64 bits.
    """
    ops = t.events.filter(F.col("cat").isin(*DEVICE_CATS, "cpu_op")).select(
        "trace_id", "cat", "name", F.coalesce("dur_ns", _zero()).alias("dur_ns"),
        F.when(F.col("cat") == "cpu_op", "host").otherwise("device").alias("side"))
    fine = ops.groupBy("trace_id", "side", "cat", "name").agg(wide_sum("dur_ns").alias("dur_ns"))
    sets = fine.groupingSets(
        [["trace_id", "side"], ["trace_id", "side", "cat"], ["trace_id", "side", "name"]],
        "trace_id", "side", "cat", "name",
    ).agg(F.sum("dur_ns").alias("_ns"), F.grouping("name").alias("_all_names"), F.grouping("cat").alias("_all_cats"))
    grain = F.when(F.col("_all_names") == 0, "name").when(F.col("_all_cats") == 0, "cat").otherwise("total")
    return sets.join(t.summary.select("trace_id", "n_steps"), "trace_id").select(
        "trace_id", "side", grain.alias("grain"), F.when(F.col("_all_names") == 0, F.col("name")).otherwise(F.col("cat")).alias("key"),
        F.col("_ns").alias("total_ns"), _per_step(F.col("_ns"), F.col("n_steps")).alias("dur_ns")
    ).filter(~((F.col("grain") == "cat") & (F.col("side") == "host")))


def top_device_host_ops(totals: DataFrame, k: int = 20) -> DataFrame:
    return top(totals.filter("grain = 'name'"), ["trace_id", "side"],
               [F.col("total_ns").desc(), F.col("key")], k)


def _overlap_classes(t: TraceTables) -> DataFrame:
    """Operations that take part in the overlap analysis, with the class of their stream."""
    kinds = t.threads.filter("stream_kind is not null").select(*THREAD_KEY, "stream_kind")
    ops = t.events.filter((F.col("ph") == "X") & F.col("cat").isin(*DEVICE_CATS)).join(kinds, list(THREAD_KEY))
    wanted = (
        (F.col("stream_kind") == "compute")
        | ((F.col("stream_kind") == "comm") & (F.col("cat") == "kernel"))
        | ((F.col("stream_kind") == "memcpy") & F.col("cat").isin("gpu_memcpy", "gpu_memset")))
    return ops.filter(wanted & (F.col("dur_ns") > 0)).select(
        "trace_id", "idx", "name", "stream_kind", F.col("ts_ns").alias("op_start"),
        (F.col("ts_ns") + F.col("dur_ns")).alias("op_end"))


def overlap_windows(t: TraceTables) -> DataFrame:
    """Host steps; device steps for traces that have no host step."""
    host = t.steps.select("trace_id", "step_no", F.col("ts_ns").alias("step_start"), F.col("end_ns").alias("step_end"))
    device = t.device_steps.select(
        "trace_id", "step_no", F.col("ts_ns").alias("step_start"), F.col("end_ns").alias("step_end"))
    return host.unionByName(device.join(host.select("trace_id").distinct(), "trace_id", "left_anti"))


def _ops_in_steps(t: TraceTables, windows: DataFrame) -> DataFrame:
    pairs = join_overlapping(
        _overlap_classes(t), windows.filter("step_end > step_start"), ["trace_id"],
        "op_start", "op_end", "step_start", "step_end", closed=False)
    return pairs.withColumns({
        "op_start": F.greatest("op_start", "step_start"), "op_end": F.least("op_end", "step_end")}
    ).filter("op_end > op_start")


def overlap_by_step(t: TraceTables, rows: int | None = None) -> DataFrame:
    """Per step: compute, collective and copy time, and how much of the last two compute hides."""
    windows = overlap_windows(t)
    swept = union_overlaps(
        _ops_in_steps(t, windows), ["trace_id", "step_no"], "op_start", "op_end",
        "stream_kind", ["compute", "comm", "memcpy"], "compute", rows)
    zero = lambda c: F.coalesce(c, _zero()).alias(c)
    return windows.join(swept, ["trace_id", "step_no"], "left").select(
        "trace_id", "step_no", (F.col("step_end") - F.col("step_start")).alias("step_ns"),
        zero("compute_ns"), zero("comm_ns"), zero("comm_overlap_ns"), zero("memcpy_ns"), zero("memcpy_overlap_ns"))


def comm_compute_overlap(per_step: DataFrame, thread_table: DataFrame) -> DataFrame:
    """Means over the steps of each trace with a primary stream, and four percentages."""
    mean = lambda e: F.sum(e).cast("double") / F.count(F.lit(1))
    streams = thread_table.groupBy("trace_id").agg(
        F.count_if(F.col("stream_kind") == "comm").alias("n_comm_streams"),
        F.count_if(F.col("stream_kind") == "memcpy").alias("n_memcpy_streams"),
        F.bool_or("is_primary_stream").alias("_primary"))
    avg = per_step.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("n_steps"),
        *[mean(F.col(c)).alias(c) for c in (
            "step_ns", "compute_ns", "comm_ns", "comm_overlap_ns", "memcpy_ns", "memcpy_overlap_ns")],
        mean(F.col("comm_ns") - F.col("comm_overlap_ns")).alias("comm_exposed_ns"),
        mean(F.col("memcpy_ns") - F.col("memcpy_overlap_ns")).alias("memcpy_exposed_ns"))
    share = lambda part, whole: F.coalesce(percent(F.col(part), F.col(whole)), F.lit(0.0))
    return avg.join(streams.filter("_primary").drop("_primary"), "trace_id").withColumns({
        "comm_overlap_pct": share("comm_overlap_ns", "comm_ns"),
        "memcpy_overlap_pct": share("memcpy_overlap_ns", "memcpy_ns"),
        "comm_exposed_pct_of_step": share("comm_exposed_ns", "step_ns"),
        "memcpy_exposed_pct_of_step": share("memcpy_exposed_ns", "step_ns")})


def top_comm_kernels(t: TraceTables, k: int = 15) -> DataFrame:
    windows = overlap_windows(t)
    n = windows.groupBy("trace_id").agg(F.count(F.lit(1)).alias("_n"))
    ns = _ops_in_steps(t, windows).filter("stream_kind = 'comm'").groupBy("trace_id", "name").agg(
        wide_sum(F.col("op_end") - F.col("op_start")).alias("_ns"))
    rows = ns.join(n, "trace_id").select(
        "trace_id", "name", "_ns", (F.col("_ns").cast("double") / F.col("_n")).alias("dur_ns"))
    return top(rows, ["trace_id"], [F.col("_ns").desc(), F.col("name")], k).drop("_ns")


def kernel_call_stacks(events: DataFrame, top_table: DataFrame, k: int = 20) -> DataFrame:
    """Total time, count and a sample stack of the hot kernels that have one."""
    hot = top_table.filter(F.col("rank") <= k).select("trace_id", "name", "rank")
    has_stack = F.size(F.coalesce("stack_traces", F.array().cast("array<string>"))) > 0
    sample = F.min_by(F.when(has_stack, F.element_at("stack_traces", 1)), F.when(has_stack, F.col("idx")))
    stacks = (
        events.filter(F.col("cat") == "kernel").join(hot.select("trace_id", "name"), ["trace_id", "name"], "left_semi")
        .groupBy("trace_id", "name")
        .agg(sample.alias("stack"), F.sum(F.coalesce("dur_ns", _zero())).alias("total_ns"), F.count(F.lit(1)).alias("n_calls"))
        .filter("stack is not null")
    )
    return stacks.join(hot, ["trace_id", "name"])


def framework_kernels(
    top_table: DataFrame, stacks: DataFrame, marker: str, namespaces: Sequence[str], url: str
) -> DataFrame:
    """Hot kernels that belong to a framework by name or by sample stack, with a search link."""
    joined = top_table.join(stacks.select("trace_id", "name", "stack"), ["trace_id", "name"], "left")
    hit = F.lower("name").contains(marker) | F.lower(F.coalesce("stack", F.lit(""))).contains(marker)
    op = namespace_op(F.col("name"), namespaces)
    return joined.filter(hit).select(
        "trace_id", "name", "dur_ns", "n_calls", op.alias("op_name"), F.lit(url).alias("repo_url"),
        F.when(op.isNotNull(), F.concat(F.lit(url + "/search?search="), op, F.lit("&type=code"))).alias("search_url"))
