"""The sections of a trace report as one tidy table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.functions.labels import percent
from stepweave.operators import device, modules, trace_dims
from stepweave.plans.tables import TraceTables
from stepweave.session import materialize

COLUMNS = "trace_id, section, rank, label, value_ns, pct, extra"


def _rows(df: DataFrame, section: str, rank: Column, label: Column, value: Column, pct: Column, extra: Column) -> DataFrame:
    return df.select("trace_id", F.lit(section).alias("section"), rank.cast("bigint").alias("rank"), label.cast("string").alias("label"),
                     value.cast("double").alias("value_ns"), pct.cast("double").alias("pct"), extra.cast("string").alias("extra"))


def report_rows(t: TraceTables, max_level: int | None = None) -> DataFrame:
    """Every section with its own cut: steps, threads, modules, kernels, gaps, device/host, overlap."""
    none = F.lit(None)
    summary = t.summary
    step = summary.select("trace_id", F.col("step_dur_ns").alias("_step"))
    host = lambda df: df.join(step, "trace_id")
    parts = [_rows(summary, "overview", F.lit(1), F.lit("steps"), F.col("step_dur_ns"), none, F.col("n_steps"))]

    split = trace_dims.step_decomposition(t.events, t.threads)
    phases = split.select("trace_id", F.col("step_dur_ns").alias("_whole"), F.posexplode(F.array(*[
        F.struct(F.lit(n).alias("n"), F.col(f"{n}_dur_ns").alias("v")) for n in ("forward_backward", "optimize", "other")])).alias("p", "x"))
    parts.append(_rows(phases.filter("x.v is not null"), "step_split", F.col("p") + 1, F.col("x.n"), F.col("x.v"),
                       percent(F.col("x.v"), F.col("_whole")), none))
    parts.append(_rows(modules.worker_threads(t), "threads", F.col("rank"), F.concat_ws(":", "pid", "tid"), F.col("dur_ns"), none, F.col("role")))

    times = modules.module_times(modules.module_calls(t), summary)
    parts.append(_rows(modules.module_levels(times, max_level), "modules", F.col("rank"), F.concat_ws("|", "depth", "module"),
                       F.col("inclusive_ns"), F.col("inclusive_pct"), F.col("thread_tag")))

    line = device.device_timeline(t)
    parts.append(_rows(line, "device", F.lit(1), F.lit("kernel time"), F.col("kernel_ns"), F.col("utilization_pct"), F.col("n_kernels")))
    hot = materialize(device.top_kernels(t))
    best = device.hot_kernel_modules(hot, device.kernel_host_modules(t)).filter("module_rank = 1").select("trace_id", "name", "module")
    kernels = hot.join(best, ["trace_id", "name"]).join(line.select("trace_id", "device_step_ns"), "trace_id")
    parts.append(_rows(kernels, "kernels", F.col("rank"), F.col("name"), F.col("dur_ns"), percent(F.col("dur_ns"), F.col("device_step_ns")), F.col("module")))
    gaps = device.kernel_gaps(t)
    parts.append(_rows(device.top_gaps(gaps), "gaps", F.col("rank"), F.concat_ws(" > ", "before_name", "after_name"), F.col("gap_ns"), none, none))
    parts.append(_rows(device.gap_per_step(gaps, summary), "gap_total", F.lit(1), F.lit("gaps"), F.col("gap_ns"), none, F.col("n_gaps")))

    totals = device.device_host_totals(t)
    parts.append(_rows(host(totals.filter("grain <> 'name'")), "device_host", F.lit(1), F.concat_ws(":", "side", "key"), F.col("dur_ns"),
                       percent(F.col("dur_ns"), F.col("_step")), F.col("grain")))
    over = device.comm_compute_overlap(device.overlap_by_step(t), t.threads)
    for place, name in enumerate(("comm", "memcpy")):
        parts.append(_rows(over, "overlap", F.lit(place + 1), F.lit(name), F.col(f"{name}_exposed_ns"), F.col(f"{name}_exposed_pct_of_step"), none))
    return reduce(DataFrame.unionByName, parts)


def analysis_tables(t: TraceTables) -> dict[str, DataFrame]:
    """The tables of the JSON result: trace kind, steps, split, modules."""
    return {
        "trace": t.summary.join(trace_dims.trace_kind(t.events), "trace_id").join(trace_dims.enhanced_flags(t.events), "trace_id"),
        "step": t.steps,
        "step_split": trace_dims.step_decomposition(t.events, t.threads),
        "module": modules.module_times(modules.module_calls(t), t.summary),
        "top_kernel": device.top_kernels(t),
    }
