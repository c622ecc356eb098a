"""Host-side module time: by name, by level and by thread; worker threads; per-thread timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave.functions.labels import percent, thread_tag
from stepweave.operators.device import top
from stepweave.operators.nesting import is_module_event
from stepweave.operators.trace_dims import clipped_in_steps
from stepweave.plans.tables import TraceTables
from stepweave.schema import DEVICE_CATS, THREAD_KEY
from stepweave.session import materialize

def _zero() -> Column:
    return F.lit(0).cast("bigint")


def module_calls(t: TraceTables) -> DataFrame:
    """Module events of the CPU process with clipped time, parent module name and thread role."""
    mods = t.events.filter(is_module_event()).select(*THREAD_KEY, "idx", "name", "ts_ns", "dur_ns")
    mods = mods.join(t.threads.filter("role is not null").select(*THREAD_KEY, "role"), list(THREAD_KEY))
    mods = mods.join(t.parents.select("trace_id", "idx", "module_idx"), ["trace_id", "idx"], "left")
    names = mods.select("trace_id", F.col("idx").alias("module_idx"), F.col("name").alias("parent_name"))
    return clipped_in_steps(mods.join(names, ["trace_id", "module_idx"], "left"), t.steps)


def module_times(calls: DataFrame, summary: DataFrame) -> DataFrame:
    """By module name: inclusive and exclusive time per step, calls, threads, roles, parent, depth.

    The parent is the one of the last call.  The exclusive time subtracts every name ever seen
    as a child, so a name with several parents is subtracted from each of them.
    """
    by_name = calls.groupBy("trace_id", "name").agg(
        F.sum("clipped_ns").alias("_ns"), F.count(F.lit(1)).alias("n_calls"),
        F.max_by(F.coalesce("parent_name", F.lit("ROOT")), "idx").alias("parent"),
        F.count_distinct("pid", "tid").alias("n_threads"),
        F.array_sort(F.collect_set("role")).alias("roles"))
    links = calls.filter("parent_name is not null").select(
        "trace_id", F.col("parent_name").alias("name"), F.col("name").alias("child")).distinct()
    child_ns = by_name.select("trace_id", F.col("name").alias("child"), F.col("_ns").alias("_c"))
    below = links.join(child_ns, ["trace_id", "child"]).groupBy("trace_id", "name").agg(
        F.sum("_c").alias("_below"), F.count(F.lit(1)).alias("n_children"))
    n = F.greatest(F.col("n_steps"), F.lit(1))
    out = (
        by_name.join(below, ["trace_id", "name"], "left").join(summary, "trace_id")
        .withColumn("_excl", F.greatest(_zero(), F.col("_ns") - F.coalesce("_below", _zero())))
        .select("trace_id", "name", "parent", (F.col("_ns").cast("double") / n).alias("inclusive_ns"),
                (F.col("_excl").cast("double") / n).alias("exclusive_ns"), "n_calls", "n_threads",
                F.coalesce("n_children", _zero()).alias("n_children"), "roles", "step_dur_ns")
    )
    return name_depths(out)


def event_exclusive(calls: DataFrame) -> DataFrame:
    """Exclusive time per call: what its direct child calls leave over.

    Unlike the figure by name, a child counts only against the call it ran in.
    """
    below = calls.filter("module_idx is not null").groupBy("trace_id", F.col("module_idx").alias("idx")).agg(
        F.sum("clipped_ns").alias("_below"))
    return calls.join(below, ["trace_id", "idx"], "left").select(
        "trace_id", "idx", "name", F.col("clipped_ns").alias("inclusive_ns"),
        F.greatest(_zero(), F.col("clipped_ns") - F.coalesce("_below", _zero())).alias("exclusive_ns"))


def name_depths(table: DataFrame) -> DataFrame:
    """Add ``depth`` along ``parent`` (ROOT children are 0); names on a cycle get NULL.

    Works by doubling: each round looks twice as far up.  A table of names is small next to
    the events it comes from; names still unresolved after 2^rounds > name count are cyclic.
    """
    table = materialize(table)
    up = table.select("trace_id", "name", F.when(F.col("parent") != "ROOT", F.col("parent")).alias("up"),
                      F.lit(0).cast("bigint").alias("depth"))
    up = up.withColumn("depth", F.when(F.col("up").isNotNull(), F.lit(1).cast("bigint")).otherwise(F.col("depth")))
    most = table.groupBy("trace_id").count().agg(F.max("count").alias("m")).first()["m"] or 1
    reach = 1
    while reach <= most and not up.filter("up is not null").isEmpty():
        nxt = up.select("trace_id", F.col("name").alias("up"), F.col("up").alias("_up2"), F.col("depth").alias("_d2"))
        up = materialize(up.join(nxt, ["trace_id", "up"], "left").select(
            "trace_id", "name", F.col("_up2").alias("up"),
            (F.col("depth") + F.coalesce("_d2", _zero())).alias("depth")))
        reach *= 2
    depths = up.select("trace_id", "name", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))
    return table.join(depths, ["trace_id", "name"])


def module_levels(times: DataFrame, max_level: int | None = None) -> DataFrame:
    """Modules level by level, longest first, with percentages of the step and a thread tag."""
    rows = times if max_level is None else times.filter(F.col("depth") <= max_level)
    w = Window.partitionBy("trace_id", "depth").orderBy(F.col("inclusive_ns").desc(), "name")
    return rows.filter("depth is not null").select(
        "trace_id", "depth", F.row_number().over(w).cast("bigint").alias("rank"),
        F.replace(F.col("name"), F.lit("nn.Module: "), F.lit("")).alias("module"),
        thread_tag(F.col("roles")).alias("thread_tag"), "inclusive_ns", "exclusive_ns",
        percent(F.col("inclusive_ns"), F.col("step_dur_ns")).alias("inclusive_pct"),
        percent(F.col("exclusive_ns"), F.col("step_dur_ns")).alias("exclusive_pct"), "n_calls")


def module_role_counts(calls: DataFrame) -> DataFrame:
    return calls.groupBy("trace_id").agg(
        F.count_if(F.col("role") == "main_thread").alias("n_main_calls"),
        F.count_if(F.col("role") == "worker_thread").alias("n_worker_calls"))


def worker_threads(t: TraceTables) -> DataFrame:
    """Worker and autograd threads by total time, with the names of their modules."""
    workers = t.threads.filter(F.col("role").isin("worker_thread", "autograd_thread"))
    names = (
        t.events.filter(is_module_event())
        .select(*THREAD_KEY, F.replace(F.col("name"), F.lit("nn.Module: "), F.lit("")).alias("m")).distinct()
        .groupBy(*THREAD_KEY).agg(F.array_join(F.array_sort(F.collect_set("m")), "; ").alias("modules"),
                                  F.count(F.lit(1)).alias("n_modules"))
    )
    w = Window.partitionBy("trace_id").orderBy(F.col("dur_ns").desc(), "first_idx")
    return workers.join(names, list(THREAD_KEY), "left").select(
        *THREAD_KEY, "thread_name", "role", "n_events", "dur_ns",
        F.coalesce("modules", F.lit("")).alias("modules"), F.coalesce("n_modules", _zero()).alias("n_modules"),
        F.row_number().over(w).cast("bigint").alias("rank"))


# Thread start-up code that is not worth reporting.
_THREADING = ("threading.py", "concurrent/futures")


def worker_functions(t: TraceTables, longest: int = 10, shown: int = 5) -> DataFrame:
    """Python functions among the longest events of each worker thread."""
    workers = t.threads.filter(F.col("role").isin("worker_thread", "autograd_thread")).select(*THREAD_KEY)
    long_ones = t.events.filter((F.col("ph") == "X") & (F.col("dur_ns") > 1_000_000)).select(
        *THREAD_KEY, "idx", "cat", "name", "dur_ns").join(workers, list(THREAD_KEY), "left_semi")
    order = [F.col("dur_ns").desc(), F.col("idx")]
    first = top(long_ones, THREAD_KEY, order, longest, "_r").filter(
        (F.col("cat") == "python_function") & ~is_module_event())
    for part in _THREADING:
        first = first.filter(~F.col("name").contains(part))
    return top(first, THREAD_KEY, order, shown).select(*THREAD_KEY, "rank", "name", "dur_ns")


def thread_timelines(t: TraceTables) -> DataFrame:
    """Longest events of each lane: main thread, primary stream, busy streams, workers."""
    th = t.threads
    worker = th.role.isin("worker_thread", "autograd_thread")
    pick = lambda cond, kind, k: F.when(cond, F.struct(F.lit(kind).alias("kind"), F.lit(k).alias("k")))
    lanes = th.withColumn("_lanes", F.array_compact(F.array(
        pick(th.is_reported_main, "main_thread", 20),
        pick(th.is_primary_stream, "gpu_primary_stream", 20),
        pick(~th.is_primary_stream & (th.stream_ops >= 10), "gpu_stream", 10),
        pick(worker, "worker", 10),
    ))).select(*THREAD_KEY, "role", F.explode("_lanes").alias("_l")).select(
        *THREAD_KEY, "role", F.col("_l.kind").alias("lane_kind"), F.col("_l.k").alias("_k"))
    spans = t.events.filter(F.col("ph") == "X").select(
        *THREAD_KEY, "idx", "cat", "name", "ts_ns", F.coalesce("dur_ns", _zero()).alias("dur_ns"))
    long_enough = F.col("dur_ns") > 500_000
    wanted = (
        ((F.col("lane_kind") == "main_thread") & long_enough
         & F.col("cat").isin("python_function", "cpu_op", "user_annotation"))
        | ((F.col("lane_kind") == "gpu_primary_stream") & F.col("cat").isin(*DEVICE_CATS, "gpu_user_annotation"))
        | ((F.col("lane_kind") == "gpu_stream") & F.col("cat").isin(*DEVICE_CATS))
        | ((F.col("lane_kind") == "worker") & long_enough))
    rows = spans.join(lanes, list(THREAD_KEY)).filter(wanted)
    lane_key = [*THREAD_KEY, "lane_kind"]
    totals = rows.groupBy(*lane_key).agg(F.count(F.lit(1)).alias("total_events"))
    best = top(rows, lane_key, [F.col("dur_ns").desc(), F.col("ts_ns"), F.col("idx")], 20).filter("rank <= _k")
    best = best.join(t.parents.select("trace_id", "idx", "parent_idx"), ["trace_id", "idx"], "left")
    is_top = F.when(F.col("lane_kind") == "main_thread",
                    F.col("parent_idx").isNull() | (F.col("dur_ns") > 10_000_000))
    return best.join(totals, lane_key).select(
        *lane_key, "rank", "name", "cat", "ts_ns", "dur_ns", is_top.alias("is_top"), "total_events")
