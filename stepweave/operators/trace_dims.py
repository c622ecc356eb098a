"""Small per-trace tables: kind of trace, names, steps, threads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave.operators.nesting import is_module_event
from stepweave.schema import DEVICE_CATS, THREAD_KEY

RUNNER_PREFIX = "train_runner.py"
STEP_LABEL = "ProfilerStep"


def trace_kind(events: DataFrame) -> DataFrame:
    """training when there are forward/backward flows or "backward" host events."""
    backward = F.col("cat").isin("cpu_op", "python_function") & F.lower("name").contains("backward")
    trains = F.coalesce((F.col("cat") == "fwdbwd") | backward, F.lit(False))
    return events.groupBy("trace_id").agg(
        F.when(F.bool_or(trains), "training").otherwise("inference").alias("kind"))


def enhanced_flags(events: DataFrame) -> DataFrame:
    located = (F.col("ph") == "M") & (F.col("name") == "thread_name") & F.col("arg_name").contains("Code Location")
    stacked = (F.col("cat") == "kernel") & F.col("stack_traces").isNotNull()
    flag = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    return events.groupBy("trace_id").agg(
        flag(located).alias("has_code_location"), flag(stacked).alias("has_stack_traces"))


def thread_names(events: DataFrame) -> DataFrame:
    """Last name given to each thread."""
    return (
        events.filter((F.col("ph") == "M") & (F.col("name") == "thread_name"))
        .groupBy(*THREAD_KEY).agg(F.max_by(F.coalesce("arg_name", F.lit("")), "idx").alias("thread_name"))
    )


def process_labels(events: DataFrame) -> DataFrame:
    """Last label of each process, and where the process was first labelled."""
    return (
        events.filter((F.col("ph") == "M") & (F.col("name") == "process_labels"))
        .groupBy("trace_id", "pid")
        .agg(F.max_by(F.coalesce("arg_labels", F.lit("")), "idx").alias("label"), F.min("idx").alias("first_idx"))
    )


# ---------------------------------------------------------------- steps

def is_step() -> Column:
    return (F.col("cat") == "user_annotation") & (F.col("ph") == "X") & F.col("name").contains(STEP_LABEL)


def steps(events: DataFrame) -> DataFrame:
    """Profiler steps of each trace in time order."""
    dur = F.coalesce("dur_ns", F.lit(0).cast("bigint"))
    order = Window.partitionBy("trace_id").orderBy("ts_ns", "idx")
    return events.filter(is_step()).select(
        "trace_id", (F.row_number().over(order) - 1).cast("bigint").alias("step_no"),
        F.col("name").alias("step_name"), "ts_ns", (F.col("ts_ns") + dur).alias("end_ns"), dur.alias("dur_ns"))


def step_summary(events: DataFrame) -> DataFrame:
    """Number of steps and mean step time, with fallbacks for traces without steps."""
    dur = F.coalesce("dur_ns", F.lit(0).cast("bigint"))
    full = F.col("ph") == "X"
    a = events.groupBy("trace_id").agg(
        F.count_if(is_step()).alias("n_steps"),
        F.sum(F.when(is_step(), dur)).alias("_total"),
        F.min_by(F.when(F.col("cat") == "Trace", dur), F.when(F.col("cat") == "Trace", F.col("idx"))).alias("_trace"),
        (F.max(F.when(full, F.col("ts_ns") + dur)) - F.min(F.when(full, F.col("ts_ns")))).alias("_span"),
    )
    mean = F.col("_total").cast("double") / F.col("n_steps")
    whole = F.when(F.col("_trace") != 0, F.col("_trace"))
    return a.select(
        "trace_id", "n_steps",
        F.when(F.col("n_steps") > 0, mean)
        .otherwise(F.coalesce(whole, "_span", F.lit(0)).cast("double")).alias("step_dur_ns"))


def choose_step(all_steps: DataFrame, step_no: int | None = None) -> DataFrame:
    """One step per trace: the given number, or the upper median by duration."""
    if step_no is not None:
        return all_steps.filter(F.col("step_no") == step_no)
    by_dur = Window.partitionBy("trace_id").orderBy("dur_ns", "step_no")
    size = Window.partitionBy("trace_id")
    return (
        all_steps.withColumn("_rank", F.row_number().over(by_dur) - 1)
        .withColumn("_n", F.count(F.lit(1)).over(size))
        .filter(F.expr("_rank = _n div 2")).drop("_rank", "_n")
    )


def device_steps(events: DataFrame, threads: DataFrame) -> DataFrame:
    """Step windows recorded on the primary stream of each trace."""
    primary = threads.filter("is_primary_stream").select(*THREAD_KEY)
    dur = F.coalesce("dur_ns", F.lit(0).cast("bigint"))
    order = Window.partitionBy("trace_id").orderBy("ts_ns", "idx")
    marks = events.filter((F.col("cat") == "gpu_user_annotation") & F.col("name").contains(STEP_LABEL))
    return marks.join(primary, list(THREAD_KEY), "left_semi").select(
        "trace_id", (F.row_number().over(order) - 1).cast("bigint").alias("step_no"),
        F.col("name").alias("step_name"), "ts_ns", (F.col("ts_ns") + dur).alias("end_ns"), dur.alias("dur_ns"))


def step_at_start(events: DataFrame, all_steps: DataFrame) -> DataFrame:
    """First step whose half-open window contains the start of the event (NULL if none).

    Steps may overlap and the first one wins, so step *i* only takes starts after the ends
    of all steps before it.  These windows are disjoint: an event matches at most one, and
    a left join on (trace, time bin) needs no second pass over the events.
    """
    before = Window.partitionBy("trace_id").orderBy("ts_ns", "step_no").rowsBetween(Window.unboundedPreceding, -1)
    windows = all_steps.select(
        "trace_id", "step_no", F.col("ts_ns").alias("step_start"), F.col("end_ns").alias("step_end"),
        F.greatest("ts_ns", F.max("end_ns").over(before)).alias("_from"))
    width = windows.groupBy("trace_id").agg(
        F.ceil(F.log2(F.greatest(F.avg(F.col("step_end") - F.col("step_start")), F.lit(1.0)))).cast("int").alias("_level"))
    bins = windows.filter("_from < step_end").join(width, "trace_id").withColumn(
        "_bin", F.explode(F.expr("sequence(shiftright(_from, _level), shiftright(step_end, _level))"))
    ).drop("_level").withColumnRenamed("trace_id", "_trace")
    e = events.join(width, "trace_id", "left").withColumn("has_steps", F.col("_level").isNotNull()).withColumn(
        "_at", F.expr("shiftright(ts_ns, _level)"))
    inside = (
        (F.col("trace_id") == F.col("_trace")) & (F.col("_at") == F.col("_bin"))
        & (F.col("ts_ns") >= F.col("_from")) & (F.col("ts_ns") < F.col("step_end")))
    return e.join(bins, inside, "left").drop("_level", "_at", "_trace", "_bin", "_from")


def clipped_in_steps(events: DataFrame, all_steps: DataFrame) -> DataFrame:
    """Add ``clipped_ns``: duration cut to the own step, 0 outside every step.

    In a trace without any step the whole duration counts.
    """
    zero = F.lit(0).cast("bigint")
    dur = F.coalesce("dur_ns", zero)
    end = F.least(F.col("ts_ns") + dur, F.col("step_end"))
    inside = F.when(F.col("step_end").isNull(), zero).otherwise(F.greatest(zero, end - F.col("ts_ns")))
    placed = step_at_start(events, all_steps)
    return placed.withColumn("clipped_ns", F.when(F.col("has_steps"), inside).otherwise(dur)).drop("has_steps")


# ---------------------------------------------------------------- threads

def _main_threads(events: DataFrame, runner_prefix: str) -> DataFrame:
    """Per trace: thread of the first forward_backward call and of the first long step call."""
    thread = F.struct("pid", "tid")
    fb = (F.col("cat") == "python_function") & F.col("name").contains("forward_backward")
    step = (
        F.col("name").startswith(runner_prefix) & F.col("name").contains("step") & (F.col("dur_ns") > 100_000_000))
    first = lambda cond: F.min_by(F.when(cond, thread), F.when(cond, F.col("idx")))
    return (
        events.filter(fb | step).groupBy("trace_id")
        .agg(first(fb).alias("fb_thread"), first(step).alias("step_thread"))
    )


def threads(events: DataFrame, runner_prefix: str = RUNNER_PREFIX) -> DataFrame:
    """One row per thread with events: counts, time, role, and which stream is primary."""
    dur = F.coalesce("dur_ns", F.lit(0).cast("bigint"))
    count = lambda cat: F.count_if(F.col("cat") == cat)
    stats = events.filter(F.col("ph") == "X").groupBy(*THREAD_KEY).agg(
        F.count(F.lit(1)).alias("n_events"), F.sum(dur).alias("dur_ns"),
        F.count_if(F.col("cat").isin(*DEVICE_CATS)).alias("n_device_ops"),
        count("gpu_memcpy").alias("n_memcpy"),
        F.count_if((F.col("cat") == "kernel") & F.lower("name").contains("nccl")).alias("n_nccl"),
        F.bool_or(is_module_event()).alias("has_modules"), F.min("idx").alias("first_idx"))
    labels = process_labels(events)
    cpu = labels.filter(F.col("label").contains("CPU")).groupBy("trace_id").agg(
        F.max_by("pid", "first_idx").alias("cpu_pid"))
    device = labels.filter(
        ~F.col("label").contains("CPU") & (F.col("label").contains("GPU") | F.col("label").contains("MLU"))
    ).select("trace_id", "pid", F.lit(True).alias("is_device"))
    t = (
        stats.join(thread_names(events), list(THREAD_KEY), "left")
        .join(cpu, "trace_id", "left")
        .join(device, ["trace_id", "pid"], "left")
        .join(_main_threads(events, runner_prefix), "trace_id", "left")
    )
    me = F.struct("pid", "tid")
    is_main = F.coalesce(me == F.col("fb_thread"), F.lit(False)) | F.coalesce(me == F.col("step_thread"), F.lit(False))
    role = F.when(F.col("pid") == F.col("cpu_pid"), F.when(is_main, "main_thread")
                  .when(F.coalesce(F.col("thread_name").contains("pt_autograd"), F.lit(False)), "autograd_thread")
                  .when(F.col("n_events") > 10, "worker_thread").otherwise("other"))
    stream_ops = F.when(F.coalesce("is_device", F.lit(False)) & (F.col("n_device_ops") > 0), F.col("n_device_ops"))
    busiest = Window.partitionBy("trace_id").orderBy(F.col("stream_ops").desc_nulls_last(), "first_idx")
    return (
        t.withColumns({"role": role, "stream_ops": stream_ops})
        .withColumn("is_primary_stream", F.col("stream_ops").isNotNull() & (F.row_number().over(busiest) == 1))
        .withColumn("stream_kind", F.when(F.col("stream_ops").isNotNull(),
                    F.when(F.col("is_primary_stream"), "compute").when(F.col("n_nccl") > 0, "comm")
                    .when(F.col("n_memcpy") > 0, "memcpy")))
        .withColumn("is_reported_main", F.coalesce(me == F.coalesce("fb_thread", "step_thread"), F.lit(False)))
        .select(*THREAD_KEY, F.coalesce("thread_name", F.lit("")).alias("thread_name"), "role", "n_events", "dur_ns",
                "has_modules", "stream_ops", "is_primary_stream", "stream_kind", "is_reported_main", "first_idx")
    )


def step_decomposition(events: DataFrame, thread_table: DataFrame, runner_prefix: str = RUNNER_PREFIX) -> DataFrame:
    """Mean step / forward_backward / optimize time on the main thread, and the remainder."""
    main = thread_table.filter("is_reported_main").select(*THREAD_KEY)
    calls = events.filter(F.col("cat") == "python_function").join(main, list(THREAD_KEY), "left_semi")
    runner = F.col("name").startswith(runner_prefix)
    kinds = {
        "step_dur_ns": runner & F.col("name").contains("step") & (F.col("dur_ns") > 100_000_000),
        "forward_backward_dur_ns": F.col("name").contains("forward_backward"),
        "optimize_dur_ns": runner & F.col("name").contains("optimize") & (F.col("dur_ns") > 1_000_000),
    }
    dur = F.coalesce("dur_ns", F.lit(0).cast("bigint"))
    mean = lambda cond: F.sum(F.when(cond, dur)).cast("double") / F.nullif(F.count_if(cond), F.lit(0))
    out = calls.groupBy("trace_id").agg(*[mean(c).alias(n) for n, c in kinds.items()])
    return out.withColumn(
        "other_dur_ns", F.col("step_dur_ns") - F.col("forward_backward_dur_ns") - F.col("optimize_dur_ns"))
