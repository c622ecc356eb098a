"""Column expressions over event names, durations and stack text."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from stepweave.schema import MODULE_PREFIX

# Name parts that mark a runtime wrapper module.
WRAPPER_KEYWORDS = (
    "DDP", "FSDP", "Runstep", "RunStep", "Sync", "Async",
    "Sequential", "Stream", "Pipeline", "Composition",
    "Wrapper", "Hang", "Read", "Recv", "Lookup", "FeedRuntime",
    "GlobalStep", "SetInput", "SetOutput", "Module:Main",
    "EmbeddingAllToAll", "FidAllToAll", "AllToAll",
    "AllReduce", "ReduceScatter", "AllGather",
    "SampleRate", "SizeTensor", "Dense", "Sparse",
    "Pool", "Split", "Multi", "PerStep",
)

# Name parts that mark a layer of the user's model.
BUSINESS_KEYWORDS = (
    "Transformer", "Attention", "Encoder", "Decoder",
    "MLP", "Linear", "Conv", "BatchNorm", "LayerNorm",
    "Embedding", "Block", "Head", "Loss", "Activation",
    "Perceiver", "Bottom", "Tower",
)

# Fixed value: one frame of a Python stack as the profiler prints it.
FRAME_PATTERN = r'File "([^"]+)", line (\d+), in (\w+)'

# Digits shown for seconds, milliseconds and microseconds.
REPORT_DIGITS = (3, 3, 2)
SWIMLANE_DIGITS = (3, 2, 1)


def phase_of_label(name: Column) -> Column:
    """forward / backward / optimize by the words in a label, else NULL."""
    low = F.lower(name)
    word = lambda w: low.rlike(f"(^|[^a-z]){w}([^a-z]|$)")
    return (
        F.when(low.contains("optimize") | low.contains("optimizer.step"), "optimize")
        .when(word("backward"), "backward")
        .when(word("forward"), "forward")
    )


def is_backward_stack(traces: Column) -> Column:
    hit = F.exists(traces, lambda t: t.contains("Gradient") | t.contains("Backward") | t.contains("backward"))
    return F.coalesce(hit, F.lit(False))


def runtime_name(name: Column) -> Column:
    """Module event name without its prefix and without ``, callsite: N``."""
    bare = F.replace(F.replace(name, F.lit("nn.Module: "), F.lit("")), F.lit(MODULE_PREFIX), F.lit(""))
    return F.trim(F.regexp_replace(bare, r",\s*callsite:\s*\d+", ""))


def runtime_module(name: Column) -> Column:
    """Struct runtime_name, class_name, runtime_index, callsite of a module event name."""
    short = runtime_name(name)
    number = lambda text: F.when(text != "", text.cast("bigint"))
    base = F.regexp_replace(short, r"_\d+$", "")
    return F.struct(
        short.alias("runtime_name"),
        F.regexp_replace(base, "^(FSDP|DDP|DistributedDataParallel|Wrapped)", "").alias("class_name"),
        number(F.regexp_extract(short, r"_(\d+)$", 1)).alias("runtime_index"),
        number(F.regexp_extract(name, r",\s*callsite:\s*(\d+)", 1)).alias("callsite"),
    )


def module_label(name: Column) -> Column:
    """Module name without prefix and callsite; NULL when the event is not a module."""
    rest = F.trim(name.substr(F.lit(len(MODULE_PREFIX) + 1), F.length(name)))
    return F.when(name.startswith(MODULE_PREFIX), F.trim(F.split(rest, r",\s*callsite", 2)[0]))


def _has_any(text: Column, words: Sequence[str]) -> Column:
    """Plain search without regard to case."""
    return reduce(Column.__or__, [F.lower(text).contains(w.lower()) for w in words], F.lit(False))


def is_wrapper(
    label: Column,
    wrappers: Sequence[str] = WRAPPER_KEYWORDS,
    business: Sequence[str] = BUSINESS_KEYWORDS,
) -> Column:
    base = F.regexp_replace(label, r"_\d+$", "")
    return ~_has_any(base, business) & (_has_any(base, wrappers) | base.endswith("Module"))


def duration_text(us: Column, digits: Sequence[int] = REPORT_DIGITS) -> Column:
    s, ms, u = digits
    us = us.cast("double")
    return (
        F.when(us >= 1e6, F.format_string(f"%.{s}f s", us / 1e6))
        .when(us >= 1e3, F.format_string(f"%.{ms}f ms", us / 1e3))
        .otherwise(F.format_string(f"%.{u}f us", us))
    )


def percent(part: Column, total: Column) -> Column:
    """part / total in percent; NULL when the total is not positive."""
    return F.when(total > 0, part.cast("double") / total.cast("double") * 100)


def wide_sum(column: Column | str) -> Column:
    """Exact sum of whole numbers as a decimal: long times of many events leave 64 bits."""
    return F.sum((F.col(column) if isinstance(column, str) else column).cast("decimal(20,0)"))


def thread_tag(roles: Column) -> Column:
    has = lambda r: F.array_contains(roles, r)
    return (
        F.when(has("worker_thread") & ~has("main_thread"), "worker")
        .when(has("main_thread"), "main")
        .when(has("autograd_thread"), "autograd")
        .otherwise("other")
    )


def namespace_op(name: Column, namespaces: Sequence[str]) -> Column:
    """Operator behind ``namespace::`` in a kernel name, else NULL."""
    op = F.regexp_extract(name, "(?:" + "|".join(namespaces) + r")::(\w+)", 1)
    return F.when(op != "", op)
