"""Python stacks of kernels: frames, source spans and time per source line, class and method.

The same stack text comes back for many kernels.  Each distinct text is parsed once and
known by its SHA-256; kernels refer to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave.functions.labels import FRAME_PATTERN, is_backward_stack
from stepweave.operators.device import top
from stepweave.operators.intervals import join_points_to_intervals


def stack_key(text: Column) -> Column:
    return F.sha2(text, 256)


def kernel_stacks(events: DataFrame) -> DataFrame:
    """One row per kernel and recorded stack."""
    return events.filter("cat = 'kernel'").select(
        "trace_id", "idx", F.posexplode("stack_traces").alias("trace_no", "stack")).select(
        "trace_id", "idx", F.col("trace_no").cast("bigint").alias("trace_no"), stack_key(F.col("stack")).alias("stack_key"))


def distinct_stacks(events: DataFrame) -> DataFrame:
    texts = events.filter("cat = 'kernel'").select(F.explode("stack_traces").alias("stack"))
    return texts.distinct().withColumn("stack_key", stack_key(F.col("stack")))


def stack_frames(stacks: DataFrame) -> DataFrame:
    """Frames of each stack text, outermost first; lines that are not frames drop out."""
    lines = stacks.select("stack_key", F.posexplode(F.split("stack", "\n")).alias("frame_no", "text"))
    part = lambda g: F.regexp_extract("text", FRAME_PATTERN, g)
    return lines.filter(F.col("text").rlike(FRAME_PATTERN)).select(
        "stack_key", F.col("frame_no").cast("bigint").alias("frame_no"), part(1).alias("path"),
        F.element_at(F.split(part(1), "/"), -1).alias("file"), part(2).cast("bigint").alias("line"), part(3).alias("func"))


def user_frames(frames: DataFrame, sources: DataFrame) -> DataFrame:
    """Frames in files of the user's sources (``sources`` has ``basename``)."""
    own = sources.select(F.col("basename").alias("file")).distinct()
    return frames.join(own, "file", "left_semi")


def locate_lines(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """First class, then first method in it, whose span contains each distinct (file, line)."""
    points = lines.select("file", "line").distinct()
    classes = spans.filter("method is null").select("file", "class", "start_line", "end_line", "ord")
    in_class = join_points_to_intervals(points, classes, ["file"], "line", "start_line", "end_line", closed_end=True)
    first = in_class.groupBy("file", "line").agg(
        F.min_by(F.struct("class", F.col("start_line").alias("class_start")), "ord").alias("_c")
    ).select("file", "line", "_c.*")
    methods = spans.filter("method is not null").select("file", "class", "method", "start_line", "end_line", "ord")
    in_method = join_points_to_intervals(
        first.select("file", "class", "line"), methods, ["file", "class"], "line", "start_line", "end_line",
        closed_end=True,
    ).groupBy("file", "class", "line").agg(F.min_by("method", "ord").alias("method"))
    return first.join(in_method, ["file", "class", "line"], "left")


def source_hotspots(events: DataFrame, spans: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """Kernel time by source line, class and method, split into forward and backward; ``frames``: those of all stacks, if known.

    A kernel with n stacks gives dur/n to each distinct key, once per kernel however many
    of its stacks name it.  Kernels with the same set of stacks are summed before any
    stack is opened.
    """
    kernels = events.filter(F.col("cat") == "kernel").filter(F.size("stack_traces") > 0)
    sets = kernels.select(
        "trace_id", F.coalesce("dur_ns", F.lit(0)).alias("dur_ns"),
        F.when(is_backward_stack(F.col("stack_traces")), "bwd").otherwise("fwd").alias("phase"),
        F.size("stack_traces").alias("n_stacks"),
        F.array_sort(F.array_distinct(F.transform("stack_traces", stack_key))).alias("stack_set"),
    ).groupBy("trace_id", "phase", "n_stacks", "stack_set").agg(F.sum("dur_ns").alias("dur_ns"))
    frames = (stack_frames(distinct_stacks(events)) if frames is None else frames).select("stack_key", "file", "line").distinct()
    where = frames.join(locate_lines(frames, spans), ["file", "line"], "left")
    cls = F.concat_ws(":", "file", "class")
    key = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("key"))
    keys = where.select("stack_key", F.explode(F.array_compact(F.array(
        key("line", F.concat_ws(":", "file", "line")),
        F.when(F.col("class").isNotNull(), key("class", cls)),
        F.when(F.col("method").isNotNull(), key("method", F.concat_ws(".", cls, "method"))),
    ))).alias("k")).select("stack_key", "k.*").distinct()
    share = F.col("dur_ns").cast("double") / F.col("n_stacks")
    once = (
        sets.select("trace_id", "phase", "n_stacks", "stack_set", "dur_ns", F.explode("stack_set").alias("stack_key"))
        .join(keys, "stack_key")
        .groupBy("trace_id", "phase", "n_stacks", "stack_set", "kind", "key").agg(F.first("dur_ns").alias("dur_ns"))
    )
    sums = lambda p: F.coalesce(F.sum(F.when(F.col("phase") == p, share)), F.lit(0.0)).alias(f"{p}_ns")
    return once.groupBy("trace_id", "kind", "key").agg(sums("fwd"), sums("bwd"))


def kernel_time(events: DataFrame) -> DataFrame:
    return events.filter("cat = 'kernel'").groupBy("trace_id").agg(
        F.sum(F.coalesce("dur_ns", F.lit(0))).alias("kernel_ns"))


def hot_sources(hotspots: DataFrame, kind: str, k: int) -> DataFrame:
    total = F.col("fwd_ns") + F.col("bwd_ns")
    return top(hotspots.filter(F.col("kind") == kind).withColumn("total_ns", total), ["trace_id"],
               [F.col("total_ns").desc(), F.col("key")], k)


def hot_lines_of_classes(hotspots: DataFrame, spans: DataFrame, classes: int = 5, lines: int = 10) -> DataFrame:
    """Hottest lines of the hottest classes."""
    where = F.split("key", ":")
    line = hotspots.filter("kind = 'line'").select(
        "trace_id", where[0].alias("file"), where[1].cast("bigint").alias("line"), "fwd_ns", "bwd_ns")
    line = line.join(locate_lines(line, spans), ["file", "line"]).withColumn(
        "class_key", F.concat_ws(":", "file", "class")).withColumn("total_ns", F.col("fwd_ns") + F.col("bwd_ns"))
    hot = hot_sources(hotspots, "class", classes).select("trace_id", F.col("key").alias("class_key"))
    kept = line.join(hot, ["trace_id", "class_key"], "left_semi")
    return top(kept, ["trace_id", "class_key"], [F.col("total_ns").desc(), F.col("line")], lines).select(
        "trace_id", "class_key", "rank", "line", "method", "total_ns", "fwd_ns", "bwd_ns")


def kernel_source_classes(events: DataFrame, spans: DataFrame) -> DataFrame:
    """Time of each kernel name by the innermost user class of its stacks."""
    frames = stack_frames(distinct_stacks(events)).filter(
        ~F.col("path").contains("site-packages") & ~F.col("path").contains("/usr/"))
    leaf = frames.join(locate_lines(frames, spans), ["file", "line"]).groupBy("stack_key").agg(
        F.max_by("class", "frame_no").alias("class"))
    uses = events.filter("cat = 'kernel'").select(
        "trace_id", "name", F.coalesce("dur_ns", F.lit(0)).alias("dur_ns"), F.size("stack_traces").alias("n"),
        F.explode(F.transform("stack_traces", stack_key)).alias("stack_key"))
    summed = uses.groupBy("trace_id", "name", "n", "stack_key").agg(F.sum("dur_ns").alias("dur_ns"))
    return summed.join(leaf, "stack_key").groupBy("trace_id", "name", "class").agg(
        F.sum(F.col("dur_ns").cast("double") / F.col("n")).alias("dur_ns"))


def enriched_kernel_modules(hot_modules: DataFrame, source_classes: DataFrame) -> DataFrame:
    """Modules of the hot kernels, replaced by source classes where the stacks name any."""
    named = source_classes.select("trace_id", "name").distinct().withColumn("_named", F.lit(True))
    host = hot_modules.join(named, ["trace_id", "name"], "left").filter("_named is null").select(
        "trace_id", "name", "module", F.col("dur_ns").cast("double").alias("dur_ns"), F.lit("host").alias("source"))
    hot = hot_modules.select("trace_id", "name").distinct()
    own = source_classes.join(hot, ["trace_id", "name"], "left_semi").select(
        "trace_id", "name", F.col("class").alias("module"), "dur_ns", F.lit("stack").alias("source"))
    return host.unionByName(own)


# ---------------------------------------------------------------- instances

def instance_keys(frames: DataFrame, spans: DataFrame) -> DataFrame:
    """Instances a stack passes through, outermost first.

    ``frames`` are user frames.  Each change of class along the stack enters an instance; it is
    known by its class, the frame that called it and the calls above that.  A stack that
    starts inside a class enters it from ``<root>`` at the first line of the class.
    A window covers one stack, whose depth the interpreter bounds.
    """
    placed = frames.join(
        locate_lines(frames, spans).select("file", "line", "class", "class_start"), ["file", "line"], "left")
    w = Window.partitionBy("stack_key").orderBy("frame_no")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumns({
        "_before": F.last("class", ignorenulls=True).over(past),
        "_from_file": F.lag("file").over(w), "_from_line": F.lag("line").over(w)})
    enters = F.col("class").isNotNull() & (F.col("_before").isNull() | (F.col("class") != F.col("_before")))
    site = F.struct(
        F.coalesce("_from_file", F.lit("<root>")).alias("file"),
        F.when(F.col("_from_file").isNotNull(), F.col("_from_line")).otherwise(F.col("class_start")).alias("line"))
    entered = placed.withColumn("_site", F.when(enters, site))
    return entered.withColumn("ancestors", F.collect_list("_site").over(past)).filter("_site is not null").select(
        "stack_key", "frame_no", "class", F.col("_site.file").alias("site_file"), F.col("_site.line").alias("site_line"),
        "ancestors")


def leaf_instances(keys: DataFrame) -> DataFrame:
    """Innermost instance of each stack."""
    return keys.groupBy("stack_key").agg(
        F.max_by(F.struct("class", "site_file", "site_line", "ancestors"), "frame_no").alias("_k")
    ).select("stack_key", "_k.*")
