"""Interval arithmetic: clipping, unions, overlap of unions and interval joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.operators.chunks import Chunked, chunked, previous_row, running


def overlap_length(a_start, a_end, b_start, b_end) -> Column:
    """Length of the common part of two intervals, never negative."""
    return F.greatest(F.lit(0).cast("bigint"), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def clip_to_window(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """Keep rows whose ``[ts_ns, ts_ns+dur_ns]`` overlaps the window (open test), cut to it."""
    row_end = F.col("ts_ns") + F.col("dur_ns")
    cut_start, cut_end = F.greatest(F.col("ts_ns"), start), F.least(row_end, end)
    return (
        df.filter((row_end > start) & (F.col("ts_ns") < end) & (cut_end > cut_start))
        .withColumns({"ts_ns": cut_start, "dur_ns": cut_end - cut_start})
    )


def merge_intervals(
    df: DataFrame, keys: Sequence[str], start: str, end: str, rows: int | None = None
) -> DataFrame:
    """Union of the intervals per key; touching intervals merge.

    Identical intervals are folded first, so repeated rows never reach the window.
    """
    keys = list(keys)
    distinct = df.groupBy(*keys, start).agg(F.max(end).alias(end))
    c = chunked(distinct, keys, start, rows)
    c = running(c, [start], {"_reach": end}, "max", before=True)
    opens = F.col("_reach").isNull() | (F.col(start) > F.col("_reach"))
    c = Chunked(c.frame.withColumn("_open", F.when(opens, F.col(start))), c.keys, c.split)
    c = running(c, [start], {"_island": "_open"}, "max")
    return c.frame.groupBy(*keys, F.col("_island").alias(start)).agg(F.max(end).alias(end))


def covered_length(merged: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    return merged.groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).alias("covered_ns"))


def union_overlaps(
    df: DataFrame, keys: Sequence[str], start: str, end: str, kind: str,
    kinds: Sequence[str], against: str, rows: int | None = None,
) -> DataFrame:
    """Sweep line per key: covered length of each kind, and its overlap with ``against``.

    Every interval becomes a +1 and a -1 at its ends.  The deltas are summed per instant
    before the sweep, so a window row stands for a distinct instant.  A stretch between
    two instants counts for a kind while its running sum is positive.
    """
    keys = list(keys)
    ends = F.array(
        F.struct(F.col(start).alias("t"), F.lit(1).alias("d")),
        F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")),
    )
    deltas = (
        df.select(*keys, kind, F.explode(ends).alias("_e"))
        .groupBy(*keys, F.col("_e.t").alias("_t"))
        .agg(*[F.sum(F.when(F.col(kind) == k, F.col("_e.d")).otherwise(0)).alias(f"_d_{k}") for k in kinds])
    )
    c = chunked(deltas, keys, "_t", rows)
    c = running(c, ["_t"], {f"_open_{k}": f"_d_{k}" for k in kinds}, "sum", before=True)
    c = previous_row(c, ["_t"], ["_t"], "_prev")
    stretch = F.col("_t") - F.col("_prev._t")
    on = {k: F.col(f"_open_{k}") > 0 for k in kinds}
    zero = F.lit(0).cast("bigint")
    total = lambda cond, name: F.coalesce(F.sum(F.when(cond, stretch)), zero).alias(name)
    return c.frame.groupBy(*keys).agg(
        *[total(on[k], f"{k}_ns") for k in kinds],
        *[total(on[k] & on[against], f"{k}_overlap_ns") for k in kinds if k != against],
    )


def _level(length: Column) -> Column:
    """Smallest power of two (as exponent) that is about as long as the interval."""
    return F.greatest(F.ceil(F.log2(F.greatest(length, F.lit(1)))).cast("int"), F.lit(0))


def join_points_to_intervals(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str],
    at: str, start: str, end: str, closed_end: bool, how: str = "inner",
) -> DataFrame:
    """All (point, interval) pairs with the point inside the interval, as an equi-join.

    A plain range predicate would compare every pair with equal keys.  Instead each
    interval goes into the one or two bins of its own power-of-two width, and each
    point looks up one bin per width that occurs under its key (at most 64).  The bin
    number is a join key, so a hot key spreads over many tasks.
    """
    keys = list(keys)
    binned = intervals.withColumn("_level", _level(F.col(end) - F.col(start)))
    levels = binned.groupBy(*keys).agg(F.array_sort(F.collect_set("_level")).alias("_levels"))
    binned = binned.withColumn(
        "_bin", F.explode(F.expr(f"sequence(shiftright({start}, _level), shiftright({end}, _level))")))
    probes = (
        points.join(levels, keys)
        .withColumn("_level", F.explode("_levels")).drop("_levels")
        .withColumn("_bin", F.expr(f"shiftright({at}, _level)"))
    )
    inside = (F.col(at) >= F.col(start)) & (
        F.col(at) <= F.col(end) if closed_end else F.col(at) < F.col(end))
    return probes.join(binned, [*keys, "_level", "_bin"]).filter(inside).drop("_level", "_bin")


def join_overlapping(
    left: DataFrame, right: DataFrame, keys: Sequence[str],
    l_start: str, l_end: str, r_start: str, r_end: str, closed: bool,
) -> DataFrame:
    """All pairs with overlapping intervals, each once.

    Two intervals overlap when one of them starts inside the other, so this is the union
    of two point joins; the second leaves out equal starts, which the first has found.
    """
    touches = F.col(l_end) >= F.col(r_start) if closed else F.col(l_end) > F.col(r_start)
    left_in = join_points_to_intervals(left, right, keys, l_start, r_start, r_end, closed_end=closed)
    right_in = join_points_to_intervals(right, left, keys, r_start, l_start, l_end, closed_end=closed)
    columns = [*keys, *[c for c in left.columns if c not in keys],
               *[c for c in right.columns if c not in keys]]
    return left_in.filter(touches).select(*columns).unionByName(
        right_in.filter(F.col(r_start) > F.col(l_start)).select(*columns))


def last_mark_at(
    points: DataFrame, marks: DataFrame, keys: Sequence[str], at: str, mark: str, out: str,
    rows: int | None = None,
) -> DataFrame:
    """As-of join: add ``out``, the largest ``mark`` that is <= ``at`` under the same keys.

    Points and marks are sorted together and a running maximum carries the mark forward,
    so no pair of a point and a mark is ever built.
    """
    keys = list(keys)
    times = marks.groupBy(*keys, F.col(mark).alias("_t")).agg(F.lit(0).alias("_point"))
    both = points.withColumns({"_t": F.col(at), "_point": F.lit(1)}).unionByName(times, allowMissingColumns=True)
    both = both.withColumn("_mark", F.when(F.col("_point") == 0, F.col("_t")))
    c = running(chunked(both, keys, "_t", rows), ["_t", "_point"], {out: "_mark"}, "max")
    return c.frame.filter("_point = 1").drop("_t", "_point", "_mark", "chunk")
