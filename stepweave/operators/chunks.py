"""Ordered-window work on hot keys without one task per key.

A Spark window puts all rows of a partition key into one task.  A profiler thread or a
stream can hold a large share of all rows, so the ordered operators split such a key
into *chunks* of consecutive rows first.  Each chunk is an independent window
partition; what a chunk needs to know about the rows before it (last row, running sum,
running maximum) comes from a second, tiny window over one summary row per chunk.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave.session import materialize

ROWS_PER_CHUNK = 250_000
MAX_CHUNKS = 2048
_STRIDE = 32  # split points are searched in two steps: every 32nd, then the ones between


@dataclass
class Chunked:
    """``frame`` has a ``chunk`` column; ``split`` tells whether any key has more than one chunk."""

    frame: DataFrame
    keys: list[str]
    split: bool


def chunked(
    df: DataFrame, keys: Sequence[str], at: str, rows: int | None = None, reach: str | None = None
) -> Chunked:
    """Give every row a chunk number by the value of ``at``; rows with equal ``at`` share it.

    With ``reach``, another column on the same axis, ``reach_chunk`` is the chunk that value falls in.

    Only keys with more than ``rows`` rows are split, at approximate quantiles, so a
    burst or an outlier in time does not unbalance the chunks.  The split points are
    written out: approximate quantiles may differ between two evaluations, and all
    uses of a chunk number must agree.
    """
    rows = rows or ROWS_PER_CHUNK
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows)
    if sizes.isEmpty():
        whole = {"chunk": F.lit(0), **({"reach_chunk": F.lit(0)} if reach else {})}
        return Chunked(df.withColumns(whole), keys, False)

    hot = materialize(sizes)
    fractions = F.lit([i / MAX_CHUNKS for i in range(1, MAX_CHUNKS)])
    quantiles = (
        df.select(*keys, at).join(hot, keys)
        .groupBy(*keys)
        .agg(F.percentile_approx(at, fractions, 10_000).alias("_q"), F.max("_n").alias("_n"))
    )
    wanted = F.least(F.lit(MAX_CHUNKS), F.ceil(F.col("_n") / F.lit(rows))).cast("int")
    splits = materialize(
        quantiles.withColumn("_m", wanted)
        .withColumn("_splits", F.expr(
            f"array_distinct(transform(sequence(1, greatest(_m - 1, 1)),"
            f" i -> element_at(_q, cast(i * {MAX_CHUNKS} div greatest(_m, 2) as int))))"))
        .withColumn("_coarse", F.expr(
            f"transform(filter(sequence(0, size(_splits) div {_STRIDE}), i -> i > 0), i -> _splits[i * {_STRIDE} - 1])"))
        .select(*keys, "_splits", "_coarse")
    )
    frame = df.join(splits, keys, "left")
    for name, column in {"chunk": at, **({"reach_chunk": reach} if reach else {})}.items():
        frame = frame.withColumn("_base", F.expr(f"size(filter(_coarse, s -> s <= {column})) * {_STRIDE}")).withColumn(
            name, F.expr(f"coalesce(_base + size(filter(slice(_splits, _base + 1, {_STRIDE - 1}), s -> s <= {column})), 0)"))
    return Chunked(frame.drop("_splits", "_coarse", "_base"), keys, True)


def _window(c: Chunked, order: Sequence[Column]):
    return Window.partitionBy(*c.keys, "chunk").orderBy(*order)


def previous_row(c: Chunked, order: Sequence[str], fields: Sequence[str], out: str) -> Chunked:
    """Add struct ``out``: ``fields`` of the row just before this one under ``order``."""
    w = _window(c, [F.col(o) for o in order])
    packed = F.struct(*fields)
    frame = c.frame.withColumn(out, F.lag(packed).over(w))
    if c.split:
        chunk_order = Window.partitionBy(*c.keys).orderBy("chunk")
        carry = (
            c.frame.groupBy(*c.keys, "chunk")
            .agg(F.max_by(packed, F.struct(*order)).alias("_tail"))
            .withColumn("_carry", F.lag("_tail").over(chunk_order))
            .drop("_tail")
        )
        frame = (
            frame.join(carry, [*c.keys, "chunk"], "left")
            .withColumn(out, F.coalesce(out, "_carry")).drop("_carry")
        )
    return Chunked(frame, c.keys, c.split)


def running(
    c: Chunked, order: Sequence[str], columns: dict[str, str], how: str, before: bool = False
) -> Chunked:
    """Add running ``how`` ("sum" or "max") columns ``{out: source}``.

    With ``before`` the current row is left out.  Rows that tie under ``order`` must not
    exist (give a full order), which keeps the result independent of row arrival.
    """
    fold = {"sum": F.sum, "max": F.max}[how]
    w = _window(c, [F.col(o) for o in order]).rowsBetween(
        Window.unboundedPreceding, -1 if before else Window.currentRow)
    frame = c.frame.withColumns({out: fold(src).over(w) for out, src in columns.items()})
    if c.split:
        earlier = Window.partitionBy(*c.keys).orderBy("chunk").rowsBetween(
            Window.unboundedPreceding, -1)
        carry = c.frame.groupBy(*c.keys, "chunk").agg(
            *[fold(src).alias(f"_t_{out}") for out, src in columns.items()])
        carry = carry.select(
            *c.keys, "chunk", *[fold(f"_t_{out}").over(earlier).alias(f"_c_{out}") for out in columns])
        frame = frame.join(carry, [*c.keys, "chunk"], "left")
        for out in columns:
            local, past = F.col(out), F.col(f"_c_{out}")
            if how == "sum":
                both = F.coalesce(local, F.lit(0)) + F.coalesce(past, F.lit(0))
            else:
                both = F.greatest(local, past)
            frame = frame.withColumn(out, both).drop(f"_c_{out}")
    return Chunked(frame, c.keys, c.split)
