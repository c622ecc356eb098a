"""Who encloses whom on a thread.

The parent of an event is the latest earlier event on the same thread that is still
open when it starts.  That needs the thread in time order, so each chunk of a thread
(see ``chunks``) is sorted by Spark and streamed through a small stack; the batches of a
thread are never gathered.  Events that reach into a later chunk are handed to it as
*carried* rows, which makes the chunks independent of each other.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.operators.chunks import Chunked, chunked
from stepweave.schema import MODULE_PREFIX, THREAD_KEY
from stepweave.session import materialize

FILE_ORDER = ("ts_ns", "idx")                 # start time, ties by file position
OUTER_FIRST = ("ts_ns", "_minus_dur", "idx")  # start time, longer event first


def is_module_event() -> Column:
    return (F.col("cat") == "python_function") & F.col("name").startswith(MODULE_PREFIX)


def _with_carried(c: Chunked) -> DataFrame:
    """Rows of every chunk plus the pushable events of earlier chunks still open there."""
    own = c.frame.withColumn("_carried", F.lit(False))
    if not c.split:
        return own
    later = F.explode(F.sequence(F.col("chunk") + 1, F.col("reach_chunk")))
    reaching = c.frame.filter(F.col("_push") & (F.col("reach_chunk") > F.col("chunk"))).withColumns(
        {"chunk": later, "_carried": F.lit(True)})
    return own.unionByName(reaching)


def _stack_scan(keys: Sequence[str], closed: bool, own_first: bool):
    """Stack over sorted Arrow batches: parent, nearest tagged ancestor, or a carried anchor."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_group = None
        ends: list[int] = []
        open_rows: list[tuple] = []  # idx, nearest tag at or above, anchor at or above
        for batch in batches:
            if batch.empty:
                continue
            groups = list(zip(*[batch[k] for k in [*keys, "chunk"]]))
            parents, tags, anchors = [], [], []
            for group, t, end, idx, push, tag, carried in zip(
                groups, batch["ts_ns"].tolist(), batch["_end"].tolist(), batch["idx"].tolist(),
                batch["_push"].tolist(), batch["_tag"].tolist(), batch["_carried"].tolist(),
            ):
                if group != last_group:
                    last_group, ends, open_rows = group, [], []
                while ends and (ends[-1] < t if closed else ends[-1] <= t) and not carried:
                    ends.pop()
                    open_rows.pop()
                top = open_rows[-1] if open_rows else (None, None, None)
                if carried:
                    mine = (idx, idx, None) if tag else (idx, None, idx)
                else:
                    mine = (idx, idx, None) if tag else (idx, top[1], top[2])
                if push:
                    ends.append(end)
                    open_rows.append(mine)
                seen = mine if (own_first and push) else top
                parents.append(seen[0])
                tags.append(seen[1])
                anchors.append(seen[2])
            out = batch[[*keys, "idx", "_carried"]].copy()
            out["parent_idx"] = pd.array(parents, dtype="Int64")
            out["tag_idx"] = pd.array(tags, dtype="Int64")
            out["_anchor"] = pd.array(anchors, dtype="Int64")
            out = out[~out["_carried"]].drop(columns="_carried")
            yield out

    return scan


def enclosing_events(
    events: DataFrame,
    closed: bool = True,
    order: Sequence[str] = FILE_ORDER,
    keys: Sequence[str] = THREAD_KEY,
    push: Column | None = None,
    tag: Column | None = None,
    own_first: bool = False,
    rank: Column | None = None,
    rows: int | None = None,
) -> DataFrame:
    """``(keys, idx, parent_idx, tag_idx)`` for every event.

    ``closed``: an event that starts exactly where another ends is still inside it.
    ``push``: which events can enclose others (default all).  ``tag``: marks events; the
    result names the nearest marked event found by following parents upwards.
    ``own_first``: an event that can enclose others also encloses itself.
    ``rank``: extra sort column between duration and file position.
    """
    keys = list(keys)
    true, false = F.lit(True), F.lit(False)
    dur = F.coalesce("dur_ns", F.lit(0).cast("bigint"))
    base = events.select(
        *keys, "idx", "ts_ns",
        (F.col("ts_ns") + dur).alias("_end"), (-dur).alias("_minus_dur"),
        F.coalesce(push if push is not None else true, false).alias("_push"),
        F.coalesce(tag if tag is not None else is_module_event(), false).alias("_tag"),
        (rank if rank is not None else F.lit(0)).alias("_rank"),
    )
    if rank is not None:
        order = [*[o for o in order if o != "idx"], "_rank", "idx"]
    c = chunked(base, keys, "ts_ns", rows, reach="_end")
    data = _with_carried(c)
    group = [*keys, "chunk"]
    data = data.repartition(*group).sortWithinPartitions(
        *group, F.col("_carried").desc(), *order
    ).select(*group, "idx", "ts_ns", "_end", "_push", "_tag", "_carried")
    types = dict(base.dtypes)
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "idx bigint", "parent_idx bigint",
                        "tag_idx bigint", "_anchor bigint"])
    scanned = data.mapInPandas(_stack_scan(keys, closed, own_first), schema)
    if not c.split:
        return scanned.drop("_anchor")
    return _follow_anchors(scanned, keys)


def _follow_anchors(scanned: DataFrame, keys: list[str]) -> DataFrame:
    """Replace "continues above carried event a" by what event a itself resolved to.

    Only events that cross a chunk border are anchors, so the table that is looped over is
    small.  Each round doubles the distance looked ahead.
    """
    scanned = materialize(scanned)
    anchors = scanned.filter("_anchor is not null").select(*keys, F.col("_anchor").alias("idx")).distinct()
    links = materialize(
        scanned.join(anchors, [*keys, "idx"], "left_semi").select(*keys, "idx", "tag_idx", "_anchor"))
    while not links.filter("_anchor is not null").isEmpty():
        nxt = links.select(
            *keys, F.col("idx").alias("_anchor"),
            F.col("tag_idx").alias("_next_tag"), F.col("_anchor").alias("_next_anchor"))
        links = materialize(
            links.join(nxt, [*keys, "_anchor"], "left")
            .select(*keys, "idx", F.coalesce("tag_idx", "_next_tag").alias("tag_idx"),
                    F.col("_next_anchor").alias("_anchor")))
    resolved = links.select(*keys, F.col("idx").alias("_anchor"), F.col("tag_idx").alias("_far_tag"))
    return (
        scanned.join(resolved, [*keys, "_anchor"], "left")
        .select(*keys, "idx", "parent_idx", F.coalesce("tag_idx", "_far_tag").alias("tag_idx")))


def event_parents(events: DataFrame, rows: int | None = None) -> DataFrame:
    """Parent and nearest module ancestor of every complete event (touching counts as inside)."""
    spans = events.filter((F.col("ph") == "X") & F.col("pid").isNotNull() & F.col("tid").isNotNull())
    return enclosing_events(spans, rows=rows).withColumnRenamed("tag_idx", "module_idx")


def main_thread_tree(
    events: DataFrame, rows: int | None = None, thread_key: Sequence[str] = THREAD_KEY
) -> DataFrame:
    """Parents on the thread with the most step annotations (touching events are siblings).

    With ``thread_key=("trace_id", "tid")`` threads of equal tid in several processes are one.
    """
    key = [k for k in thread_key if k != "trace_id"]
    steps = events.filter(
        F.col("name").startswith("ProfilerStep") & (F.col("ph") == "X") & (F.col("cat") == "user_annotation"))
    main = (
        steps.groupBy(*thread_key).agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first"))
        .groupBy("trace_id")
        .agg(F.max_by(F.struct(*key), F.struct("n", -F.col("first"))).alias("m"))
        .select("trace_id", "m.*")
    )
    spans = events.filter((F.col("ph") == "X") & F.col("dur_ns").isNotNull()).join(
        main, list(thread_key), "left_semi")
    return enclosing_events(spans, closed=False, order=OUTER_FIRST, keys=thread_key, rows=rows).drop("tag_idx")


def external_id_modules(
    events: DataFrame, rows: int | None = None, thread_key: Sequence[str] = THREAD_KEY
) -> DataFrame:
    """External id -> name of the innermost open module; the first one seen wins.

    "First" means: threads in order of first appearance, then start time, longer first,
    Python functions first.  A module event can name itself.
    """
    spans = events.filter((F.col("ph") == "X") & F.col("dur_ns").isNotNull() & (F.col("cat") != "kernel"))
    python_first = F.when(F.col("cat") == "python_function", 0).otherwise(1)
    inner = enclosing_events(
        spans, closed=False, order=OUTER_FIRST, keys=thread_key, push=is_module_event(), own_first=True,
        rank=python_first, rows=rows,
    ).select("trace_id", "idx", F.col("parent_idx").alias("module_idx"))
    first_seen = spans.groupBy(*thread_key).agg(F.min("idx").alias("_thread_first"))
    modules = spans.filter(is_module_event()).select(
        "trace_id", F.col("idx").alias("module_idx"), F.col("name").alias("module"))
    tagged = spans.filter(F.col("external_id").isNotNull())
    seen = F.struct("_thread_first", "ts_ns", -F.col("dur_ns"), python_first, "idx")
    return (
        tagged.join(inner.filter("module_idx is not null"), ["trace_id", "idx"])
        .join(modules, ["trace_id", "module_idx"])
        .join(first_seen, list(thread_key))
        .groupBy("trace_id", "external_id").agg(F.min_by("module", seen).alias("module"))
    )
