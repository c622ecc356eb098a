"""Trace operators over the driver's tables, each with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.functions import labels
from stepweave.operators import device, intervals, modules, nesting, trace_dims
from stepweave.plans.tables import TraceTables
from stepweave.session import materialize
from workload.oracle import with_ctes
from workload.views import spark_view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SELECTS: dict[str, str] = {}  # the same, without the shared texts in front


_LANDED: dict[tuple[str, str], TraceTables] = {}


def trace_tables(spark: SparkSession, sf_dir: str) -> TraceTables:
    """The driver's tables as one landed event table; written once per session and scale."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LANDED:
        _LANDED[key] = TraceTables(materialize(spark_view(spark, sf_dir, "trace_event", stacks=True)))
    return _LANDED[key]


def query(name: str, sql: str | None = None, stacks: bool = False):
    def add(fn: Callable[[TraceTables], DataFrame]):
        QUERIES[name] = lambda spark, sf: fn(trace_tables(spark, sf))
        if sql:
            ORACLES[name], SELECTS[name] = with_ctes(sql, stacks), sql
        return fn
    return add


def _as_bigint(totals: DataFrame, column: str = "total_ns") -> DataFrame:
    """``column`` in the SQL's type; NULL where the exact total does not fit, which the SQL cannot state either."""
    return totals.withColumn(column, F.expr(f"try_cast({column} as bigint)"))


# ---------------------------------------------------------------- dimensions and expressions

@query("s02_thread_names", "SELECT trace_id, pid, tid, thread_name FROM o_name")
def _(t):
    return trace_dims.thread_names(t.events)


@query("s02_process_labels", "SELECT trace_id, pid, label, first_idx FROM o_label")
def _(t):
    return trace_dims.process_labels(t.events)


@query("f01_trace_kind", """
SELECT trace_id, CASE WHEN bool_or(coalesce(cat = 'fwdbwd' OR (cat IN ('cpu_op', 'python_function')
  AND lower(name) LIKE '%backward%'), false)) THEN 'training' ELSE 'inference' END AS kind FROM trace_event GROUP BY 1
""")
def _(t):
    return trace_dims.trace_kind(t.events)


@query("f02_enhanced", """
SELECT trace_id, bool_or(coalesce(ph = 'M' AND name = 'thread_name' AND arg_name LIKE '%Code Location%', false)) AS has_code_location,
  bool_or(coalesce(cat = 'kernel' AND stack_traces IS NOT NULL, false)) AS has_stack_traces FROM trace_event GROUP BY 1
""", stacks=True)
def _(t):
    return trace_dims.enhanced_flags(t.events)


@query("f03_phase_label", """
SELECT name, count(*) AS n, CASE WHEN lower(name) LIKE '%optimize%' THEN 'optimize'
  WHEN regexp_matches(lower(name), '(^|[^a-z])backward([^a-z]|$)') THEN 'backward'
  WHEN regexp_matches(lower(name), '(^|[^a-z])forward([^a-z]|$)') THEN 'forward' END AS phase
FROM trace_event GROUP BY name
""")
def _(t):
    return t.events.groupBy("name").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "phase", labels.phase_of_label(F.col("name")))


@query("f04_backward_stack", """
SELECT trace_id, idx, coalesce(len(list_filter(stack_traces, lambda x: contains(x, 'ackward') OR contains(x, 'Gradient'))) > 0, false)
  AS is_backward FROM trace_event WHERE cat = 'kernel'
""", stacks=True)
def _(t):
    return t.events.filter("cat = 'kernel'").select(
        "trace_id", "idx", labels.is_backward_stack(F.col("stack_traces")).alias("is_backward"))


@query("f05_runtime_module", """
SELECT name, n, runtime_name, regexp_replace(regexp_replace(runtime_name, '_[0-9]+$', ''),
    '^(FSDP|DDP|DistributedDataParallel|Wrapped)', '') AS class_name,
  CAST(nullif(regexp_extract(runtime_name, '_([0-9]+)$', 1), '') AS BIGINT) AS runtime_index,
  CAST(nullif(regexp_extract(name, 'callsite: ([0-9]+)', 1), '') AS BIGINT) AS callsite
FROM (SELECT name, count(*) AS n, regexp_replace(replace(name, 'nn.Module: ', ''), ', callsite: [0-9]+', '') AS runtime_name
      FROM trace_event WHERE name LIKE 'nn.Module:%' GROUP BY name) x
""")
def _(t):
    return t.events.filter(F.col("name").startswith("nn.Module:")).groupBy("name").agg(
        F.count(F.lit(1)).alias("n")).select("name", "n", labels.runtime_module(F.col("name")).alias("r")).select(
        "name", "n", "r.*")


@query("f06_module_label", """
SELECT trace_id, idx, regexp_replace(substr(name, 12), ', callsite.*', '') AS label FROM trace_event WHERE name LIKE 'nn.Module:%'
""")
def _(t):
    return t.events.select("trace_id", "idx", labels.module_label(F.col("name")).alias("label")).filter("label is not null")


@query("f07_wrapper_name", """
SELECT label, count(*) AS n, (label LIKE 'Sync%' OR label LIKE 'Dense%' OR label LIKE 'Sparse%' OR label LIKE 'Tail%') AS is_wrapper
FROM (SELECT regexp_replace(substr(name, 12), ', callsite.*', '') AS label FROM trace_event WHERE name LIKE 'nn.Module:%') x
GROUP BY label
""")
def _(t):
    lab = t.events.select(labels.module_label(F.col("name")).alias("label")).filter("label is not null")
    return lab.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "is_wrapper", labels.is_wrapper(F.col("label")))


@query("f10_duration_text", """
SELECT dur_ns, n, CASE WHEN us >= 1e6 THEN printf('%.3f s', us / 1e6) WHEN us >= 1e3 THEN printf('%.3f ms', us / 1e3)
  ELSE printf('%.2f us', us) END AS report_text,
  CASE WHEN us >= 1e6 THEN printf('%.3f s', us / 1e6) WHEN us >= 1e3 THEN printf('%.2f ms', us / 1e3)
  ELSE printf('%.1f us', us) END AS swimlane_text
FROM (SELECT dur_ns, count(*) AS n, CAST(dur_ns AS DOUBLE) / 1e6 AS us FROM trace_event WHERE dur_ns IS NOT NULL GROUP BY 1) x
""")
def _(t):
    us = F.col("dur_ns").cast("double") / 1e6  # the view's times, scaled down to reach all three units
    return t.events.filter("dur_ns is not null").groupBy("dur_ns").agg(F.count(F.lit(1)).alias("n")).select(
        "dur_ns", "n", labels.duration_text(us).alias("report_text"),
        labels.duration_text(us, labels.SWIMLANE_DIGITS).alias("swimlane_text"))


@query("f11_percent", """
SELECT trace_id, cat, CASE WHEN host > 0 THEN CAST(ns AS DOUBLE) / CAST(host AS DOUBLE) * 100 END AS pct FROM (
  SELECT trace_id, cat, CAST(sum(coalesce(dur_ns, 0)) AS BIGINT) AS ns,
    CAST(sum(CASE WHEN pid = '0' THEN coalesce(dur_ns, 0) ELSE 0 END) AS BIGINT) AS host FROM trace_event GROUP BY 1, 2) x
""")
def _(t):
    dur = F.coalesce("dur_ns", F.lit(0).cast("bigint"))
    g = t.events.groupBy("trace_id", "cat").agg(
        labels.wide_sum(dur).alias("ns"), labels.wide_sum(F.when(F.col("pid") == "0", dur).otherwise(0)).alias("host"))
    return g.select("trace_id", "cat", labels.percent(F.col("ns"), F.col("host")).alias("pct"))


# ---------------------------------------------------------------- steps and threads

@query("t01_steps", "SELECT * FROM o_step")
def _(t):
    return trace_dims.steps(t.events)


@query("t01_step_summary", "SELECT * FROM o_sum")
def _(t):
    return trace_dims.step_summary(t.events)


@query("t02_clip_to_step", """
SELECT e.trace_id, e.idx, s.step_no, greatest(0, least(e.ts_ns + e.dur_ns, s.end_ns) - e.ts_ns) AS clipped_ns
FROM trace_event e JOIN o_step s ON s.trace_id = e.trace_id AND s.ts_ns <= e.ts_ns AND e.ts_ns < s.end_ns
WHERE e.ph = 'X'
""")
def _(t):
    got = trace_dims.clipped_in_steps(t.events.filter("ph = 'X'"), t.steps)
    return got.filter("step_no is not null").select("trace_id", "idx", "step_no", "clipped_ns")


@query("t03_step_at_start", """
SELECT e.trace_id, e.idx, (SELECT min(s.step_no) FROM o_step s WHERE s.trace_id = e.trace_id AND s.ts_ns <= e.ts_ns
  AND e.ts_ns < s.end_ns) AS step_no FROM trace_event e
""")
def _(t):
    return trace_dims.step_at_start(t.events, t.steps).select("trace_id", "idx", "step_no")


@query("t05_choose_step", """
SELECT trace_id, step_no, step_name, ts_ns, end_ns, dur_ns FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY dur_ns, step_no) AS r,
  count(*) OVER (PARTITION BY trace_id) AS n FROM o_step) x WHERE r = n // 2 + 1
""")
def _(t):
    return trace_dims.choose_step(t.steps)


@query("t04_window_filter", """
SELECT e.trace_id, e.idx, greatest(e.ts_ns, s.ts_ns) AS ts_ns, least(e.ts_ns + e.dur_ns, s.end_ns) - greatest(e.ts_ns, s.ts_ns) AS dur_ns
FROM trace_event e JOIN o_step s ON s.trace_id = e.trace_id AND s.step_no = 3
WHERE e.ph = 'X' AND e.ts_ns + e.dur_ns > s.ts_ns AND e.ts_ns < s.end_ns
  AND least(e.ts_ns + e.dur_ns, s.end_ns) > greatest(e.ts_ns, s.ts_ns)
""")
def _(t):
    window = trace_dims.choose_step(t.steps, 3).select(
        "trace_id", F.col("ts_ns").alias("w_start"), F.col("end_ns").alias("w_end"))
    cut = intervals.clip_to_window(t.events.filter("ph = 'X'").join(window, "trace_id"), F.col("w_start"), F.col("w_end"))
    return cut.select("trace_id", "idx", "ts_ns", "dur_ns")


@query("t06_overlap_length", """
SELECT e.trace_id, e.idx, s.step_no, greatest(0, least(e.ts_ns + e.dur_ns, s.end_ns) - greatest(e.ts_ns, s.ts_ns)) AS overlap_ns
FROM trace_event e JOIN o_step s ON s.trace_id = e.trace_id AND e.ts_ns <= s.end_ns AND e.ts_ns + e.dur_ns >= s.ts_ns
WHERE e.ph = 'X' AND e.cat = 'kernel'
""")
def _(t):
    spans = t.events.filter("ph = 'X' AND cat = 'kernel'").select(
        "trace_id", "idx", F.col("ts_ns").alias("a"), (F.col("ts_ns") + F.col("dur_ns")).alias("b"))
    windows = t.steps.select("trace_id", "step_no", F.col("ts_ns").alias("c"), F.col("end_ns").alias("d"))
    pairs = intervals.join_overlapping(spans, windows, ["trace_id"], "a", "b", "c", "d", closed=True)
    return pairs.select("trace_id", "idx", "step_no", intervals.overlap_length(
        F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("overlap_ns"))


@query("t21_device_steps", "SELECT * FROM o_dstep")
def _(t):
    return trace_dims.device_steps(t.events, t.threads)


@query("a01_threads", "SELECT * FROM o_thread")
def _(t):
    return trace_dims.threads(t.events)


@query("a02_step_decomposition", """
SELECT *, step_dur_ns - forward_backward_dur_ns - optimize_dur_ns AS other_dur_ns FROM (
 SELECT e.trace_id,
  CAST(sum(e.dur_ns) FILTER (name LIKE 'train_runner.py%' AND name LIKE '%step%' AND e.dur_ns > 100000000) AS DOUBLE)
   / count(*) FILTER (name LIKE 'train_runner.py%' AND name LIKE '%step%' AND e.dur_ns > 100000000) AS step_dur_ns,
  CAST(sum(e.dur_ns) FILTER (name LIKE '%forward_backward%') AS DOUBLE)
   / count(*) FILTER (name LIKE '%forward_backward%') AS forward_backward_dur_ns,
  CAST(sum(e.dur_ns) FILTER (name LIKE 'train_runner.py%' AND name LIKE '%optimize%' AND e.dur_ns > 1000000) AS DOUBLE)
   / count(*) FILTER (name LIKE 'train_runner.py%' AND name LIKE '%optimize%' AND e.dur_ns > 1000000) AS optimize_dur_ns
 FROM trace_event e JOIN o_thread t ON e.trace_id = t.trace_id AND e.pid = t.pid AND e.tid = t.tid AND t.is_reported_main
 WHERE cat = 'python_function' GROUP BY 1) x
""")
def _(t):
    return trace_dims.step_decomposition(t.events, t.threads)


# ---------------------------------------------------------------- nesting

@query("t07_parent", "SELECT trace_id, idx, parent_idx FROM o_parent")
def _(t):
    return nesting.event_parents(t.events).select("trace_id", "idx", "parent_idx")


@query("t20_module_parent", """
SELECT s.trace_id, s.idx, m.module_idx FROM o_span s LEFT JOIN o_mod m ON s.trace_id = m.trace_id AND s.idx = m.idx
""")
def _(t):
    return t.parents.select("trace_id", "idx", "module_idx")


@query("t08_main_thread_tree", "SELECT trace_id, idx, parent_idx FROM o_main_parent")
def _(t):
    return nesting.main_thread_tree(t.events).select("trace_id", "idx", "parent_idx")


@query("t11_merge_intervals", """
SELECT trace_id, pid, tid, min(s) AS start_ns, max(e) AS end_ns FROM (
  SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id, pid, tid ORDER BY s, e, idx) AS island FROM (
    SELECT trace_id, pid, tid, idx, ts_ns AS s, ts_ns + dur_ns AS e, max(ts_ns + dur_ns) OVER (PARTITION BY trace_id, pid, tid
      ORDER BY ts_ns, ts_ns + dur_ns, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
    FROM trace_event WHERE ph = 'X') a) b GROUP BY trace_id, pid, tid, island
""")
def _(t):
    spans = t.events.filter("ph = 'X'").select("trace_id", "pid", "tid", F.col("ts_ns").alias("start_ns"),
                                         (F.col("ts_ns") + F.col("dur_ns")).alias("end_ns"))
    return intervals.merge_intervals(spans, ["trace_id", "pid", "tid"], "start_ns", "end_ns")


@query("t12_covered_length", """
SELECT trace_id, pid, tid, CAST(sum(greatest(0, e - greatest(s, coalesce(reach, s)))) AS BIGINT) AS covered_ns FROM (
    SELECT trace_id, pid, tid, ts_ns AS s, ts_ns + dur_ns AS e, max(ts_ns + dur_ns) OVER (PARTITION BY trace_id, pid, tid
      ORDER BY ts_ns, ts_ns + dur_ns, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
    FROM trace_event WHERE ph = 'X') a GROUP BY 1, 2, 3
""")
def _(t):
    spans = t.events.filter("ph = 'X'").select("trace_id", "pid", "tid", F.col("ts_ns").alias("start_ns"),
                                         (F.col("ts_ns") + F.col("dur_ns")).alias("end_ns"))
    key = ["trace_id", "pid", "tid"]
    return intervals.covered_length(intervals.merge_intervals(spans, key, "start_ns", "end_ns"), key, "start_ns", "end_ns")


@query("t13_union_overlap", """
SELECT trace_id, CAST(sum(CASE WHEN h > 0 THEN nxt - t ELSE 0 END) AS BIGINT) AS host_ns,
  CAST(sum(CASE WHEN d > 0 THEN nxt - t ELSE 0 END) AS BIGINT) AS device_ns,
  CAST(sum(CASE WHEN h > 0 AND d > 0 THEN nxt - t ELSE 0 END) AS BIGINT) AS host_overlap_ns FROM (
  SELECT trace_id, t, lead(t) OVER w AS nxt, sum(h) OVER w AS h, sum(d) OVER w AS d FROM (
    SELECT trace_id, t, sum(h) AS h, sum(d) AS d FROM (
      SELECT trace_id, ts_ns AS t, CASE WHEN pid = '0' THEN 1 ELSE 0 END AS h, CASE WHEN pid = '1' THEN 1 ELSE 0 END AS d
      FROM trace_event WHERE ph = 'X' AND cat <> 'gpu_user_annotation'
      UNION ALL SELECT trace_id, ts_ns + dur_ns, CASE WHEN pid = '0' THEN -1 ELSE 0 END, CASE WHEN pid = '1' THEN -1 ELSE 0 END
      FROM trace_event WHERE ph = 'X' AND cat <> 'gpu_user_annotation') a GROUP BY 1, 2) b
  WINDOW w AS (PARTITION BY trace_id ORDER BY t)) c WHERE nxt IS NOT NULL GROUP BY 1
""")
def _(t):
    spans = t.events.filter("ph = 'X' AND cat <> 'gpu_user_annotation'").select(
        "trace_id", F.when(F.col("pid") == "0", "host").otherwise("device").alias("side"),
        F.col("ts_ns").alias("s"), (F.col("ts_ns") + F.col("dur_ns")).alias("e"))
    return intervals.union_overlaps(spans, ["trace_id"], "s", "e", "side", ["host", "device"], "device")


# ---------------------------------------------------------------- device

@query("t14_gaps", """
SELECT trace_id, idx, gap_ns, before_name, before_dur_ns, after_name, after_dur_ns,
  coalesce((SELECT bool_or(x.ts_ns - x.gap_ns >= s.ts_ns) FROM o_step s WHERE s.trace_id = x.trace_id AND s.ts_ns <= x.ts_ns AND x.ts_ns < s.end_ns), false) AS within_step FROM (
  SELECT trace_id, idx, ts_ns, ts_ns - lag(ts_ns + dur_ns) OVER w AS gap_ns, lag(name) OVER w AS before_name,
    lag(dur_ns) OVER w AS before_dur_ns, name AS after_name, dur_ns AS after_dur_ns
  FROM o_prim WINDOW w AS (PARTITION BY trace_id ORDER BY ts_ns, idx)) x WHERE gap_ns > 0
""")
def _(t):
    return device.kernel_gaps(t)


@query("t14_top_gaps", """
SELECT * FROM (SELECT trace_id, idx, gap_ns, before_name, before_dur_ns, after_name, after_dur_ns,
  coalesce((SELECT bool_or(x.ts_ns - x.gap_ns >= s.ts_ns) FROM o_step s WHERE s.trace_id = x.trace_id AND s.ts_ns <= x.ts_ns AND x.ts_ns < s.end_ns), false) AS within_step, row_number() OVER (PARTITION BY trace_id ORDER BY gap_ns DESC, idx) AS rank FROM (
  SELECT trace_id, idx, ts_ns, ts_ns - lag(ts_ns + dur_ns) OVER w AS gap_ns, lag(name) OVER w AS before_name,
    lag(dur_ns) OVER w AS before_dur_ns, name AS after_name, dur_ns AS after_dur_ns
  FROM o_prim WINDOW w AS (PARTITION BY trace_id ORDER BY ts_ns, idx)) x WHERE gap_ns > 0) y WHERE rank <= 15
""")
def _(t):
    return device.top_gaps(device.kernel_gaps(t))


@query("t14_gap_per_step", """
SELECT trace_id, count(*) AS n_gaps, CAST(sum(gap_ns) AS DOUBLE) / any_value(n_steps) AS gap_ns FROM (
  SELECT trace_id, ts_ns - lag(ts_ns + dur_ns) OVER (PARTITION BY trace_id ORDER BY ts_ns, idx) AS gap_ns FROM o_prim) x
JOIN o_sum USING (trace_id) WHERE gap_ns > 0 GROUP BY 1
""")
def _(t):
    return device.gap_per_step(device.kernel_gaps(t), t.summary)


_TOP_KERNELS = """
SELECT trace_id, name, CAST(ns AS DOUBLE) / n_steps AS dur_ns, CASE WHEN n // n_steps = 0 THEN n ELSE n // n_steps END AS n_calls, rank FROM (
  SELECT trace_id, name, CAST(sum(clipped) AS BIGINT) AS ns, count(*) AS n,
    row_number() OVER (PARTITION BY trace_id ORDER BY sum(clipped) DESC, name) AS rank FROM o_prim_clip GROUP BY 1, 2) x
JOIN o_sum USING (trace_id) WHERE rank <= 30
"""


@query("a04_top_kernels", _TOP_KERNELS)
def _(t):
    return device.top_kernels(t)


@query("a04_device_timeline", """
SELECT trace_id, kernel_ns, device_step_ns, kernel_ns / device_step_ns * 100 AS utilization_pct, n_kernels, n_device_steps FROM (
  SELECT trace_id, CAST(sum(clipped) AS DOUBLE) / any_value(n_steps) AS kernel_ns, count(*) // any_value(n_steps) AS n_kernels
  FROM o_prim_clip JOIN o_sum USING (trace_id) GROUP BY 1) a
JOIN (SELECT trace_id, CAST(sum(dur_ns) AS DOUBLE) / count(*) AS device_step_ns, count(*) AS n_device_steps FROM o_dstep GROUP BY 1) b
USING (trace_id)
""")
def _(t):
    return device.device_timeline(t)


_HOST_MODULES = """
SELECT p.trace_id, p.name, replace(m.module, 'nn.Module: ', '') AS module, CAST(sum(p.dur_ns) AS BIGINT) AS dur_ns
FROM o_prim p JOIN (SELECT trace_id, external_id, max(idx) AS idx FROM trace_event WHERE cat = 'cpu_op' AND ph = 'X'
  AND external_id IS NOT NULL GROUP BY 1, 2) h ON h.trace_id = p.trace_id AND h.external_id = p.external_id
JOIN o_mod m ON m.trace_id = h.trace_id AND m.idx = h.idx GROUP BY 1, 2, 3
"""


@query("a05_kernel_host_modules", _HOST_MODULES)
def _(t):
    return _as_bigint(device.kernel_host_modules(t), "dur_ns")


@query("a05_hot_kernel_modules", f"""
SELECT k.trace_id, k.name, module, h.dur_ns, row_number() OVER (PARTITION BY k.trace_id, k.name ORDER BY h.dur_ns DESC NULLS LAST, module) AS module_rank
FROM ({_TOP_KERNELS}) k LEFT JOIN ({_HOST_MODULES}) h ON k.trace_id = h.trace_id AND k.name = h.name
""")
def _(t):
    return _as_bigint(device.hot_kernel_modules(device.top_kernels(t), device.kernel_host_modules(t)), "dur_ns")


_TOTALS = """
SELECT trace_id, side, grain, key, total_ns, CAST(total_ns AS DOUBLE) / n_steps AS dur_ns FROM (
  SELECT trace_id, side, CASE WHEN grouping(name) = 0 THEN 'name' WHEN grouping(cat) = 0 THEN 'cat' ELSE 'total' END AS grain,
    coalesce(name, cat) AS key, CAST(sum(dur_ns) AS BIGINT) AS total_ns
  FROM (SELECT trace_id, CASE WHEN cat = 'cpu_op' THEN 'host' ELSE 'device' END AS side, cat, name, dur_ns FROM trace_event
        WHERE cat IN ('kernel', 'gpu_memcpy', 'gpu_memset', 'cpu_op')) e
  GROUP BY GROUPING SETS ((trace_id, side), (trace_id, side, cat), (trace_id, side, name))) x
JOIN o_sum USING (trace_id) WHERE NOT (grain = 'cat' AND side = 'host')
"""


@query("a06_device_host_totals", _TOTALS)
def _(t):
    return _as_bigint(device.device_host_totals(t))


@query("a06_top_device_host_ops", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trace_id, side ORDER BY total_ns DESC, key) AS rank
FROM ({_TOTALS}) t WHERE grain = 'name') x WHERE rank <= 20
""")
def _(t):
    return _as_bigint(device.top_device_host_ops(device.device_host_totals(t)))


_OVERLAP_OPS = """
SELECT e.trace_id, e.name, s.step_no, stream_kind AS kind, greatest(e.ts_ns, s.ts_ns) AS a, least(e.ts_ns + e.dur_ns, s.end_ns) AS b
FROM trace_event e JOIN o_thread t ON e.trace_id = t.trace_id AND e.pid = t.pid AND e.tid = t.tid
JOIN o_step s ON s.trace_id = e.trace_id AND e.ts_ns < s.end_ns AND e.ts_ns + e.dur_ns > s.ts_ns
WHERE ph = 'X' AND ((stream_kind = 'compute' AND cat IN ('kernel', 'gpu_memcpy', 'gpu_memset'))
  OR (stream_kind = 'comm' AND cat = 'kernel') OR (stream_kind = 'memcpy' AND cat IN ('gpu_memcpy', 'gpu_memset')))
  AND e.dur_ns > 0
"""
_OVERLAP = f"""
SELECT s.trace_id, s.step_no, s.dur_ns AS step_ns, coalesce(compute_ns, 0) AS compute_ns, coalesce(comm_ns, 0) AS comm_ns,
  coalesce(comm_overlap_ns, 0) AS comm_overlap_ns, coalesce(memcpy_ns, 0) AS memcpy_ns, coalesce(memcpy_overlap_ns, 0) AS memcpy_overlap_ns
FROM o_step s LEFT JOIN (
 SELECT trace_id, step_no, CAST(sum(CASE WHEN c > 0 THEN d ELSE 0 END) AS BIGINT) AS compute_ns,
  CAST(sum(CASE WHEN n > 0 THEN d ELSE 0 END) AS BIGINT) AS comm_ns, CAST(sum(CASE WHEN m > 0 THEN d ELSE 0 END) AS BIGINT) AS memcpy_ns,
  CAST(sum(CASE WHEN n > 0 AND c > 0 THEN d ELSE 0 END) AS BIGINT) AS comm_overlap_ns,
  CAST(sum(CASE WHEN m > 0 AND c > 0 THEN d ELSE 0 END) AS BIGINT) AS memcpy_overlap_ns FROM (
  SELECT trace_id, step_no, coalesce(lead(t) OVER w - t, 0) AS d, sum(c) OVER w AS c, sum(n) OVER w AS n, sum(m) OVER w AS m FROM (
   SELECT trace_id, step_no, t, sum(CASE WHEN kind = 'compute' THEN x ELSE 0 END) AS c, sum(CASE WHEN kind = 'comm' THEN x ELSE 0 END) AS n,
    sum(CASE WHEN kind = 'memcpy' THEN x ELSE 0 END) AS m FROM (
     SELECT trace_id, step_no, kind, a AS t, 1 AS x FROM ({_OVERLAP_OPS}) p UNION ALL
     SELECT trace_id, step_no, kind, b, -1 FROM ({_OVERLAP_OPS}) q) u GROUP BY 1, 2, 3) v
  WINDOW w AS (PARTITION BY trace_id, step_no ORDER BY t)) z GROUP BY 1, 2) y ON s.trace_id = y.trace_id AND s.step_no = y.step_no
"""


@query("a08_overlap_by_step", _OVERLAP)
def _(t):
    return device.overlap_by_step(t)


_pct = lambda part, whole: f"CASE WHEN {whole} > 0 THEN {part} / {whole} * 100 ELSE 0.0 END"


@query("a08_comm_compute_overlap", f"""
SELECT *, {_pct('comm_overlap_ns', 'comm_ns')} AS comm_overlap_pct, {_pct('memcpy_overlap_ns', 'memcpy_ns')} AS memcpy_overlap_pct,
  {_pct('comm_exposed_ns', 'step_ns')} AS comm_exposed_pct_of_step, {_pct('memcpy_exposed_ns', 'step_ns')} AS memcpy_exposed_pct_of_step FROM (
 SELECT trace_id, count(*) AS n_steps, {', '.join(f'CAST(sum({c}) AS DOUBLE) / count(*) AS {c}' for c in
   ('step_ns', 'compute_ns', 'comm_ns', 'comm_overlap_ns', 'memcpy_ns', 'memcpy_overlap_ns'))},
  CAST(sum(comm_ns - comm_overlap_ns) AS DOUBLE) / count(*) AS comm_exposed_ns,
  CAST(sum(memcpy_ns - memcpy_overlap_ns) AS DOUBLE) / count(*) AS memcpy_exposed_ns FROM ({_OVERLAP}) o GROUP BY 1) a
JOIN (SELECT trace_id, count(*) FILTER (stream_kind = 'comm') AS n_comm_streams, count(*) FILTER (stream_kind = 'memcpy') AS n_memcpy_streams
      FROM o_thread GROUP BY 1) t USING (trace_id)
""")
def _(t):
    return device.comm_compute_overlap(device.overlap_by_step(t), t.threads)


@query("a08_top_comm_kernels", f"""
SELECT trace_id, name, CAST(ns AS DOUBLE) / n_steps AS dur_ns, rank FROM (
  SELECT trace_id, name, sum(b - a) AS ns, row_number() OVER (PARTITION BY trace_id ORDER BY sum(b - a) DESC, name) AS rank
  FROM ({_OVERLAP_OPS}) o WHERE kind = 'comm' GROUP BY 1, 2) x JOIN o_sum USING (trace_id) WHERE rank <= 15
""")
def _(t):
    return device.top_comm_kernels(t)


# ---------------------------------------------------------------- modules and threads

_EXCL = "CAST(excl AS DOUBLE) / n_steps"


@query("a03_modules", f"""
SELECT m.trace_id, m.name, parent, CAST(ns AS DOUBLE) / n_steps AS inclusive_ns, {_EXCL} AS exclusive_ns, n_calls, n_threads,
  n_children, array_to_string(roles, ',') AS roles, CAST(depth AS BIGINT) AS depth
FROM o_module m JOIN o_sum USING (trace_id) LEFT JOIN o_depth d ON d.trace_id = m.trace_id AND d.name = m.name
""")
def _(t):
    out = modules.module_times(modules.module_calls(t), t.summary)
    return out.withColumn("roles", F.array_join("roles", ",")).drop("step_dur_ns")


@query("a03_event_exclusive", """
SELECT c.trace_id, c.idx, c.name, c.clipped AS inclusive_ns, greatest(0, c.clipped - coalesce(b.below, 0)) AS exclusive_ns FROM o_call c
LEFT JOIN (SELECT m.trace_id, m.module_idx, CAST(sum(k.clipped) AS BIGINT) AS below FROM o_call k JOIN o_mod m ON m.trace_id = k.trace_id AND m.idx = k.idx
  GROUP BY 1, 2) b ON b.trace_id = c.trace_id AND b.module_idx = c.idx
""")
def _(t):
    return modules.event_exclusive(modules.module_calls(t))


@query("a03_role_counts", """
SELECT trace_id, count(*) FILTER (role = 'main_thread') AS n_main_calls, count(*) FILTER (role = 'worker_thread') AS n_worker_calls
FROM o_call GROUP BY 1
""")
def _(t):
    return modules.module_role_counts(modules.module_calls(t))


@query("a22_module_levels", f"""
SELECT trace_id, CAST(depth AS BIGINT) AS depth, row_number() OVER (PARTITION BY trace_id, depth ORDER BY inclusive_ns DESC, name) AS rank,
  replace(name, 'nn.Module: ', '') AS module,
  CASE WHEN list_contains(roles, 'worker_thread') AND NOT list_contains(roles, 'main_thread') THEN 'worker'
       WHEN list_contains(roles, 'main_thread') THEN 'main' WHEN list_contains(roles, 'autograd_thread') THEN 'autograd' ELSE 'other' END AS thread_tag,
  inclusive_ns, exclusive_ns, inclusive_ns / step_dur_ns * 100 AS inclusive_pct, exclusive_ns / step_dur_ns * 100 AS exclusive_pct, n_calls FROM (
  SELECT m.trace_id, m.name, roles, depth, n_calls, step_dur_ns, CAST(ns AS DOUBLE) / n_steps AS inclusive_ns, {_EXCL} AS exclusive_ns
  FROM o_module m JOIN o_sum USING (trace_id) JOIN o_depth d ON d.trace_id = m.trace_id AND d.name = m.name) x
""")
def _(t):
    return modules.module_levels(modules.module_times(modules.module_calls(t), t.summary))


@query("f12_thread_tag", """
SELECT trace_id, thread_tag, count(*) AS n FROM (
  SELECT trace_id, name, CASE WHEN bool_or(role = 'worker_thread') AND NOT bool_or(role = 'main_thread') THEN 'worker'
    WHEN bool_or(role = 'main_thread') THEN 'main' WHEN bool_or(role = 'autograd_thread') THEN 'autograd' ELSE 'other' END AS thread_tag
  FROM trace_event e JOIN o_thread t USING (trace_id, pid, tid) WHERE cat = 'python_function' AND role IS NOT NULL GROUP BY 1, 2) x
GROUP BY 1, 2
""")
def _(t):
    known = t.threads.filter("role is not null").select("trace_id", "pid", "tid", "role")
    roles = t.events.filter("cat = 'python_function'").join(known, ["trace_id", "pid", "tid"]).groupBy(
        "trace_id", "name").agg(F.collect_set("role").alias("roles"))
    return roles.groupBy("trace_id", labels.thread_tag(F.col("roles")).alias("thread_tag")).agg(
        F.count(F.lit(1)).alias("n"))


@query("a07_worker_threads", """
SELECT t.trace_id, t.pid, t.tid, thread_name, role, n_events, dur_ns, coalesce(modules, '') AS modules, coalesce(n_modules, 0) AS n_modules,
  row_number() OVER (PARTITION BY t.trace_id ORDER BY dur_ns DESC, first_idx) AS rank
FROM o_thread t LEFT JOIN (SELECT trace_id, pid, tid, string_agg(m, '; ' ORDER BY m) AS modules, count(*) AS n_modules
  FROM (SELECT DISTINCT trace_id, pid, tid, replace(name, 'nn.Module: ', '') AS m FROM trace_event
        WHERE cat = 'python_function' AND name LIKE 'nn.Module:%') d GROUP BY 1, 2, 3) x USING (trace_id, pid, tid)
WHERE role IN ('worker_thread', 'autograd_thread')
""")
def _(t):
    return modules.worker_threads(t)


@query("a07_worker_functions", """
SELECT trace_id, pid, tid, rank, name, dur_ns FROM (
  SELECT *, row_number() OVER (PARTITION BY trace_id, pid, tid ORDER BY dur_ns DESC, idx) AS rank FROM (
    SELECT e.trace_id, e.pid, e.tid, e.idx, e.cat, e.name, e.dur_ns, row_number() OVER (PARTITION BY e.trace_id, e.pid, e.tid ORDER BY e.dur_ns DESC, e.idx) AS r
    FROM trace_event e JOIN o_thread t ON e.trace_id = t.trace_id AND e.pid = t.pid AND e.tid = t.tid AND role IN ('worker_thread', 'autograd_thread')
    WHERE ph = 'X' AND e.dur_ns > 1000000) x
  WHERE r <= 10 AND cat = 'python_function' AND name NOT LIKE 'nn.Module:%' AND name NOT LIKE '%threading.py%') y WHERE rank <= 5
""")
def _(t):
    return modules.worker_functions(t)


@query("a09_thread_timelines", """
SELECT trace_id, pid, tid, lane_kind, rank, name, cat, ts_ns, dur_ns,
  CASE WHEN lane_kind = 'main_thread' THEN parent_idx IS NULL OR dur_ns > 10000000 END AS is_top, total_events FROM (
  SELECT e.trace_id, e.pid, e.tid, e.idx, e.name, e.cat, e.ts_ns, e.dur_ns, lane_kind, k, row_number() OVER w AS rank,
    count(*) OVER (PARTITION BY e.trace_id, e.pid, e.tid, lane_kind) AS total_events
  FROM trace_event e JOIN (
    SELECT *, 'main_thread' AS lane_kind, 20 AS k FROM o_thread WHERE is_reported_main
    UNION ALL SELECT *, 'gpu_primary_stream', 20 FROM o_thread WHERE is_primary_stream
    UNION ALL SELECT *, 'gpu_stream', 10 FROM o_thread WHERE NOT is_primary_stream AND stream_ops >= 10
    UNION ALL SELECT *, 'worker', 10 FROM o_thread WHERE role IN ('worker_thread', 'autograd_thread')) t
    ON e.trace_id = t.trace_id AND e.pid = t.pid AND e.tid = t.tid
  WHERE ph = 'X' AND CASE lane_kind
    WHEN 'main_thread' THEN e.dur_ns > 500000 AND cat IN ('python_function', 'cpu_op', 'user_annotation')
    WHEN 'gpu_primary_stream' THEN cat IN ('kernel', 'gpu_memcpy', 'gpu_memset', 'gpu_user_annotation')
    WHEN 'gpu_stream' THEN cat IN ('kernel', 'gpu_memcpy', 'gpu_memset') ELSE e.dur_ns > 500000 END
  WINDOW w AS (PARTITION BY e.trace_id, e.pid, e.tid, lane_kind ORDER BY e.dur_ns DESC, e.ts_ns, e.idx)) x
LEFT JOIN o_parent p USING (trace_id, idx) WHERE rank <= k
""")
def _(t):
    return modules.thread_timelines(t)


_STACKS = f"""
SELECT h.trace_id, h.name, arg_min(e.stack_traces[1], e.idx) FILTER (len(e.stack_traces) > 0) AS stack,
  CAST(sum(e.dur_ns) AS BIGINT) AS total_ns, count(*) AS n_calls, any_value(rank) AS rank
FROM ({_TOP_KERNELS}) h JOIN trace_event e ON e.trace_id = h.trace_id AND e.name = h.name AND e.cat = 'kernel' WHERE h.rank <= 20
GROUP BY 1, 2 HAVING count(*) FILTER (len(e.stack_traces) > 0) > 0
"""


@query("a10_kernel_call_stacks", _STACKS, stacks=True)
def _(t):
    return device.kernel_call_stacks(t.events, device.top_kernels(t))


@query("f13_framework_kernels", f"""
SELECT k.trace_id, k.name, dur_ns, k.n_calls, op_name, 'https://example.org/vendor' AS repo_url,
  'https://example.org/vendor/search?search=' || op_name || '&type=code' AS search_url FROM (
  SELECT *, nullif(regexp_extract(name, '(?:vendor|vendor_torch)::([A-Za-z0-9_]+)', 1), '') AS op_name FROM ({_TOP_KERNELS}) t) k
LEFT JOIN ({_STACKS}) s ON s.trace_id = k.trace_id AND s.name = k.name
WHERE lower(k.name) LIKE '%vendor%' OR lower(coalesce(stack, '')) LIKE '%vendor%'
""", stacks=True)
def _(t):
    hot = device.top_kernels(t)
    return device.framework_kernels(hot, device.kernel_call_stacks(t.events, hot), "vendor", ["vendor", "vendor_torch"],
                                    "https://example.org/vendor")
