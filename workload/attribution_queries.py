"""Stacks, flows and module instances over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.operators import device, flows, nesting, phases, rollup, stacks
from stepweave.plans.instances import InstanceTiming
from stepweave.session import materialize
from workload.oracle import with_ctes
from workload.trace_queries import _HOST_MODULES, _TOP_KERNELS, _as_bigint, trace_tables
from workload.views import spark_view

QUERIES = {}
ORACLES: dict[str, str] = {}
_SPANS: dict[tuple[str, str], DataFrame] = {}

ROOTS = ("C3", "C7")


def source_spans(spark: SparkSession, sf: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _SPANS:
        _SPANS[key] = materialize(spark_view(spark, sf, "source_span"))
    return _SPANS[key]


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, sf: fn(trace_tables(spark, sf), source_spans(spark, sf))
        if sql:
            ORACLES[name] = with_ctes(sql, stacks=True)
        return fn
    return add


def _sources(spans: DataFrame) -> DataFrame:
    return spans.select(F.col("file").alias("basename")).distinct()


def sites_text(sites: Column) -> Column:
    return F.array_join(F.transform(sites, lambda s: F.concat_ws(":", s["file"], s["line"])), ">")


_SITES = "array_to_string(list_transform(ancestors, lambda s: concat(s.file, ':', s.line)), '>')"


@query("f09_user_frames", """
SELECT trace_id, idx, trace_no, frame_no, file, line, func FROM o_frame WHERE is_own
""")
def _(t, spans):
    own = stacks.user_frames(t.frames, _sources(spans))
    return stacks.kernel_stacks(t.events).join(own, "stack_key").select(
        "trace_id", "idx", "trace_no", "frame_no", "file", "line", "func")


@query("d03_line_to_method", """
SELECT DISTINCT f.file, f.line, l.class, l.method, l.class_start FROM o_frame f JOIN o_loc l ON l.file = f.file AND l.line = f.line
""")
def _(t, spans):
    return stacks.locate_lines(t.frames, spans)


_HOT = """
SELECT trace_id, kind, key, coalesce(sum(share) FILTER (NOT is_bwd), 0.0) AS fwd_ns, coalesce(sum(share) FILTER (is_bwd), 0.0) AS bwd_ns FROM (
  SELECT DISTINCT f.trace_id, f.idx, u.kind, u.key, CAST(f.dur_ns AS DOUBLE) / s.n_stacks AS share, s.is_bwd
  FROM o_frame f JOIN o_stacked s ON s.trace_id = f.trace_id AND s.idx = f.idx LEFT JOIN o_loc l ON l.file = f.file AND l.line = f.line,
  LATERAL (SELECT 'line' AS kind, concat(f.file, ':', f.line) AS key UNION ALL SELECT 'class', concat(f.file, ':', l.class) WHERE l.class IS NOT NULL
           UNION ALL SELECT 'method', concat(f.file, ':', l.class, '.', l.method) WHERE l.method IS NOT NULL) u) x
GROUP BY 1, 2, 3
"""


@query("a11_source_hotspots", _HOT)
def _(t, spans):
    return stacks.source_hotspots(t.events, spans, t.frames)


@query("a11_kernel_time", """
SELECT trace_id, CAST(sum(coalesce(dur_ns, 0)) AS BIGINT) AS kernel_ns FROM trace_event WHERE cat = 'kernel' GROUP BY 1
""")
def _(t, spans):
    return stacks.kernel_time(t.events)


@query("a11_hot_classes", f"""
SELECT * FROM (SELECT *, fwd_ns + bwd_ns AS total_ns, row_number() OVER (PARTITION BY trace_id ORDER BY fwd_ns + bwd_ns DESC, key) AS rank
FROM ({_HOT}) h WHERE kind = 'class') x WHERE rank <= 20
""")
def _(t, spans):
    return stacks.hot_sources(stacks.source_hotspots(t.events, spans, t.frames), "class", 20)


@query("a11_hot_lines", f"""
WITH hot AS ({_HOT}) SELECT trace_id, class_key, rank, line, method, total_ns, fwd_ns, bwd_ns FROM (
  SELECT *, row_number() OVER (PARTITION BY trace_id, class_key ORDER BY total_ns DESC, line) AS rank FROM (
    SELECT h.trace_id, l.file || ':' || l.class AS class_key, l.line, l.method, fwd_ns + bwd_ns AS total_ns, fwd_ns, bwd_ns
    FROM hot h JOIN o_loc l ON h.key = l.file || ':' || l.line WHERE kind = 'line') a
  JOIN (SELECT trace_id, key AS class_key FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY fwd_ns + bwd_ns DESC, key) AS r
        FROM hot WHERE kind = 'class') c WHERE r <= 5) b USING (trace_id, class_key)) d WHERE rank <= 10
""")
def _(t, spans):
    return stacks.hot_lines_of_classes(materialize(stacks.source_hotspots(t.events, spans, t.frames)), spans)


_LEAF_CLASS = """
SELECT trace_id, name, class, sum(share) AS dur_ns FROM (
  SELECT f.trace_id, f.idx, f.name, f.trace_no, arg_max(l.class, f.frame_no) AS class, any_value(CAST(f.dur_ns AS DOUBLE) / s.n_stacks) AS share
  FROM o_frame f JOIN o_loc l ON l.file = f.file AND l.line = f.line JOIN o_stacked s ON s.trace_id = f.trace_id AND s.idx = f.idx
  WHERE f.path NOT LIKE '%site-packages%' AND f.path NOT LIKE '%/usr/%' GROUP BY 1, 2, 3, 4) x GROUP BY 1, 2, 3
"""


@query("a13_kernel_source_classes", _LEAF_CLASS)
def _(t, spans):
    return stacks.kernel_source_classes(t.events, spans)


@query("a13_enriched_modules", f"""
WITH top AS ({_TOP_KERNELS}), src AS ({_LEAF_CLASS}), host AS ({_HOST_MODULES})
SELECT s.trace_id, s.name, s.class AS module, s.dur_ns, 'stack' AS source FROM src s SEMI JOIN top k ON k.trace_id = s.trace_id AND k.name = s.name
UNION ALL
SELECT k.trace_id, k.name, h.module, CAST(h.dur_ns AS DOUBLE), 'host' FROM top k LEFT JOIN host h ON h.trace_id = k.trace_id AND h.name = k.name
WHERE NOT EXISTS (SELECT 1 FROM src s WHERE s.trace_id = k.trace_id AND s.name = k.name)
""")
def _(t, spans):
    hot = device.hot_kernel_modules(device.top_kernels(t), device.kernel_host_modules(t))
    return stacks.enriched_kernel_modules(materialize(hot), materialize(stacks.kernel_source_classes(t.events, spans)))


@query("t09_step_phases", "SELECT trace_id, step_no, phase, phase_start, phase_end, label FROM o_phase")
def _(t, spans):
    return phases.step_phases(t.events)[1]


@query("t09_annotated_steps", "SELECT trace_id, step_no, step_name, step_start, step_end FROM o_pstep")
def _(t, spans):
    return phases.step_phases(t.events)[0]


_TIMING: dict[int, InstanceTiming] = {}


def _timing(t, spans) -> InstanceTiming:
    if id(t) not in _TIMING:
        _TIMING[id(t)] = InstanceTiming(t, _sources(spans), spans)
    return _TIMING[id(t)]


@query("t10_kernel_phase", "SELECT trace_id, idx, phase FROM o_kphase")
def _(t, spans):
    timing = _timing(t, spans)
    kernels = t.events.filter("cat = 'kernel' and dur_ns > 0").select(
        "trace_id", "idx", F.col("ts_ns").alias("start_ns"), (F.col("ts_ns") + F.col("dur_ns")).alias("end_ns"))
    return phases.phase_of_spans(kernels, timing.steps, timing.phases)


@query("t16_flow_pairs", "SELECT * FROM o_flow")
def _(t, spans):
    return flows.flow_pairs(t.events)


@query("t15_enclosing_op", "SELECT trace_id, flow_id, bwd_op AS op_idx, bwd_start AS op_start, bwd_end AS op_end FROM o_flow_op WHERE bwd_op IS NOT NULL")
def _(t, spans):
    return flows.enclosing_op(flows.flow_pairs(t.events), t.events, "bwd_ts", "bwd_tid", ["flow_id"])


@query("t17_forward_scope", "SELECT trace_id, idx, flow_id, fwd_tid, fwd_start, fwd_end FROM o_scope")
def _(t, spans):
    kernels = t.events.filter("cat = 'kernel' and dur_ns > 0")
    return flows.forward_scope(kernels, flows.flow_pairs(t.events), t.events)


@query("t18_borrowed_stack", "SELECT trace_id, idx, donor_idx FROM o_lent")
def _(t, spans):
    return flows.kernel_stack_costs(t, _sources(spans)).filter("donor_idx is not null").select(
        "trace_id", "idx", "donor_idx")


@query("t19_external_id_module", "SELECT trace_id, external_id, module FROM o_ext")
def _(t, spans):
    return nesting.external_id_modules(t.events)


@query("a14_kernel_stack_costs", """
SELECT k.trace_id, k.idx, k.dur_ns, CASE WHEN has_stack AND bwd_stack OR NOT has_stack AND is_bwd THEN 'bwd' ELSE 'fwd' END AS phase,
  CASE WHEN has_stack THEN 'stack' WHEN donor_idx IS NOT NULL THEN 'borrowed' ELSE coalesce(via, 'none') END AS source, donor_idx,
  CASE WHEN NOT has_stack AND donor_idx IS NULL THEN regexp_replace(regexp_replace(regexp_replace(replace(m.module, 'nn.Module: ', ''),
    ', callsite: [0-9]+', ''), '_[0-9]+$', ''), '^FSDP', '') END AS module_class, NOT has_stack AND donor_idx IS NULL AND via IS NULL AS unmatched
FROM o_kernel k LEFT JOIN o_lent l ON l.trace_id = k.trace_id AND l.idx = k.idx LEFT JOIN o_kmod m ON m.trace_id = k.trace_id AND m.idx = k.idx
""")
def _(t, spans):
    return flows.kernel_stack_costs(t, _sources(spans))


@query("a15_instance_keys", f"""
SELECT trace_id, idx, trace_no, frame_no, class, site_file, site_line, {_SITES} AS ancestors FROM o_key
""")
def _(t, spans):
    own = stacks.user_frames(t.frames, _sources(spans))
    keys = stacks.instance_keys(own, spans)
    return stacks.kernel_stacks(t.events).join(keys, "stack_key").drop("stack_key").withColumn(
        "ancestors", sites_text(F.col("ancestors")))


@query("a16_attribution", f"""
SELECT trace_id, idx, dur_ns, is_bwd, class, site_file, site_line, {_SITES} AS ancestors, CAST(n_hits AS BIGINT) AS n_hits,
  CAST(n_total AS BIGINT) AS n_total, rung FROM o_attr
""")
def _(t, spans):
    return rollup.kernel_attribution(t, _sources(spans), spans).withColumn("ancestors", sites_text(F.col("ancestors"))).drop("ts_ns")


_COUNTERS = """
SELECT trace_id, count(*) AS total_kernels, count(*) FILTER (rung = 'stack' AND NOT is_bwd) AS fwd_attributed,
  count(*) FILTER (rung = 'stack' AND is_bwd) AS bwd_attributed, count(*) FILTER (rung = 'wrapped') AS wrapped_fallback,
  count(*) FILTER (rung = 'none' AND NOT is_bwd) AS fwd_unattributed, count(*) FILTER (rung = 'none' AND is_bwd) AS bwd_unattributed,
  count(*) FILTER (narrowed) AS bwd_via_flow_narrowed, CAST(sum(dur_ns) AS BIGINT) AS total_kernel_ns FROM (
  SELECT DISTINCT a.trace_id, a.idx, a.rung, a.is_bwd, a.dur_ns, a.rung = 'stack' AND a.is_bwd AND s.idx IS NOT NULL AS narrowed
  FROM o_attr a LEFT JOIN o_scope s ON s.trace_id = a.trace_id AND s.idx = a.idx) x GROUP BY 1
"""


@query("a16_counters", _COUNTERS)
def _(t, spans):
    return _as_bigint(rollup.attribution_counters(t, _timing(t, spans).attribution), "total_kernel_ns")


def _ns(exact: str) -> str:
    """Billionths of a ns as ns, in DuckDB."""
    return f"CAST(CAST({exact} AS HUGEINT) // 1000000000 AS DOUBLE) + CAST(CAST({exact} AS HUGEINT) % 1000000000 AS DOUBLE) / 1e9"


_INST_COLUMNS = f"""trace_id, class, site_file, site_line, {_SITES} AS ancestors,
  {_ns('self_f')} AS self_forward, {_ns('self_b')} AS self_backward, {_ns('self_o')} AS self_optimize, {_ns('self_x')} AS self_other,
  {_ns('f')} AS inclusive_forward, {_ns('b')} AS inclusive_backward, {_ns('o')} AS inclusive_optimize, {_ns('x')} AS inclusive_other, synthesized, is_orphan"""


@query("a17_instance_times", f"SELECT {_INST_COLUMNS} FROM o_inst")
def _(t, spans):
    return _timing(t, spans).times().withColumn("ancestors", sites_text(F.col("ancestors")))


@query("a17_instance_times_one_level", f"SELECT {_INST_COLUMNS} FROM o_inst1")
def _(t, spans):
    return _timing(t, spans).times(mode="one_level").withColumn("ancestors", sites_text(F.col("ancestors")))


# The root that takes the orphans: smallest instance of a root class, entered from <root> if there is one.
_ROOTED = f"""
SELECT i.* REPLACE (f + CASE WHEN r.trace_id IS NOT NULL THEN xf ELSE 0 END AS f, b + CASE WHEN r.trace_id IS NOT NULL THEN xb ELSE 0 END AS b,
  o + CASE WHEN r.trace_id IS NOT NULL THEN xo ELSE 0 END AS o, x + CASE WHEN r.trace_id IS NOT NULL THEN xx ELSE 0 END AS x)
FROM o_inst i LEFT JOIN (
  SELECT p.trace_id, p.k, sum(i.f) AS xf, sum(i.b) AS xb, sum(i.o) AS xo, sum(i.x) AS xx FROM (
    SELECT trace_id, arg_min((class, site_file, site_line, ancestors), (CASE WHEN site_file = '<root>' THEN 0 ELSE 1 END, class, site_file, site_line, ancestors)) AS k
    FROM o_inst WHERE class IN {ROOTS} GROUP BY 1) p
  JOIN o_inst i ON i.trace_id = p.trace_id AND i.is_orphan AND (i.class, i.site_file, i.site_line, i.ancestors) <> p.k GROUP BY 1, 2) r
ON r.trace_id = i.trace_id AND r.k = (i.class, i.site_file, i.site_line, i.ancestors)
"""


@query("a17_instance_times_rooted", f"SELECT {_INST_COLUMNS} FROM ({_ROOTED}) i")
def _(t, spans):
    return _timing(t, spans).times(ROOTS).withColumn("ancestors", sites_text(F.col("ancestors")))


_PANEL = f"""
SELECT trace_id, class, CASE WHEN site_file <> '<wrapped>' AND site_line > 0 THEN concat(class, '@', site_file, ':', site_line) ELSE class END AS instance_name,
  site_file, CASE WHEN site_line > 0 THEN site_line END AS site_line, ancestors, site_line AS raw_line, f, b, o, x, self_f, self_b, self_o, self_x FROM ({_ROOTED}) i
"""


@query("a18_timing_panel", f"""
SELECT trace_id, class, instance_name, site_file, site_line, {_SITES} AS ancestors, {_ns('self_f')} AS forward_ns,
  {_ns('self_b')} AS backward_ns, {_ns('self_o')} AS optimize_ns, {_ns('self_x')} AS other_ns,
  {_ns('self_f + self_b + self_o + self_x')} AS self_ns, {_ns('f')} AS inclusive_forward_ns,
  {_ns('b')} AS inclusive_backward_ns, {_ns('f + b + o + x')} AS inclusive_ns,
  row_number() OVER (PARTITION BY trace_id, class ORDER BY site_file, coalesce(site_line, 0), instance_name, raw_line, ancestors) AS ord
FROM ({_PANEL}) p
""")
def _(t, spans):
    return _timing(t, spans).panel(ROOTS).withColumn("ancestors", sites_text(F.col("ancestors")))


@query("a18_class_times", f"""
SELECT trace_id, class, {_ns('sum(f + b + o + x)')} AS inclusive_ns, {_ns('sum(f)')} AS forward_ns,
  {_ns('sum(b)')} AS backward_ns, count(*) AS n_instances FROM ({_PANEL}) p GROUP BY 1, 2
""")
def _(t, spans):
    return _timing(t, spans).class_times(ROOTS)


@query("a19_instance_summary", f"""
SELECT c.trace_id, {_ns('step')} AS step_kernel_ns, {_ns('own')} AS attributed_ns,
  {_ns('greatest(0, step - own)')} AS unattributed_ns
FROM (SELECT c.trace_id, CAST(total_kernel_ns AS HUGEINT) * 1000000000 // n AS step FROM ({_COUNTERS}) c
  JOIN (SELECT trace_id, count(*) AS n FROM o_pstep GROUP BY 1) s ON s.trace_id = c.trace_id) c
JOIN (SELECT trace_id, sum(f + b + o + x) AS own FROM o_self GROUP BY 1) o ON o.trace_id = c.trace_id
""")
def _(t, spans):
    return _timing(t, spans).summary()
