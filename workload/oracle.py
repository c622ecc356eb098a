"""DuckDB texts for intermediate results that several oracle queries share."""

from __future__ import annotations

from workload.views import VIEWS, duckdb_ctes

CTES: dict[str, str] = {}

CTES["o_label"] = """
SELECT trace_id, pid, arg_max(arg_labels, idx) AS label, min(idx) AS first_idx
FROM trace_event WHERE ph = 'M' AND name = 'process_labels' GROUP BY 1, 2
"""
CTES["o_name"] = """
SELECT trace_id, pid, tid, arg_max(arg_name, idx) AS thread_name
FROM trace_event WHERE ph = 'M' AND name = 'thread_name' GROUP BY 1, 2, 3
"""
CTES["o_thread"] = """
SELECT trace_id, pid, tid, thread_name, role, n_events, dur_ns, has_modules, stream_ops, is_primary_stream,
  CASE WHEN stream_ops IS NULL THEN NULL WHEN is_primary_stream THEN 'compute' WHEN n_nccl > 0 THEN 'comm'
       WHEN n_copy > 0 THEN 'memcpy' END AS stream_kind, is_reported_main, first_idx
FROM (
 SELECT *, stream_ops IS NOT NULL AND row_number() OVER (PARTITION BY trace_id ORDER BY stream_ops DESC NULLS LAST, first_idx) = 1
        AS is_primary_stream
 FROM (
  SELECT x.*, coalesce(n.thread_name, '') AS thread_name,
    CASE WHEN x.pid = (SELECT max(pid) FROM o_label l WHERE l.trace_id = x.trace_id AND label LIKE '%CPU%') THEN
      CASE WHEN (x.pid, x.tid) = (fb.pid, fb.tid) OR (x.pid, x.tid) = (st.pid, st.tid) THEN 'main_thread'
           WHEN n.thread_name LIKE '%pt_autograd%' THEN 'autograd_thread'
           WHEN n_events > 10 THEN 'worker_thread' ELSE 'other' END END AS role,
    CASE WHEN x.pid IN (SELECT pid FROM o_label l WHERE l.trace_id = x.trace_id AND label LIKE '%GPU%') AND n_dev > 0
         THEN n_dev END AS stream_ops,
    coalesce((x.pid, x.tid) = (coalesce(fb.pid, st.pid), coalesce(fb.tid, st.tid)), false) AS is_reported_main
  FROM (SELECT trace_id, pid, tid, count(*) AS n_events, CAST(sum(coalesce(dur_ns, 0)) AS BIGINT) AS dur_ns,
          count(*) FILTER (cat IN ('kernel', 'gpu_memcpy', 'gpu_memset')) AS n_dev,
          count(*) FILTER (cat = 'gpu_memcpy') AS n_copy,
          count(*) FILTER (cat = 'kernel' AND lower(name) LIKE '%nccl%') AS n_nccl,
          bool_or(cat = 'python_function' AND name LIKE 'nn.Module:%') AS has_modules, min(idx) AS first_idx
        FROM trace_event WHERE ph = 'X' GROUP BY 1, 2, 3) x
  LEFT JOIN o_name n USING (trace_id, pid, tid)
  LEFT JOIN (SELECT trace_id, arg_min(pid, idx) AS pid, arg_min(tid, idx) AS tid FROM trace_event
             WHERE cat = 'python_function' AND name LIKE '%forward_backward%' GROUP BY 1) fb ON fb.trace_id = x.trace_id
  LEFT JOIN (SELECT trace_id, arg_min(pid, idx) AS pid, arg_min(tid, idx) AS tid FROM trace_event
             WHERE name LIKE 'train_runner.py%' AND name LIKE '%step%' AND dur_ns > 100000000 GROUP BY 1) st
         ON st.trace_id = x.trace_id) y) z
"""
CTES["o_step"] = """
SELECT trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY ts_ns, idx) - 1 AS step_no, name AS step_name,
  ts_ns, ts_ns + dur_ns AS end_ns, dur_ns
FROM trace_event WHERE cat = 'user_annotation' AND ph = 'X' AND name LIKE '%ProfilerStep%'
"""
CTES["o_sum"] = """
SELECT trace_id, count(*) AS n_steps, CAST(sum(dur_ns) AS DOUBLE) / count(*) AS step_dur_ns FROM o_step GROUP BY 1
"""
CTES["o_dstep"] = """
SELECT e.trace_id, row_number() OVER (PARTITION BY e.trace_id ORDER BY ts_ns, idx) - 1 AS step_no, name AS step_name,
  ts_ns, ts_ns + e.dur_ns AS end_ns, e.dur_ns
FROM trace_event e JOIN o_thread t ON e.trace_id = t.trace_id AND e.pid = t.pid AND e.tid = t.tid AND t.is_primary_stream
WHERE cat = 'gpu_user_annotation' AND name LIKE '%ProfilerStep%'
"""
CTES["o_prim"] = """
SELECT e.* FROM trace_event e JOIN o_thread t
  ON e.trace_id = t.trace_id AND e.pid = t.pid AND e.tid = t.tid AND t.is_primary_stream
WHERE ph = 'X' AND cat IN ('kernel', 'gpu_memcpy', 'gpu_memset')
"""
# Cut to the first device step that contains the start.
CTES["o_prim_clip"] = """
SELECT p.trace_id, p.idx, p.name, p.dur_ns,
  coalesce((SELECT arg_min(least(p.ts_ns + p.dur_ns, s.end_ns) - p.ts_ns, s.step_no) FROM o_dstep s
            WHERE s.trace_id = p.trace_id AND s.ts_ns <= p.ts_ns AND p.ts_ns < s.end_ns), 0) AS clipped
FROM o_prim p
"""
CTES["o_span"] = """
SELECT trace_id, pid, tid, idx, cat, name, ts_ns, ts_ns + coalesce(dur_ns, 0) AS e_ns,
  cat = 'python_function' AND name LIKE 'nn.Module:%' AS is_mod,
  row_number() OVER (PARTITION BY trace_id, pid, tid ORDER BY ts_ns, idx) AS pos
FROM trace_event WHERE ph = 'X'
"""
CTES["o_parent"] = """
SELECT a.trace_id, a.idx, b.idx AS parent_idx FROM (
  SELECT a.trace_id, a.pid, a.tid, a.idx, max(b.pos) AS ppos FROM o_span a LEFT JOIN o_span b
    ON a.trace_id = b.trace_id AND a.pid = b.pid AND a.tid = b.tid AND b.pos < a.pos AND b.e_ns >= a.ts_ns
  GROUP BY ALL) a
LEFT JOIN o_span b ON a.trace_id = b.trace_id AND a.pid = b.pid AND a.tid = b.tid AND b.pos = a.ppos
"""
CTES["o_walk(trace_id, idx, cur)"] = """
SELECT trace_id, idx, parent_idx FROM o_parent WHERE parent_idx IS NOT NULL
UNION ALL
SELECT w.trace_id, w.idx, p.parent_idx FROM o_walk w
JOIN o_span m ON m.trace_id = w.trace_id AND m.idx = w.cur AND NOT m.is_mod
JOIN o_parent p ON p.trace_id = w.trace_id AND p.idx = w.cur AND p.parent_idx IS NOT NULL
"""
CTES["o_mod"] = """
SELECT w.trace_id, w.idx, w.cur AS module_idx, m.name AS module
FROM o_walk w JOIN o_span m ON m.trace_id = w.trace_id AND m.idx = w.cur AND m.is_mod
"""
# Main thread, half-open nesting, longer event first.
CTES["o_main_span"] = """
SELECT e.*, ts_ns + dur_ns AS e_ns, row_number() OVER (PARTITION BY e.trace_id ORDER BY ts_ns, -dur_ns, idx) AS pos
FROM trace_event e JOIN (
  SELECT trace_id, arg_max(tid, n) AS tid FROM (SELECT trace_id, tid, count(*) AS n FROM trace_event
    WHERE cat = 'user_annotation' AND ph = 'X' AND name LIKE 'ProfilerStep%' GROUP BY 1, 2) c GROUP BY 1) m
  ON e.trace_id = m.trace_id AND e.tid = m.tid AND e.pid = '0' AND ph = 'X' AND dur_ns IS NOT NULL
"""
CTES["o_main_parent"] = """
SELECT a.trace_id, a.idx, b.idx AS parent_idx FROM (
  SELECT a.trace_id, a.idx, max(b.pos) AS ppos FROM o_main_span a LEFT JOIN o_main_span b
    ON a.trace_id = b.trace_id AND b.pos < a.pos AND b.e_ns > a.ts_ns GROUP BY ALL) a
LEFT JOIN o_main_span b ON a.trace_id = b.trace_id AND b.pos = a.ppos
"""
CTES["o_call"] = """
SELECT c.*, coalesce(m.module, 'ROOT') AS parent,
  coalesce((SELECT arg_min(least(c.ts_ns + c.dur_ns, s.end_ns) - c.ts_ns, s.step_no) FROM o_step s
            WHERE s.trace_id = c.trace_id AND s.ts_ns <= c.ts_ns AND c.ts_ns < s.end_ns), 0) AS clipped
FROM (SELECT e.trace_id, e.pid, e.tid, e.idx, e.name, e.ts_ns, e.dur_ns, t.role
      FROM trace_event e JOIN o_thread t ON e.trace_id = t.trace_id AND e.pid = t.pid AND e.tid = t.tid AND t.role IS NOT NULL
      WHERE e.cat = 'python_function' AND e.name LIKE 'nn.Module:%') c
LEFT JOIN o_mod m ON m.trace_id = c.trace_id AND m.idx = c.idx
"""
CTES["o_module"] = """
SELECT a.*, greatest(0, ns - coalesce(below, 0)) AS excl, coalesce(n_children, 0) AS n_children FROM (
  SELECT trace_id, name, CAST(sum(clipped) AS BIGINT) AS ns, count(*) AS n_calls, arg_max(parent, idx) AS parent,
    count(DISTINCT (pid, tid)) AS n_threads, list_sort(list(DISTINCT role)) AS roles FROM o_call GROUP BY 1, 2) a
LEFT JOIN (
  SELECT l.trace_id, l.parent AS name, CAST(sum(c.ns) AS BIGINT) AS below, count(*) AS n_children
  FROM (SELECT DISTINCT trace_id, parent, name FROM o_call WHERE parent <> 'ROOT') l
  JOIN (SELECT trace_id, name, sum(clipped) AS ns FROM o_call GROUP BY 1, 2) c ON c.trace_id = l.trace_id AND c.name = l.name
  GROUP BY 1, 2) b ON a.trace_id = b.trace_id AND a.name = b.name
"""
CTES["o_depth(trace_id, name, depth)"] = """
SELECT trace_id, name, 0 FROM o_module WHERE parent = 'ROOT'
UNION ALL
SELECT m.trace_id, m.name, d.depth + 1 FROM o_depth d JOIN o_module m ON m.trace_id = d.trace_id AND m.parent = d.name
"""

# ---- stacks: frames straight from the line items, never from the text
CTES["o_frame"] = """
SELECT e.trace_id, e.idx, e.name, e.dur_ns, e.ts_ns, f.path, f.file, f.line, f.func, dense_rank() OVER (PARTITION BY e.trace_id, e.idx ORDER BY trace_no) - 1 AS trace_no,
  row_number() OVER (PARTITION BY e.trace_id, e.idx, trace_no ORDER BY f.frame_no) - 1 AS frame_no, f.file <> 'f9.py' AS is_own
FROM trace_event e JOIN frame f ON f.kernel_idx = e.idx WHERE e.cat = 'kernel' AND e.stack_traces IS NOT NULL
"""
CTES["o_stacked"] = """
SELECT trace_id, idx, max(trace_no) + 1 AS n_stacks, bool_or(func = 'backward_step') AS is_bwd, bool_or(is_own) AS has_chains
FROM o_frame GROUP BY 1, 2
"""
CTES["o_loc"] = """
SELECT c.file, c.line, c.class, c.class_start, (SELECT arg_min(m.method, m.ord) FROM source_span m WHERE m.file = c.file AND m.class = c.class
  AND m.method IS NOT NULL AND c.line BETWEEN m.start_line AND m.end_line) AS method FROM (
  SELECT l.file, l.line, arg_min(s.class, s.ord) AS class, arg_min(s.start_line, s.ord) AS class_start
  FROM (SELECT DISTINCT file, line FROM frame) l JOIN source_span s ON s.file = l.file AND s.method IS NULL
    AND l.line BETWEEN s.start_line AND s.end_line GROUP BY 1, 2) c
"""
CTES["o_key"] = """
SELECT trace_id, idx, trace_no, frame_no, class, coalesce(from_file, '<root>') AS site_file, coalesce(from_line, class_start) AS site_line,
  coalesce(list({'file': coalesce(from_file, '<root>'), 'line': coalesce(from_line, class_start)}) OVER (PARTITION BY trace_id, idx, trace_no
    ORDER BY frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS ancestors FROM (
  SELECT f.trace_id, f.idx, f.trace_no, f.frame_no, l.class, l.class_start,
    last_value(l.class IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen,
    lag(f.file) OVER w AS from_file, lag(f.line) OVER w AS from_line
  FROM o_frame f LEFT JOIN o_loc l ON l.file = f.file AND l.line = f.line WHERE is_own
  WINDOW w AS (PARTITION BY f.trace_id, f.idx, f.trace_no ORDER BY f.frame_no)) x
WHERE class IS NOT NULL AND (seen IS NULL OR seen <> class)
"""
CTES["o_leaf"] = """
SELECT trace_id, idx, trace_no, arg_max({'class': class, 'site_file': site_file, 'site_line': site_line, 'ancestors': ancestors}, frame_no) AS leaf
FROM o_key GROUP BY 1, 2, 3
"""
# ---- flows
CTES["o_flow"] = """
SELECT * FROM (SELECT trace_id, flow_id, arg_max(ts_ns, idx) FILTER (ph = 's') AS fwd_ts, arg_max(tid, idx) FILTER (ph = 's') AS fwd_tid,
  arg_max(ts_ns, idx) FILTER (ph = 'f') AS bwd_ts, arg_max(tid, idx) FILTER (ph = 'f') AS bwd_tid, min(idx) AS first_idx
FROM trace_event WHERE cat = 'fwdbwd' AND flow_id IS NOT NULL GROUP BY 1, 2) x WHERE fwd_ts IS NOT NULL AND bwd_ts IS NOT NULL
"""
CTES["o_op"] = """
SELECT trace_id, tid, idx, ts_ns AS a, ts_ns + dur_ns AS b, dur_ns FROM trace_event WHERE cat = 'cpu_op' AND dur_ns IS NOT NULL
"""
CTES["o_flow_op"] = """
SELECT f.*, fo.a AS fwd_start, fo.b AS fwd_end, bo.idx AS bwd_op, bo.a AS bwd_start, bo.b AS bwd_end FROM o_flow f
LEFT JOIN (SELECT f.trace_id, f.flow_id, arg_min(o, (o.dur_ns, o.a, o.idx)) AS o FROM o_flow f JOIN o_op o ON o.trace_id = f.trace_id AND o.tid = f.fwd_tid
  AND f.fwd_ts BETWEEN o.a AND o.b GROUP BY 1, 2) x ON x.trace_id = f.trace_id AND x.flow_id = f.flow_id
LEFT JOIN (SELECT f.trace_id, f.flow_id, arg_min(o, (o.dur_ns, o.a, o.idx)) AS o FROM o_flow f JOIN o_op o ON o.trace_id = f.trace_id AND o.tid = f.bwd_tid
  AND f.bwd_ts BETWEEN o.a AND o.b GROUP BY 1, 2) y ON y.trace_id = f.trace_id AND y.flow_id = f.flow_id,
LATERAL (SELECT x.o.a AS a, x.o.b AS b) fo, LATERAL (SELECT y.o.idx AS idx, y.o.a AS a, y.o.b AS b) bo
"""
CTES["o_kernel"] = """
SELECT e.trace_id, e.idx, e.tid, e.ts_ns, e.dur_ns, e.external_id, s.idx IS NOT NULL AS has_stack, coalesce(s.is_bwd, false) AS bwd_stack,
  coalesce(s.has_chains, false) AS has_chains, e.tid IN (SELECT bwd_tid FROM o_flow f WHERE f.trace_id = e.trace_id) OR coalesce(s.is_bwd, false) AS is_bwd
FROM trace_event e LEFT JOIN o_stacked s ON s.trace_id = e.trace_id AND s.idx = e.idx WHERE cat = 'kernel' AND e.dur_ns > 0
"""
CTES["o_scope"] = """
SELECT trace_id, idx, ts_ns, s.flow_id AS flow_id, s.fwd_tid AS fwd_tid, s.fwd_start AS fwd_start, s.fwd_end AS fwd_end FROM (
  SELECT k.trace_id, k.idx, k.ts_ns, arg_max(f, (f.bwd_ts, f.first_idx)) AS s FROM o_kernel k JOIN o_flow_op f
    ON f.trace_id = k.trace_id AND f.bwd_tid = k.tid AND f.bwd_ts <= k.ts_ns AND k.ts_ns BETWEEN f.bwd_start AND f.bwd_end GROUP BY ALL) x
WHERE s.fwd_start IS NOT NULL
"""
CTES["o_lent"] = """
SELECT k.trace_id, k.idx, arg_min(d.idx, (abs(d.ts_ns - k.ts_ns), d.ts_ns, d.idx)) AS donor_idx
FROM o_kernel k JOIN o_scope s ON s.trace_id = k.trace_id AND s.idx = k.idx
JOIN o_kernel d ON d.trace_id = k.trace_id AND d.tid = s.fwd_tid AND NOT d.is_bwd AND d.has_chains AND d.ts_ns BETWEEN s.fwd_start AND s.fwd_end
WHERE NOT k.has_stack AND k.is_bwd GROUP BY 1, 2
"""
CTES["o_ext_span"] = """
SELECT trace_id, pid, tid, idx, name, external_id, ts_ns, ts_ns + dur_ns AS e_ns, cat = 'python_function' AND name LIKE 'nn.Module:%' AS is_mod,
  min(idx) OVER (PARTITION BY trace_id, pid, tid) AS thread_first,
  row_number() OVER (PARTITION BY trace_id, pid, tid ORDER BY ts_ns, -dur_ns, CASE WHEN cat = 'python_function' THEN 0 ELSE 1 END, idx) AS pos
FROM trace_event WHERE ph = 'X' AND dur_ns IS NOT NULL AND cat <> 'kernel'
"""
CTES["o_ext"] = """
SELECT trace_id, external_id, arg_min(module, (thread_first, pos)) AS module FROM (
  SELECT a.trace_id, a.external_id, a.thread_first, a.pos, arg_max(m.name, m.pos) AS module
  FROM o_ext_span a JOIN o_ext_span m ON m.trace_id = a.trace_id AND m.pid = a.pid AND m.tid = a.tid AND m.is_mod
    AND (m.pos = a.pos OR (m.pos < a.pos AND m.e_ns > a.ts_ns)) WHERE a.external_id IS NOT NULL GROUP BY 1, 2, 3, 4) x GROUP BY 1, 2
"""
CTES["o_kmod"] = """
SELECT k.trace_id, k.idx, coalesce(x.module, m.module) AS module,
  CASE WHEN x.module IS NOT NULL THEN 'external_id' WHEN m.module IS NOT NULL THEN 'parent' END AS via
FROM o_kernel k LEFT JOIN o_ext x ON x.trace_id = k.trace_id AND x.external_id = k.external_id
LEFT JOIN o_mod m ON m.trace_id = k.trace_id AND m.idx = k.idx
"""
# ---- phases
CTES["o_pstep"] = """
SELECT p.trace_id, row_number() OVER (PARTITION BY p.trace_id ORDER BY p.ts_ns, -p.dur_ns, p.idx) - 1 AS step_no, p.name AS step_name,
  p.ts_ns AS step_start, p.e_ns AS step_end, c.body FROM o_main_span p
JOIN (SELECT s.trace_id, m.parent_idx, arg_max(s.idx, (s.dur_ns, -s.ts_ns, -s.idx)) AS body FROM o_main_parent m
      JOIN o_main_span s ON s.trace_id = m.trace_id AND s.idx = m.idx WHERE m.parent_idx IS NOT NULL GROUP BY 1, 2) c
  ON c.trace_id = p.trace_id AND c.parent_idx = p.idx
WHERE p.name LIKE 'ProfilerStep%' AND p.cat = 'user_annotation'
"""
CTES["o_second"] = """
SELECT p.trace_id, p.step_no, s.idx, s.name, s.ts_ns, s.e_ns FROM o_pstep p JOIN o_main_parent m ON m.trace_id = p.trace_id AND m.parent_idx = p.body
JOIN o_main_span s ON s.trace_id = m.trace_id AND s.idx = m.idx
"""
CTES["o_phase"] = """
SELECT trace_id, step_no, 'optimize' AS phase, ts_ns AS phase_start, e_ns AS phase_end, name AS label FROM o_second
WHERE name NOT LIKE '%forward_backward%' AND lower(name) LIKE '%optimize%'
UNION ALL
SELECT * FROM (SELECT x.trace_id, x.step_no, CASE WHEN lower(s.name) LIKE '%optimize%' THEN NULL
    WHEN regexp_matches(lower(s.name), '(^|[^a-z])backward([^a-z]|$)') THEN 'backward'
    WHEN regexp_matches(lower(s.name), '(^|[^a-z])forward([^a-z]|$)') THEN 'forward' END AS phase, s.ts_ns, s.e_ns, s.name
  FROM o_second x JOIN o_main_parent m ON m.trace_id = x.trace_id AND m.parent_idx = x.idx
  JOIN o_main_span s ON s.trace_id = m.trace_id AND s.idx = m.idx WHERE x.name LIKE '%forward_backward%') y WHERE phase IS NOT NULL
"""
CTES["o_kphase"] = """
SELECT trace_id, idx, CASE WHEN greatest(f, b, o) <= 0 THEN 'other' WHEN f >= b AND f >= o THEN 'forward' WHEN b >= o THEN 'backward' ELSE 'optimize' END AS phase FROM (
  SELECT k.trace_id, k.idx,
    coalesce(sum(greatest(0, least(k.ts_ns + k.dur_ns, p.phase_end) - greatest(k.ts_ns, p.phase_start))) FILTER (p.phase = 'forward'), 0) AS f,
    coalesce(sum(greatest(0, least(k.ts_ns + k.dur_ns, p.phase_end) - greatest(k.ts_ns, p.phase_start))) FILTER (p.phase = 'backward'), 0) AS b,
    coalesce(sum(greatest(0, least(k.ts_ns + k.dur_ns, p.phase_end) - greatest(k.ts_ns, p.phase_start))) FILTER (p.phase = 'optimize'), 0) AS o
  FROM o_kernel k LEFT JOIN (SELECT k.trace_id, k.idx, min(step_no) AS step_no FROM o_kernel k JOIN o_pstep s ON s.trace_id = k.trace_id
      AND k.ts_ns + k.dur_ns >= s.step_start AND k.ts_ns <= s.step_end GROUP BY 1, 2) h ON h.trace_id = k.trace_id AND h.idx = k.idx
  LEFT JOIN o_phase p ON p.trace_id = k.trace_id AND p.step_no = h.step_no GROUP BY 1, 2) x
"""
# ---- attribution
CTES["o_attr"] = """
SELECT k.trace_id, k.idx, k.dur_ns, k.bwd_stack AS is_bwd, v.leaf.class AS class, v.leaf.site_file AS site_file, v.leaf.site_line AS site_line, v.leaf.ancestors AS ancestors, v.n_hits,
  sum(v.n_hits) OVER (PARTITION BY k.trace_id, k.idx) AS n_total, 'stack' AS rung
FROM o_kernel k JOIN (SELECT trace_id, idx, leaf, count(*) AS n_hits FROM o_leaf GROUP BY 1, 2, 3) v ON v.trace_id = k.trace_id AND v.idx = k.idx
UNION ALL
SELECT trace_id, idx, dur_ns, bwd_stack, cls, CASE WHEN cls IS NOT NULL THEN '<wrapped>' END, CASE WHEN cls IS NOT NULL THEN
    coalesce(CAST(nullif(regexp_extract(module, 'callsite: ([0-9]+)', 1), '') AS BIGINT), -CAST(regexp_extract(module, '_([0-9]+)', 1) AS BIGINT)) END,
  CASE WHEN cls IS NOT NULL THEN [] END, 1, 1, CASE WHEN cls IS NOT NULL THEN 'wrapped' ELSE 'none' END FROM (
  SELECT k.*, m.module, nullif(regexp_replace(regexp_replace(regexp_replace(replace(m.module, 'nn.Module: ', ''), ', callsite: [0-9]+', ''), '_[0-9]+$', ''), '^FSDP', ''), '') AS cls
  FROM o_kernel k LEFT JOIN o_kmod m ON m.trace_id = k.trace_id AND m.idx = k.idx
  WHERE NOT EXISTS (SELECT 1 FROM o_leaf l WHERE l.trace_id = k.trace_id AND l.idx = k.idx)) w
"""
# Times in whole billionths of a ns.
CTES["o_self"] = """
SELECT a.trace_id, class, site_file, site_line, ancestors,
  CAST(coalesce(sum(CAST(dur_ns AS HUGEINT) * n_hits * 1000000000 // n_total) FILTER (phase = 'forward'), 0) AS HUGEINT) // any_value(n) AS f,
  CAST(coalesce(sum(CAST(dur_ns AS HUGEINT) * n_hits * 1000000000 // n_total) FILTER (phase = 'backward'), 0) AS HUGEINT) // any_value(n) AS b,
  CAST(coalesce(sum(CAST(dur_ns AS HUGEINT) * n_hits * 1000000000 // n_total) FILTER (phase = 'optimize'), 0) AS HUGEINT) // any_value(n) AS o,
  CAST(coalesce(sum(CAST(dur_ns AS HUGEINT) * n_hits * 1000000000 // n_total) FILTER (phase = 'other'), 0) AS HUGEINT) // any_value(n) AS x
FROM o_attr a JOIN o_kphase p ON p.trace_id = a.trace_id AND p.idx = a.idx
JOIN (SELECT trace_id, count(*) AS n FROM o_pstep GROUP BY 1) s ON s.trace_id = a.trace_id WHERE class IS NOT NULL GROUP BY 1, 2, 3, 4, 5
"""
CTES["o_climb(trace_id, class, site_file, site_line, ancestors, f, b, o, x)"] = """
SELECT * FROM o_self
UNION ALL
SELECT c.trace_id, l.class, c.ancestors[len(c.ancestors)].file, c.ancestors[len(c.ancestors)].line, c.ancestors[1:len(c.ancestors) - 1], c.f, c.b, c.o, c.x
FROM o_climb c JOIN o_loc l ON l.file = c.site_file AND l.line = c.site_line WHERE len(c.ancestors) > 0
"""
CTES["o_inst"] = """
SELECT i.*, coalesce(s.f, 0) AS self_f, coalesce(s.b, 0) AS self_b, coalesce(s.o, 0) AS self_o, coalesce(s.x, 0) AS self_x,
  s.class IS NULL AS synthesized, NOT (len(i.ancestors) > 0 AND EXISTS (SELECT 1 FROM o_loc l WHERE l.file = i.site_file AND l.line = i.site_line)) AS is_orphan
FROM (SELECT trace_id, class, site_file, site_line, ancestors, sum(f) AS f, sum(b) AS b, sum(o) AS o, sum(x) AS x FROM o_climb GROUP BY 1, 2, 3, 4, 5) i
LEFT JOIN o_self s ON s.trace_id = i.trace_id AND s.class = i.class AND s.site_file = i.site_file AND s.site_line = i.site_line AND s.ancestors = i.ancestors
"""

# An instance without kernels of its own passes nothing on.
CTES["o_climb1(trace_id, class, site_file, site_line, ancestors, f, b, o, x, is_real)"] = """
SELECT *, true FROM o_self
UNION ALL
SELECT p.*, EXISTS (SELECT 1 FROM o_self s WHERE s.trace_id = p.trace_id AND s.class = p.class AND s.site_file = p.site_file AND s.site_line = p.site_line
    AND s.ancestors = p.ancestors) FROM (
  SELECT c.trace_id, l.class, c.ancestors[len(c.ancestors)].file AS site_file, c.ancestors[len(c.ancestors)].line AS site_line,
    c.ancestors[1:len(c.ancestors) - 1] AS ancestors, c.f, c.b, c.o, c.x
  FROM o_climb1 c JOIN o_loc l ON l.file = c.site_file AND l.line = c.site_line WHERE len(c.ancestors) > 0 AND c.is_real) p
"""
CTES["o_inst1"] = """
SELECT i.*, coalesce(s.f, 0) AS self_f, coalesce(s.b, 0) AS self_b, coalesce(s.o, 0) AS self_o, coalesce(s.x, 0) AS self_x, s.class IS NULL AS synthesized,
  s.class IS NULL OR NOT (len(i.ancestors) > 0 AND EXISTS (SELECT 1 FROM o_loc l WHERE l.file = i.site_file AND l.line = i.site_line)) AS is_orphan
FROM (SELECT trace_id, class, site_file, site_line, ancestors, sum(f) AS f, sum(b) AS b, sum(o) AS o, sum(x) AS x FROM o_climb1 GROUP BY 1, 2, 3, 4, 5) i
LEFT JOIN o_self s ON s.trace_id = i.trace_id AND s.class = i.class AND s.site_file = i.site_file AND s.site_line = i.site_line AND s.ancestors = i.ancestors
"""

# Nested scopes: containers made, who is in which, and what happens to floating nodes, first in the scopes, then in their root containers.
CTES["n_made"] = """
SELECT *, 101 + row_number() OVER (PARTITION BY graph_id ORDER BY depth DESC, attr_id) AS node_id FROM (
  SELECT DISTINCT graph_id, scope_id, concat('c', scope_id, box) AS attr_id, 1 AS depth FROM norm_node WHERE home = 'box'
  UNION ALL SELECT DISTINCT graph_id, scope_id, concat('root', scope_id), 0 FROM norm_node WHERE home <> 'none') b
"""
CTES["n_node"] = """
SELECT n.*, m.node_id AS container_id FROM norm_node n LEFT JOIN n_made m ON m.graph_id = n.graph_id
  AND m.attr_id = CASE home WHEN 'box' THEN concat('c', n.scope_id, box) WHEN 'root' THEN concat('root', n.scope_id) END
"""
CTES["n_nb"] = """
SELECT graph_id, src_id AS a, dst_id AS b FROM graph_edge UNION ALL SELECT graph_id, dst_id, src_id FROM graph_edge
"""
_FATE = """
SELECT c.graph_id, c.scope_id, c.node_id, c.component, CASE WHEN t.loose THEN 'dropped' WHEN t.lo = t.hi THEN 'absorbed' ELSE 'stays' END AS fate,
  CASE WHEN NOT t.loose AND t.lo = t.hi THEN t.lo END AS container_id FROM n_comp{0} c LEFT JOIN (
  SELECT x.graph_id, x.scope_id, y.component, bool_or(target IS NULL) AS loose, min(target) AS lo, max(target) AS hi FROM n_touch{0} x
  JOIN n_comp{0} y ON y.graph_id = x.graph_id AND y.scope_id = x.scope_id AND y.node_id = x.node_id WHERE NOT link GROUP BY 1, 2, 3) t
  ON t.graph_id = c.graph_id AND t.scope_id = c.scope_id AND t.component = c.component
"""
_REACH = """
SELECT graph_id, scope_id, node_id, node_id FROM n_float{0}
UNION SELECT r.graph_id, r.scope_id, r.node_id, t.peer FROM n_reach{0} r JOIN n_touch{0} t ON t.graph_id = r.graph_id AND t.scope_id = r.scope_id AND t.node_id = r.to_id AND t.link
"""
_COMP = "SELECT graph_id, scope_id, node_id, min(to_id) AS component FROM n_reach{0} GROUP BY 1, 2, 3"
CTES["n_float0"] = "SELECT graph_id, scope_id, node_id FROM n_node WHERE home = 'none'"
CTES["n_touch0"] = """
SELECT f.graph_id, f.scope_id, f.node_id, p.node_id AS peer, p.scope_id = f.scope_id AND p.home = 'none' AS link, CASE WHEN p.scope_id = f.scope_id THEN p.container_id END AS target
FROM n_float0 f JOIN n_nb ON n_nb.graph_id = f.graph_id AND n_nb.a = f.node_id JOIN n_node p ON p.graph_id = f.graph_id AND p.node_id = n_nb.b
"""
CTES["n_reach0(graph_id, scope_id, node_id, to_id)"] = _REACH.format(0)
CTES["n_comp0"] = _COMP.format(0)
CTES["n_fate0"] = _FATE.format(0)
CTES["n_box"] = """
SELECT b.graph_id, b.node_id AS box_id, r.node_id AS root_id FROM n_made b JOIN n_made r ON r.graph_id = b.graph_id AND r.scope_id = b.scope_id AND r.depth = 0 WHERE b.depth = 1
"""
CTES["n_held"] = """
SELECT n.graph_id, n.node_id, coalesce(f.container_id, n.container_id) AS container_id FROM n_node n LEFT JOIN n_fate0 f ON f.graph_id = n.graph_id AND f.node_id = n.node_id
"""
CTES["n_float1"] = """
SELECT DISTINCT h.graph_id, concat('container:', CAST(h.container_id AS VARCHAR)) AS scope_id, h.node_id, h.container_id FROM n_held h JOIN n_box x ON x.graph_id = h.graph_id AND x.root_id = h.container_id
"""
CTES["n_touch1"] = """
SELECT f.graph_id, f.scope_id, f.node_id, p.node_id AS peer, coalesce(p.container_id = f.container_id, false) AS link, x.box_id AS target
FROM n_float1 f JOIN n_nb ON n_nb.graph_id = f.graph_id AND n_nb.a = f.node_id JOIN n_held p ON p.graph_id = f.graph_id AND p.node_id = n_nb.b
LEFT JOIN n_box x ON x.graph_id = f.graph_id AND x.root_id = f.container_id AND x.box_id = p.container_id
"""
CTES["n_reach1(graph_id, scope_id, node_id, to_id)"] = _REACH.format(1)
CTES["n_comp1"] = _COMP.format(1)
CTES["n_fate1"] = _FATE.format(1)
CTES["n_content"] = """
SELECT h.graph_id, coalesce(f.container_id, h.container_id) AS container_id, h.node_id FROM n_held h LEFT JOIN n_fate1 f ON f.graph_id = h.graph_id AND f.node_id = h.node_id
WHERE h.container_id IS NOT NULL UNION ALL SELECT graph_id, root_id, box_id FROM n_box
"""
# Direct nodes: what is free and was not absorbed, and behind it the root container of the scope.
CTES["n_direct"] = """
SELECT n.graph_id, n.scope_id, n.node_id, n.node_id AS ord, n.attr_kind, n.is_native, n.file, n.line, n.func FROM n_node n
JOIN n_fate0 f ON f.graph_id = n.graph_id AND f.node_id = n.node_id WHERE f.container_id IS NULL
UNION ALL SELECT graph_id, scope_id, node_id, 1000, 'container', true, NULL, NULL, NULL FROM n_made WHERE depth = 0
"""
CTES["n_helper"] = """
SELECT graph_id, scope_id, func AS group_name, min(node_id) AS first_id, min(ord) AS ord, count(*) AS n_members FROM n_direct
WHERE scope_id <> 'low' AND func LIKE 'help_%' GROUP BY 1, 2, 3 HAVING bool_and(attr_kind = 'functional' OR is_native)
"""
CTES["n_place"] = """
SELECT d.* FROM n_direct d LEFT JOIN n_helper h ON h.graph_id = d.graph_id AND h.scope_id = d.scope_id AND h.group_name = d.func WHERE d.scope_id <> 'low' AND h.group_name IS NULL
UNION ALL SELECT graph_id, scope_id, -first_id - 1, ord, 'module', false, NULL, NULL, NULL FROM n_helper
"""
CTES["n_walk(graph_id, node_id, rank)"] = """
SELECT graph_id, node_id, 0 FROM n_place UNION SELECT w.graph_id, b.node_id, w.rank + 1 FROM n_walk w JOIN graph_edge e ON e.graph_id = w.graph_id AND e.src_id = w.node_id
JOIN n_place a ON a.graph_id = e.graph_id AND a.node_id = e.src_id JOIN n_place b ON b.graph_id = e.graph_id AND b.node_id = e.dst_id AND a.scope_id = b.scope_id
"""
CTES["n_order"] = """
SELECT p.*, row_number() OVER (PARTITION BY p.graph_id, p.scope_id ORDER BY CASE WHEN mixed THEN r.rank ELSE 0 END, p.ord) AS place FROM n_place p
JOIN (SELECT graph_id, node_id, max(rank) AS rank FROM n_walk GROUP BY 1, 2) r ON r.graph_id = p.graph_id AND r.node_id = p.node_id
JOIN (SELECT graph_id, scope_id, bool_or(attr_kind = 'functional' OR is_native) AND bool_or(attr_kind <> 'functional' AND NOT is_native) AS mixed FROM n_place GROUP BY 1, 2) m
  ON m.graph_id = p.graph_id AND m.scope_id = p.scope_id
"""
CTES["n_run"] = """
SELECT graph_id, scope_id, concat(any_value(func), ':', min(line), '~', max(line)) AS group_name, arg_min(node_id, place) AS first_id, min(place) AS ord, count(*) AS n_members FROM (
  SELECT *, sum(CASE WHEN site IS NULL OR before IS NULL OR site <> before THEN 1 ELSE 0 END) OVER (PARTITION BY graph_id, scope_id ORDER BY place) AS run,
    count(*) OVER (PARTITION BY graph_id, scope_id) AS scope_size FROM (
    SELECT *, lag(site) OVER (PARTITION BY graph_id, scope_id ORDER BY place) AS before FROM (
      SELECT *, CASE WHEN func IS NOT NULL AND (attr_kind = 'functional' OR is_native) THEN concat(file, '|', func) END AS site FROM n_order) a) b) c
WHERE site IS NOT NULL GROUP BY graph_id, scope_id, run HAVING count(*) >= 2 AND count(*) < any_value(scope_size)
"""


def _short(name: str) -> str:
    return name.split("(")[0]


def with_ctes(sql: str, stacks: bool = False) -> str:
    """Put the shared texts that ``sql`` mentions in front of it, dependencies first."""
    chosen: list[str] = []

    def visit(text: str) -> None:
        words = text.replace("(", " ").replace(")", " ").replace(",", " ").replace(".", " ").split()
        for key, body in CTES.items():
            if _short(key) in words and key not in chosen:
                chosen.append(key)
                visit(body)

    visit(sql)
    names = [k for k in CTES if k in chosen]
    text = sql + " " + " ".join(CTES[k] for k in names)
    words = text.replace("(", " ").replace(")", " ").replace(",", " ").split()
    base = duckdb_ctes([v for v in VIEWS if v in words], stacks)
    parts = [f"{n} AS ({b})" for n, b in base] + [f"{k} AS ({CTES[k].strip()})" for k in names]
    if sql.strip().startswith("WITH "):
        sql = f"SELECT * FROM ({sql.strip()}) q"
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + sql.strip()
