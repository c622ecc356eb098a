"""Swimlane operators over the driver's tables."""

from __future__ import annotations


from stepweave.operators import swimlane
from stepweave.operators.trace_dims import choose_step
from workload.oracle import with_ctes
from workload.trace_queries import trace_tables

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, sf: fn(trace_tables(spark, sf))
        if sql:
            ORACLES[name] = with_ctes(sql)
        return fn
    return add


_LABEL = "regexp_replace(substr(name, 12), ', callsite.*', '')"
_CALLS = f"""
SELECT trace_id, pid, tid, idx, {_LABEL} AS name, ts_ns, dur_ns, call_from, py_id, py_parent_id
FROM trace_event WHERE cat = 'python_function' AND name LIKE 'nn.Module:%'
"""
_WRAPPERS = f"SELECT * FROM ({_CALLS}) c WHERE regexp_matches(name, '^(Sync|Dense|Sparse|Tail)')"
_STEP = """
SELECT trace_id, ts_ns, end_ns, dur_ns FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY dur_ns, step_no) AS r,
  count(*) OVER (PARTITION BY trace_id) AS n FROM o_step) x WHERE r = n // 2 + 1
"""
_IN_STEP = f"""
SELECT c.* REPLACE (greatest(c.ts_ns, s.ts_ns) AS ts_ns, least(c.ts_ns + c.dur_ns, s.end_ns) - greatest(c.ts_ns, s.ts_ns) AS dur_ns)
FROM ({_CALLS}) c JOIN ({_STEP}) s ON s.trace_id = c.trace_id AND c.ts_ns + c.dur_ns > s.ts_ns AND c.ts_ns < s.end_ns
WHERE least(c.ts_ns + c.dur_ns, s.end_ns) > greatest(c.ts_ns, s.ts_ns)
"""


@query("f08_module_events", f"SELECT * FROM ({_WRAPPERS}) w WHERE dur_ns >= 1000000000000")
def _(t):
    return swimlane.module_events(t.events, min_dur_ns=1_000_000_000_000)


@query("t04_calls_in_step", _IN_STEP)
def _(t):
    return swimlane.in_step(swimlane.module_events(t.events, include_all=True), choose_step(t.steps))


def _gaps(calls: str) -> str:
    return f"""
SELECT trace_id, pid, tid, greatest(20000.0, least(dur_ns * 0.1::DOUBLE, 500000.0)) AS gap_ns FROM (
  SELECT trace_id, pid, tid, dur_ns, row_number() OVER (PARTITION BY trace_id, pid, tid ORDER BY dur_ns) AS r,
    count(*) OVER (PARTITION BY trace_id, pid, tid) AS n FROM ({calls}) c) x WHERE r = n // 2 + 1
"""


@query("t22_lane_gaps", _gaps(_CALLS))
def _(t):
    return swimlane.lane_gaps(swimlane.module_events(t.events, include_all=True))


# First fit: a walk along each lane that carries the ends of its tracks.
def _packed(calls: str) -> str:
    return f"""
SELECT trace_id, pid, tid, idx, CAST(sub_row AS BIGINT) AS sub_row FROM (
  WITH RECURSIVE o AS MATERIALIZED (SELECT c.trace_id, c.pid, c.tid, c.idx, c.ts_ns, c.ts_ns + c.dur_ns AS fin, g.gap_ns,
      row_number() OVER (PARTITION BY c.trace_id, c.pid, c.tid ORDER BY c.ts_ns, -c.dur_ns, c.idx) AS pos
    FROM ({calls}) c JOIN ({_gaps(calls)}) g ON g.trace_id = c.trace_id AND g.pid = c.pid AND g.tid = c.tid),
  walk AS (SELECT trace_id, pid, tid, pos, idx, 0::BIGINT AS sub_row, [fin] AS ends FROM o WHERE pos = 1
    UNION ALL
    SELECT trace_id, pid, tid, pos, idx, r, CASE WHEN r = len(ends) THEN list_append(ends, fin) ELSE list_concat(list_concat(ends[:r], [fin]), ends[r + 2:]) END FROM (
      SELECT o.*, w.ends, coalesce(nullif(list_position(list_transform(w.ends, lambda e: o.ts_ns - e >= o.gap_ns), true), 0) - 1, len(w.ends))::BIGINT AS r
      FROM walk w JOIN o ON o.trace_id = w.trace_id AND o.pid = w.pid AND o.tid = w.tid AND o.pos = w.pos + 1) x)
  SELECT * FROM walk) w
"""


@query("t22_lane_rows", _packed(_CALLS))
def _(t):
    return swimlane.pack_lanes(swimlane.module_events(t.events, include_all=True))


@query("a12_module_stats", f"""
SELECT trace_id, name, CAST(sum(dur_ns) AS BIGINT) AS dur_ns, count(*) AS n_calls FROM ({_CALLS}) c GROUP BY 1, 2
""")
def _(t):
    return swimlane.module_stats(swimlane.module_events(t.events, include_all=True))


@query("a12_module_thread_counts", f"SELECT trace_id, name, tid, count(*) AS n_calls FROM ({_CALLS}) c GROUP BY 1, 2, 3")
def _(t):
    return swimlane.module_thread_counts(swimlane.module_events(t.events, include_all=True))


@query("a12_hot_modules", f"""
SELECT trace_id, rank, name, x.dur_ns, n_calls, CAST(x.dur_ns AS DOUBLE) / CAST(s.dur_ns AS DOUBLE) * 100 AS step_pct FROM (
  SELECT trace_id, name, CAST(sum(dur_ns) AS BIGINT) AS dur_ns, count(*) AS n_calls,
    row_number() OVER (PARTITION BY trace_id ORDER BY sum(dur_ns) DESC, name) AS rank FROM ({_IN_STEP}) c GROUP BY 1, 2) x
JOIN ({_STEP}) s USING (trace_id) WHERE rank <= 8
""")
def _(t):
    step = choose_step(t.steps)
    return swimlane.hot_modules(swimlane.in_step(swimlane.module_events(t.events, include_all=True), step), step)


_DIRECT = f"""
SELECT c.trace_id, o.source, c.name AS target, count(*) AS n_calls FROM ({_CALLS}) c
JOIN (SELECT trace_id, py_id, arg_max(name, idx) AS source FROM ({_CALLS}) c WHERE py_id IS NOT NULL GROUP BY 1, 2) o
  ON o.trace_id = c.trace_id AND o.py_id = c.py_parent_id WHERE o.source <> c.name GROUP BY 1, 2, 3
"""
_EDGES = f"""
SELECT * FROM ({_DIRECT}) d UNION ALL
SELECT trace_id, source, target, count(*) FROM (
  SELECT a.trace_id, a.idx, any_value(a.name) AS target, arg_max(b.name, b.pos) AS source FROM
   (SELECT *, row_number() OVER (PARTITION BY trace_id, pid, tid ORDER BY ts_ns, -dur_ns, idx) AS pos FROM ({_CALLS}) c) a JOIN
   (SELECT *, row_number() OVER (PARTITION BY trace_id, pid, tid ORDER BY ts_ns, -dur_ns, idx) AS pos FROM ({_CALLS}) c) b
   ON a.trace_id = b.trace_id AND a.pid = b.pid AND a.tid = b.tid AND b.pos < a.pos AND b.ts_ns + b.dur_ns > a.ts_ns
  WHERE a.trace_id NOT IN (SELECT trace_id FROM ({_DIRECT}) d) GROUP BY 1, 2) x WHERE source <> target GROUP BY 1, 2, 3
"""


@query("g31_call_edges", _EDGES)
def _(t):
    return swimlane.call_edges(swimlane.module_events(t.events, include_all=True))


@query("g31_top_call_edges", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY n_calls DESC, source, target) AS rank FROM ({_EDGES}) e) x WHERE rank <= 15
""")
def _(t):
    return swimlane.top_call_edges(swimlane.call_edges(swimlane.module_events(t.events, include_all=True)))


_HOT = f"""
SELECT trace_id, name FROM (SELECT trace_id, name, row_number() OVER (PARTITION BY trace_id ORDER BY sum(dur_ns) DESC, name) AS rank
  FROM ({_IN_STEP}) c GROUP BY 1, 2) x WHERE rank <= 8
"""


@query("s07_lane_events", f"""
SELECT c.trace_id, c.pid, c.tid, c.idx, c.name, c.ts_ns - s.ts_ns AS rel_ns, c.dur_ns, p.sub_row, h.name IS NOT NULL AS hot, e.call_from FROM ({_IN_STEP}) c
JOIN ({_packed(_IN_STEP)}) p ON p.trace_id = c.trace_id AND p.pid = c.pid AND p.tid = c.tid AND p.idx = c.idx
JOIN ({_STEP}) s ON s.trace_id = c.trace_id LEFT JOIN ({_HOT}) h ON h.trace_id = c.trace_id AND h.name = c.name
JOIN trace_event e ON e.trace_id = c.trace_id AND e.idx = c.idx
""")
def _(t):
    return swimlane.Swimlane(t, include_all=True).lane_events()


@query("s07_lanes", f"""
SELECT p.trace_id, p.pid, p.tid, concat(CASE WHEN p.tid = p.pid THEN '[MAIN] ' ELSE '' END, 'thread ', p.tid) AS label,
  coalesce(n.thread_name, concat('pid=', p.pid, ' tid=', p.tid)) AS thread_name, coalesce(l.label, '') AS process_label, n_calls, n_sub_rows
FROM (SELECT trace_id, pid, tid, count(*) AS n_calls, max(sub_row) + 1 AS n_sub_rows FROM ({_packed(_IN_STEP)}) q GROUP BY 1, 2, 3) p
LEFT JOIN o_name n ON n.trace_id = p.trace_id AND n.pid = p.pid AND n.tid = p.tid LEFT JOIN o_label l ON l.trace_id = p.trace_id AND l.pid = p.pid
""")
def _(t):
    return swimlane.Swimlane(t, include_all=True).lanes()
