"""The driver's tables seen as traces, stacks, source spans and model graphs.

One SQL text per view serves Spark and DuckDB; only the few expressions in ``DIALECT``
differ.  Every view is a mapping of whole tables: no rows are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DIALECT = {
    "spark": {
        "ts_us": "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)",
        "k": "CAST(get_json_object(props, '$.k') AS BIGINT)",
        "div": "div",
        "nl": "'\\n'",
        "join_lines": "array_join(transform(array_sort(collect_list(struct(l_linenumber, txt))), x -> x.txt), '\\n')",
        "join_traces": "transform(array_sort(collect_list(struct(trace_no, trace))), x -> x.trace)",
        "txt_array": "ARRAY<STRING>",
        "str": "STRING",
        "loc_array": "array_sort(collect_list(struct(frame_no, file, line, func)))",
    },
    "duckdb": {
        "ts_us": "epoch_us(ts)",
        "k": "CAST(json_extract_string(props, '$.k') AS BIGINT)",
        "div": "//",
        "nl": "chr(10)",
        "join_lines": "string_agg(txt, chr(10) ORDER BY l_linenumber)",
        "join_traces": "list(trace ORDER BY trace_no)",
        "txt_array": "VARCHAR[]",
        "str": "VARCHAR",
        "loc_array": "list({'frame_no': frame_no, 'file': file, 'line': line, 'func': func} ORDER BY frame_no)",
    },
}

# Annotated spans of one step on the main thread: order, category, name, start hour, hours.
PHASES = [
    (0, "user_annotation", "ProfilerStep", 0, 0),
    (1, "python_function", "train_runner.py(10): step", 1, 20),
    (2, "python_function", "engine.py(5): forward_backward", 2, 12),
    (3, "user_annotation", "forward pass", 2, 5),
    (4, "user_annotation", "backward pass", 7, 6),
    (5, "python_function", "train_runner.py(44): optimize", 15, 4),
]
_PHASE_COLUMNS = ("j", "cat", "name", "from_h", "for_h")
DIALECT["duckdb"]["phases"] = (
    "CROSS JOIN (VALUES " + ", ".join(map(str, PHASES)) + f") AS v({', '.join(_PHASE_COLUMNS)})")
DIALECT["spark"]["phases"] = (
    "LATERAL VIEW inline(array(" + ", ".join(f"struct{p}" for p in PHASES)
    + f")) v AS {', '.join(_PHASE_COLUMNS)}")
DIALECT["duckdb"]["members"] = "CROSS JOIN (SELECT unnest(range(5)) AS m) z"
DIALECT["spark"]["members"] = "LATERAL VIEW explode(sequence(0L, 4L)) z AS m"

VIEWS: dict[str, str] = {}

# One row per raw event, with times in ns.  Four traces; even users are host threads, odd users
# are device streams; a fifth of the host users share the thread "main" and run short events.
VIEWS["trace_base"] = """
SELECT concat('t', CAST((u {div} 2) % 4 AS {str})) AS trace_id, event_id AS idx, u, k,
  CAST(u % 2 AS {str}) AS pid,
  CASE WHEN u % 2 = 0 AND (u {div} 8) % 5 = 0 THEN 'main' ELSE CAST(u AS {str}) END AS tid,
  CASE WHEN u % 2 = 0 AND et = 'error' AND (u {div} 8) % 3 = 1 THEN 'f' WHEN u % 2 = 0 AND et IN ('signup', 'error') THEN 's' ELSE 'X' END AS ph,
  CASE WHEN u % 2 = 0 THEN
         CASE WHEN et = 'purchase' THEN 'python_function' WHEN et IN ('signup', 'error') THEN 'fwdbwd'
              WHEN et = 'view' AND k % 2 = 0 THEN 'kernel' WHEN et = 'click' AND k % 3 = 0 THEN 'python_function'
              ELSE 'cpu_op' END
       WHEN u % 10 = 3 THEN 'gpu_memcpy'
       WHEN et = 'purchase' THEN 'gpu_memcpy' WHEN et = 'error' THEN 'gpu_memset' ELSE 'kernel' END AS cat,
  CASE WHEN u % 2 = 0 AND et = 'purchase' THEN concat('nn.Module: ',
         CASE k % 7 WHEN 0 THEN 'SyncRunner' WHEN 1 THEN 'DenseStage' WHEN 2 THEN 'FSDPEncoder' WHEN 3 THEN 'LinearHead'
                    WHEN 4 THEN 'SparseLookup' WHEN 5 THEN 'TailModule' ELSE 'Plain' END,
         '_', CAST(k % 3 AS {str}), CASE WHEN k % 5 = 0 THEN concat(', callsite: ', CAST(k AS {str})) ELSE '' END)
       WHEN u % 2 = 0 AND et = 'view' AND k % 2 = 0 THEN concat('host_kernel_', CAST(k % 5 AS {str}))
       WHEN u % 2 = 0 AND et = 'click' AND k % 30 = 0 THEN 'threading.py(12): run'
       WHEN u % 2 = 0 AND et = 'click' AND k % 3 = 0 THEN concat('data.py(', CAST(k AS {str}), '): fetch')
       WHEN u % 2 = 0 THEN concat('aten::op_', CAST(k % 25 AS {str}))
       WHEN u % 10 = 1 THEN concat('ncclKernel_', CAST(k % 5 AS {str}))
       WHEN k % 25 = 7 THEN concat('vendor::fused_', CAST(k % 10 AS {str}))
       ELSE concat('kernel_', CAST(k % 25 AS {str})) END AS name,
  ts_us * 1000 AS ts_ns,
  CASE WHEN u % 2 = 0 AND et IN ('signup', 'error') THEN NULL
       WHEN u % 2 = 0 AND (u {div} 8) % 5 = 0 THEN cents * 20000000
       WHEN u % 2 = 0 AND k % 5 = 3 AND et <> 'purchase' THEN cents * 40000000000 ELSE cents * 2000000000 END AS dur_ns
FROM (SELECT event_id, user_id AS u, event_type AS et, {ts_us} AS ts_us,
             CAST(round(value * 100) AS BIGINT) AS cents, {k} AS k FROM events) e
"""

VIEWS["line_item_1"] = """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, min(l_suppkey) AS suppkey, min(l_partkey) AS partkey,
  min(CAST(round(l_quantity) AS BIGINT)) AS qty, min(l_returnflag) AS rflag, min(l_linestatus) AS lstat
FROM lineitem GROUP BY l_orderkey, l_linenumber
"""

# Stack frames: f9.py lies outside the user's sources.
VIEWS["frame"] = """
SELECT l_orderkey AS kernel_idx, l_linenumber % 2 AS trace_no, l_linenumber AS frame_no,
  concat(CASE WHEN suppkey % 10 = 9 THEN '/usr/lib/site-packages/' ELSE '/app/models/' END,
         'f', CAST(suppkey % 10 AS {str}), '.py') AS path,
  concat('f', CAST(suppkey % 10 AS {str}), '.py') AS file, partkey AS line,
  CASE WHEN rflag = 'R' AND qty > 40 THEN 'backward_step' WHEN lstat = 'O' THEN 'forward'
       ELSE concat('helper_', rflag) END AS func
FROM line_item_1
"""

VIEWS["stack_text"] = """
SELECT kernel_idx, {join_traces} AS stack_traces FROM (
  SELECT kernel_idx, trace_no, {join_lines} AS trace FROM (
    SELECT kernel_idx, trace_no, frame_no AS l_linenumber,
      concat('  File "', path, '", line ', CAST(line AS {str}), ', in ', func) AS txt FROM frame) f
  GROUP BY kernel_idx, trace_no) g
GROUP BY kernel_idx
"""

VIEWS["trace_days"] = """
SELECT trace_id, ts_ns {div} 86400000000000 AS d FROM trace_base GROUP BY 1, 2
"""

VIEWS["trace_event"] = """
SELECT b.trace_id, b.idx, b.ph, b.cat, b.name, b.pid, b.tid, b.ts_ns, b.dur_ns,
  CASE WHEN b.cat = 'fwdbwd' THEN CAST(b.idx {div} 40 AS {str}) END AS flow_id,
  CASE WHEN b.ph = 'X' THEN b.idx {div} 20 END AS external_id,
  CASE WHEN b.name LIKE 'nn.Module:%' THEN b.idx {div} 10 END AS py_id,
  CASE WHEN b.name LIKE 'nn.Module:%' AND b.trace_id <> 't3' THEN b.idx {div} 10 - 1 END AS py_parent_id,
  CASE WHEN b.cat = 'python_function' THEN concat('run.py:', CAST(b.k AS {str})) END AS call_from,
  CAST(NULL AS {str}) AS arg_name, CAST(NULL AS {str}) AS arg_labels, {stack} AS stack_traces
FROM trace_base b {stack_join}
UNION ALL
SELECT trace_id, -10 - min(u), 'M', NULL, 'thread_name', pid, tid, 0, NULL, NULL, NULL, NULL, NULL, NULL,
  CASE WHEN tid = 'main' THEN 'main' WHEN min(u) % 14 = 0 THEN 'pt_autograd_0'
       WHEN min(u) % 22 = 0 THEN 'Code Location' ELSE concat('thread ', tid) END, NULL, NULL
FROM trace_base GROUP BY trace_id, pid, tid
UNION ALL
SELECT trace_id, CAST(-1 - min(u) % 2 AS BIGINT), 'M', NULL, 'process_labels', pid, '0', 0, NULL, NULL, NULL, NULL, NULL, NULL,
  NULL, CASE pid WHEN '0' THEN 'CPU' ELSE 'GPU 0' END, NULL
FROM trace_base GROUP BY trace_id, pid
UNION ALL
SELECT trace_id, 1152921504606846976 + d * 10 + j, 'X', cat, CASE WHEN j = 0 THEN concat('ProfilerStep#', CAST(d AS {str})) ELSE name END,
  '0', 'main', d * 86400000000000 + from_h * 3600000000000,
  CASE WHEN j = 0 THEN 86400000000000 - (d % 3) * 3600000000000 ELSE for_h * 3600000000000 END,
  NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
FROM trace_days {phases}
UNION ALL
SELECT trace_id, 2305843009213693952 + d * 1099511627776 + u, 'X', 'gpu_user_annotation', concat('ProfilerStep#', CAST(d AS {str})),
  pid, tid, d * 86400000000000 + 600000000000, 85200000000000, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
FROM (SELECT DISTINCT trace_id, pid, tid, u, ts_ns {div} 86400000000000 AS d FROM trace_base WHERE pid = '1') g
"""

# Only kernels carry stacks, and a third of them have none.
_STACK = "CASE WHEN b.cat = 'kernel' AND b.k % 3 <> 0 THEN s.stack_traces END"
_STACK_JOIN = "LEFT JOIN stack_text s ON s.kernel_idx = b.idx"

VIEWS["source_span"] = """
SELECT concat('f', CAST(f AS {str}), '.py') AS file, concat('C', CAST(c AS {str})) AS class,
  CASE WHEN m = 4 THEN NULL ELSE concat('m', CAST(m AS {str})) END AS method,
  CASE WHEN m = 4 THEN c * 100 ELSE c * 100 + m * 20 END AS start_line,
  CASE WHEN m = 4 THEN c * 100 + 89 ELSE c * 100 + m * 20 + 19 END AS end_line, c * 10 + m AS ord
FROM (SELECT DISTINCT suppkey % 10 AS f, partkey {div} 100 AS c FROM line_item_1 WHERE suppkey % 10 <> 9) a {members}
"""

# Model graphs: one graph per order, one node per line; containment region > nation style is in `member`.
VIEWS["graph_node"] = """
SELECT CAST(l_orderkey AS {str}) AS graph_id, l_linenumber AS node_id, lstat AS container, rflag AS helper,
  concat('f', CAST(suppkey % 2 AS {str}), '.py') AS file, suppkey AS line, qty, partkey
FROM line_item_1
"""

VIEWS["graph_edge"] = """
SELECT a.graph_id, a.node_id AS src_id, b.node_id AS dst_id
FROM graph_node a JOIN graph_node b ON a.graph_id = b.graph_id AND b.node_id = a.node_id + 1
UNION ALL
SELECT a.graph_id, a.node_id AS src_id, b.node_id AS dst_id
FROM graph_node a JOIN graph_node b ON a.graph_id = b.graph_id AND b.node_id = a.node_id + 2
"""

# The nodes of a graph in three nested scopes: `top`, `mid` inside its module 100, `low` inside the native module 101 of `mid`.
# Nodes are free, in one of two boxes of their scope, or directly in the root container around these.
VIEWS["norm_node"] = """
SELECT graph_id, node_id, CASE WHEN qty % 3 <> 0 THEN 'top' WHEN partkey % 2 = 0 THEN 'mid' ELSE 'low' END AS scope_id,
  CASE helper WHEN 'N' THEN 'none' WHEN 'A' THEN 'root' ELSE 'box' END AS home, concat('b', CAST(line % 2 AS {str})) AS box,
  CASE WHEN qty % 4 = 0 THEN 'module' ELSE 'functional' END AS attr_kind, qty % 8 = 0 AS is_native, file, line,
  CASE WHEN qty % 5 < 2 THEN 'forward' ELSE concat('help_', CAST(qty % 2 AS {str})) END AS func
FROM graph_node
UNION ALL SELECT DISTINCT graph_id, CAST(100 AS BIGINT), 'top', 'none', 'b0', 'module', false, 'm.py', CAST(1 AS BIGINT), 'forward' FROM graph_node
UNION ALL SELECT DISTINCT graph_id, CAST(101 AS BIGINT), 'mid', 'none', 'b0', 'module', true, 'm.py', CAST(2 AS BIGINT), 'forward' FROM graph_node
"""

# What each node is, by quantity; some names are empty on purpose.
VIEWS["graph_attr"] = """
SELECT graph_id, node_id,
  CASE qty % 9 WHEN 0 THEN 'input' WHEN 1 THEN 'forward_arg' WHEN 2 THEN 'param' WHEN 3 THEN 'const' WHEN 4 THEN 'output'
    WHEN 5 THEN 'return_val' WHEN 6 THEN 'module' WHEN 7 THEN 'functional' ELSE 'container' END AS attr_kind,
  CASE WHEN qty % 11 = 0 THEN '' ELSE concat('a', CAST(partkey % 50 AS {str})) END AS attr_name,
  CASE WHEN qty % 13 = 0 THEN '' ELSE concat('K', CAST(line % 5 AS {str})) END AS class_name,
  CASE WHEN qty % 5 = 0 THEN '' ELSE 'feed' END AS kind, partkey % 4 AS arg_index,
  CASE WHEN qty % 4 = 0 THEN '' ELSE concat('p', CAST(partkey % 9 AS {str})) END AS param_name, 'zeros' AS op_name,
  CASE WHEN qty % 7 = 0 THEN '' ELSE concat('head', CAST(partkey % 3 AS {str})) END AS head_name, partkey % 3 AS ret_index,
  CASE WHEN qty % 2 = 0 THEN NULL ELSE concat('r', CAST(partkey % 6 AS {str})) END AS ret_key, 'ModuleList' AS container_kind,
  qty % 2 = 0 AS is_native
FROM graph_node
"""

# One tree of all customers under nations under regions.
VIEWS["tree"] = """
SELECT 'g0' AS graph_id, concat('r', CAST(r_regionkey AS {str})) AS node_id, CAST(NULL AS {str}) AS parent_id, CAST(r_regionkey AS BIGINT) AS ord,
  CAST(r_regionkey AS {str}) AS key, lower(r_name) AS attr_name, CAST(0 AS BIGINT) AS cents FROM region
UNION ALL SELECT 'g0', concat('n', CAST(n_nationkey AS {str})), concat('r', CAST(n_regionkey AS {str})), CAST(n_nationkey AS BIGINT), CAST(n_nationkey AS {str}), lower(n_name), 0 FROM nation
UNION ALL SELECT 'g0', concat('c', CAST(c_custkey AS {str})), concat('n', CAST(c_nationkey AS {str})), c_custkey, CAST(c_custkey AS {str}), lower(c_name), CAST(round(c_acctbal * 100) AS BIGINT) FROM customer
"""

# Data moves from each customer to the next one.
VIEWS["tree_edge"] = """
SELECT 'g0' AS graph_id, concat('c', CAST(a.c_custkey AS {str})) AS src_id, concat('c', CAST(b.c_custkey AS {str})) AS dst_id
FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1
"""


def _needs(name: str, stacks: bool) -> list[str]:
    text = VIEWS[name]
    if name == "trace_event" and stacks:
        text += " stack_text "
    return [v for v in VIEWS if v != name and f"{v} " in text.replace("\n", " ").replace(")", " ) ")]


def render(name: str, dialect: str, stacks: bool = False) -> str:
    d = dict(DIALECT[dialect])
    d["stack"] = _STACK if stacks else f"CAST(NULL AS {d['txt_array']})"
    d["stack_join"] = _STACK_JOIN if stacks else ""
    text = VIEWS[name]
    for key, value in d.items():
        text = text.replace("{" + key + "}", value)
    return text.strip()


def ordered(names: list[str], stacks: bool) -> list[str]:
    """Views needed for ``names``, dependencies first."""
    out: list[str] = []

    def visit(n: str) -> None:
        for dep in _needs(n, stacks):
            visit(dep)
        if n not in out:
            out.append(n)

    for n in names:
        visit(n)
    return out


BASE_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
               "pages benchmark labels conversations").split()


def spark_view(spark: SparkSession, sf_dir: str, name: str, stacks: bool = False) -> DataFrame:
    frames: dict[str, DataFrame] = {}
    for view in ordered([name], stacks):
        text = render(view, "spark", stacks)
        for table in [*BASE_TABLES, *frames]:
            for lead in ("FROM ", "JOIN "):
                for tail in (" ", ")", "\n"):
                    text = text.replace(f"{lead}{table}{tail}", f"{lead}<{table}>{tail}")
                if text.endswith(f"{lead}{table}"):
                    text = text[: -len(table)] + f"<{table}>"
        used = {}
        for table in BASE_TABLES:
            if f"<{table}>" in text:
                used[table] = spark.read.parquet(f"{sf_dir}/{table}.parquet")
                if view == "line_item_1":  # dealt once: lines, frames, stacks and their kernels all go by the order
                    used[table] = used[table].repartition("l_orderkey")
        for other, frame in frames.items():
            if f"<{other}>" in text:
                used[other] = frame
        for table in used:
            text = text.replace(f"<{table}>", "{" + table + "}")
        frames[view] = spark.sql(text, **used)
    return frames[name]


def duckdb_ctes(names: list[str], stacks: bool = False) -> list[tuple[str, str]]:
    return [(v, render(v, "duckdb", stacks)) for v in ordered(names, stacks)]
