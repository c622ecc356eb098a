"""Source facts and reports over the driver's tables."""

from __future__ import annotations

import io
import tarfile
import uuid
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.plans.report import analysis_tables, report_rows
from stepweave.sources import code
from stepweave.sources.traces import commit_tables, read_large_traces, read_table
from stepweave.session import materialize, shared_folder
from workload import trace_queries as tq
from workload.graph_queries import Graphs
from workload.oracle import with_ctes

QUERIES = {}
ORACLES: dict[str, str] = {}
_CACHE: dict[tuple, object] = {}


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """One Python class per part, ten classes to a file.

    Class k holds classes 2k and 2k+1; a third of the classes inherit from class k/2.
    """
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("size"))
    base = F.when(F.col("k") % 3 == 0, "nn.Module").when(F.col("k") % 3 == 1, F.format_string("P%d", F.expr("k div 2"))).otherwise("object")
    text = F.concat_ws("\n",
        F.concat(F.format_string("class P%d(", "k"), base, F.lit("):")), F.lit("    def __init__(self):"),
        F.format_string("        self.left = P%d(%d)", F.col("k") * 2, "size"), F.lit("        self.items = nn.ModuleList()"),
        F.format_string("        if True:\n            item = P%d()", F.col("k") * 2 + 1), F.lit("            self.items.append(item)"),
        F.lit("        self.sizes = list()"), F.lit("        setattr(self, 'act', nn.ReLU())"), F.lit("    def forward(self, x):"), F.lit("        return x"))
    lines = p.select(F.expr("k div 10").alias("f"), "k", text.alias("t"))
    return lines.groupBy("f").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]), "\n").alias("content")).select(
        F.lit("code").alias("code_id"), F.format_string("m/f%05d.py", "f").alias("path"), F.format_string("f%05d.py", "f").alias("basename"), "content")


class Code:
    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf = spark, sf

    def _once(self, name: str, make) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf, name)
        if key not in _CACHE:
            _CACHE[key] = materialize(make())
        return _CACHE[key]

    def kept(self, name: str, make):
        """What ``make`` returns, once per session and scale."""
        key = (self.spark.sparkContext.applicationId, self.sf, name)
        if key not in _CACHE:
            _CACHE[key] = make()
        return _CACHE[key]

    @property
    def facts(self):
        return self._once("facts", lambda: code.source_facts(_texts(self.spark, self.sf)))

    @property
    def inventory(self):
        return self._once("inventory", lambda: code.class_inventory(self.facts))

    @property
    def modules(self):
        return self._once("modules", lambda: code.module_classes(self.inventory))

    @property
    def subs(self):
        return self._once("subs", lambda: code.submodules(self.facts, self.inventory))


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, sf: fn(Code(spark, sf))
        if sql:
            ORACLES[name] = sql if sql.startswith("WITH RECURSIVE") else with_ctes(sql)
        return fn
    return add


_BASE = "CASE k % 3 WHEN 0 THEN 'nn.Module' WHEN 1 THEN concat('P', k // 2) ELSE 'object' END"
_PART = "(SELECT p_partkey AS k, row_number() OVER (PARTITION BY p_partkey // 10 ORDER BY p_partkey) - 1 AS place FROM part)"


@query("d01_class_inventory", f"SELECT concat('P', k) AS class, printf('m/f%05d.py', k // 10) AS path, {_BASE} AS bases FROM {_PART} p")
def _(c):
    return code.class_inventory(code.source_facts(_texts(c.spark, c.sf))).select("class", "path", "bases")


@query("d02_source_spans", f"""
SELECT printf('f%05d.py', k // 10) AS file, concat('P', k) AS class, v.m AS method, place * 11 + v.a AS start_line, place * 11 + v.b AS end_line
FROM {_PART} p CROSS JOIN (VALUES (NULL, 1, 11), ('__init__', 2, 9), ('forward', 10, 11)) v(m, a, b)
""")
def _(c):
    return code.source_spans(c.facts).select("file", "class", "method", "start_line", "end_line")


# Class k is a module when the chain of halvings from it meets a multiple of 3 before a class outside.
_MODULE = f"""
SELECT class FROM (WITH RECURSIVE up(k, cur) AS (SELECT p_partkey, p_partkey FROM part
  UNION ALL SELECT k, cur // 2 FROM up WHERE cur % 3 = 1 AND cur // 2 IN (SELECT p_partkey FROM part) AND cur // 2 <> cur)
SELECT DISTINCT concat('P', k) AS class FROM up WHERE cur % 3 = 0) m
"""


@query("d04_module_classes", _MODULE)
def _(c):
    return code.module_classes(c.inventory).select("class")


_SUBS = f"""
SELECT concat('P', k) AS class, v.attr, CASE v.n WHEN 1 THEN concat('P', 2 * k) WHEN 3 THEN concat('P', 2 * k + 1) WHEN 4 THEN 'ReLU' ELSE '' END AS child_class,
  CASE v.n WHEN 2 THEN 'ModuleList' ELSE '' END AS container_type, place * 11 + v.line AS line
FROM {_PART} p CROSS JOIN (VALUES (1, 'left', 3), (2, 'items', 4), (3, 'items[*]', 7), (4, 'act', 9)) v(n, attr, line)
"""


@query("d05_submodules", _SUBS)
def _(c):
    return code.submodules(c.facts, c.inventory).select("class", "attr", "child_class", "container_type", "line")


@query("d06_root_class", f"""
SELECT class, n_submodules, n_module_classes, n_module_classes * 10 + n_submodules AS score FROM (
  SELECT m.class, count(*) AS n_submodules, count(DISTINCT s.child_class) FILTER (s.child_class IN ({_MODULE})) AS n_module_classes
  FROM ({_MODULE}) m JOIN ({_SUBS}) s ON s.class = m.class GROUP BY 1) x ORDER BY score DESC, class LIMIT 1
""")
def _(c):
    return code.root_classes(c.subs, c.modules).select("class", "n_submodules", "n_module_classes", "score")


@query("d07_module_tree", f"""
WITH RECURSIVE mods AS ({_MODULE}), subs AS ({_SUBS}), tree(attr_path, class, depth, parent_class, line) AS (
  SELECT attr, CASE WHEN child_class <> '' THEN child_class ELSE container_type END, 1, class, line FROM subs WHERE class = 'P3'
  UNION ALL SELECT concat(t.attr_path, '.', s.attr), CASE WHEN s.child_class <> '' THEN s.child_class ELSE s.container_type END, t.depth + 1, s.class, s.line
  FROM tree t JOIN mods m ON m.class = t.class JOIN subs s ON s.class = t.class)
SELECT attr_path, class, CAST(depth AS BIGINT) AS depth, parent_class, line FROM tree
""")
def _(c):
    roots = c.modules.select("code_id").distinct().withColumn("class", F.lit("P3"))
    return code.module_tree(c.subs, c.modules, roots).select("attr_path", "class", "depth", "parent_class", "line")


@query("d07_module_forest", f"""
WITH RECURSIVE mods AS ({_MODULE}), subs AS ({_SUBS}),
roots AS (SELECT class FROM mods WHERE class NOT IN (SELECT s.child_class FROM subs s JOIN mods m ON m.class = s.class WHERE s.child_class <> s.class)),
tree(root, attr_path, class, depth, parent_class, line, above) AS (
  SELECT s.class, s.attr, CASE WHEN s.child_class <> '' THEN s.child_class ELSE s.container_type END, 1, s.class, s.line, [s.class]
  FROM subs s JOIN roots r ON r.class = s.class
  UNION ALL SELECT t.root, concat(t.attr_path, '.', s.attr), CASE WHEN s.child_class <> '' THEN s.child_class ELSE s.container_type END, t.depth + 1, s.class,
    s.line, list_append(t.above, s.class)
  FROM tree t JOIN mods m ON m.class = t.class AND NOT list_contains(t.above, t.class) JOIN subs s ON s.class = t.class)
SELECT root, attr_path, class, CAST(depth AS BIGINT) AS depth, parent_class, line FROM tree
""")
def _(c):
    """The whole part table: the trees below every class that no other module contains."""
    return code.module_forest(c.subs, c.modules).select("root", "attr_path", "class", "depth", "parent_class", "line")


@query("d08_calibrated_edges", """
SELECT e.graph_id, e.src_id, e.dst_id, CASE WHEN a.helper = 'A' OR b.helper = 'A' THEN 'static_only' WHEN a.partkey % 3 = b.line % 3 THEN 'dynamic_confirmed'
  WHEN a.line % 3 = b.line % 3 THEN 'parallel' ELSE 'suspect' END AS status
FROM graph_edge e JOIN graph_node a ON a.graph_id = e.graph_id AND a.node_id = e.src_id JOIN graph_node b ON b.graph_id = e.graph_id AND b.node_id = e.dst_id
""")
def _(c):
    g = Graphs(c.spark, c.sf)
    calls = g.node.filter("helper <> 'A'").select("graph_id", "node_id", F.array(F.col("line") % 3).alias("inputs"), F.array(F.col("partkey") % 3).alias("outputs"))
    return code.calibrated_edges(g.edge, calls)


# ---------------------------------------------------------------- report

def _section(name: str, columns: str, sql: str) -> str:
    return f"SELECT trace_id, '{name}' AS section, {columns} FROM ({sql}) s_{name}"


def _sql(name: str) -> str:
    """The final SELECT of another oracle, without the shared texts in front."""
    return tq.SELECTS[name]


@query("s06_report", " UNION ALL ".join([
    _section("overview", "CAST(1 AS BIGINT) AS rank, 'steps' AS label, step_dur_ns AS value_ns, CAST(NULL AS DOUBLE) AS pct, CAST(n_steps AS VARCHAR) AS extra", "SELECT * FROM o_sum"),
    _section("step_split", "1, 'forward_backward', forward_backward_dur_ns, forward_backward_dur_ns / step_dur_ns * 100, NULL", _sql("a02_step_decomposition")),
    _section("step_split", "2, 'optimize', optimize_dur_ns, optimize_dur_ns / step_dur_ns * 100, NULL", _sql("a02_step_decomposition")),
    _section("step_split", "3, 'other', other_dur_ns, other_dur_ns / step_dur_ns * 100, NULL", _sql("a02_step_decomposition")),
    _section("threads", "rank, pid || ':' || tid, CAST(dur_ns AS DOUBLE), NULL, role", _sql("a07_worker_threads")),
    _section("modules", "rank, depth || '|' || module, inclusive_ns, inclusive_pct, thread_tag", _sql("a22_module_levels")),
    _section("device", "1, 'kernel time', kernel_ns, utilization_pct, CAST(n_kernels AS VARCHAR)", _sql("a04_device_timeline")),
    _section("kernels", "rank, name, dur_ns, dur_ns / device_step_ns * 100, module", f"""
      SELECT k.trace_id, k.rank, k.name, k.dur_ns, d.device_step_ns, m.module FROM ({_sql('a04_top_kernels')}) k JOIN ({_sql('a04_device_timeline')}) d USING (trace_id)
      JOIN ({_sql('a05_hot_kernel_modules')}) m ON m.trace_id = k.trace_id AND m.name = k.name AND m.module_rank = 1"""),
    _section("gaps", "rank, before_name || ' > ' || after_name, CAST(gap_ns AS DOUBLE), NULL, NULL", _sql("t14_top_gaps")),
    _section("gap_total", "1, 'gaps', gap_ns, NULL, CAST(n_gaps AS VARCHAR)", _sql("t14_gap_per_step")),
    _section("device_host", "1, concat_ws(':', side, key), dur_ns, dur_ns / step_dur_ns * 100, grain",
             f"SELECT t.*, step_dur_ns FROM ({_sql('a06_device_host_totals')}) t JOIN o_sum USING (trace_id) WHERE grain <> 'name'"),
    _section("overlap", "1, 'comm', comm_exposed_ns, comm_exposed_pct_of_step, NULL", _sql("a08_comm_compute_overlap")),
    _section("overlap", "2, 'memcpy', memcpy_exposed_ns, memcpy_exposed_pct_of_step, NULL", _sql("a08_comm_compute_overlap")),
]))
def _(c):
    return report_rows(tq.trace_tables(c.spark, c.sf))


@query("s05_result_module", f"SELECT m.*, step_dur_ns FROM ({_sql('a03_modules')}) m JOIN o_sum USING (trace_id)")
def _(c):
    return analysis_tables(tq.trace_tables(c.spark, c.sf))["module"].withColumn("roles", F.array_join("roles", ","))


def _committed(c):
    """The result tables, committed twice: the second run replaces the first, which lacked a trace and had other values."""
    def make():
        path = f"{shared_folder(c.spark)}/{uuid.uuid4().hex}"
        tables = {name: materialize(df) for name, df in analysis_tables(tq.trace_tables(c.spark, c.sf)).items()}
        commit_tables({name: df.filter("trace_id <> 't1'").limit(50) for name, df in tables.items()}, path)
        commit_tables(tables, path)
        return path
    return c.kept("committed", make)


def _back(name):
    return lambda c: read_table(c.spark, _committed(c), name)


query("s05_step", _sql("t01_steps"))(_back("step"))
query("s05_step_split", _sql("a02_step_decomposition"))(_back("step_split"))
query("s05_top_kernel", _sql("a04_top_kernels"))(_back("top_kernel"))
query("s05_module", f"SELECT m.*, step_dur_ns FROM ({_sql('a03_modules')}) m JOIN o_sum USING (trace_id)")(
    lambda c: _back("module")(c).withColumn("roles", F.array_join("roles", ",")))
query("s05_trace", with_ctes(f"""
SELECT s.*, kind, e.* EXCLUDE (trace_id) FROM o_sum s JOIN ({_sql('f01_trace_kind')}) k USING (trace_id) JOIN ({_sql('f02_enhanced')}) e ON e.trace_id = s.trace_id
""", stacks=True))(_back("trace"))


@query("s05_result_tables", f"""
SELECT 'step' AS name, trace_id, count(*) AS n FROM ({_sql('t01_steps')}) GROUP BY 2
UNION ALL SELECT 'step_split', trace_id, count(*) FROM ({_sql('a02_step_decomposition')}) GROUP BY 2
UNION ALL SELECT 'module', trace_id, count(*) FROM ({_sql('a03_modules')}) GROUP BY 2
UNION ALL SELECT 'top_kernel', trace_id, count(*) FROM ({_sql('a04_top_kernels')}) GROUP BY 2
UNION ALL SELECT 'trace', trace_id, 1 FROM o_sum
""")
def _(c):
    """Rows of all five tables, read back; ``s05_step`` and so on compare their values."""
    count = lambda name: _back(name)(c).groupBy("trace_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "trace_id", "n")
    return reduce(DataFrame.unionByName, [count(name) for name in ("step", "step_split", "module", "top_kernel", "trace")])


def _trace_files(c):
    """Events as trace files, one per trace and day, with header and stacks: a line per event, so no file is gathered in one row."""
    def make():
        us = lambda ns: (F.col(ns).cast("decimal(23,3)") / 1000).cast("decimal(20,3)")
        stack = F.when(F.col("stack_traces").isNotNull(), F.struct("stack_traces"))
        args = F.struct(F.col("external_id").alias("External id"), F.col("py_id").alias("Python id"), F.col("py_parent_id").alias("Python parent id"),
                        F.col("call_from").alias("CallFrom"), F.col("arg_name").alias("name"), F.col("arg_labels").alias("labels"), stack.alias("stack"))
        event = F.struct("ph", "cat", "name", "pid", "tid", F.col("flow_id").alias("id"), us("ts_ns").alias("ts"), us("dur_ns").alias("dur"), args.alias("args"))
        day = F.expr("ts_ns div 86400000000000")
        rows = tq.trace_tables(c.spark, c.sf).events.withColumn("day", day).withColumn("file", F.concat_ws("_", "trace_id", day.cast("string")))
        sums = materialize(rows.groupBy("file", "trace_id", "day").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first")))
        rank = F.when(F.col("trace_id") != "t3", F.format_string('"distributedInfo":{"rank":%d,"world_size":8},', F.col("day") % 8)).otherwise("")
        head = F.concat(F.lit("{"), rank, F.format_string('"deviceProperties":[{"name":"gpu-%s","numSms":%d}],"traceEvents":[', "trace_id", F.col("n") % 128))
        low, high = F.lit(-(1 << 63)), F.lit((1 << 63) - 1)
        lines = rows.join(sums.select("file", "first"), "file").select("file", "idx", F.lit(1).alias("part"), F.concat(F.when(F.col("idx") == F.col("first"), "").otherwise(","), F.to_json(event)).alias("value"))
        lines = lines.unionByName(sums.select("file", low.alias("idx"), F.lit(0).alias("part"), head.alias("value"))).unionByName(sums.select("file", high.alias("idx"), F.lit(2).alias("part"), F.lit("]}").alias("value")))
        path = f"{shared_folder(c.spark)}/{uuid.uuid4().hex}"
        lines.repartition("file").sortWithinPartitions("file", "part", "idx").select("value", "file").write.partitionBy("file").text(path)
        events, headers = read_large_traces(c.spark, f"{path}/*/")
        of = [F.regexp_extract("trace_id", r"file=([^/]+)_(-?\d+)/", 1).alias("trace_id"), F.regexp_extract("trace_id", r"file=([^/]+)_(-?\d+)/", 2).cast("bigint").alias("day")]
        return materialize(events.select(*of, *[x for x in events.columns if x != "trace_id"])), materialize(headers.select(*of, *[x for x in headers.columns if x != "trace_id"]))
    return c.kept("trace_files", make)


@query("s01_read_traces", with_ctes("""
SELECT trace_id, ts_ns // 86400000000000 AS day, row_number() OVER (PARTITION BY trace_id, ts_ns // 86400000000000 ORDER BY idx) - 1 AS idx, ph, cat, name, pid, tid,
  ts_ns, dur_ns, flow_id, external_id, py_id, py_parent_id, call_from, arg_name, arg_labels, stack_traces FROM trace_event
""", stacks=True))
def _(c):
    """Events of trace files, split by Spark wherever it likes, read back with their stacks."""
    return _trace_files(c)[0]


@query("s02_trace_headers", """
SELECT trace_id, ts_ns // 86400000000000 AS day, concat('gpu-', trace_id) AS device_name, count(*) % 128 AS num_sms,
  CASE WHEN trace_id <> 't3' THEN CAST(ts_ns // 86400000000000 % 8 AS INTEGER) END AS rank, CASE WHEN trace_id <> 't3' THEN CAST(8 AS INTEGER) END AS world_size
FROM trace_event GROUP BY 1, 2
""")
def _(c):
    return _trace_files(c)[1]


_CLASS_TEXT = """concat('class P', k, '(', {base}, '):', chr(10), '    def __init__(self):', chr(10), '        self.left = P', 2 * k, '(', size, ')', chr(10), '        self.items = nn.ModuleList()', chr(10),
  '        if True:', chr(10), '            item = P', 2 * k + 1, '()', chr(10), '            self.items.append(item)', chr(10), '        self.sizes = list()', chr(10),
  '        setattr(self, ''act'', nn.ReLU())', chr(10), '    def forward(self, x):', chr(10), '        return x')""".format(base=_BASE)


def _packed(rows):
    """A gzipped tar archive of one file per row; eight files of ten classes."""
    data = io.BytesIO()
    with tarfile.open(fileobj=data, mode="w:gz") as tar:
        for path, text in zip(rows["path"], rows["content"]):
            raw = text.encode()
            member = tarfile.TarInfo(path)
            member.size = len(raw)
            tar.addfile(member, io.BytesIO(raw))
    return pd.DataFrame({"path": [f"code/a{rows['pack'].iloc[0]}.tgz"], "content": [data.getvalue()]})


@query("s03_source_files", f"""
SELECT CASE WHEN f % 3 = 0 THEN printf('m/f%05d.py', f) ELSE printf('code/a%d.tgz!m/f%05d.py', f // 8, f) END AS path, printf('f%05d.py', f) AS basename, sha256(string_agg(t, chr(10) ORDER BY k)) AS content_sha256
FROM (SELECT k, k // 10 AS f, {_CLASS_TEXT} AS t FROM (SELECT p_partkey AS k, p_size AS size FROM part) p) c GROUP BY f
""")
def _(c):
    """Model code, two files of three in archives, unpacked again."""
    texts = _texts(c.spark, c.sf).withColumn("f", F.regexp_extract("basename", r"(\d+)", 1).cast("long")).withColumn("pack", F.expr("f div 8"))
    packs = texts.filter("f % 3 <> 0").select("pack", "path", "content").groupBy("pack").applyInPandas(_packed, "path string, content binary")
    files = materialize(packs.unionByName(texts.filter("f % 3 = 0").select("path", F.col("content").cast("binary").alias("content"))))
    return code.unpack_sources(files).select("path", "basename", F.sha2(F.col("content").cast("binary"), 256).alias("content_sha256"))
