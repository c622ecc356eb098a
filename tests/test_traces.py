import gzip
import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from stepweave.functions import labels
from stepweave.operators import device, modules, phases, swimlane, trace_dims
from stepweave.plans.tables import TraceTables
from stepweave.sources import code, traces
from workload import source_queries


def meta(name, pid, tid="0", **args):
    return {"ph": "M", "cat": None, "name": name, "pid": pid, "tid": tid, **args}


LABELS = [meta("process_labels", "0", arg_labels="CPU"), meta("process_labels", "1", arg_labels="GPU 0")]


def op(ts, dur, **kw):
    return {"ts_ns": ts, "dur_ns": dur, **kw}


def kernel(ts, dur, name="k", tid="7", **kw):
    return op(ts, dur, **{"cat": "kernel", "name": name, "pid": "1", "tid": tid, **kw})


def step(ts, dur, n=0):
    return op(ts, dur, cat="user_annotation", name=f"ProfilerStep#{n}", tid="main")


def test_read_traces_plain_and_gzip(spark, tmp_path):
    doc = {"deviceProperties": [{"name": "X1", "numSms": 8}], "distributedInfo": {"rank": 1},
           "traceEvents": [
               {"ph": "X", "cat": "kernel", "name": "k", "pid": 3, "tid": "s", "ts": 1712345678901234.5, "dur": 2.5,
                "args": {"External id": 5, "stack": {"stack_traces": ["a", "b"]}, "other": {"deep": [1]}}},
               {"ph": "M", "name": "thread_name", "pid": 3, "tid": "s", "args": {"name": "stream"}}]}
    # more digits than a double holds
    (tmp_path / "a.json").write_text(json.dumps(doc).replace("1712345678901234.5", "1712345678901234.567"))
    with gzip.open(tmp_path / "b.json.gz", "wt") as f:
        json.dump({"traceEvents": [{"ph": "X", "name": "n", "pid": 1, "tid": 2, "ts": 4, "dur": 1}]}, f)
    raw = traces.read_raw_traces(spark, str(tmp_path))
    rows = {(r.trace_id.rsplit("/", 1)[-1], r.idx): r for r in traces.explode_events(raw).collect()}
    k = rows["a.json", 0]
    assert (k.pid, k.ts_ns, k.dur_ns, k.external_id, k.stack_traces) == ("3", 1712345678901234567, 2500, 5, ["a", "b"])
    assert rows["a.json", 1].arg_name == "stream" and rows["b.json.gz", 0].ts_ns == 4000
    heads = {r.trace_id.rsplit("/", 1)[-1]: (r.device_name, r.num_sms, r.rank, r.world_size) for r in traces.trace_headers(raw).collect()}
    assert heads == {"a.json": ("X1", 8, 1, 1), "b.json.gz": (None, None, None, None)}


def test_landed_events_and_result_tables(spark, make_events, tmp_path):
    ev = make_events([op(5, 1), op(1, 1, trace_id="u")])
    traces.land_events(ev, str(tmp_path / "events"))
    assert spark.read.parquet(str(tmp_path / "events")).count() == 2
    traces.write_tables({"kinds": trace_dims.trace_kind(ev)}, str(tmp_path / "out"), "json")
    assert spark.read.json(str(tmp_path / "out" / "kinds")).filter("trace_id = 'u'").count() == 1


def test_sources_from_folder_and_archive(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "a.py").write_bytes(b"x = '\xff'\n")
    (tmp_path / "pkg" / "note.txt").write_text("no")
    data = b"class B(nn.Module):\n    pass\n"
    with tarfile.open(tmp_path / "code.tar.gz", "w:gz") as tar:
        info = tarfile.TarInfo("m/a.py")
        info.size = len(data)
        tar.addfile(info, io.BytesIO(data))
    got = code.read_sources(spark, str(tmp_path))
    assert sorted(r.basename for r in got.collect()) == ["a.py", "a.py"]
    assert code.by_basename(got).count() == 1


def test_facts_of_one_file(spark):
    text = """
class Root(nn.Module):
    def __init__(self):
        self.a = b = Child()
        self.many = nn.ModuleList()
        for i in range(3):
            layer = Child(i)
            self.many.append(layer)
        with ctx():
            self.many.append(torch.nn.Linear(1, 1))
        setattr(self, name, Child())
        self.n = Counter()
        while True:
            self.skipped = Child()
    async def run(self):
        pass
class Child(Root):
    pass
"""
    bad = "def broken(:\n"
    src = spark.createDataFrame([("p/a.py", "a.py", text), ("p/b.py", "b.py", bad)], code.SOURCE_SCHEMA)
    facts = code.source_facts(src).cache()
    subs = [(r.name, r.detail, r.container_type, r.is_dynamic) for r in facts.filter("kind = 'submodule'").orderBy("ord").collect()]
    assert subs == [("a", "Child", "", False), ("many", "", "ModuleList", False), ("many[*]", "Child", "", False),
                    ("many[*]", "Linear", "", False), ("<dynamic>", "Child", "", True)]
    assert facts.filter("kind = 'unparsable'").count() == 1
    inv = code.class_inventory(facts)
    assert sorted(r["class"] for r in code.module_classes(inv).collect()) == ["Child", "Root"]
    tree = code.module_tree(code.submodules(facts, inv), code.module_classes(inv), code.root_classes(code.submodules(facts, inv), code.module_classes(inv)))
    assert sorted(r.attr_path for r in tree.collect()) == ["<dynamic>", "a", "many", "many[*]", "many[*]"]


def test_module_forest(spark):
    # R and S are roots (S contains itself); C > D > C lies below none of them, object is no module
    modules = spark.createDataFrame([("x", c) for c in "RACDS"], "code_id string, class string")
    links = [("R", "A"), ("A", "ReLU"), ("C", "D"), ("D", "C"), ("S", "S"), ("S", "A"), ("object", "R")]
    rows = [("x", c, f"{c}.py", f"to_{d}", d, "", False, 1, False, i) for i, (c, d) in enumerate(links)]
    subs = spark.createDataFrame(rows, "code_id string, class string, path string, attr string, child_class string, container_type string, "
                                 "is_container boolean, line long, is_dynamic boolean, ord long")
    assert {r["class"] for r in code.tree_roots(subs, modules).collect()} == {"R", "S"}
    got = sorted((r.root, r.attr_path, r.depth) for r in code.module_forest(subs, modules).collect())
    assert got == [("C", "to_D", 1), ("C", "to_D.to_C", 2), ("R", "to_A", 1), ("R", "to_A.to_ReLU", 2),
                   ("S", "to_A", 1), ("S", "to_A.to_ReLU", 2), ("S", "to_S", 1)]


def test_forest_query_opens_every_module_class(spark):
    from oracle_check import compare, connect

    sf = "/root/testdata/sf0.001"
    assert not (problem := compare(spark, connect(sf), "d07_module_forest", sf)), problem
    c = source_queries.Code(spark, sf)
    opened = source_queries.QUERIES["d07_module_forest"](spark, sf).select("parent_class").distinct()
    assert opened.count() == c.modules.count()  # the tree below P3 opens a part of them


def test_phase_words(spark):
    words = {"Optimizer.step#Adam": "optimize", "run_backward": "backward", "backwards": None, "Forward 1": "forward", "feedforward": None}
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", labels.phase_of_label(F.col("w")).alias("p"))
    assert {r.w: r.p for r in df.collect()} == words


def test_wrapper_words(spark):
    words = {"SyncRunner_0": True, "FSDPEncoder_1": False, "MainModule_3": True, "Module_x": False, "Plain_0": False, "mlp_sync": False}
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", labels.is_wrapper(F.col("w")).alias("p"))
    assert {r.w: r.p for r in df.collect()} == words


def test_runtime_module_parts(spark):
    df = spark.createDataFrame([("nn.Module: FSDPNet_12, callsite: 30",), ("nn.Module:Net",)], "w string")
    got = [tuple(r.r) for r in df.select(labels.runtime_module(F.col("w")).alias("r")).collect()]
    assert got == [("FSDPNet_12", "Net", 12, 30), ("Net", "Net", None, None)]


def test_step_fallbacks(make_events):
    ev = make_events([op(0, 5), op(10, 20), op(0, 77, trace_id="u", cat="Trace"), op(0, 0, trace_id="v", cat="Trace"), op(3, 4, trace_id="v")])
    got = {r.trace_id: (r.n_steps, r.step_dur_ns) for r in trace_dims.step_summary(ev).collect()}
    assert got == {"t": (0, 30.0), "u": (0, 77.0), "v": (0, 7.0)}


def test_upper_median_step(make_events):
    ev = make_events([step(0, 10), step(100, 40), step(200, 20), step(300, 30)])
    assert trace_dims.choose_step(trace_dims.steps(ev)).first().dur_ns == 30


def test_first_of_overlapping_steps(make_events):
    ev = make_events([step(0, 100), step(50, 100), op(60, 1), op(120, 1), op(150, 1), op(500, 1)])
    got = {r.idx: r.step_no for r in trace_dims.step_at_start(ev, trace_dims.steps(ev)).collect()}
    assert (got[2], got[3], got[4], got[5]) == (0, 1, None, None)


def test_clip_to_step(make_events):
    ev = make_events([step(10, 10), op(5, 100), op(15, 100)])
    got = {r.idx: r.clipped_ns for r in trace_dims.clipped_in_steps(ev, trace_dims.steps(ev)).collect()}
    assert (got[1], got[2]) == (0, 5)


def test_kernel_counts_never_drop_to_zero(make_events):
    t = TraceTables(make_events([*LABELS, *[step(i * 10, 10, i) for i in range(3)], kernel(0, 3), kernel(11, 3)]))
    top = device.top_kernels(t).first()
    assert (top.n_calls, top.dur_ns) == (2, 2.0)


def test_gap_uses_previous_event_only(make_events):
    t = TraceTables(make_events([*LABELS, kernel(0, 100, "long"), kernel(10, 5), kernel(30, 5)]))
    assert [r.gap_ns for r in device.kernel_gaps(t, rows=1).collect()] == [15]


def test_stream_kinds(make_events):
    busy = [kernel(i, 1, tid="7") for i in range(5)]
    copy = dict(cat="gpu_memcpy")
    t = TraceTables(make_events([*LABELS, *busy, kernel(0, 1, "ncclAll", "8"), kernel(9, 1, tid="9", **copy),
                                 kernel(0, 1, "NCCL", "10"), kernel(5, 1, tid="10", **copy)]))
    assert {r.tid: r.stream_kind for r in t.threads.filter("pid = '1'").collect()} == {"7": "compute", "8": "comm", "9": "memcpy", "10": "comm"}


def test_overlap_of_comm_and_compute(make_events):
    ev = [*LABELS, step(0, 100), kernel(0, 30), kernel(10, 30), kernel(50, 1), kernel(20, 40, "nccl", "8"), kernel(90, 40, "nccl", "8")]
    t = TraceTables(make_events(ev))
    for rows in (2, None):
        r = device.overlap_by_step(t, rows).first()
        assert (r.compute_ns, r.comm_ns, r.comm_overlap_ns) == (41, 50, 21)


def test_phases_of_kernels(make_events):
    py = dict(cat="python_function", tid="main")
    ev = make_events([step(0, 100), op(1, 95, name="train_runner.py step", **py), op(2, 50, name="x.forward_backward", **py),
                      op(3, 10, name="forward", **py), op(20, 30, name="backward", **py), op(60, 20, name="optimize", **py),
                      kernel(5, 20, "both"), kernel(62, 1, "opt"), kernel(90, 1, "none"), kernel(500, 1, "outside")])
    steps, parts = phases.step_phases(ev)
    spans = ev.filter("cat = 'kernel'").select("trace_id", "idx", F.col("ts_ns").alias("start_ns"), (F.col("ts_ns") + F.col("dur_ns")).alias("end_ns"))
    got = {r.idx: r.phase for r in phases.phase_of_spans(spans, steps, parts).collect()}
    assert got == {6: "forward", 7: "optimize", 8: "other", 9: "other"}


def test_cyclic_module_names_have_no_depth(spark):
    t = spark.createDataFrame([("t", "a", "b"), ("t", "b", "a"), ("t", "c", "ROOT"), ("t", "d", "c"), ("t", "e", "d")], "trace_id string, name string, parent string")
    assert {r.name: r.depth for r in modules.name_depths(t).collect()} == {"a": None, "b": None, "c": 0, "d": 1, "e": 2}


def greedy(rows):
    durs = sorted(d for _, d, _ in rows)
    gap = max(20_000.0, min(durs[len(durs) // 2] * 0.1, 500_000.0))
    ends, out = [], {}
    for ts, minus, i in sorted((ts, -d, i) for ts, d, i in rows):
        row = next((n for n, e in enumerate(ends) if ts - e >= gap), len(ends))
        ends[row:row + 1] = [ts - minus]
        out[i] = row
    return out


@pytest.mark.parametrize("rows", [12, 10_000])
def test_lane_packing_matches_greedy_loop(make_events, rows):
    import random
    r = random.Random(11)
    data = [{"ts_ns": r.randrange(20_000_000), "dur_ns": r.choice([1_000, 90_000, 700_000, 2_000_000]), "tid": "hot" if i % 4 else "b",
             "cat": "python_function", "name": "nn.Module: SyncX_0"} for i in range(200)]
    calls = swimlane.module_events(make_events(data))
    got = {x.idx: x.sub_row for x in swimlane.pack_lanes(calls, rows).collect()}
    want = {}
    for tid in ("hot", "b"):
        want |= greedy([(d["ts_ns"], d["dur_ns"], i) for i, d in enumerate(data) if d["tid"] == tid])
    assert got == want


def module(ts, dur, name, py=None, up=None):
    return op(ts, dur, cat="python_function", name=f"nn.Module: {name}", py_id=py, py_parent_id=up)


def test_call_edges_by_id_or_by_nesting(make_events):
    linked = [module(0, 10, "A_0", 1), module(1, 2, "B_0", 2, 1), module(4, 2, "B_1", 3, 1)]
    nested = [{**module(0, 10, "A_0", 1), "trace_id": "u"}, {**module(1, 2, "A_0", 2, 1), "trace_id": "u"}, {**module(10, 1, "C_0", 3), "trace_id": "u"},
              {**module(2, 1, "B_0", 9, 77), "trace_id": "u"}]
    got = {(r.trace_id, r.source, r.target): r.n_calls for r in swimlane.call_edges(swimlane.module_events(make_events(linked + nested), True)).collect()}
    assert got == {("t", "A_0", "B_0"): 1, ("t", "A_0", "B_1"): 1, ("u", "A_0", "B_0"): 1}


def test_two_traces_do_not_mix(make_events):
    rows = [*LABELS, step(0, 100), kernel(0, 30, "a"), kernel(40, 5, "b")]
    both = rows + [{**r, "trace_id": "u"} for r in rows]
    one, two = TraceTables(make_events(rows)), TraceTables(make_events(both))
    want = {(r.name, r.dur_ns, r["rank"]) for r in device.top_kernels(one).collect()}
    for name in "tu":
        assert {(r.name, r.dur_ns, r["rank"]) for r in device.top_kernels(two).filter(F.col("trace_id") == name).collect()} == want


def test_committed_runs_replace_traces_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "results")
    table = lambda rows: spark.createDataFrame(rows, "trace_id string, v long")
    rows = lambda name: sorted((r.trace_id, r.v) for r in traces.read_table(spark, path, name).collect())
    traces.commit_tables({"a": table([("1", 1), ("1", 2), ("2", 3)]), "b": table([("1", 10), ("2", 20)])}, path)
    assert rows("a") == [("1", 1), ("1", 2), ("2", 3)]
    table([("1", 99)]).write.mode("append").partitionBy("trace_id").parquet(f"{path}/a/run=2")  # a run that broke off
    assert rows("a") == [("1", 1), ("1", 2), ("2", 3)] and rows("b") == [("1", 10), ("2", 20)]
    assert traces.commit_tables({"a": table([("1", 4)]), "b": table([("1", 40)])}, path) == 2
    assert rows("a") == [("1", 4), ("2", 3)] and rows("b") == [("1", 40), ("2", 20)]


def test_totals_beyond_64_bits(make_events):
    from workload.trace_queries import QUERIES, _LANDED

    big = 6 * 10**18
    t = TraceTables(make_events([*LABELS, step(0, 100), kernel(0, big, "a"), kernel(1, big, "a"), kernel(2, 5, "b"), op(0, big, pid="0"), op(1, big, pid="0")]))
    got = {(r.side, r.grain, r.key): (int(r.total_ns), r.dur_ns) for r in device.device_host_totals(t).collect()}
    assert got["device", "total", None] == got["device", "cat", "kernel"] == (2 * big + 5, float(2 * big + 5))
    assert got["device", "name", "b"] == (5, 5.0)
    _LANDED[t.events.sparkSession.sparkContext.applicationId, "big"] = t
    spark = t.events.sparkSession
    rows = {(r.side, r.grain, r.key): (r.total_ns, r.dur_ns) for r in QUERIES["a06_device_host_totals"](spark, "big").collect()}
    assert rows["device", "name", "a"] == (None, float(2 * big)) and rows["device", "name", "b"] == (5, 5.0)
    first = {r["rank"]: r.key for r in QUERIES["a06_top_device_host_ops"](spark, "big").filter("side = 'device'").collect()}
    assert first == {1: "a", 2: "b"}
    assert {r.cat: r.pct for r in QUERIES["f11_percent"](spark, "big").collect()}["cpu_op"] == 100.0
