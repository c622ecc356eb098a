import pytest
from pyspark.sql import functions as F

from stepweave.operators import flows, rollup, stacks
from stepweave.plans.tables import TraceTables

SPANS = [("net.py", "Net", None, 10, 49, 0), ("net.py", "Net", "forward", 20, 30, 1), ("net.py", "Block", None, 50, 89, 2),
         ("net.py", "Head", None, 100, 149, 3), ("net.py", "Head", "forward", 100, 120, 4)]


@pytest.fixture(scope="module")
def spans(spark):
    return spark.createDataFrame(SPANS, "file string, class string, method string, start_line long, end_line long, ord long")


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame([("net.py",), ("main.py",)], "basename string")


def text(*frames):
    return "\n".join(["Traceback:"] + [f'  File "/app/{f}", line {n}, in {fn}' for f, n, fn in frames])


def kernel(ts, dur, *traces, **kw):
    return {"ts_ns": ts, "dur_ns": dur, "cat": "kernel", "name": "k", "pid": "1", "tid": "7", "stack_traces": list(traces) or None, **kw}


def keys_of(make_events, spans, sources, trace):
    ev = make_events([kernel(0, 1, trace)])
    own = stacks.user_frames(stacks.stack_frames(stacks.distinct_stacks(ev)), sources)
    rows = stacks.instance_keys(own, spans).orderBy("frame_no").collect()
    return [(r["class"], r.site_file, r.site_line, [tuple(a) for a in r.ancestors]) for r in rows]


def test_keys_follow_class_changes(make_events, spans, sources):
    trace = text(("main.py", 5, "run"), ("net.py", 25, "forward"), ("/x/torch.py", 1, "call"), ("net.py", 27, "forward"), ("net.py", 60, "go"), ("net.py", 110, "forward"))
    assert keys_of(make_events, spans, sources, trace) == [
        ("Net", "main.py", 5, []), ("Block", "net.py", 27, [("main.py", 5)]), ("Head", "net.py", 60, [("main.py", 5), ("net.py", 27)])]


def test_first_frame_in_a_class_hangs_on_root(make_events, spans, sources):
    assert keys_of(make_events, spans, sources, text(("net.py", 25, "f"))) == [("Net", "<root>", 10, [])]
    assert keys_of(make_events, spans, sources, text(("main.py", 1, "f"))) == []


def test_dedup_of_hotspots_but_not_of_votes(make_events, spans, sources):
    same = text(("net.py", 25, "forward"))
    other = text(("net.py", 26, "forward"))
    t = TraceTables(make_events([kernel(0, 30, same, same, other)]))
    hot = {(r.kind, r.key): r.fwd_ns for r in stacks.source_hotspots(t.events, spans).collect()}
    assert hot == {("line", "net.py:25"): 10.0, ("line", "net.py:26"): 10.0, ("class", "net.py:Net"): 10.0, ("method", "net.py:Net.forward"): 10.0}
    block = text(("net.py", 25, "forward"), ("net.py", 60, "go"))
    t = TraceTables(make_events([kernel(0, 30, same, same, block)]))
    votes = {r["class"]: (r.n_hits, r.n_total) for r in rollup.kernel_attribution(t, sources, spans).collect()}
    assert votes == {"Net": (2, 3), "Block": (1, 3)}


def test_fallback_ladder(make_events, spans, sources):
    ev = make_events([
        {"ts_ns": 0, "dur_ns": 100, "cat": "python_function", "name": "nn.Module: FSDPFoo_3", "external_id": 5},
        kernel(0, 2, external_id=5), kernel(5, 2, text(("other.py", 1, "f")), external_id=5), kernel(9, 2, external_id=6),
        {**kernel(50, 2), "pid": "0", "tid": "1"}])
    rows = {r.idx: (r["class"], r.site_file, r.site_line, r.rung) for r in rollup.kernel_attribution(TraceTables(ev), sources, spans).collect()}
    assert rows[1] == ("Foo", "<wrapped>", -3, "wrapped") and rows[2] == rows[1]
    assert rows[3] == (None, None, None, "none") and rows[4][3] == "wrapped"


def instances(spark, rows):
    schema = "trace_id string, class string, site_file string, site_line long, ancestors array<struct<file:string,line:bigint>>, " + ", ".join(
        f"self_{p} double" for p in rollup.ALL_PHASES)
    return spark.createDataFrame([("t", c, f, n, a, v, 0.0, 0.0, 0.0) for c, f, n, a, v in rows], schema)


@pytest.mark.parametrize("mode", ["transitive", "one_level"])
def test_rollup_past_an_instance_without_kernels(spark, spans, mode):
    # Net -> Block (no kernels) -> Head
    rows = [("Net", "<root>", 10, [], 1.0), ("Head", "net.py", 60, [("<root>", 10), ("net.py", 25)], 4.0)]
    out = rollup.instance_times(instances(spark, rows), spans, ["Net"], mode)
    got = {r["class"]: (r.self_forward, r.inclusive_forward, r.synthesized, r.is_orphan) for r in out.collect()}
    assert got["Head"] == (4.0, 4.0, False, False)
    assert got["Block"] == (0.0, 4.0, True, mode == "one_level")
    assert got["Net"][:2] == (1.0, 5.0)


def test_unresolved_parent_makes_an_orphan(spark, spans):
    rows = [("Net", "<root>", 10, [], 1.0), ("Head", "main.py", 1, [("main.py", 9)], 4.0), ("Foo", "<wrapped>", 3, [], 2.0)]
    plain = {r["class"]: r.inclusive_forward for r in rollup.instance_times(instances(spark, rows), spans).collect()}
    rooted = {r["class"]: r.inclusive_forward for r in rollup.instance_times(instances(spark, rows), spans, ["Net"]).collect()}
    assert plain == {"Net": 1.0, "Head": 4.0, "Foo": 2.0} and rooted == {"Net": 7.0, "Head": 4.0, "Foo": 2.0}


def test_flow_pairing_last_row_wins(make_events):
    f = lambda ph, i, ts, tid: {"ph": ph, "cat": "fwdbwd", "name": "f", "flow_id": i, "ts_ns": ts, "tid": tid}
    ev = make_events([f("s", "1", 5, "a"), f("s", "1", 6, "b"), f("f", "1", 9, "c"), f("s", "2", 1, "a"), f("f", "3", 1, "a")])
    assert [(r.flow_id, r.fwd_ts, r.fwd_tid, r.bwd_ts) for r in flows.flow_pairs(ev).collect()] == [("1", 6, "b", 9)]


def test_borrowed_stack_is_the_nearest_in_scope(make_events, spans, sources):
    f = lambda ph, i, ts, tid: {"ph": ph, "cat": "fwdbwd", "name": "f", "flow_id": i, "ts_ns": ts, "tid": tid}
    stack = text(("net.py", 25, "forward"))
    k = lambda ts, tid, *s: {**kernel(ts, 1, *s), "tid": tid}
    ev = make_events([
        {"ts_ns": 0, "dur_ns": 50, "tid": "a"}, {"ts_ns": 100, "dur_ns": 50, "tid": "b"}, f("s", "1", 10, "a"), f("f", "1", 110, "b"),
        k(5, "a", stack), k(20, "a", stack), k(60, "a", stack), k(120, "b"), k(105, "b")])
    got = {r.idx: (r.source, r.donor_idx, r.phase) for r in flows.kernel_stack_costs(TraceTables(ev), sources).collect()}
    assert got[7] == ("borrowed", 5, "bwd")          # the donor at 60 lies outside the forward operation
    assert got[8] == ("none", None, "bwd")           # starts before the arrow
    assert got[4] == ("stack", None, "fwd")


@pytest.mark.parametrize("rows", [8, 10_000])
def test_nearest_donor_matches_brute_force(spark, rows):
    import random
    r = random.Random(4)
    scoped = [("t", i, r.randrange(400), "a", s := r.randrange(300), s + r.randrange(80)) for i in range(80)]
    donors = [("t", 1000 + i, "a", r.randrange(400)) for i in range(60)]
    got = flows.nearest_in_scope(
        spark.createDataFrame(scoped, "trace_id string, idx long, ts_ns long, fwd_tid string, fwd_start long, fwd_end long"),
        spark.createDataFrame(donors, "trace_id string, idx long, tid string, ts_ns long"), rows)
    want = {}
    for _, i, ts, _, a, b in scoped:
        best = min(((abs(d - ts), d, j) for _, j, _, d in donors if a <= d <= b), default=None)
        if best:
            want[i] = best[2]
    assert {x.idx: x.donor_idx for x in got.collect()} == want


def test_coverage_of_odd_values(spark):
    g = spark.createDataFrame([("g", 0, "5", "0", "R"), ("g", 1, "x", None, "A"), ("g", 2, "0", "3", "B"), ("h", 0, "1", "1", "R")],
                              "graph_id string, depth int, kernel_us string, total_us string, class_name string").withColumns(
        {"label": F.lit("l"), "attr_name": F.lit(""), "id": F.col("depth")})
    cov = {r.graph_id: (r.total_instances, r.timed_instances, r.coverage_rate) for r in rollup.timing_coverage(g).collect()}
    assert cov == {"g": (2, 1, 0.5), "h": (0, 0, 0.0)}
    assert [(r.class_name, r.instance_key) for r in rollup.untimed_groups(g).collect()] == [("A", "1")]


def test_kernel_totals_beyond_64_bits(spark, make_events):
    from decimal import Decimal

    big = 6 * 10**18
    t = TraceTables(make_events([kernel(0, big), kernel(1, big), kernel(2, 5)]))
    key = "class string, site_file string, site_line long, ancestors array<struct<file:string,line:bigint>>"
    attribution = spark.createDataFrame([("t", i, i, d, False, "Net", "net.py", 1, [], 1, 1, "wrapped") for i, d in enumerate((big, big, 5))],
                                        f"trace_id string, idx long, ts_ns long, dur_ns long, is_bwd boolean, {key}, n_hits long, n_total long, rung string")
    counters = rollup.attribution_counters(t, attribution)
    assert [(r.total_kernels, int(r.total_kernel_ns)) for r in counters.collect()] == [(3, 2 * big + 5)]
    none = "self_forward decimal(38,0), self_backward decimal(38,0), self_optimize decimal(38,0), self_other decimal(38,0)"
    steps = spark.createDataFrame([("t",)], "trace_id string")
    times = spark.createDataFrame([("t", Decimal(0), Decimal(0), Decimal(0), Decimal(10**9) * big)], f"trace_id string, {none}")
    row = rollup.in_ns(rollup.instance_summary(counters, steps, times)).collect()[0]
    assert (row.step_kernel_ns, row.attributed_ns, row.unattributed_ns) == (float(2 * big + 5), float(big), float(big + 5))
