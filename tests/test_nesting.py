import random

import pytest

from stepweave.operators import nesting


def brute(rows, closed, order):
    """Parent = latest earlier event still open; nearest module = walk along parents."""
    parent = {}
    for key in {(r["pid"], r["tid"]) for r in rows}:
        line = sorted((r for r in rows if (r["pid"], r["tid"]) == key), key=order)
        for n, r in enumerate(line):
            open_ones = [q for q in line[:n] if (q["end"] >= r["ts_ns"] if closed else q["end"] > r["ts_ns"])]
            parent[r["idx"]] = open_ones[-1]["idx"] if open_ones else None
    by_idx = {r["idx"]: r for r in rows}
    module = {}
    for i in parent:
        p = parent[i]
        while p is not None and not by_idx[p]["name"].startswith("nn.Module:"):
            p = parent[p]
        module[i] = p
    return parent, module


def threads(seed, n=300):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        dur = r.choice([0, 1, 5, 20, 100, 900])
        mod = r.random() < 0.15
        rows.append({"idx": i, "pid": "0", "tid": "hot" if r.random() < 0.7 else "2", "ts_ns": r.randrange(2000), "dur_ns": dur,
                     "cat": "python_function" if mod else "cpu_op", "name": "nn.Module: M_0" if mod else "op"})
        rows[-1]["end"] = rows[-1]["ts_ns"] + dur
    return rows


@pytest.mark.parametrize("rows,seed", [(20, 1), (7, 2), (10_000, 3)])
def test_parents_and_modules_match_brute_force(make_events, rows, seed):
    data = threads(seed)
    got = {r.idx: (r.parent_idx, r.module_idx) for r in nesting.event_parents(make_events(data), rows).collect()}
    parent, module = brute(data, True, lambda r: (r["ts_ns"], r["idx"]))
    assert got == {i: (parent[i], module[i]) for i in parent}


@pytest.mark.parametrize("rows", [15, 10_000])
def test_half_open_outer_first(make_events, rows):
    data = threads(5)
    got = nesting.enclosing_events(make_events(data), closed=False, order=nesting.OUTER_FIRST, rows=rows)
    parent, _ = brute(data, False, lambda r: (r["ts_ns"], -r["dur_ns"], r["idx"]))
    assert {r.idx: r.parent_idx for r in got.collect()} == parent


def parents(make_events, spans, **kw):
    ev = make_events([{"ts_ns": s, "dur_ns": d} for s, d in spans])
    return {r.idx: r.parent_idx for r in nesting.enclosing_events(ev, **kw).collect()}


def test_touching_events(make_events):
    assert parents(make_events, [(0, 10), (10, 10)]) == {0: None, 1: 0}
    assert parents(make_events, [(0, 10), (10, 10)], closed=False, order=nesting.OUTER_FIRST) == {0: None, 1: None}


def test_crossing_events(make_events):
    assert parents(make_events, [(0, 10), (5, 10), (12, 1)]) == {0: None, 1: 0, 2: 1}


def test_module_walk_follows_parent_links(make_events):
    # the module has ended before the last event starts, but it is the parent of its parent
    ev = make_events([{"ts_ns": 0, "dur_ns": 10, "cat": "python_function", "name": "nn.Module: A_0"},
                      {"ts_ns": 5, "dur_ns": 10}, {"ts_ns": 12, "dur_ns": 1}])
    assert {r.idx: r.module_idx for r in nesting.event_parents(ev).collect()} == {0: None, 1: 0, 2: 0}


def test_equal_start_keeps_file_order(make_events):
    assert parents(make_events, [(0, 1), (0, 50), (0, 0)]) == {0: None, 1: 0, 2: 1}
    assert parents(make_events, [(0, 1), (0, 50), (0, 0)], closed=False, order=nesting.OUTER_FIRST) == {0: 1, 1: None, 2: 0}


def test_external_id_first_seen_module_wins(make_events):
    m = lambda ts, dur, name, ext=None: {"ts_ns": ts, "dur_ns": dur, "cat": "python_function", "name": f"nn.Module: {name}", "external_id": ext}
    ev = make_events([m(0, 100, "Outer_0"), m(10, 20, "Inner_0"), {"ts_ns": 15, "dur_ns": 1, "external_id": 7},
                      {"ts_ns": 50, "dur_ns": 1, "external_id": 7}, {"ts_ns": 60, "dur_ns": 1, "external_id": 8},
                      {"ts_ns": 15, "dur_ns": 1, "cat": "kernel", "external_id": 9}, m(200, 5, "Self_0", 11)])
    got = {r.external_id: r.module for r in nesting.external_id_modules(ev).collect()}
    assert got == {7: "nn.Module: Inner_0", 8: "nn.Module: Outer_0", 11: "nn.Module: Self_0"}


def test_chunks_do_not_change_external_ids(make_events):
    data = [{**r, "external_id": i % 40} for i, r in enumerate(threads(9))]
    ev = make_events(data)
    a = {tuple(r) for r in nesting.external_id_modules(ev, 12).collect()}
    assert a == {tuple(r) for r in nesting.external_id_modules(ev).collect()} and a
