"""Trace files read in splits against the reader that takes a file whole."""

import json
import random

import pytest

from stepweave.sources import traces

TEXTS = ["plain", 'quote " in it', "brace } and { and ] [", "back\\slash", 'both \\" }', "{", "é中", "", "\\\\", '"traceEvents": [']


def trace_file(r, n, indent):
    events = []
    for i in range(n):
        e = {"ph": "X", "cat": r.choice(["cpu_op", "kernel"]), "name": r.choice(TEXTS), "pid": i % 3, "tid": r.choice([7, "t"]), "ts": 1712345678901234.567 + i, "dur": 1.5}
        if r.random() < 0.5:
            e["args"] = {"External id": i, "name": r.choice(TEXTS), "stack": {"stack_traces": [r.choice(TEXTS) for _ in range(r.randrange(3))]}}
        events.append(e)
    head = {"schemaVersion": 1, "deviceProperties": [{"name": r.choice(TEXTS), "numSms": 80}, {"name": "other"}], "distributedInfo": {"rank": 3, "world_size": 8, "more": {"a": [{"b": 1}]}}}
    parts = [*head.items(), ("traceEvents", events), ("traceName", "x}y"), ("tail", [{"z": 1}])]
    r.shuffle(parts)
    return json.dumps(dict(parts), indent=indent, ensure_ascii=r.random() < 0.5) + r.choice(["", "\n"])


@pytest.mark.parametrize("split", ["150", "700", "128m"])
def test_splits_give_the_same_events(spark, tmp_path, split):
    r = random.Random(len(split))
    for k in range(6):
        (tmp_path / f"trace_{k}.json").write_text(trace_file(r, [0, 1, 3, 8, 15, 25][k], [None, 1][k % 2]), encoding="utf-8")
    path = str(tmp_path / "trace_*.json")
    want = traces.read_raw_traces(spark, path)
    conf = {"spark.sql.files.maxPartitionBytes": split, "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        events, headers = traces.read_large_traces(spark, path)
        key = lambda x: (x[0].rsplit("/", 1)[1], x[1])
        got, head = sorted(map(tuple, events.collect()), key=key), sorted(map(tuple, headers.collect()))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    name = lambda rows: [(x[0].rsplit("/", 1)[1], *x[1:]) for x in rows]
    assert name(got) == name(sorted(map(tuple, traces.explode_events(want).collect()), key=key))
    assert name(head) == name(sorted(map(tuple, traces.trace_headers(want).collect())))


def test_a_large_object_crosses_many_splits(spark, tmp_path):
    events = [{"ph": "X", "name": "a"}, {"ph": "X", "name": "} {" * 1500, "args": {"name": '"' * 50}}, {"ph": "X", "name": "b"}]
    (tmp_path / "t.json").write_text(json.dumps({"traceEvents": events}))
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
        rows, _ = traces.read_large_traces(spark, str(tmp_path / "t.json"))
        got = [(r.idx, r.name, r.arg_name) for r in rows.orderBy("idx").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(0, "a", None), (1, "} {" * 1500, '"' * 50), (2, "b", None)]
