"""Small graphs are done in their task, with the results of the joins."""

from stepweave.graph import closure, containers, edges, whole


def _rows(df):
    return sorted(map(str, (r.asDict() for r in df.select(*sorted(df.columns)).collect())))


def _exchanges(spark, monkeypatch, module, run):
    """Shuffle keys of the tables that ``run`` writes."""
    plans, write = [], module.materialize
    monkeypatch.setattr(module, "materialize", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df))[1])
    run()
    return [line.split("Exchange hashpartitioning(")[1].split("), ")[0] for p in plans for line in p.splitlines() if "Exchange hashpartitioning(" in line]


MEMBERS = [("a", "n1", "g"), ("a", "n2", "g"), ("a", "g", "root"), ("a", "n1", "root"), ("a", "n1", "g"),  # two ways up, a link twice
           ("b", "x", "y"), ("b", "y", "z"), ("b", "z", "x"), ("b", "w", "x"),  # a cycle
           (None, "p", "q"), (None, "q", "r"), ("c", None, "t"), ("c", "s", None), ("c", "t", "u"), ("c", "n1", "t"),
           *[("d", f"k{i}", f"k{i + 1}") for i in range(40)]]


def test_closure_in_task_is_that_of_the_rounds(spark, monkeypatch):
    members = spark.createDataFrame(MEMBERS, "graph_id string, child_id string, parent_id string")
    assert _rows(closure.ancestors(members)) == _rows(closure.ancestors_in_rounds(members))
    dealt = _exchanges(spark, monkeypatch, whole, lambda: closure.ancestors(members))
    assert [d for d in dealt if "graph_id" in d] and not [d for d in dealt if "ancestor_id" in d]  # by graph, once
    monkeypatch.setattr(whole, "SMALL", 5)  # graph d goes in rounds, which others do not
    assert _rows(closure.ancestors(members)) == _rows(closure.ancestors_in_rounds(members))


def test_focus_sets_in_task_are_those_of_the_joins(spark, monkeypatch):
    up = closure.ancestors(spark.createDataFrame(MEMBERS, "graph_id string, child_id string, parent_id string"))
    links = spark.createDataFrame([("a", "n1", "n2"), ("a", "n2", "out"), ("a", "in", "n1"), ("b", "w", "v"), ("b", "v", "v"), ("c", "n1", None),
                                   (None, "p", "q"), *[("d", f"k{i}", f"k{i + 3}") for i in range(20)], ("a", "n1", "n2")], "graph_id string, src_id string, dst_id string")
    focus = spark.createDataFrame([("a", "n1"), ("a", "g"), ("a", "root"), ("b", "x"), ("b", "v"), ("b", "v"), ("c", "n1"), ("c", None), (None, "p"), ("e", "alone"), ("d", "k3"), ("d", "k20")],
                                  "graph_id string, node_id string")
    io = spark.createDataFrame([("a", "in"), ("a", "out"), ("b", "v"), ("d", "k7"), ("c", None)], "graph_id string, node_id string")
    want = _rows(edges.focus_sets_by_joins(focus, links, up, io))
    assert _rows(edges.focus_sets(focus, links, up, io)) == want
    dealt = _exchanges(spark, monkeypatch, whole, lambda: edges.focus_sets(focus, links, up, io))
    assert [d for d in dealt if "graph_id" in d] and not [d for d in dealt if "src_id" in d or "focus_id" in d]
    monkeypatch.setattr(whole, "SMALL", 20)
    assert _rows(edges.focus_sets(focus, links, up, io)) == want


def _boxes(spark):
    attrs = [("a", "m1", "box", "0", "m", "L", False), ("a", "m2", "deep", "0", "m", "L", False), ("a", "deep", "box", "1", "deep", "S", True), ("a", "box", "root", "0", "box", "S", True),
             ("a", "root", None, None, "root", "S", True), ("a", "none", "root", "1", "none", "S", True), ("a", "own", "root", "2", "own", "S", True), ("a", "m3", "own", "0", "m", "L", False),
             ("b", "r", "s", "0", "r", "S", True), ("b", "s", "r", "0", "s", "S", True), ("b", "m", "r", "1", "m", "L", False), ("c", "r", None, None, "r", "S", True), ("c", "m", "r", "0", "m", "L", None),
             (None, "m", "r", "0", "m", "L", False), (None, "r", None, None, "r", "S", True), ("d", None, "r", "0", "x", "S", True), ("d", "r", None, None, "r", "S", True), ("d", "m", "r", "0", "m", "L", False),
             *[("e", f"c{i}", f"c{i + 1}", str(i), f"c{i}", "S", True) for i in range(30)], ("e", "m", "c0", "0", "m", "L", False)]
    nodes = [("a", 1, "m1"), ("a", 2, "m2"), ("a", 7, "own"), ("a", 3, "m3"), ("a", 4, "m3"), ("b", 5, "m"), ("d", 1, "m"), ("d", 2, None), ("d", None, "m"), (None, 1, "m"), ("e", 3, "m")]
    return (spark.createDataFrame(attrs, "graph_id string, attr_id string, parent_attr_id string, key string, attr_name string, class_name string, is_container boolean"),
            spark.createDataFrame(nodes, "graph_id string, node_id bigint, attr_id string"))


def test_containers_in_task_are_those_of_the_joins(spark, monkeypatch):
    attrs, nodes = _boxes(spark)
    made = containers.missing_containers_by_joins(attrs, nodes)
    made = spark.createDataFrame(made.collect(), made.schema)
    want, members = _rows(made), _rows(containers.container_members_by_joins(attrs, nodes, made))
    assert _rows(containers.missing_containers(attrs, nodes)) == want and want
    assert _rows(containers.container_members(attrs, nodes, made)) == members and members
    for run in (lambda: containers.missing_containers(attrs, nodes), lambda: containers.container_members(attrs, nodes, made)):
        dealt = _exchanges(spark, monkeypatch, whole, run)
        assert [d for d in dealt if "graph_id" in d] and not [d for d in dealt if "attr_id" in d]
    monkeypatch.setattr(whole, "SMALL", 9)  # a and e are left to the joins
    assert _rows(containers.missing_containers(attrs, nodes)) == want
    assert _rows(containers.container_members(attrs, nodes, made)) == members


def test_batches_end_at_graphs():
    import pyarrow as pa

    ids = ["a"] * 3 + ["b"] * 9 + ["c"] + ["d"] * 4
    batches = [pa.RecordBatch.from_pydict({"graph_id": ids[i:i + 2], "n": list(range(i, min(i + 2, len(ids))))}) for i in range(0, len(ids), 2)]
    parts = list(whole.whole_graphs(iter(batches), 5))
    assert [n for t, _ in parts for n in t["n"].to_pylist()] == [0, 1, 2, 12, 13, 14, 15, 16] and [x for _, left in parts for x in left.to_pylist()] == ["b"]


LOC = "struct<file:string,line:bigint,col:bigint,frames:array<struct<file:string,line:bigint,function_name:string>>>"


def _scoped_graphs(spark):
    """Graphs by chance, three scopes each with nested containers, and odd ones."""
    import random

    r = random.Random(5)
    attrs, nodes, links, scoped = [], [], [], []

    def place(g, s, n, **more):
        func = r.choice(["forward"] * 9 + ["help_0", "help_1", None])
        frames = [] if func is None else [("a.py", n, "forward")] + [("b.py", n, func)] * (func != "forward")
        loc = None if r.random() < 0.1 else (r.choice(["a.py"] * 5 + [None]), r.choice([n, n, None]), 0, frames)
        row = {"g": g, "scope": s, "node": n, "ord": 2 * n % 31, "kind": r.choice(["functional"] * 6 + ["module", None]), "native": r.random() < 0.4, "loc": loc, "groupable": s != "z"}
        scoped.append(tuple({**row, **more}.values()))

    def box(g, b, up):
        attrs.append((g, b, up, b, b, "ModuleList", True))

    def node(g, n, up, attr=None):
        nodes.append((g, n, attr or f"m{n}"))
        attrs.append((g, attr or f"m{n}", up, str(n), "m", "Linear", False))

    for i in range(30):
        g = f"g{i}"
        boxes = [f"{s}{k}" for s in "xyz" for k in range(4)]
        for b in boxes:
            box(g, b, None if b[1] == "0" else r.choice([b[0] + "0", b[0] + str(int(b[1]) - 1), None]))
        for n in range(1, 22):
            s = r.choice("xyz")
            node(g, n, r.choice([None, None, None, r.choice("zx" if s == "x" else s) + r.choice("0123")]))  # z holds nodes of x
            place(g, s, n)
        if i % 5 == 0:  # a container that is a node itself, and listed
            nodes.append((g, 40, "x2"))
            place(g, "x", 40)
        ends = [r.sample(range(1, 24), 2) for _ in range(i % 20)]
        links.extend((g, *(sorted(e) if r.random() < 0.97 else e)) for e in ends)
    for g in ("circle", "twice", "two", "no end", "no ord", "no scope", "shared", "below", "loop", None):
        box(g, "p", None)
        box(g, "q", "p")
        for n, up in ((1, "q"), (2, "p"), (3, None), (4, None), (5, None)):
            node(g, n, up)
            place(g, "x", n, **({"ord": None} if g == "no ord" and n == 5 else {}), **({"scope": None} if g == "no scope" and n == 4 else {}), kind="functional" if n > 3 else "module", groupable=g != "twice")
        links.extend([(g, 3, 1), (g, 4, 3), (g, 2, 4)])
    box("circle", "p", "q")
    scoped.append(("twice", "y", 3, 7, "module", False, None, False))  # a node stands in one scope, else it has no rank
    attrs.append(("two", "m1", "p", "9", "m", "Linear", False))
    links.append(("no end", 4, None))
    nodes.append(("shared", 9, "q"))
    links.append(("below", 5, -4))
    links.extend([("loop", 4, 5), ("loop", 5, 4), ("loop", 3, 3)])
    return (spark.createDataFrame(attrs, "graph_id string, attr_id string, parent_attr_id string, key string, attr_name string, class_name string, is_container boolean"),
            spark.createDataFrame(nodes, "graph_id string, node_id bigint, attr_id string"), spark.createDataFrame(links, "graph_id string, src_id bigint, dst_id bigint"),
            spark.createDataFrame(scoped, f"graph_id string, scope_id string, node_id bigint, ord bigint, attr_kind string, is_native boolean, call_loc {LOC}, groupable boolean"))


def test_scopes_in_task_are_those_of_the_joins(spark, monkeypatch):
    tables = _scoped_graphs(spark)
    by = containers.NormalizedByJoins(*tables)
    parts = {"fates": lambda g: g.fates, "containers": lambda g: g.containers(), "lists": lambda g: g.direct.drop("place"),
             "helpers": lambda g: g.groups()[0], "runs": lambda g: g.groups()[1]}
    want = {name: _rows(part(by)) for name, part in parts.items()}
    assert all(len(rows) > 10 for rows in want.values()), {n: len(r) for n, r in want.items()}
    g = containers.NormalizedGraph(*tables)  # the odd ones go by joins
    for name, part in parts.items():
        assert _rows(part(g)) == want[name], name
    dealt = _exchanges(spark, monkeypatch, whole, lambda: containers.NormalizedGraph(*[t.filter("graph_id like 'g%'") for t in tables]).groups())
    assert [d for d in dealt if "graph_id" in d] and not [d for d in dealt if "node_id" in d or "scope_id" in d]  # by graph, once
    monkeypatch.setattr(whole, "SMALL", 90)  # some graphs are left to the joins
    g = containers.NormalizedGraph(*tables)
    for name in ("fates", "lists"):
        assert _rows(parts[name](g)) == want[name], name
