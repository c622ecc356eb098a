import random

import pytest

from stepweave.graph import closure, containers, edges, flatten, grouping

G = "g"


def members(spark, pairs):
    return spark.createDataFrame([(G, p, c, i) for i, (p, c) in enumerate(pairs)], "graph_id string, parent_id long, child_id long, ord long")


def links(spark, pairs):
    return spark.createDataFrame([(G, a, b) for a, b in pairs], "graph_id string, src_id long, dst_id long")


def test_deep_chain_closure(spark):
    got = {(r.node_id, r.ancestor_id, r.dist) for r in closure.ancestors(members(spark, [(i, i + 1) for i in range(11)])).collect()}
    assert got == {(j, i, j - i) for j in range(12) for i in range(j)}


def test_containment_cycle_ends_and_shows(spark):
    up = closure.ancestors(members(spark, [(1, 2), (2, 3), (3, 1), (3, 4)]))
    assert sorted(r.node_id for r in closure.cyclic_nodes(up).collect()) == [1, 2, 3]


def ranks(spark, pairs, n):
    nodes = spark.createDataFrame([(G, i, i) for i in range(n)], "graph_id string, node_id long, ord long")
    return {r.node_id: (r["rank"], r.in_cycle) for r in edges.longest_path_ranks(nodes, links(spark, pairs)).collect()}


def test_ranks_of_a_random_dag(spark):
    r = random.Random(1)
    pairs = [(a, b) for a in range(25) for b in range(a + 1, 25) if r.random() < 0.12]
    want = {}
    for n in range(25):
        want[n] = max((want[a] + 1 for a, b in pairs if b == n), default=0)
    assert ranks(spark, pairs, 25) == {n: (k, False) for n, k in want.items()}


def test_ranks_with_a_cycle(spark):
    assert ranks(spark, [(0, 1), (1, 2), (2, 1), (3, 4), (4, 3)], 5) == {0: (0, False), 1: (1, True), 2: (2, True), 3: (3, True), 4: (4, True)}


def test_ranks_behind_a_cycle(spark):
    got = ranks(spark, [(0, 1), (1, 2), (2, 1), (2, 3), (3, 4), (0, 4)], 5)
    assert got == {0: (0, False), 1: (1, True), 2: (2, True), 3: (3, True), 4: (4, True)}
    late = ranks(spark, [(4, 5), (5, 4), (5, 0), (0, 1)], 6)  # the list position of what is behind does not matter
    assert late[0][0] == late[5][0] + 1 and late[1][0] == late[0][0] + 1


def test_components_of_a_long_path(spark):
    pairs = [(i, i + 1) for i in range(20)] + [(30, 31)]
    nodes = spark.createDataFrame([(G, n) for n in {x for p in pairs for x in p} | {50}], "graph_id string, node_id long")
    got = {r.node_id: r.component for r in grouping.components(nodes, grouping.both_ways(links(spark, pairs))).collect()}
    assert got == {**{i: 0 for i in range(21)}, 30: 30, 31: 30, 50: 50}


def fates(spark, floating, pairs, inside):
    nodes = spark.createDataFrame([(G, n) for n in floating], "graph_id string, node_id long")
    up = spark.createDataFrame([(G, n, c, 1) for n, c in inside], "graph_id string, node_id long, ancestor_id long, dist long")
    return {r.node_id: (r.fate, r.container_id) for r in grouping.floating_components(nodes, links(spark, pairs), up).collect()}


def test_absorbing_floating_nodes(spark):
    inside = [(1, 100), (2, 100), (3, 200)]
    assert fates(spark, [10, 11], [(1, 10), (10, 11), (11, 2)], inside) == {10: ("absorbed", 100), 11: ("absorbed", 100)}
    assert fates(spark, [10, 11], [(1, 10), (10, 11), (11, 2), (11, 99)], inside) == {10: ("dropped", None), 11: ("dropped", None)}
    assert fates(spark, [10], [(1, 10), (10, 3)], inside) == {10: ("stays", None)}
    assert fates(spark, [10], [], inside) == {10: ("stays", None)}


def test_nested_containers_take_the_innermost(spark):
    inside = [(1, 100), (2, 100), (100, 300), (1, 300), (2, 300), (5, 300)]
    assert fates(spark, [10], [(1, 10), (10, 2)], inside) == {10: ("absorbed", 100)}


def scope(spark, rows):
    """rows: node, kind, native, list of function names."""
    frame = "struct<file:string,line:bigint,function_name:string>"
    data = [(G, "s", n, i, k, nat, ("a.py", n, 0, [("a.py", n, f) for f in funcs])) for i, (n, k, nat, funcs) in enumerate(rows)]
    return spark.createDataFrame(data, f"graph_id string, scope_id string, node_id long, ord long, attr_kind string, is_native boolean, call_loc struct<file:string,line:bigint,col:bigint,frames:array<{frame}>>")


def test_helper_groups(spark):
    s = scope(spark, [(1, "functional", True, ["forward", "norm"]), (2, "module", True, ["run", "forward", "norm", "deep"]), (3, "functional", True, ["forward"]),
                      (4, "functional", True, ["forward", "mix"]), (5, "module", False, ["forward", "mix"]),
                      (6, "functional", True, ["__call__", "forward", "norm"]), (7, "functional", True, ["forward", "__call__"])])
    got = [(r.group_name, r.n_members, r.first_id, r.line) for r in grouping.helper_groups(s).collect()]
    assert got == [("norm", 2, 1, 1)]


@pytest.mark.parametrize("rows", [2, 10_000])
def test_call_site_runs(spark, rows):
    f = lambda n, fn, kind="functional", nat=True: (n, kind, nat, ["forward", fn])
    s = scope(spark, [f(1, "a"), f(2, "a"), f(3, "b"), f(4, "a"), f(5, "x", "module", False), f(6, "c"), f(7, "c"), f(8, "c")])
    got = sorted((r.group_name, r.n_members) for r in grouping.call_site_runs(s, rows).collect())
    assert got == [("a:1~2", 2), ("c:6~8", 3)]


def test_run_that_is_the_whole_scope_is_no_group(spark):
    f = lambda n: (n, "functional", True, ["forward", "a"])
    assert grouping.call_site_runs(scope(spark, [f(1), f(2)])).count() == 0


def test_missing_containers(spark):
    attrs = spark.createDataFrame([
        (G, "root", None, None, "layers", "Sequential", True), (G, "in", "root", "0", "in", "ModuleList", True), (G, "dead", "root", "1", "dead", "ModuleList", True),
        (G, "have", None, None, "have", "ModuleDict", True), (G, "m1", "in", "0", "m1", "Linear", False), (G, "m2", "dead", "0", "m2", "Linear", False),
        (G, "m3", "have", "k", "m3", "Linear", False)],
        "graph_id string, attr_id string, parent_attr_id string, key string, attr_name string, class_name string, is_container boolean")
    nodes = spark.createDataFrame([(G, 1, "m1"), (G, 2, "have"), (G, 3, "m3")], "graph_id string, node_id long, attr_id string")
    made = containers.missing_containers(attrs, nodes)
    assert {r.attr_id: r.node_id for r in made.collect()} == {"in": 4, "root": 5}
    got = {(r.container_id, r.node_id, r.key) for r in containers.container_members(attrs, nodes, made).collect()}
    assert got == {(4, 1, "0"), (5, 4, "0"), (2, 3, "k")}
    again = nodes.unionByName(made.select("graph_id", "node_id", "attr_id"))
    assert containers.missing_containers(attrs, again).count() == 0


def test_lifting_never_makes_self_edges(spark):
    up = closure.ancestors(members(spark, [(100, 1), (100, 2), (200, 100), (200, 3), (300, 4)]))
    shut = spark.createDataFrame([(G, 100, True), (G, 200, True), (G, 300, False)], "graph_id string, node_id long, collapsed boolean")
    got = {(r.src_id, r.dst_id): r.n_edges for r in edges.lift_to_collapsed(links(spark, [(1, 2), (1, 3), (1, 4), (2, 4), (4, 3)]), up, shut).collect()}
    assert got == {(200, 4): 2, (4, 200): 1}


def test_focus_around_inputs(spark):
    up = closure.ancestors(members(spark, [(100, 1), (200, 2)]))
    one = lambda n: spark.createDataFrame([(G, n)], "graph_id string, node_id long")
    got = {r.node_id for r in edges.focus_sets(one(1), links(spark, [(9, 1), (1, 2)]), up, one(9)).collect()}
    assert got == {1, 2, 9, 100, 200}
    assert {r.node_id for r in edges.focus_sets(one(9), links(spark, [(9, 1), (1, 2)]), up, one(9)).collect()} == {9, 100}


def test_flattening_rules(spark):
    import json
    leaf = lambda i, **kw: {"node_id": i, "label": f"n{i}", "attr_name": f"a{i}", "class_name": "K", "attr_type": "module", **kw}
    empty = {"input_nodes": [], "param_nodes": [], "const_nodes": [], "output_nodes": [], "nodes": [], "edges": []}
    box = {**leaf(20), "children_nodes": [2, 77], "inner_dag": {**empty, "nodes": [leaf(2), leaf(3)]}}
    top = {**empty, "nodes": [{**leaf(10), "inner_dag": {**empty, "nodes": [leaf(1), box]}}, leaf(4, attr_type="odd")],
           "edges": [{"src_id": 1, "dst_id": 2}, {"src_id": 1, "dst_id": 2}, {"src_id": 1, "dst_id": 50}, {"src_id": 1, "dst_id": 60, "flows": {"0": {"dtype": "f"}}},
                     {"src_id": 10, "dst_id": 1, "is_containment": True}]}
    texts = spark.createDataFrame([(G, json.dumps(top)), ("h", '{"nodes": []}')], "graph_id string, text string")
    flat = flatten.FlatGraphs(texts)
    assert {(r.group_id, r.parent_id, r.node_type) for r in flat.groups().collect()} == {(10, None, "group"), (20, 10, "container_group")}
    assert {(r.node_id, r.parent_id, r.depth) for r in flat.leaves().collect()} == {(1, 10, 1), (2, 20, 2), (4, None, 0)}
    assert [(r.src_id, r.dst_id) for r in flat.edges()[0].collect()] == [(1, 2)]
    rules = {(r.graph_id, r.rule, r.node_id) for r in flat.violations().collect()}
    assert {(G, "edge end not in node index", 50), (G, "unsupported attr_type", 4), ("h", "missing field: edges", None), ("h", "no root groups", None)} <= rules
    assert not any(n == 60 for _, _, n in rules)


def test_components_across_batches(spark):
    r = random.Random(4)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100 + r.randrange(40), 100 + r.randrange(40)) for _ in range(30)] + [(300, 200), (300, 250), (260, 250)]
    nodes = sorted({x for p in pairs for x in p})
    want = {n: n for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(batch, "3")  # links of a graph fall into many batches
    try:
        frame = spark.createDataFrame([(G, n) for n in nodes], "graph_id string, node_id long")
        got = {x.node_id: x.component for x in grouping.components(frame, grouping.both_ways(links(spark, pairs))).collect()}
    finally:
        spark.conf.unset(batch)
    assert got == want


LOC = "struct<file:string,line:bigint,col:bigint,frames:array<struct<file:string,line:bigint,function_name:string>>>"


def normalized(spark, scopes, held, boxes, pairs):
    """scopes: {scope: nodes}; held: {node: container attribute}; boxes: {container attribute: its own}."""
    attrs = [(G, f"m{n}", held.get(n), str(n), "m", "Linear", False) for ns in scopes.values() for n in ns]
    attrs += [(G, b, up, b, b, "ModuleList", True) for b, up in boxes.items()]
    nodes = [(G, n, f"m{n}") for ns in scopes.values() for n in ns]
    scoped = [(G, s, n, i, "functional", True, None, True) for s, ns in scopes.items() for i, n in enumerate(ns)]
    return containers.NormalizedGraph(
        spark.createDataFrame(attrs, "graph_id string, attr_id string, parent_attr_id string, key string, attr_name string, class_name string, is_container boolean"),
        spark.createDataFrame(nodes, "graph_id string, node_id long, attr_id string"), links(spark, pairs),
        spark.createDataFrame(scoped, f"graph_id string, scope_id string, node_id long, ord long, attr_kind string, is_native boolean, call_loc {LOC}, groupable boolean"))


def test_nodes_of_another_scope_stay(spark):
    g = normalized(spark, {"top": [1, 2, 3], "other": [9, 4]}, {1: "c", 2: "c", 4: "d"}, {"c": None, "d": None}, [(9, 1), (3, 2), (4, 3)])
    made = {r.attr_id: r.node_id for r in g.made.collect()}
    assert {r.node_id: (r.scope_id, r.fate) for r in g.fates.collect()} == {9: ("other", "dropped"), 3: ("top", "dropped")}
    lists = {}
    for r in g.direct.orderBy("ord").collect():
        lists.setdefault(r.scope_id, []).append(r.node_id)
    assert lists == {"top": [3, made["c"]], "other": [9, made["d"]]}
    alone = normalized(spark, {"top": [1, 2, 3], "other": [9, 4]}, {1: "c", 2: "c", 4: "d"}, {"c": None, "d": None}, [(9, 4), (3, 2)])
    assert {(r.container_id, r.node_id) for r in alone.containers().collect()} == {(made["c"], n) for n in (1, 2, 3)} | {(made["d"], n) for n in (4, 9)}


def test_members_of_a_container_move_into_the_ones_inside(spark):
    # root holds box and node 5; box holds inner; 5 touches box's node 2 only, 6 floats between 5 and nothing else
    g = normalized(spark, {"top": [1, 2, 5, 6]}, {1: "inner", 2: "box", 5: "root"}, {"inner": "box", "box": "root", "root": None}, [(5, 2), (6, 5), (2, 1)])
    made = {r.attr_id: r.node_id for r in g.made.collect()}
    fates = {(r.scope_id, r.node_id): (r.fate, r.container_id) for r in g.fates.collect()}
    assert fates[("top", 6)] == ("absorbed", made["root"])
    assert fates[(f"container:{made['root']}", 5)] == fates[(f"container:{made['root']}", 6)] == ("absorbed", made["box"])
    # in the box, 5, 6 and 2 touch nothing outside of it but its inner container
    assert {(r.container_id, r.node_id) for r in g.containers().collect()} == {
        (made["inner"], 1), (made["inner"], 2), (made["inner"], 5), (made["inner"], 6), (made["box"], made["inner"]), (made["root"], made["box"])}


def test_a_container_with_a_node_of_its_own(spark):
    g = normalized(spark, {"top": [1, 2, 7]}, {1: "m7"}, {}, [(2, 1)])
    assert g.containers().count() == 0  # m7 is no container
    attrs = [(G, "m1", "m7", "0", "m", "Linear", False), (G, "m2", None, None, "m", "Linear", False), (G, "m7", None, None, "m", "Sequential", True)]
    h = containers.NormalizedGraph(
        spark.createDataFrame(attrs, "graph_id string, attr_id string, parent_attr_id string, key string, attr_name string, class_name string, is_container boolean"),
        spark.createDataFrame([(G, n, f"m{n}") for n in (1, 2, 7)], "graph_id string, node_id long, attr_id string"), links(spark, [(2, 1)]),
        spark.createDataFrame([(G, "top", n, n, "functional", True, None, True) for n in (1, 2, 7)],
                              f"graph_id string, scope_id string, node_id long, ord long, attr_kind string, is_native boolean, call_loc {LOC}, groupable boolean"))
    assert sorted((r.container_id, r.node_id) for r in h.containers().collect()) == [(7, 1), (7, 2)]
    assert [r.node_id for r in h.direct.collect()] == [7]


def test_ranks_of_a_deep_chain_and_of_many_graphs(spark, monkeypatch):
    n = 100_000
    nodes = spark.range(n).selectExpr("'deep' as graph_id", "id as node_id", "id as ord").unionByName(
        spark.range(3000).selectExpr("concat('g', id div 3) as graph_id", "id % 3 as node_id", "id % 3 as ord"))
    pairs = spark.range(n - 1).selectExpr("'deep' as graph_id", "id as src_id", "id + 1 as dst_id").unionByName(
        spark.range(3000).filter("id % 3 < 2").selectExpr("concat('g', id div 3) as graph_id", "id % 3 as src_id", "id % 3 + 1 as dst_id"))
    loop = spark.createDataFrame([("g7", 2, 0)], "graph_id string, src_id long, dst_id long")
    got = edges.longest_path_ranks(nodes, pairs.unionByName(loop))
    assert got.filter("graph_id <> 'g7' and (rank <> node_id or in_cycle)").isEmpty() and got.count() == n + 3000
    assert got.filter("graph_id = 'g7'").filter("in_cycle").count() == 3


def test_large_graphs_rank_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(edges, "GRAPH_ROWS", 10)
    test_ranks_of_a_random_dag(spark)
    test_ranks_behind_a_cycle(spark)


def test_packed_tables_count_by_their_rows(spark):
    from pyspark.sql import functions as F

    from stepweave.session import materialize

    nodes = spark.range(200_000).select((F.col("id") % 3).cast("string").alias("graph_id"), F.lit(7).cast("bigint").alias("node_id"))
    links = spark.createDataFrame([("0", 7, 8)], "graph_id string, node_id long, peer_id long")
    grouping.components(nodes.limit(1), links)  # as any graph operator does at its start
    table = materialize(nodes.coalesce(1))
    known = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert known > 100_000  # 4,365 bytes on disk


def test_flattening_keeps_no_text_beside_its_parse_and_reads_levels_once(spark):
    import json

    from pyspark.sql import functions as F

    empty = {"input_nodes": [], "param_nodes": [], "const_nodes": [], "output_nodes": [], "nodes": [], "edges": []}
    texts = spark.createDataFrame([(G, json.dumps({**empty, "param_nodes": [{"node_id": 1}, {"node_id": 2}], "output_nodes": [{"node_id": 3, "io_subtype": "odd"}]}))], "graph_id string, text string")
    flat = flatten.FlatGraphs(texts)
    assert "text" not in spark.read.parquet(*flat.levels.inputFiles()).columns  # nor on disk
    rows = {(r.section, r.ord & 0xFFFFFFFF, r.node_id, r.io_subtype, r.ord >> 32) for r in flat.io_entries.collect()}
    assert rows == {("param_nodes", 0, 1, "param", 1), ("param_nodes", 1, 2, "param", 1), ("output_nodes", 0, 3, "odd", 3)}
    scans = flat.io_entries.select(F.count(F.lit(1)))._jdf.queryExecution().optimizedPlan().toString().count("Generate posexplode")
    assert scans <= 2  # one level here and the empty start, not four lists of each


def test_routed_edges_meet_flags_only(spark):
    import json
    empty = {"input_nodes": [], "param_nodes": [], "const_nodes": [], "output_nodes": [], "nodes": [], "edges": []}
    leaf = lambda i: {"node_id": i, "attr_name": f"a{i}", "class_name": "K"}
    top = {**empty, "nodes": [leaf(1), leaf(1), leaf(2)], "edges": [{"src_id": 1, "dst_id": 2}, {"src_id": 1, "dst_id": 2}, {"src_id": 1, "dst_id": 9}]}
    flat = flatten.FlatGraphs(spark.createDataFrame([(G, json.dumps(top))], "graph_id string, text string"))
    first, violations = flat.routed()
    assert [(r.src_id, r.dst_id, r.edge_ord.pos) for r in first.collect()] == [(1, 2, 0)]
    assert [r.node_id for r in violations.collect()] == [9]  # once, though node 1 is there twice
    (whole,) = flat.edges()[0].collect()
    assert (whole.src_node.attr_name, whole.dst_node.attr_name) == ("a1", "a2")


def test_graph_views_take_one_shuffle(spark):
    from workload.graph_queries import Graphs
    from workload.views import spark_view

    sf = "/root/testdata/sf0.001"
    g = Graphs(spark, sf)
    for mine, name in ((g.node, "graph_node"), (g.edge, "graph_edge")):
        view = spark_view(spark, sf, name)
        assert mine.columns == view.columns and mine.exceptAll(view).isEmpty() and view.exceptAll(mine).isEmpty()
    assert g.texts()._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
