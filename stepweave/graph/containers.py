"""Native containers: which exist, which must be made up, and who belongs to them.

``attrs``: graph_id, attr_id, parent_attr_id, key, attr_name, class_name, is_container.
``nodes``: graph_id, node_id, attr_id.
"""

from __future__ import annotations

from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.graph import scopes, whole
from stepweave.graph.closure import ancestors
from stepweave.operators.chunks import chunked, running
from stepweave.session import materialize, size_by_rows

# Module classes that only hold other modules.
NATIVE_CONTAINERS = ("ModuleList", "ModuleDict", "Sequential")


def attr_index(nodes: DataFrame) -> DataFrame:
    """Nodes per attribute; ``is_shared`` where one was expected."""
    return nodes.groupBy("graph_id", "attr_id").agg(
        F.min("node_id").alias("node_id"), F.count(F.lit(1)).alias("n_nodes")).withColumn(
        "is_shared", F.col("n_nodes") > 1)


def shared_attr_violations(nodes: DataFrame, attrs: DataFrame) -> DataFrame:
    held = attrs.filter("parent_attr_id is not null").select("graph_id", "attr_id")
    return attr_index(nodes).filter("is_shared").join(held, ["graph_id", "attr_id"], "left_semi").select(
        "graph_id", F.lit("container child has several nodes").alias("rule"), "node_id")


def attr_closure(attrs: DataFrame) -> DataFrame:
    return ancestors(attrs.filter("parent_attr_id is not null").select(
        "graph_id", F.col("parent_attr_id").alias("parent_id"), F.col("attr_id").alias("child_id")))


def _made(table: pa.Table) -> dict:
    ids = whole.Ids(table, "attr_id", "parent_attr_id")
    attr, parent, is_node = ids.of["attr_id"], ids.of["parent_attr_id"], pc.equal(table["_table"], "nodes").to_numpy()
    held = ~is_node & ids.known(parent)
    node, above, _ = ids.closed(attr[held], parent[held])
    numbered, boxes = is_node & table["node_id"].is_valid().to_numpy(), pc.fill_null(table["is_container"], False).to_numpy()
    at, depth, new, known = scopes.made_at(ids, attr, parent, is_node, numbered, pc.fill_null(table["node_id"], 0).to_numpy(), boxes, (node, above))
    take = lambda c: table[c].take(pa.array(at)).combine_chunks()
    return {"graph_id": take("graph_id"), "node_id": pa.array(new, mask=~known), "attr_id": take("attr_id"),
            "attr_name": take("attr_name"), "container_kind": take("class_name"), "path_depth": pa.array(depth.astype(np.int64) + 1)}


def _members(table: pa.Table) -> dict:
    ids = whole.Ids(table, "attr_id", "parent_attr_id")
    attr, parent, is_attr = ids.of["attr_id"], ids.of["parent_attr_id"], pc.equal(table["_table"], "attrs").to_numpy()
    held, every = np.flatnonzero(is_attr & ids.known(parent)), np.flatnonzero(~is_attr)
    boxes = attr[pc.fill_null(table["is_container"], False).to_numpy()]
    owner = every[np.isin(attr[every], boxes)]
    h, e = ids.matches(attr[held], attr[every])
    held, every = held[h], every[e]
    h, o = ids.matches(parent[held], attr[owner])
    take = lambda c, at: table[c].take(pa.array(at)).combine_chunks()
    return {"graph_id": take("graph_id", held[h]), "container_id": take("node_id", owner[o]), "node_id": take("node_id", every[h]), "key": take("key", held[h])}


def missing_containers(attrs: DataFrame, nodes: DataFrame, closure: DataFrame | None = None) -> DataFrame:
    """Containers without a node that still hold something, with the node ids they get.

    A container is alive when anything below it has a node.  New ids follow the largest id of
    the graph, deeper containers first.  Small graphs are done in the task they are dealt to, the others by joins
    (see :func:`missing_containers_by_joins`).
    """
    kinds = dict(attrs.dtypes)
    own = lambda c: F.when(F.col("is_container"), F.col(c)).alias(c)
    rows = attrs.filter("is_container or parent_attr_id is not null").select("graph_id", "attr_id", "parent_attr_id", "is_container", own("attr_name"), own("class_name"))
    done, left = whole.in_tasks(
        {"attrs": rows, "nodes": nodes.select("graph_id", "attr_id", F.col("node_id").cast("bigint").alias("node_id"))}, _made,
        f"graph_id {kinds['graph_id']}, node_id bigint, attr_id {kinds['attr_id']}, attr_name {kinds['attr_name']}, container_kind {kinds['class_name']}, path_depth bigint")
    if left.isEmpty():
        return done
    part = lambda t: t.join(left, "graph_id", "left_semi")
    return done.unionByName(materialize(missing_containers_by_joins(part(attrs), part(nodes), None if closure is None else part(closure))))


def missing_containers_by_joins(attrs: DataFrame, nodes: DataFrame, closure: DataFrame | None = None) -> DataFrame:
    """As :func:`missing_containers`, for graphs of any size."""
    closure = attr_closure(attrs) if closure is None else closure
    with_node = nodes.select("graph_id", "attr_id").distinct()
    empty = attrs.filter("is_container").join(with_node, ["graph_id", "attr_id"], "left_anti")
    alive = closure.join(with_node.withColumnRenamed("attr_id", "node_id"), ["graph_id", "node_id"], "left_semi").select(
        "graph_id", F.col("ancestor_id").alias("attr_id")).distinct()
    depth = closure.groupBy("graph_id", F.col("node_id").alias("attr_id")).agg(F.count(F.lit(1)).alias("_depth"))
    top_id = nodes.groupBy("graph_id").agg(F.max("node_id").alias("_top"))
    rows = (
        empty.join(alive, ["graph_id", "attr_id"], "left_semi").join(depth, ["graph_id", "attr_id"], "left")
        .withColumn("_depth", F.coalesce("_depth", F.lit(0))).join(top_id, "graph_id")
        .withColumns({"_minus_depth": -F.col("_depth"), "_one": F.lit(1)})
    )
    numbered = running(chunked(rows, ["graph_id"], "_minus_depth"), ["_minus_depth", "attr_id"], {"_place": "_one"}, "sum").frame
    return (
        numbered.select("graph_id", (F.col("_top") + F.col("_place")).alias("node_id"), "attr_id", "attr_name",
                F.col("class_name").alias("container_kind"), (F.col("_depth") + 1).alias("path_depth"))
    )


def container_members(attrs: DataFrame, nodes: DataFrame, made: DataFrame) -> DataFrame:
    """``(graph_id, container_id, node_id, key)``: direct members of each live container.

    Small graphs are done in the task they are dealt to, the others by joins (see :func:`container_members_by_joins`).
    """
    kinds = dict(attrs.dtypes)
    rows = attrs.filter("is_container or parent_attr_id is not null").select("graph_id", "attr_id", "parent_attr_id", "key", "is_container")
    every = lambda t: t.select("graph_id", "attr_id", F.col("node_id").cast("bigint").alias("node_id"))
    done, left = whole.in_tasks({"attrs": rows, "nodes": every(nodes), "made": every(made)}, _members,
                                f"graph_id {kinds['graph_id']}, container_id bigint, node_id bigint, key {kinds['key']}")
    if left.isEmpty():
        return done
    return done.unionByName(container_members_by_joins(*[t.join(left, "graph_id", "left_semi") for t in (attrs, nodes, made)]))


def container_members_by_joins(attrs: DataFrame, nodes: DataFrame, made: DataFrame) -> DataFrame:
    """As :func:`container_members`, for graphs of any size."""
    every = nodes.select("graph_id", "attr_id", "node_id").unionByName(made.select("graph_id", "attr_id", "node_id"))
    held = attrs.filter("parent_attr_id is not null").select("graph_id", "attr_id", "parent_attr_id", "key")
    owner = every.join(attrs.filter("is_container").select("graph_id", "attr_id"), ["graph_id", "attr_id"], "left_semi").select(
        "graph_id", F.col("attr_id").alias("parent_attr_id"), F.col("node_id").alias("container_id"))
    return held.join(every, ["graph_id", "attr_id"]).join(owner, ["graph_id", "parent_attr_id"]).select(
        "graph_id", "container_id", "node_id", "key")


def unsupported_containers(attrs: DataFrame) -> DataFrame:
    return attrs.filter(F.col("is_container") & ~F.col("class_name").isin(*NATIVE_CONTAINERS)).select(
        "graph_id", F.lit("unsupported container class").alias("rule"), "attr_id")


class NormalizedGraph:
    """All scopes of all graphs after container membership, absorption and grouping.

    ``scoped`` lists the nodes of each scope (``graph_id, scope_id, node_id``) with ``ord`` and grouping columns, plus
    ``groupable``: false inside native modules.  A node stands in one scope.

    Small graphs are normalized in the task that they are dealt to (see ``scopes.Scopes``), one result at a time when it is first asked for. Large
    ones, and those that lack an id, list something twice or contain each other in a circle, go by joins (see :class:`NormalizedByJoins`).
    """

    _IDS = ["graph_id", "node_id", "attr_id", "parent_attr_id", "scope_id", "ord", "to_id"]
    _MORE = ["to_id_2", "box_ids", "box_parent_ids"]  # if there are such columns

    def __init__(self, attrs: DataFrame, nodes: DataFrame, edges: DataFrame, scoped: DataFrame):
        size_by_rows(attrs)
        self.tables = {"attrs": attrs, "nodes": nodes, "edges": edges, "scoped": scoped}
        is_ = lambda bit: F.lit(bit).alias("_is")
        parts = [attrs.filter("is_container or parent_attr_id is not null").select("graph_id", "attr_id", "parent_attr_id", "is_container", is_(scopes.ATTR)),
                 nodes.select("graph_id", "node_id", "attr_id", is_(scopes.NODE)), scoped.withColumn("_is", F.lit(scopes.PLACE)),
                 edges.select("graph_id", F.col("src_id").alias("node_id"), F.col("dst_id").alias("to_id"), is_(scopes.EDGE))]
        self._grouped, self._rest = {}, None
        self._rows, self._dealt, self._large = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), False, None
        whole_numbers = [t[c] for t, c in ((dict(nodes.dtypes), "node_id"), (dict(scoped.dtypes), "node_id"), (dict(scoped.dtypes), "ord"), (dict(edges.dtypes), "src_id"), (dict(edges.dtypes), "dst_id"))]
        if {*whole_numbers} != {"bigint"} or dict(scoped.dtypes)["scope_id"] != "string" or len({dict(attrs.dtypes)[c] for c in ("attr_id", "parent_attr_id")}) > 1:
            self._large = self._rows.select("graph_id").distinct()  # ids of other kinds: all by joins
            self._rows = self._rows.limit(0)

    @classmethod
    def of_dealt(cls, rows: DataFrame) -> NormalizedGraph:
        """Of rows that lie by graph already, each an attribute, a node, a place and an edge or two at once, as ``_is`` says (see ``scopes``).

        Rows may list containers, which are attributes too. A graph's rows pass one task, which keeps up to ``whole.SMALL`` of them.
        """
        g = cls.__new__(cls)
        size_by_rows(rows)
        of = lambda bit: rows.filter(F.col("_is").bitwiseAND(bit) > 0)
        none = [F.lit(None).cast("string").alias(c) for c in ("key", "attr_name", "class_name")]
        attrs = of(scopes.ATTR).select("graph_id", "attr_id", "parent_attr_id", "is_container", *none)
        if "box_ids" in rows.columns:
            attrs = attrs.unionByName(rows.select("graph_id", F.inline(F.arrays_zip("box_ids", "box_parent_ids")).alias("attr_id", "parent_attr_id")).withColumn(
                "is_container", F.lit(True)).select("graph_id", "attr_id", "parent_attr_id", "is_container", *none))
        ends = F.array_compact(F.array(*[c for c in rows.columns if c in ("to_id", "to_id_2")]))
        g.tables = {"attrs": attrs, "nodes": of(scopes.NODE).select("graph_id", "node_id", "attr_id"),
                    "edges": of(scopes.EDGE).select("graph_id", F.col("node_id").alias("src_id"), F.explode(ends).alias("dst_id")),
                    "scoped": of(scopes.PLACE).drop("attr_id", "parent_attr_id", "is_container", "to_id", "_is", *cls._MORE)}
        g._grouped, g._rest = {}, None
        g._rows, g._dealt, g._large = rows, True, None
        return g

    def _solved(self, result, schema: str, columns: list, facts: tuple = (), rows: DataFrame | None = None) -> tuple[DataFrame, NormalizedByJoins | None]:
        """What ``result`` makes of the small graphs, and all results of the others; ``facts`` are bits with their conditions."""
        rows, large = (self._rows if rows is None else rows), self._large
        facts = (("is_container", scopes.BOX), ("groupable", scopes.GROUPABLE), ("groupable is null", scopes.UNCLEAR), *facts)
        bits = reduce(Column.bitwiseOR, [F.when(F.expr(c) if isinstance(c, str) else c, bit).otherwise(0) for c, bit in facts], F.col("_is"))
        rows = rows.select(*self._IDS, *[c for c in rows.columns if c in self._MORE], *columns, bits.alias("_is"))
        if not self._dealt:
            rows, more = whole.uncrowded(rows)
            rows, large = rows.repartition("graph_id"), more if large is None else more.unionByName(large)
        kind = dict(rows.dtypes)["graph_id"]
        done, left = whole.solved(rows, scopes.runner(result, whole.SMALL), f"graph_id {kind}, {schema}", large)
        if left.isEmpty():
            return done, None
        if self._rest is None or not (left.subtract(self._rest[0]).isEmpty() and self._rest[0].subtract(left).isEmpty()):
            graph = left.withColumnRenamed("graph_id", "_graph")
            part = lambda t: t.join(graph, F.col("graph_id").eqNullSafe(F.col("_graph")), "left_semi")
            self._rest = left, NormalizedByJoins(*[materialize(part(self.tables[t])) for t in ("attrs", "nodes", "edges", "scoped")])
        return done, self._rest[1]

    @cached_property
    def made(self) -> DataFrame:
        """Containers without a node that hold something, with the node ids they get."""
        return materialize(missing_containers(self.tables["attrs"], self.tables["nodes"]))

    @cached_property
    def fates(self) -> DataFrame:
        """Floating nodes of every scope, containers included, and what becomes of them (see ``grouping.scope_fates``)."""
        done, rest = self._solved(scopes.Scopes.fates, "scope_id string, node_id bigint, component bigint, fate string, container_id bigint", [])
        return done if rest is None else done.unionByName(rest.fates)

    @cached_property
    def direct(self) -> DataFrame:
        """Lists of the scopes: the columns of ``scoped``, and ``place``, the position in the list."""
        kinds = dict(self.tables["scoped"].dtypes)
        more = [c for c in kinds if c not in (*self._IDS, "groupable", "attr_kind", "is_native")]
        listed = ["scope_id", "node_id", "ord", "groupable", "place", "attr_kind", "is_native", *more]
        schema = ", ".join(f"`{c}` {kinds.get(c, 'bigint')}" for c in listed)
        done, rest = self._solved(lambda s: s.lists(more), schema, ["attr_kind", "is_native", *more])
        done = done.select(*kinds, "place")
        return done if rest is None else done.unionByName(rest.direct)

    def containers(self) -> DataFrame:
        """Final members of every container; sort them by id."""
        done, rest = self._content
        return done if rest is None else done.unionByName(rest.containers())

    @cached_property
    def _content(self) -> tuple[DataFrame, NormalizedByJoins | None]:
        return self._solved(scopes.Scopes.content, "container_id bigint, node_id bigint", [])

    def _groups(self, located: bool) -> tuple[DataFrame, NormalizedByJoins | None]:
        from stepweave.graph import grouping

        if located not in self._grouped:
            at, frames, plain = F.col("call_loc"), F.col("call_loc")["frames"], grouping.is_plain()
            rows = self._rows.withColumn("_h", grouping.helper_frame(frames)).withColumn("_last", F.get(frames, F.size(frames) - 1))
            columns = [F.col("_h.function_name").alias("_helper"), at["file"].alias("_site_file"), F.col("_last.function_name").alias("_site_func"), at["line"].alias("_line"),
                       *([F.col("_h.file").alias("_helper_file"), F.col("_h.line").alias("_helper_line")] if located else [])]
            schema = "scope_id string, is_run boolean, name string, n_members bigint, first_id bigint, ord bigint, last_ord bigint, low bigint, high bigint"
            self._grouped[located] = self._solved(lambda s: s.groups(located), schema + ", file string, line bigint" * located, columns, (
                (plain, scopes.PLAIN), (~plain, scopes.OTHER), (plain & (F.size(frames) > 0), scopes.USABLE)), rows)
        return self._grouped[located]

    def groups(self, located: bool = True) -> tuple[DataFrame, DataFrame]:
        """(helper groups, call-site runs) of the scopes that may be grouped; helpers with file and line if ``located``.

        Runs are looked for in what the helper groups leave over, in scope order: by data-flow level where plain and
        other nodes mix, else as listed.
        """
        done, rest = self._groups(located)
        site = ["file", "line"] if located else []
        helpers = done.filter("not is_run").select("graph_id", "scope_id", F.col("name").alias("group_name"), "n_members", "first_id", *site, "ord")
        runs = done.filter("is_run").select("graph_id", "scope_id", F.format_string("%s:%d~%d", "name", "low", "high").alias("group_name"), "first_id", "ord", "last_ord", "n_members")
        return (helpers, runs) if rest is None else tuple(a.unionByName(b.select(*a.columns)) for a, b in zip((helpers, runs), rest.groups()))


class NormalizedByJoins:
    """As :class:`NormalizedGraph`, for graphs of any size and kind.

    A container belongs to the scope of the nodes below it and joins its list, behind the nodes; its members leave
    the list.  Floating nodes are absorbed scope by scope: a node of another scope, or in no container of this scope, keeps
    its neighbours where they are.  Then each container is a scope of its own, outer ones first: what it holds besides
    containers may move on into those.  A round per level of nesting serves all scopes of all graphs.
    """

    def __init__(self, attrs: DataFrame, nodes: DataFrame, edges: DataFrame, scoped: DataFrame):
        from stepweave.graph import grouping

        self.edges, scope = edges, ["graph_id", "scope_id"]
        size_by_rows(attrs)
        closure = attr_closure(attrs)
        self.made = materialize(missing_containers(attrs, nodes, closure))
        self.members = materialize(container_members(attrs, nodes, self.made))
        boxes = attrs.filter("is_container").select("graph_id", "attr_id")
        box = nodes.select("graph_id", "attr_id", "node_id").unionByName(self.made.select("graph_id", "attr_id", "node_id")).join(boxes, ["graph_id", "attr_id"], "left_semi")
        box = materialize(box)
        ids = lambda attr, node: box.select("graph_id", F.col("attr_id").alias(attr), F.col("node_id").alias(node))
        # containers around containers, as nodes
        around = materialize(closure.select("graph_id", F.col("node_id").alias("_in"), F.col("ancestor_id").alias("_out"), "dist").join(ids("_in", "inner_id"), ["graph_id", "_in"])
                             .join(ids("_out", "outer_id"), ["graph_id", "_out"]).select("graph_id", "inner_id", "outer_id", "dist"))
        direct = self.members.select("graph_id", "node_id", "container_id")

        # the containers of a scope: those around its nodes, those around these, and those it lists anyway
        near = scoped.select(*scope, "node_id", "ord").join(direct, ["graph_id", "node_id"]).groupBy(*scope, F.col("container_id").alias("inner_id")).agg(F.min("ord").alias("_first"))
        far = near.join(around, ["graph_id", "inner_id"]).groupBy(*scope, F.col("outer_id").alias("node_id")).agg(F.min(F.struct("_first", "dist")).alias("_place"))
        near = near.select(*scope, F.col("inner_id").alias("node_id"), F.struct("_first", F.lit(0).cast("bigint").alias("dist")).alias("_place"))
        joined = near.unionByName(far).groupBy(*scope, "node_id").agg(F.min("_place").alias("_place")).join(scoped.select(*scope, "node_id"), [*scope, "node_id"], "left_anti")
        listed = scoped.join(box.select("graph_id", "node_id"), ["graph_id", "node_id"], "left_semi").select(*scope, "node_id")
        held = materialize(joined.select(*scope, "node_id").unionByName(listed))  # containers per scope
        inside = held.withColumnRenamed("node_id", "container_id")
        homes = direct.join(inside, ["graph_id", "container_id"]).select(*scope, "node_id", "container_id")
        free = materialize(scoped.join(homes, [*scope, "node_id"], "left_anti").join(listed, [*scope, "node_id"], "left_anti"))

        fates = materialize(grouping.scope_fates(free, edges, homes))
        moved = fates.filter("fate = 'absorbed'")
        direct_ = self._lists(scoped, free.join(moved, [*scope, "node_id"], "left_anti"), joined, listed, homes).withColumn("_one", F.lit(1))
        self.direct = materialize(running(chunked(direct_, scope, "ord"), ["ord"], {"place": "_one"}, "sum").frame.select(*scoped.columns, "place"))
        content = materialize(direct.unionByName(moved.select("graph_id", "node_id", "container_id")).distinct())
        parts = [fates]
        depth = around.groupBy("graph_id", F.col("inner_id").alias("container_id")).agg(F.max("dist").alias("depth"))
        outer = around.select("graph_id", F.col("outer_id").alias("container_id")).distinct()  # those that hold containers
        level = materialize(outer.join(depth, ["graph_id", "container_id"], "left").withColumn("depth", F.coalesce("depth", F.lit(0).cast("bigint"))))
        for d in [r["depth"] for r in level.select("depth").distinct().orderBy("depth").collect()]:  # one row per level of nesting
            now = level.filter(F.col("depth") == d).select("graph_id", "container_id")
            name = F.concat(F.lit("container:"), F.col("container_id").cast("string")).alias("scope_id")
            loose = content.join(now, ["graph_id", "container_id"], "left_semi").join(box.select("graph_id", "node_id"), ["graph_id", "node_id"], "left_anti")
            below = now.withColumnRenamed("container_id", "outer_id").join(around, ["graph_id", "outer_id"])
            home = content.join(below.withColumnRenamed("inner_id", "container_id"), ["graph_id", "container_id"]).select(
                "graph_id", F.concat(F.lit("container:"), F.col("outer_id").cast("string")).alias("scope_id"), "node_id", "container_id")
            fates = materialize(grouping.scope_fates(loose.select("graph_id", name, "node_id"), edges, home))
            parts.append(fates)
            moved = fates.filter("fate = 'absorbed'").select("graph_id", "node_id", F.col("container_id").alias("_to"))
            content = materialize(content.join(moved, ["graph_id", "node_id"], "left").select("graph_id", "node_id", F.coalesce("_to", "container_id").alias("container_id")))
        self.fates = reduce(DataFrame.unionByName, parts)
        self.content = content

    @staticmethod
    def _lists(scoped: DataFrame, free: DataFrame, joined: DataFrame, listed: DataFrame, homes: DataFrame) -> DataFrame:
        """Direct nodes of each scope: what is in no container, and the outermost containers behind it."""
        scope = ["graph_id", "scope_id"]
        last = scoped.groupBy(*scope).agg(F.max("ord").alias("_last"), F.bool_and("groupable").alias("groupable"))
        outermost = joined.join(homes.select(*scope, "node_id"), [*scope, "node_id"], "left_anti").join(last, scope)
        numbered = running(chunked(outermost.withColumns({"_f": F.col("_place._first"), "_d": F.col("_place.dist"), "_one": F.lit(1)}), scope, "_f"), ["_f", "_d", "node_id"], {"_n": "_one"}, "sum").frame
        added = numbered.select(*scope, "node_id", (F.col("_last") + F.col("_n")).alias("ord"), F.lit("container").alias("attr_kind"), F.lit(True).alias("is_native"), "groupable")
        kept = scoped.join(listed, [*scope, "node_id"], "left_semi").join(homes.select(*scope, "node_id"), [*scope, "node_id"], "left_anti")
        return free.unionByName(kept).unionByName(added, allowMissingColumns=True)

    def containers(self) -> DataFrame:
        """Final members of every container; sort them by id."""
        return self.content.select("graph_id", "container_id", "node_id")

    def groups(self) -> tuple[DataFrame, DataFrame]:
        """(helper groups, call-site runs) of the scopes that may be grouped.

        Runs are looked for in what the helper groups leave over, in scope order: by data-flow level where plain and
        other nodes mix, else as listed.
        """
        from stepweave.graph import grouping

        open_scopes = self.direct.filter("groupable")
        helpers = materialize(grouping.helper_groups(open_scopes))
        name = grouping.helper_frame(F.col("call_loc")["frames"])["function_name"]
        rest = open_scopes.withColumn("group_name", name).join(
            helpers.select("graph_id", "scope_id", "group_name"), ["graph_id", "scope_id", "group_name"], "left_anti")
        places = materialize(rest.drop("group_name").unionByName(
            helpers.select("graph_id", "scope_id", (-F.col("first_id") - 1).alias("node_id"), "ord",  # a new node, without edges
                           F.lit("module").alias("attr_kind"), F.lit(False).alias("is_native")), allowMissingColumns=True))
        ordered = grouping.scope_order(places, self.edges).withColumns({"_list": F.col("ord"), "_one": F.lit(1)}).drop("ord")
        placed = running(chunked(ordered, ["graph_id", "scope_id"], "level"), ["level", "_list"], {"ord": "_one"}, "sum").frame
        return helpers, grouping.call_site_runs(placed)
