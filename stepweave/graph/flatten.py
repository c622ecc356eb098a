"""Serialized graphs (nested JSON) to flat tables, level by level, and their integrity checks."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepweave.graph.closure import ancestors, cyclic_nodes
from stepweave.graph.edges import route_edges, with_endpoints
from stepweave.schema import CALL_LOC
from stepweave.session import materialize, size_by_rows

_flow = T.StructType([
    T.StructField("shape", T.ArrayType(T.IntegerType())),
    T.StructField("dtype", T.StringType()),
    T.StructField("steps", T.ArrayType(T.StructType([
        T.StructField("loc", CALL_LOC), T.StructField("var", T.StringType())]))),
])

_io = T.ArrayType(T.StructType([
    T.StructField("node_id", T.LongType()), T.StructField("io_subtype", T.StringType()), T.StructField("label", T.StringType()),
    T.StructField("attr_name", T.StringType()), T.StructField("class_name", T.StringType()), T.StructField("call_loc", CALL_LOC),
]))

# One level.  ``inner_dag`` stays text and is parsed as the next level.
LEVEL = T.StructType([
    T.StructField("input_nodes", _io), T.StructField("param_nodes", _io),
    T.StructField("const_nodes", _io), T.StructField("output_nodes", _io),
    T.StructField("nodes", T.ArrayType(T.StructType([
        T.StructField("node_id", T.LongType()), T.StructField("label", T.StringType()), T.StructField("attr_name", T.StringType()),
        T.StructField("class_name", T.StringType()), T.StructField("attr_type", T.StringType()),
        T.StructField("call_loc", CALL_LOC), T.StructField("def_loc", CALL_LOC), T.StructField("class_def_loc", CALL_LOC),
        T.StructField("is_native", T.BooleanType()), T.StructField("is_synthetic", T.BooleanType()),
        T.StructField("synthetic_type", T.StringType()), T.StructField("is_container", T.BooleanType()),
        T.StructField("container_kind", T.StringType()), T.StructField("children_nodes", T.ArrayType(T.LongType())),
        T.StructField("inner_dag", T.StringType()),
    ]))),
    T.StructField("edges", T.ArrayType(T.StructType([
        T.StructField("src_id", T.LongType()), T.StructField("dst_id", T.LongType()), T.StructField("is_containment", T.BooleanType()),
        T.StructField("flows", T.MapType(T.StringType(), _flow)),
    ]))),
])

# IO lists of a level, the kind each stands for and the label of the collapsed group.
IO_SECTIONS = {"input_nodes": "input", "param_nodes": "param", "const_nodes": "const", "output_nodes": "output"}
IO_LABELS = {"input": "Input", "param": "Param", "const": "Const", "output": "Result"}
REQUIRED = ("nodes", "edges", *IO_SECTIONS)


def _in_section(place: int | Column, pos: Column) -> Column:
    """Order by section, then by position; a position in an array has less than 32 bits."""
    return F.shiftleft((F.lit(place) if isinstance(place, int) else place).cast("bigint"), 32) + pos.cast("bigint")


def _is_port() -> Column:
    return F.col("owner_id").isNotNull() & F.col("section").isin("input_nodes", "output_nodes") & F.col("io_subtype").isin("forward_arg", "return_val")


def _is_io_leaf() -> Column:
    return ~F.col("io_subtype").isin("forward_arg", "return_val") & ~F.col("in_container")


class FlatGraphs:
    """Flat tables of a corpus of serialized graphs.

    ``texts`` has graph_id and ``text``, the JSON of one graph.  Every level of nesting is one
    pass over all graphs that go that deep; the number of passes is the deepest nesting.
    """

    def __init__(self, texts: DataFrame):
        size_by_rows(texts)
        level = texts.select("graph_id", F.lit(None).cast("bigint").alias("owner_id"), F.lit(0).cast("bigint").alias("depth"),
                             F.lit(None).cast("array<bigint>").alias("children"), "text")
        parsed: list[DataFrame] = []
        while True:
            this = materialize(level.withColumn("d", F.from_json("text", LEVEL)).drop("text"))  # text is not kept beside its parse
            if this.isEmpty():
                break
            parsed.append(this)
            inner = this.select("graph_id", "depth", F.explode("d.nodes").alias("n")).filter("n.inner_dag is not null")
            level = inner.select("graph_id", F.col("n.node_id").alias("owner_id"), (F.col("depth") + 1).alias("depth"),
                                 F.col("n.children_nodes").alias("children"), F.col("n.inner_dag").alias("text"))
        self.levels = reduce(DataFrame.unionByName, parsed, level.withColumn("d", F.from_json("text", LEVEL)).drop("text").limit(0))

    # -------------------------------------------------------- rows of the levels

    #: Entries as written tables, for what reads them many times; one output alone reads the levels instead, and of these what it needs.
    _written: tuple[DataFrame, DataFrame] | None = None

    def write_entries(self) -> None:
        if self._written is None:
            self._written = materialize(self.io_entries), materialize(self.node_entries)

    @property
    def io_entries(self) -> DataFrame:
        """IO of all levels, from one pass over them."""
        if self._written:
            return self._written[0]
        lists = F.array(*[F.struct(F.lit(place).alias("place"), F.col(f"d.{section}").alias("list")) for place, section in enumerate(IO_SECTIONS)])
        rows = self.levels.select("graph_id", "owner_id", "depth", "children", F.explode(lists).alias("s")).select(
            "graph_id", "owner_id", "depth", "children", F.col("s.place").alias("place"), F.posexplode("s.list").alias("pos", "n"))
        of_place = lambda names: F.get(F.array(*[F.lit(x) for x in names]), F.col("place"))
        return rows.select(
            "graph_id", "owner_id", "depth", of_place(IO_SECTIONS).alias("section"), _in_section(F.col("place"), F.col("pos")).alias("ord"),
            F.coalesce("n.io_subtype", of_place(IO_SECTIONS.values())).alias("io_subtype"), F.col("n.node_id").alias("node_id"),
            F.col("n.label").alias("label"), F.col("n.attr_name").alias("attr_name"),
            F.col("n.class_name").alias("class_name"), F.col("n.call_loc").alias("call_loc"),
            F.col("children").isNotNull().alias("in_container"))

    @property
    def node_entries(self) -> DataFrame:
        """Nodes of all levels; in a container only the listed children are kept, in list order."""
        if self._written:
            return self._written[1]
        rows = self.levels.select("graph_id", "owner_id", "depth", "children", F.posexplode("d.nodes").alias("pos", "n"))
        place = F.when(F.col("children").isNull(), F.col("pos").cast("bigint")).otherwise(
            F.array_position("children", F.col("n.node_id")) - 1)
        return rows.select(
            "graph_id", "owner_id", "depth", place.alias("ord"), F.col("n.node_id").alias("node_id"),
            *[F.col(f"n.{c}").alias(c) for c in (
                "label", "attr_name", "class_name", "attr_type", "call_loc", "def_loc", "class_def_loc", "is_native",
                "is_synthetic", "synthetic_type")],
            F.col("n.children_nodes").isNotNull().alias("is_container"), F.col("n.inner_dag").isNotNull().alias("is_group"),
            F.col("children").isNotNull().alias("in_container"),
        ).filter("ord >= 0")

    # -------------------------------------------------------- output tables

    def groups(self) -> DataFrame:
        g = self.node_entries.filter("is_group")
        kind = F.when(F.col("is_container"), "container_group").otherwise("group")
        return g.select("graph_id", F.col("node_id").alias("group_id"), F.col("owner_id").alias("parent_id"), "depth", "ord",
                        "label", "class_name", "attr_name", kind.alias("node_type"),
                        F.coalesce("is_synthetic", F.lit(False)).alias("is_synthetic"), "synthetic_type", "is_native",
                        "call_loc", "def_loc", "class_def_loc", F.col("call_loc.file").alias("src_file"))

    def leaves(self) -> DataFrame:
        """Operators, modules and IO nodes; ports are not leaves, nor is the IO inside containers."""
        n = self.node_entries.filter("not is_group").select(
            "graph_id", "node_id", F.col("owner_id").alias("parent_id"), "depth",
            _in_section(len(IO_SECTIONS), F.col("ord")).alias("ord"), "label", F.col("attr_type").alias("node_type"),
            "attr_name", "class_name", "call_loc")
        io = self.io_entries.filter(_is_io_leaf()).select(
            "graph_id", "node_id", F.col("owner_id").alias("parent_id"), "depth", "ord", "label",
            F.col("io_subtype").alias("node_type"), "attr_name", "class_name", "call_loc")
        return n.unionByName(io)

    def ports(self) -> DataFrame:
        """Arguments and return values of each group, numbered in order per side."""
        io = self.io_entries.filter(_is_port())
        side = F.when(F.col("io_subtype") == "forward_arg", "in").otherwise("out")
        w = Window.partitionBy("graph_id", "group_id", "side").orderBy("ord")
        return io.select("graph_id", F.col("owner_id").alias("group_id"), side.alias("side"), "ord", "node_id", "label",
                         "attr_name", "class_name", "call_loc").withColumn("port_index", (F.row_number().over(w) - 1).cast("bigint"))

    def call_order(self) -> DataFrame:
        """Children of each group (NULL: top level) in order."""
        g = self.groups().select("graph_id", "parent_id", F.col("group_id").alias("node_id"),
                                 _in_section(len(IO_SECTIONS), F.col("ord")).alias("ord"), F.lit("group").alias("type"))
        return g.unionByName(self.leaves().select("graph_id", "parent_id", "node_id", "ord", F.lit("node").alias("type")))

    def members(self) -> DataFrame:
        """Containment edges between groups, leaves and ports."""
        order = self.call_order().filter("parent_id is not null").select(
            "graph_id", "parent_id", F.col("node_id").alias("child_id"), "ord")
        ports = self.ports().select("graph_id", F.col("group_id").alias("parent_id"), F.col("node_id").alias("child_id"), "ord")
        return order.unionByName(ports)

    def raw_edges(self) -> DataFrame:
        """Edges of all levels that are walked (a container contributes through its owner's level)."""
        rows = self.levels.filter("children is null").select(
            "graph_id", "depth", F.coalesce("owner_id", F.lit(-1)).alias("_o"), F.posexplode("d.edges").alias("pos", "e"))
        return rows.select("graph_id", F.struct("depth", "_o", "pos").alias("edge_ord"), F.col("e.src_id").alias("src_id"),
                           F.col("e.dst_id").alias("dst_id"), F.col("e.is_containment").alias("is_containment"),
                           F.col("e.flows").alias("flows"), (F.coalesce(F.size("e.flows"), F.lit(0)) > 0).alias("has_flows"))

    @cached_property
    def endpoints(self) -> DataFrame:
        part = lambda df, key: df.select("graph_id", F.col(key).alias("node_id"), "attr_name", "class_name", "call_loc")
        return materialize(part(self.groups(), "group_id").unionByName(part(self.leaves(), "node_id")).unionByName(part(self.ports(), "node_id")))

    def known_ids(self) -> DataFrame:
        """``(graph_id, node_id, is_point, is_seen)``: which ids are end points, and which are at least serialized."""
        seen = (~F.col("in_container")).alias("is_seen")
        ids = self.node_entries.select("graph_id", "node_id", F.lit(True).alias("is_point"), seen).unionByName(
            self.io_entries.select("graph_id", "node_id", (_is_port() | _is_io_leaf()).alias("is_point"), seen))
        return ids.groupBy("graph_id", "node_id").agg(F.bool_or("is_point").alias("is_point"), F.bool_or("is_seen").alias("is_seen"))

    def routed(self) -> tuple[DataFrame, DataFrame]:
        """(routed edges without their end points, violations)."""
        return route_edges(self.raw_edges(), self.known_ids())

    def edges(self) -> tuple[DataFrame, DataFrame]:
        """(routed edges, violations)."""
        first, violations = self.routed()
        return with_endpoints(first, self.endpoints), violations

    def io_groups(self) -> DataFrame:
        """Collapsed group per kind of top-level input and output."""
        io = self.io_entries.filter("owner_id is null")
        kind = F.create_map(*[F.lit(x) for kv in IO_SECTIONS.items() for x in kv])[F.col("section")]
        label = F.create_map(*[F.lit(x) for kv in IO_LABELS.items() for x in kv])
        sums = io.groupBy("graph_id", kind.alias("io_subtype")).agg(F.count(F.lit(1)).alias("n_members"))
        return sums.select("graph_id", "io_subtype", F.concat(F.lit("io_group:"), "io_subtype").alias("group_id"),
                           F.concat(label[F.col("io_subtype")], F.lit(" ("), F.col("n_members").cast("string"), F.lit(")")).alias("label"),
                           "n_members")

    def io_members(self) -> DataFrame:
        kind = F.create_map(*[F.lit(x) for kv in IO_SECTIONS.items() for x in kv])[F.col("section")]
        return self.io_entries.filter("owner_id is null").select(
            "graph_id", F.concat(F.lit("io_group:"), kind).alias("group_id"), "node_id", "ord")

    def header(self) -> DataFrame:
        """Per graph: module count, root groups, sizes."""
        g = self.groups().groupBy("graph_id").agg(
            F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("depth") == 0).alias("n_root_groups"))
        n = self.leaves().groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_leaves"))
        every = self.levels.filter("owner_id is null").select("graph_id")
        zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
        return every.join(g, "graph_id", "left").join(n, "graph_id", "left").select(
            "graph_id", zero("n_groups").alias("n_groups"), zero("n_leaves").alias("n_leaves"),
            (zero("n_groups") + zero("n_leaves")).alias("n_modules"), zero("n_root_groups").alias("n_root_groups"),
            F.lit(False).alias("has_timing"))

    def header_lists(self) -> DataFrame:
        """The id lists of the header as rows: ``(graph_id, list, place, node_id, label)``; ``root_groups`` has the root labels."""
        lists = F.create_map(*[F.lit(x) for s in IO_SECTIONS for x in (s, s.replace("_nodes", "_node_ids"))])
        io = self.io_entries.filter("owner_id is null").select(
            "graph_id", lists[F.col("section")].alias("list"), F.col("ord").bitwiseAND(F.lit((1 << 32) - 1)).alias("place"), "node_id", "label")
        roots = self.groups().filter("depth = 0").select("graph_id", F.lit("root_groups").alias("list"), F.col("ord").alias("place"), F.col("group_id").alias("node_id"), "label")
        return io.unionByName(roots)

    def violations(self) -> DataFrame:
        """Every broken rule as a row ``(graph_id, rule, node_id)``."""
        self.write_entries()
        out: list[DataFrame] = []
        add = lambda df, rule, node: out.append(df.select("graph_id", F.lit(rule).alias("rule"), node.cast("bigint").alias("node_id")))
        none = F.lit(None)
        for field in REQUIRED:
            add(self.levels.filter(F.col(f"d.{field}").isNull()), f"missing field: {field}", F.col("owner_id"))
        ids = self.endpoints
        add(ids.groupBy("graph_id", "node_id").count().filter("count > 1"), "duplicate node id", F.col("node_id"))
        m = self.members().groupBy("graph_id", "child_id").agg(F.count_distinct("parent_id").alias("n"))
        add(m.filter("n > 1"), "child of two groups", F.col("child_id"))
        inner = self.groups().filter("parent_id is not null").select("graph_id", "parent_id", F.col("group_id").alias("child_id"))
        add(cyclic_nodes(ancestors(inner)), "cycle in group tree", F.col("node_id"))
        n = self.node_entries.filter("not is_group and coalesce(attr_type, '') not in ('module', 'functional')")
        add(n, "unsupported attr_type", F.col("node_id"))
        section_kinds = F.create_map(*[F.lit(x) for kv in IO_SECTIONS.items() for x in kv])[F.col("section")]
        odd = self.io_entries.filter(F.col("owner_id").isNotNull() & ~F.col("io_subtype").isin("forward_arg", "return_val")
                                       & F.col("section").isin("input_nodes", "output_nodes") & (F.col("io_subtype") != section_kinds))
        add(odd, "unsupported io_subtype", F.col("node_id"))
        top = self.io_members().groupBy("graph_id", "node_id").count().filter("count > 1")
        add(top, "member of two io groups", F.col("node_id"))
        for column in ("attr_name", "class_name"):
            add(ids.filter(F.coalesce(column, F.lit("")) == ""), f"edge endpoint missing {column}", F.col("node_id"))
        add(self.header().filter("n_root_groups = 0"), "no root groups", none)
        return reduce(DataFrame.unionByName, out).unionByName(self.routed()[1])
