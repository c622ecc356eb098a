"""Display records of graph nodes and edges, and the rows that break a rule.

Node columns used here: node_kind, attr_kind, attr_name, class_name, kind, arg_index,
param_name, op_name, head_name, ret_index, ret_key, container_kind, display_name, call_loc.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IO_KINDS = ("input", "forward_arg", "param", "const", "output", "return_val")


def _filled(*columns: Column) -> Column:
    """First of the columns that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def _numbered(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def io_records(nodes: DataFrame) -> DataFrame:
    """Inputs, arguments, parameters, constants, outputs and return values with their labels."""
    kind = F.col("attr_kind")
    ret = _filled(F.col("ret_key"), _numbered("ret_", "ret_index"))
    named = F.coalesce("attr_name", F.lit("")) != ""
    label = (
        F.when(kind == "input", _filled(F.col("attr_name"), F.col("kind"), _numbered("input_", "node_id")))
        .when(kind == "forward_arg", _numbered("arg_", "arg_index"))
        .when(kind == "param", _filled(F.col("param_name"), _numbered("param_", "node_id")))
        .when(kind == "const", F.when(named, F.concat("attr_name", F.lit("("), "op_name", F.lit(")"))).otherwise(F.col("op_name")))
        .when(kind == "output", _filled(F.col("head_name"), _numbered("output_", "node_id")))
        .when(kind == "return_val", ret)
    )
    name = F.when(kind == "output", F.col("head_name")).when(kind == "return_val", ret).otherwise(F.col("attr_name"))
    return nodes.filter(kind.isin(*IO_KINDS)).select(
        "graph_id", "node_id", kind.alias("io_subtype"), label.alias("label"),
        F.coalesce(name, F.lit("")).alias("attr_name"), F.coalesce("class_name", F.lit("")).alias("class_name"))


def empty_name_violations(records: DataFrame) -> DataFrame:
    rule = F.when(F.col("attr_name") == "", "empty attr_name").when(F.col("class_name") == "", "empty class_name")
    return records.withColumn("rule", rule).filter("rule is not null").select("graph_id", "rule", "node_id")


def module_records(nodes: DataFrame) -> DataFrame:
    """Containers, modules and functional operators; ``label`` is NULL when nothing names the node."""
    kind = F.col("attr_kind")
    name = F.coalesce("display_name", F.col("attr_name"), F.lit(""))
    cls = F.coalesce(F.when(kind == "container", F.col("container_kind")).otherwise(F.col("class_name")), F.lit(""))
    both = F.concat(name, F.lit("("), cls, F.lit(")"))
    label = F.when((name != "") & ((cls != "") | (kind == "container")), both).otherwise(_filled(name, cls))
    return nodes.filter(kind.isin("container", "module", "functional")).select(
        "graph_id", "node_id", kind.alias("attr_type"), label.alias("label"), name.alias("attr_name"), cls.alias("class_name"),
        F.when(kind != "container", F.col("is_native")).alias("is_native"))


def edge_flows(edges: DataFrame) -> DataFrame:
    """One row per flow of an edge: output index, shape, type and number of evidence steps.

    ``flows`` is a map from output index to shape, dtype and steps.
    """
    return edges.select("graph_id", "src_id", "dst_id", F.explode("flows").alias("flow_index", "flow")).select(
        "graph_id", "src_id", "dst_id", F.col("flow_index").cast("bigint").alias("flow_index"),
        F.col("flow.shape").alias("shape"), F.col("flow.dtype").alias("dtype"), F.col("flow.steps").alias("steps"))


def collect_flows(flow_rows: DataFrame) -> DataFrame:
    """Back from flow rows to one edge with a map; an edge has as many flows as its source has outputs."""
    value = F.struct("shape", "dtype", "steps")
    return flow_rows.groupBy("graph_id", "src_id", "dst_id").agg(F.map_from_entries(F.array_sort(
        F.collect_list(F.struct(F.col("flow_index").cast("string").alias("k"), value.alias("v"))))).alias("flows"))


def scope_records(io: DataFrame, modules: DataFrame, edges: DataFrame, scoped: DataFrame) -> DataFrame:
    """Contents of every scope as rows ``(graph_id, scope_id, section, ord, record)``.

    ``record`` is the JSON of one node or edge: a scope is never gathered into one value.
    """
    # Section of the serialized form by kind of node.
    sections = {"input": "input_nodes", "forward_arg": "input_nodes", "param": "param_nodes", "const": "const_nodes",
                "output": "output_nodes", "return_val": "output_nodes"}
    table = F.create_map(*[F.lit(x) for kv in sections.items() for x in kv])
    json = lambda df: F.to_json(F.struct(*[c for c in df.columns if c != "graph_id"]))
    place = scoped.select("graph_id", "scope_id", "node_id", "ord")
    rows = io.select("graph_id", "node_id", table[F.col("io_subtype")].alias("section"), json(io).alias("record"))
    rows = rows.unionByName(modules.select("graph_id", "node_id", F.lit("nodes").alias("section"), json(modules).alias("record")))
    inside = edges.join(place.select("graph_id", "scope_id", F.col("node_id").alias("src_id")), ["graph_id", "src_id"]).join(
        place.select("graph_id", F.col("scope_id").alias("_s"), F.col("node_id").alias("dst_id")), ["graph_id", "dst_id"]).filter("scope_id = _s")
    edge_rows = inside.select("graph_id", "scope_id", F.lit("edges").alias("section"), "src_id", "dst_id").select(
        "graph_id", "scope_id", "section", F.col("src_id").alias("ord"), F.to_json(F.struct("src_id", "dst_id")).alias("record"))
    return place.join(rows, ["graph_id", "node_id"]).select("graph_id", "scope_id", "section", "ord", "record").unionByName(edge_rows)


def source_references(groups: DataFrame, flow_rows: DataFrame) -> DataFrame:
    """Distinct files named by group locations and by the evidence of edges."""
    own = groups.select("graph_id", F.explode(F.array(
        "src_file", "call_loc.file", "def_loc.file", "class_def_loc.file")).alias("file"))
    steps = flow_rows.select("graph_id", F.explode("steps").alias("s")).select("graph_id", F.col("s.loc.file").alias("file"))
    return own.unionByName(steps).filter((F.col("file").isNotNull()) & (F.col("file") != "")).distinct()


def with_location(df: DataFrame) -> DataFrame:
    """Source columns from ``call_loc`` and timing columns at their defaults."""
    return df.withColumns({
        "src_file": F.col("call_loc.file"), "src_start_line": F.col("call_loc.line"), "src_end_line": F.col("call_loc.line"),
        "has_timing": F.lit(False), "pct": F.lit(0.0), "dur_us": F.lit(0.0), "kernel_us": F.lit(0.0),
        "role": F.lit(None).cast("string")})
