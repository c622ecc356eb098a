"""Profiler trace files in, event table out; result tables to storage."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.operators.trace_dims import enhanced_flags
from stepweave.schema import RAW_TRACE
from stepweave.session import materialize
from stepweave.sources.trace_splits import read_objects


def read_raw_traces(spark: SparkSession, path: str) -> DataFrame:
    """One row per trace file (plain or gzip JSON) with its header and event list.

    ``trace_id`` is the file path: files of one name in different folders stay apart.
    """
    return spark.read.schema(RAW_TRACE).option("multiLine", True).json(path).withColumn(
        "trace_id", F.input_file_name())


def _ns(us: str):
    return (F.col(us) * 1000).cast("bigint")


def _flat(rows: DataFrame) -> DataFrame:
    """Event columns of rows ``trace_id, idx, e``."""
    arg = lambda name: F.col("e.args").getField(name)
    return rows.select(
        "trace_id", F.col("idx").cast("bigint").alias("idx"), "e.ph", "e.cat", "e.name", "e.pid", "e.tid",
        _ns("e.ts").alias("ts_ns"), _ns("e.dur").alias("dur_ns"), F.col("e.id").alias("flow_id"),
        arg("External id").alias("external_id"), arg("Python id").alias("py_id"), arg("Python parent id").alias("py_parent_id"),
        arg("CallFrom").alias("call_from"), arg("name").alias("arg_name"), arg("labels").alias("arg_labels"),
        arg("stack")["stack_traces"].alias("stack_traces"))


def explode_events(raw: DataFrame) -> DataFrame:
    """Event table; ``idx`` is the position in the file, times become whole ns."""
    return _flat(raw.select("trace_id", F.posexplode("traceEvents").alias("idx", "e")))


def trace_headers(raw: DataFrame) -> DataFrame:
    """Device and rank of each trace; absent parts stay NULL, absent fields get their defaults."""
    device, rank = F.get("deviceProperties", F.lit(0)), F.col("distributedInfo")
    or_else = lambda part, value, default: F.when(part.isNotNull(), F.coalesce(value, F.lit(default)))
    return raw.select(
        "trace_id", or_else(device, device["name"], "Unknown").alias("device_name"),
        or_else(device, device["numSms"], 0).alias("num_sms"),
        or_else(rank, rank["rank"], 0).alias("rank"), or_else(rank, rank["world_size"], 1).alias("world_size"))


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    return explode_events(read_raw_traces(spark, path))


def read_large_traces(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Events and headers of trace files, many tasks to a file (see ``trace_splits``); the same rows as one file per task gives.

    Elements of ``traceEvents`` that are no objects do not count in ``idx``.
    """
    objects = materialize(read_objects(spark, path))
    kind = {f.name: f.dataType for f in RAW_TRACE.fields}
    events = objects.where("key = 'traceEvents'").select(F.col("file").alias("trace_id"), "idx", F.from_json("text", kind["traceEvents"].elementType).alias("e"))
    first = lambda key, schema: F.from_json(F.max(F.when((F.col("key") == key) & (F.col("idx") == 0), F.col("text"))), schema)
    raw = objects.groupBy(F.col("file").alias("trace_id")).agg(
        first("deviceProperties", kind["deviceProperties"].elementType).alias("_device"), first("distributedInfo", kind["distributedInfo"]).alias("distributedInfo"))
    return _flat(events), trace_headers(raw.select("trace_id", F.when(F.col("_device").isNotNull(), F.array("_device")).alias("deviceProperties"), "distributedInfo"))


def land_events(events: DataFrame, path: str) -> None:
    """Write the event table once, in trace and time order, for all later analyses.

    A JSON file that ``read_traces`` reads is one task and one row until it is exploded (``read_large_traces`` splits it); from
    here on the work splits by rows, and row groups can be skipped by trace and time.
    """
    events.repartitionByRange("trace_id", "ts_ns").sortWithinPartitions("trace_id", "ts_ns", "idx").write.mode(
        "error").parquet(path)


def traces_missing_sources(events: DataFrame) -> DataFrame:
    """Traces with code locations and stacks: their source analysis needs the model code."""
    return enhanced_flags(events).filter("has_code_location and has_stack_traces").select(
        "trace_id", F.lit("enhanced trace needs model sources").alias("rule"))


def commit_tables(tables: dict[str, DataFrame], path: str) -> int:
    """Write the tables of a run below ``path`` and then list the run, so that readers see all of its tables or none.

    Every table has a ``trace_id``; a later run replaces the traces that it has as a whole.  Returns the number of the run.
    A run that breaks off leaves files that no reader looks at.
    """
    first = next(iter(tables.values()))
    spark, runs = first.sparkSession, f"{path}/_runs"
    run = 1 + max([r["run"] for r in _runs(spark, runs).agg(F.max("run").alias("run")).collect() if r["run"] is not None], default=0)
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy("trace_id").parquet(f"{path}/{name}/run={run}")
    traces = reduce(DataFrame.unionByName, [spark.read.schema("trace_id string").parquet(f"{path}/{name}/run={run}").select("trace_id") for name in tables]).distinct()
    traces.select("trace_id", F.lit(run).cast("long").alias("run")).coalesce(1).write.mode("append").parquet(runs)
    return run


def _runs(spark: SparkSession, path: str) -> DataFrame:
    """Listed runs, ``trace_id, run``; none before the first."""
    try:
        return spark.read.schema("trace_id string, run long").parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], "trace_id string, run long")


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table as the last listed run of each trace left it."""
    last = _runs(spark, f"{path}/_runs").groupBy("trace_id").agg(F.max("run").alias("run"))
    table = spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}")
    return table.withColumn("run", F.col("run").cast("long")).withColumn("trace_id", F.col("trace_id").cast("string")).join(last, ["trace_id", "run"]).drop("run")


def write_tables(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """One folder per result table, split by trace; ``fmt`` is parquet or json."""
    for name, df in tables.items():
        df.write.mode("error").partitionBy("trace_id").format(fmt).save(f"{path}/{name}")
