"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepweave.session import materialize, shared_folder, ship_code

#: White space of the word rule, as a Java and as a Python character class.
SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Plan nodes that make at most one row of each row of a file.
PLAIN_NODES = {"LogicalRelation", "Project", "Filter", "SubqueryAlias"}


def _is_plain_scan(rows: DataFrame) -> bool:
    """Whether each row is a row of a file of its own, with no other row made of it.

    Joins, generators, samples, unions and the like may repeat a row and its ``_metadata``, and so do paths that are read twice.
    """
    node = rows._jdf.queryExecution().analyzed()
    while node.getClass().getSimpleName() in PLAIN_NODES and not node.children().isEmpty():
        node = node.children().head()
    if node.getClass().getSimpleName() != "LogicalRelation" or node.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    return len(node.relation().location().inputFiles()) == len(rows._jdf.inputFiles())  # the latter are distinct


def with_locator(rows: DataFrame, name: str = "_at") -> DataFrame:
    """``rows`` with a struct that says where each row lies: file and row number in it.

    Rows that are not a plain scan of Parquet files are written to the shared folder first.  The locator tells
    repeated rows apart, and is the same when a lost task runs again.
    """
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    if _is_plain_scan(rows):
        try:
            return rows.withColumn(name, at)
        except AnalysisException:  # files of another format
            pass
    return materialize(rows).withColumn(name, at)


def uniform(*key: Column, seed: str) -> Column:
    """A number in [0, 1) made of 52 bits of an MD5 digest; the same in any engine and any run."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("null")) for k in key])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def ranked(rows: DataFrame, by: list[Column], name: str) -> DataFrame:
    """``rows`` with their place (0, 1, ..) in the order ``by``, without sorting everything in one task."""
    part = materialize(rows.repartitionByRange(*by).withColumn("_p", F.spark_partition_id()))
    sizes = part.groupBy("_p").agg(F.count("*").alias("_n"))  # a row per partition
    starts = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*by)) - 1
    return part.withColumn("_k", place).join(starts, "_p").withColumn(name, F.col("_k") + F.col("_start")).drop("_p", "_k", "_start")


def boxed(docs: DataFrame) -> Column:
    """All columns of ``docs`` in one struct ``row``, so that none of them can clash with a column of an operator."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row")


def located(docs: DataFrame) -> DataFrame:
    """``row, at``: the columns of ``docs`` in a struct, and where the row lies (see :func:`with_locator`)."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("at")
    if _is_plain_scan(docs) and "_metadata" not in docs.columns:
        try:
            return docs.select(boxed(docs), at)
        except AnalysisException:  # files of another format
            pass
    return materialize(docs.select(boxed(docs))).select("row", at)


def unboxed(rows: DataFrame, *names: str) -> DataFrame:
    """The columns in ``row`` followed by the columns ``names``; raises if ``row`` has one of them."""
    taken = {n.lower() for n in rows.schema["row"].dataType.names}
    clash = sorted(n for n in names if n.lower() in taken)
    if clash:
        raise ValueError(f"the input already has the columns that the result adds: {', '.join(clash)}")
    return rows.select("row.*", *names)
