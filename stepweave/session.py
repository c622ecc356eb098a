"""Session helpers: where intermediate tables go."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession


_SCRATCH: dict[str, str] = {}
_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that tasks can import it wherever they run.

    The archive lies in Spark's own folder of the driver, which serves it and removes it at the end.
    """
    sc = spark.sparkContext
    root = os.path.dirname(os.path.abspath(__file__))
    if sc.applicationId in _SHIPPED or not os.path.isdir(root):  # no folder: the package already is in an archive
        return
    _SHIPPED.add(sc.applicationId)
    parent, package = os.path.split(root)
    archive = os.path.join(tempfile.mkdtemp(dir=SparkFiles.getRootDirectory()), f"{package}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    z.write(os.path.join(at, name), os.path.relpath(os.path.join(at, name), parent))
    sc.addPyFile(archive)


def shared_folder(spark: SparkSession) -> str:
    """Folder for the intermediate tables of this application.

    It lies below ``spark.checkpoint.dir`` of the session, in one subfolder per application that
    can go when the application has ended.  Only a single-machine session without that setting
    gets a scratch folder of its own.
    """
    ship_code(spark)
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        if sc.applicationId not in _SCRATCH:
            _SCRATCH[sc.applicationId] = tempfile.mkdtemp(prefix="spark-stepweave-")
        base = _SCRATCH[sc.applicationId]
    return f"{base}/stepweave-{sc.applicationId}"


#: Bytes in memory, hash table included, for one byte of a written graph table: ids repeat and are packed to a byte or two.
UNPACKED = "100"


def size_by_rows(df: DataFrame) -> None:
    """Let the planner take written tables for what they are in memory, not for the few bytes that packed ids take on disk.

    Else a table of millions of rows in a file of some MB is broadcast, by way of the driver.  A factor that the session has set stays.
    Joins that turn out small are still changed to broadcasts while they run (AQE knows the unpacked sizes).
    """
    conf = df.sparkSession.conf
    if float(conf.get("spark.sql.sources.fileCompressionFactor")) == 1.0:
        conf.set("spark.sql.sources.fileCompressionFactor", UNPACKED)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    This cuts the lineage on reliable storage, so a lost executor costs one task and not
    the history of the table.  It also tells Catalyst the size on disk: a small table is
    broadcast in later joins and a large one is not, without any hint (see :func:`size_by_rows` for packed ids).
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spark_session(app: str = "stepweave", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
