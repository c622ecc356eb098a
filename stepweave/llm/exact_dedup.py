"""Exact deduplication by keyed streaming state.

Every row becomes a narrow fact: digest of its normalised text, stable id, length, and a locator (file and row
number).  The facts run through a streaming aggregation whose state lives in RocksDB, is keyed by digest and never
expires; the state keeps the row that stays (its id and locator) and a count.  More facts can be
streamed into the same checkpoint later.  Rows whose digest was already there are hits: their whole normalised
texts are compared with the text that the locator of the kept row leads to, and where a digest stands for
several texts its rows are grouped again by text.

The main path is DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.llm.common import located, scratch, unboxed
from stepweave.session import materialize

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Facts read per micro-batch; bounds what one batch adds to the state.
BYTES_PER_BATCH = 16 << 30


def normalised(text: Column) -> Column:
    """Text without the characters of ``[\\x20\\x09-\\x0D]``; empty for null."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _preference() -> Column:
    """Smallest first: longest original, then smallest id (null last), then place in the input."""
    return F.struct((-F.col("n_chars")).alias("less"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("at").alias("at"))


def stream_state(facts_path: str, facts: DataFrame, checkpoint: str, bytes_per_batch: int = BYTES_PER_BATCH) -> DataFrame:
    """Run all facts below ``facts_path`` that ``checkpoint`` has not seen yet into the keyed state, and read it: a row per digest.

    The session is a new one, so that the choice of state store stays here.
    """
    spark = facts.sparkSession.newSession()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", "300")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")  # else 4 MB for each partition's store
    spark.conf.set("spark.sql.shuffle.partitions", facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stream = spark.readStream.schema(facts.schema).option("maxBytesPerTrigger", bytes_per_batch).parquet(facts_path)
    state = stream.groupBy("digest").agg(F.min(_preference()).alias("keep"), F.count("*").alias("n"))
    run = state.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    stored = facts.sparkSession.read.format("statestore").load(checkpoint)
    keep, n = (f"value.`{c}`" for c in stored.schema["value"].dataType.names[-2:])
    return stored.select(F.col("key.digest").alias("digest"), F.col(keep).alias("keep"), F.col(n).alias("n"))


def _placed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256_hex,
            bytes_per_batch: int = BYTES_PER_BATCH) -> tuple[DataFrame, DataFrame]:
    """A row per document with its group, and ``row`` (the columns of ``docs``) with the locator ``at``.

    Texts are equal when they are identical without white space.  Of equal texts the row with the most code points
    in the original stays, then the one with the smallest id (null last), then the first in the input, so that of
    rows repeated whole exactly one stays.  Null texts count as empty and form one group with texts of white space.
    ``digest`` maps a normalised text to a string; it may collide.
    """
    spark = docs.sparkSession
    base = located(docs)
    key, text = F.col("row").getField(id_col), F.col("row").getField(text_col)
    norm = normalised(text)
    keyed = base.select("at", key.alias("id"), F.coalesce(F.char_length(text), F.lit(0)).alias("n_chars"), norm.alias("norm"), digest(norm).alias("digest"))
    land = scratch(spark)
    keyed.select("digest", "id", "n_chars", "at").write.parquet(land)
    facts = spark.read.parquet(land)
    groups = materialize(stream_state(land, facts, scratch(spark), bytes_per_batch))
    placed = facts.join(groups, "digest").select("digest", "id", "at", F.col("keep.id").alias("keep_id"), F.col("keep.at").alias("keep_at"), "n")

    hits = groups.where("n > 1").select("digest", F.col("keep.at").alias("keep_at"))
    same = materialize(keyed.join(hits, "digest").select("digest", "at", "keep_at", "id", "n_chars", "norm"))
    first = same.where("at = keep_at").select("digest", F.col("norm").alias("first"))
    differing = materialize(same.join(first, "digest").where("norm != first").select("digest"))
    mixed = materialize(differing.distinct())
    if not mixed.isEmpty():  # digests that stand for several texts
        again = same.join(mixed, "digest", "left_semi")
        by_text = again.groupBy("digest", "norm").agg(F.min(_preference()).alias("keep"), F.count("*").alias("n"))
        split = again.select("digest", "norm", "id", "at").join(by_text, ["digest", "norm"]).select(
            "digest", "id", "at", F.col("keep.id").alias("keep_id"), F.col("keep.at").alias("keep_at"), "n")
        placed = placed.join(mixed, "digest", "left_anti").unionByName(split)
    keep = placed.select(F.col("at").alias("_at"), F.col("id").alias("_id"), F.col("digest").alias("_digest"), F.col("keep_id").alias("_keep_id"),
                         F.col("n").alias("_group_size"), (F.col("at") == F.col("keep_at")).alias("_kept"))
    return keep, base


def dedup_report(docs: DataFrame, **how) -> DataFrame:
    """A row per document, dropped ones too: ``_id, _keep_id, _group_size, _kept, _digest`` (see :func:`exact_dedup`)."""
    placed, _ = _placed(docs, **how)
    return placed


def exact_dedup(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that stay (see :func:`dedup_report`), with the columns of ``docs``, whatever their names."""
    placed, base = _placed(docs, **how)
    return unboxed(base.join(placed.where("_kept").select(F.col("_at").alias("at")), "at", "left_semi"))
