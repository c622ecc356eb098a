"""Mixing sources to target weights.

Sizes are summed per source, the weights become targets with a bound on repetition, and each document is emitted
``floor(rate)`` times, plus once more if its hash falls below the fraction of the rate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.llm.common import boxed, ranked, unboxed, uniform, word_count
from stepweave.session import materialize

SEED = "mix-1"


def _named(source: Column) -> Column:
    """Null as a value of its own, so that an equi-join finds it."""
    return F.struct(source.isNull().alias("none"), F.coalesce(source.cast("string"), F.lit("")).alias("name"))


def targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """Per source of ``sizes`` (source, size): ``source_key, source_size, target, rate``.

    Sources in order of code points, null last, take the ``weights`` in turn and share the sum of all sizes.  No
    target exceeds ``max_repeats`` times its source; what is above goes to the other sources by weight, until none
    is above.  Sums are whole numbers; only the last division is a double.  A source without size has rate 0.
    """
    whole = sizes.groupBy(_named(F.col("source")).alias("source_key")).agg(F.sum("size").cast("long").alias("source_size"))
    order = [F.col("source_key.none"), F.col("source_key.name")]
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    table = materialize(ranked(whole, order, "place").withColumn("weight", weight))
    exact = "decimal(38,0)"
    bound = (F.col("source_size") * max_repeats).cast(exact)
    total = int(table.agg(F.sum("source_size")).first()[0] or 0)
    full, num, den = F.lit(False), 0, 0
    while True:  # a pass fixes all sources whose bound lies below their share; their number only grows
        rest = F.when(~full, F.col("weight"))
        den, taken = (int(x or 0) for x in table.agg(F.sum(rest), F.sum(F.when(full, bound))).first())
        num = total - taken
        if not den:
            break
        above = bound * F.lit(den).cast("decimal(20,0)") <= F.col("weight").cast(exact) * F.lit(num).cast("decimal(20,0)")
        more = table.where(above & ~full).limit(1).count()
        if not more:
            break
        full = full | above
    share = F.col("weight").cast("double") * F.lit(float(num)) / F.lit(float(den or 1))
    target = F.when(full, (F.col("source_size") * max_repeats).cast("double")).otherwise(share)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return materialize(table.withColumn("target", target).withColumn("rate", rate).select("source_key", "source_size", "target", "rate"))


def _planned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
            weights: Sequence[int] = (1, 2, 3), max_repeats: int = 3, seed: str = SEED, size: Column | None = None) -> DataFrame:
    """``row`` (the columns of ``docs``) with ``_size, _source_size, _target, _rate, _copies``."""
    sized = docs.select(boxed(docs), (word_count(F.col(text_col)) if size is None else size).alias("_size"))
    key, source = F.col("row").getField(id_col), F.col("row").getField(source_col)
    goal = targets(sized.select(source.alias("source"), F.col("_size").alias("size")), weights, max_repeats).select(
        "source_key", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.col("rate").alias("_rate"))
    whole = F.floor("_rate").cast("long")
    extra = uniform(key, seed=seed) < F.col("_rate") - whole
    return sized.withColumn("source_key", _named(source)).join(goal, "source_key").withColumn("_copies", whole + extra.cast("long"))


def planned(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with ``_size, _source_size, _target, _rate, _copies``; raises if it has such columns.

    ``how``: the names of the columns (``id_col``, ``text_col``, ``source_col``), ``weights``, ``max_repeats``, ``seed``, and ``size``, which replaces the
    number of words.  The hash takes seed and id: reruns agree, and rows that repeat an id get the same number of
    copies.  Null text has size 0; null sources are one source; null ids hash as one id; an empty table gives none.
    """
    return unboxed(_planned(docs, **how), "_size", "_source_size", "_target", "_rate", "_copies")


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as its source's rate says (see :func:`planned`); its columns may have any names."""
    copies = F.sequence(F.lit(1).cast("long"), F.col("_copies"))
    return unboxed(_planned(docs, **how).where("_copies > 0").select("row", F.explode(copies)))
