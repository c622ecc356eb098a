"""Near-duplicate groups: fast similarity sketches, banding, and exact Jaccard checks on full shingle sets.

Sketching places the elements of a set into ``SLOTS`` coordinates by rounds.  In round i < SLOTS each element
hashes to one coordinate with the value (i, hash); in round SLOTS + j each element goes to coordinate j.  A coordinate
keeps its least value, and a set stops when all are filled, so every coordinate fills after 2 * SLOTS rounds at most
and the estimate is concentrated as if the coordinates were independent.

Rows with the same shingle set are one node.  Nodes that share a band meet in a bucket.  A bucket never emits all its
pairs: its members are first compared with its most central member, and only members that are still in different
components afterwards, and that an exact bound does not tell apart, are compared with each other.  Every comparison takes
the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepweave.llm.common import located, unboxed
from stepweave.session import materialize

#: 32 bands of 5: two sets of similarity 0.8 share no band with probability 3e-6, of 0.85 with 7e-9.
BANDS, ROWS = 32, 5
SLOTS = BANDS * ROWS

_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit names of all runs of ``width`` words, A-Z lower-cased; a shorter text is one run of all its words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    name = np.full(n, min(width, len(h)), np.uint64)
    for j in range(min(width, len(h))):
        name = _mixed(name * _U(0x9E3779B97F4A7C15) + h[j:j + n])
    return np.unique(name)


def sketch(names: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Fast similarity sketch of a set that is not empty; a value holds its round in the upper 16 bits."""
    out = np.full(slots, np.iinfo(np.uint64).max, np.uint64)
    for i in range(2 * slots):
        h = _mixed(names + _U((i + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
        value = (_U(i) << _U(48)) | (h >> _U(16))
        if i < slots:
            np.minimum.at(out, ((h & _U(0xFFFFFFFF)) * _U(slots) >> _U(32)).astype(np.int64), value)
        else:
            out[i - slots] = min(out[i - slots], value.min())
        if int(out.max()) >> 48 < 2 * slots:
            break
    return out


def bands(slots: np.ndarray) -> np.ndarray:
    """A 64-bit name per band; it holds the band's number."""
    grid = slots.reshape(BANDS, ROWS)
    name = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        name = _mixed(name * _U(0x9E3779B97F4A7C15) + grid[:, j])
    return name


def _signatures(width: int):
    def signature(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            names = shingles(text, width)
            key = xxhash.xxh3_128_digest(names.tobytes())
            rows.append((len(names), key, bands(sketch(names)).view(np.int64) if len(names) else np.empty(0, np.int64)))
        return pd.DataFrame(rows, columns=["n", "key", "bands"])

    kind = T.StructType([T.StructField("n", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    return F.pandas_udf(signature, kind)


def _sets(width: int):
    return F.pandas_udf(lambda texts: pd.Series([shingles(t, width).tobytes() for t in texts]), T.BinaryType())


@F.pandas_udf(T.LongType())
def _common(left: pd.Series, right: pd.Series) -> pd.Series:
    """Size of the intersection of two full sets."""
    return pd.Series([len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True)) for a, b in zip(left, right)], dtype="int64")


def _names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for node, names in zip(batch["node"], batch["names"]):
            yield pd.DataFrame({"node": node, "name": np.frombuffer(names, np.int64)})


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``node, comp``: the least node that ``links`` (a, b) reach from each node, beginning from ``known`` components.

    Each round takes the least component among the neighbours of a whole component and then follows it, so long
    chains shorten quickly.
    """
    spark = links.sparkSession
    if known is None:
        known = spark.createDataFrame([], "node long, comp long")
    both = links.select("a", "b").union(links.select("b", "a"))
    fresh = both.select(F.col("a").alias("node")).distinct().join(known, "node", "left_anti")
    label = materialize(known.select("node", "comp").unionByName(fresh.withColumn("comp", F.col("node"))))
    while True:
        at = label.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
        to = label.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
        crossing = materialize(both.join(at, "a").join(to, "b").where("ca != cb").groupBy(F.col("ca").alias("comp")).agg(F.min("cb").alias("to")).where("to < comp"))
        if crossing.isEmpty():
            return label
        hop = crossing.select(F.col("comp").alias("to"), F.col("to").alias("further"))
        step = materialize(crossing.join(hop, "to", "left").select("comp", F.coalesce("further", "to").alias("to")))
        label = materialize(label.join(step, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")))


def linked_nodes(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``node, comp`` for the nodes of ``buckets`` (bucket, node, n) that have a link.

    ``sets``: node, names.  Buckets have two members or more.

    Each member is compared with the most central one of its bucket, which gives most links.  A pair in different
    components afterwards is compared only if it can be a link at all: what two sets share lies either in the centre's
    set, and then in both their intersections with it, or outside, and then neither among the names
    that only one set of the open buckets has.  The bound is exact, so no link is lost, and a group of many
    far-off copies of one text does not become a square of comparisons.
    """
    def compared(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("node").alias("a"), F.col("names").alias("names_a"))
        right = sets.select(F.col("node").alias("b"), F.col("names").alias("names_b"))
        return materialize(pairs.join(left, "a").join(right, "b").select(*pairs.columns, _common("names_a", "names_b").alias("common")))

    similar = f"100 * common >= {percent} * (na + nb - common)"
    size = materialize(buckets.groupBy("bucket").agg(F.count("*").alias("size")))
    central = materialize(buckets.join(size, "bucket").groupBy("node").agg(F.sum("size").alias("weight")))
    weighed = materialize(buckets.join(central, "node"))
    best = F.max(F.struct("weight", (-F.col("node")).alias("less"), "n")).alias("c")
    centre = materialize(weighed.groupBy("bucket").agg(best).select("bucket", (-F.col("c.less")).alias("centre"), F.col("c.n").alias("nc")))
    members = materialize(buckets.join(centre, "bucket"))
    pairs = materialize(members.where("node != centre").select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("centre").alias("b"), F.col("nc").alias("nb")).distinct())
    met = compared(pairs)
    label = components(met.where(similar).select("a", "b"))

    now = materialize(members.join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    several = materialize(now.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket"))
    rest = materialize(now.join(several, "bucket"))
    names = sets.join(materialize(rest.select("node").distinct()), "node").mapInPandas(_names, "node long, name long")
    single = names.groupBy("name").agg(F.count("*").alias("k"), F.min("node").alias("node")).where("k = 1")
    alone = materialize(single.groupBy("node").agg(F.count("*").alias("alone")))
    with_centre = met.select(F.col("a").alias("node"), F.col("b").alias("centre"), "common")
    known = rest.join(with_centre, ["node", "centre"], "left").join(alone, "node", "left")
    known = known.withColumn("inner", F.coalesce("common", "n")).withColumn("outer", F.expr("CASE WHEN node = centre THEN 0 ELSE n - common - coalesce(alone, 0) END"))
    known = materialize(known.where(f"100 * (inner + outer) >= {percent} * n").select("bucket", "node", "n", "comp", "inner", "outer"))
    where = materialize(known.groupBy("node").agg(F.collect_list("bucket").alias("buckets")))  # one per band at most
    known = materialize(known.join(where, "node"))
    x, y = known.alias("x"), known.alias("y")
    shared = "least(x.inner, y.inner) + least(x.outer, y.outer)"
    possible = (f"x.bucket = y.bucket AND x.node < y.node AND x.comp != y.comp AND 100 * ({shared}) >= {percent} * (x.n + y.n - ({shared}))"
                " AND 100 * least(x.n, y.n) >= {0} * greatest(x.n, y.n) AND x.bucket = array_min(array_intersect(x.buckets, y.buckets))".format(percent))
    further = materialize(x.join(y, F.expr(possible)).select(F.col("x.node").alias("a"), F.col("x.n").alias("na"), F.col("y.node").alias("b"), F.col("y.n").alias("nb")))
    return components(compared(further).where(similar).select("a", "b"), label)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """A row per document ``_at, _id, _n_shingles, _component_id, _kept``, and ``row`` (the columns of ``docs``) with its locator ``at``.

    ``_component_id`` is the smallest id that links of ``percent`` per cent similarity or more reach, itself included.
    Of each component the row with that id stays (null ids last, then the first in the input).  Texts that are null or
    have no word have an empty set: they link with nothing, stay, and are components of their own.
    """
    base = located(docs)
    key, text = F.col("row").getField(id_col), F.col("row").getField(text_col)
    sig = materialize(base.select(F.col("at").alias("_at"), key.alias("_id"), _signatures(width)(text).alias("s")).select("_at", "_id", "s.*"))
    own = F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), F.col("_at").alias("at"))
    node = sig.where("n > 0").groupBy("key").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.min(own).alias("first"))
    node = materialize(node.withColumn("node", F.monotonically_increasing_id()))
    banded = materialize(node.select("node", "n", F.explode("bands").alias("bucket")))
    shared = materialize(banded.groupBy("bucket").count().where("count > 1").select("bucket"))
    buckets = materialize(banded.join(shared, "bucket"))
    wanted = materialize(node.join(buckets.select("node").distinct(), "node", "left_semi").select("node", F.col("first.at").alias("_at")))
    # one plan for all sizes: which texts are wanted grows with the input
    sets = materialize(base.select(F.col("at").alias("_at"), text.alias("text")).join(wanted.hint("merge"), "_at").select("node", _sets(width)("text").alias("names")))
    label = linked_nodes(buckets, sets, percent)

    placed = node.select("key", "node", "first").join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    placed = materialize(placed)
    least = materialize(placed.groupBy("comp").agg(F.min("first").alias("least")))
    group = materialize(placed.join(least, "comp").select("key", "least"))
    full = sig.where("n > 0").join(group, "key").select("_at", "_id", F.col("n").alias("_n_shingles"), F.col("least.id").alias("_component_id"),
                                                        (F.col("_at") == F.col("least.at")).alias("_kept"))
    empty = sig.where("n = 0").select("_at", "_id", F.lit(0).cast("long").alias("_n_shingles"), F.col("_id").alias("_component_id"), F.lit(True).alias("_kept"))
    return full.unionByName(empty), base


def near_dedup(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that stay: one of each near-duplicate group (see :func:`near_groups`); its columns may have any names."""
    groups, base = near_groups(docs, **how)
    return unboxed(base.join(groups.where("_kept").select(F.col("_at").alias("at")), "at", "left_semi"))
