"""Near-duplicate vectors: p-stable hashing of normalised vectors, then exact cosines.

Each vector is scaled to length 1.  In every table ``k`` random projections, shifted and cut into steps, name its bucket.
How many projections and tables there are follows from the number of vectors: buckets of unrelated vectors stay
nearly empty, and a pair at the threshold shares no bucket with probability ``MISS`` at most.

A group of thousands of near copies shares its buckets, so pairs are never listed.  Vectors that lie within half the angle of
the threshold around a common centre form a ball, in which all pairs are links by the triangle inequality; balls are counted,
not compared.  What shares a bucket with another ball is compared with its centre, which settles most cases, and only the
cases in between are compared one by one.  Single vectors meet in blocks of a bucket; a pair that shares several buckets
counts in the first of them.  All of these comparisons are in double precision, and a bound decides only if it is clear by
more than rounding.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import acos, ceil, erf, exp, log, pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepweave.llm.common import located, unboxed
from stepweave.llm.minhash import components
from stepweave.session import materialize

COSINE = 0.95
#: Width of a step of a projection; probability that a pair at the threshold shares no bucket.
STEP, MISS = 2.0, 1e-3
#: Unrelated vectors that a bucket holds on average, besides a vector itself.
STRANGERS = 1 / 32
#: Vectors per side of a block of comparisons, about.
BLOCK = 256
#: Blocks of up to so many vectors are compared many at a time.
_FEW = 16
#: What a bound has to be clear of, in radians; rounding stays far below.
SLACK = 1e-7
#: Whole numbers that components and directions are rounded to before hashing, so that any order of adding gives equal sums.
_UNIT, _DIRECTION = float(1 << 24), float(1 << 12)


def collision(distance: float, step: float = STEP) -> float:
    """Probability that a shifted, quantised normal projection puts two points of this distance together."""
    r = step / distance
    return erf(r / sqrt(2)) - 2 / (sqrt(2 * pi) * r) * (1 - exp(-r * r / 2))


def shape(n: int, cosine: float, miss: float = MISS) -> tuple[int, int]:
    """Projections per table, and tables, for ``n`` vectors."""
    k = max(4, ceil(log(max(2.0, n / STRANGERS)) / -log(collision(sqrt(2)))))
    return k, ceil(log(miss) / log(1 - collision(sqrt(2 - 2 * cosine)) ** k))


@F.pandas_udf(T.BinaryType())
def unit(vectors: pd.Series) -> pd.Series:
    """Vectors of length 1 as bytes of doubles; null for those that are null, empty, zero or hold null or non-finite numbers."""
    out = []
    for v in vectors:
        x = None if v is None else np.array(v, dtype=np.float64)  # null components become NaN
        if x is None or not x.size or not np.isfinite(x).all() or not x.any():
            out.append(None)
            continue
        x = x / np.abs(x).max()
        out.append((x / sqrt(float(x @ x)) + 0.0).tobytes())
    return pd.Series(out, dtype=object)


def _matrix(units) -> np.ndarray:
    return np.frombuffer(b"".join(units), np.float64).reshape(len(units), -1)


@F.pandas_udf(T.DoubleType())
def cosine_of(left: pd.Series, right: pd.Series) -> pd.Series:
    """Cosine of two vectors of length 1; null if they differ in dimension."""
    return pd.Series([float(np.frombuffer(a) @ np.frombuffer(b)) if len(a) == len(b) else None for a, b in zip(left, right)], dtype="float64")


@lru_cache(maxsize=8)
def _directions(d: int, k: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng([d, k])
    return np.rint(r.standard_normal((tables * k, d)) * _DIRECTION).T, np.rint(r.uniform(0, STEP, tables * k) * _UNIT * _DIRECTION)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buckets(units: np.ndarray, k: int, tables: int) -> np.ndarray:
    """Bucket per vector (row) and table (column); its name holds table and dimension."""
    a, shift = _directions(units.shape[1], k, tables)
    cell = np.floor((np.rint(units * _UNIT) @ a + shift) / (STEP * _UNIT * _DIRECTION)).astype(np.int64).view(np.uint64).reshape(len(units), tables, k)
    name = np.broadcast_to(_mixed(np.arange(tables, dtype=np.uint64) + np.uint64(units.shape[1] << 32)), cell.shape[:2])
    for j in range(k):
        name = _mixed(name * np.uint64(0x9E3779B97F4A7C15) + cell[:, :, j])
    return name.view(np.int64)


def _banded(k: int, tables: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, rows in batch.groupby(batch["unit"].str.len()):
                for at in range(0, len(rows), 512):
                    part = rows.iloc[at:at + 512]
                    names = buckets(_matrix(part["unit"]), k, tables)
                    yield pd.DataFrame({"bucket": names.ravel(), "tab": np.tile(np.arange(tables, dtype=np.int32), len(part)), "node": np.repeat(part["node"].to_numpy(), tables)})

    return run


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``lead, total``: sum of the vectors of each lead in one task."""
    kept: dict[int, np.ndarray] = {}

    def out() -> pd.DataFrame:
        return pd.DataFrame({"lead": list(kept), "total": [v.tobytes() for v in kept.values()]})

    for batch in batches:
        for lead, u in zip(batch["lead"].tolist(), batch["unit"]):
            v = np.frombuffer(u)
            kept[lead] = kept[lead] + v if lead in kept else v
        if len(kept) > 20_000:
            yield out()
            kept.clear()
    if kept:
        yield out()


def _centre(rows: pd.DataFrame) -> pd.DataFrame:
    x = _matrix(rows["total"]).sum(axis=0)
    n = sqrt(float(x @ x))
    return pd.DataFrame({"lead": rows["lead"].iloc[:1], "centre": [(x / n if n else x).tobytes()]})


def _linked(node: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, item: np.ndarray | None = None, mate: int = 0) -> pd.DataFrame | None:
    """``node, item, n_links, mate`` for rows linked by the pairs (a, b) of row numbers; without ``item``, ``mate`` is the least node reached."""
    if not len(a):
        return None
    total = np.bincount(a, n[b], len(node)) + np.bincount(b, n[a], len(node))
    some = np.flatnonzero(total)
    comp = np.full(len(node), mate) if item is not None else node.copy()
    while item is None:
        low = np.minimum(comp[a], comp[b])
        if (low == comp[a]).all() and (low == comp[b]).all():
            break
        np.minimum.at(comp, a, low)
        np.minimum.at(comp, b, low)
    return pd.DataFrame({"node": node[some], "item": (node if item is None else item)[some], "n_links": total[some].astype(np.int64), "mate": comp[some]})


def _compared(cosine: float, k: int, tables: int):
    """Compares blocks: rows come sorted by (g, h, i, j, tab, side).  ``node, item, n_links, mate`` for all that has a link.

    Side 0 meets side 1, or itself if i = j and ``tab`` names a table.  Where ``tab`` is -1, ``g`` and ``h`` are the balls of the two sides.
    What a pair shares in a table before ``tab``, it counted there.  The many blocks of a few vectors are taken together.
    """
    def earlier(x: np.ndarray, y: np.ndarray, tab: np.ndarray) -> np.ndarray:
        return ((buckets(x, k, tables) == buckets(y, k, tables)) & (np.arange(tables) < tab[:, None])).any(axis=1)

    def few(rows: pd.DataFrame, block: np.ndarray) -> Iterator[pd.DataFrame | None]:
        for size in rows["unit"].str.len().unique():
            at = np.flatnonzero((rows["unit"].str.len() == size).to_numpy())
            x, of, tab = _matrix(rows["unit"].iloc[at]), block[at], rows["tab"].to_numpy()[at]
            left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            step = 1
            while True:
                a = np.flatnonzero(of[:-step] == of[step:]) if step < len(of) else np.empty(0, np.int64)
                if not len(a):
                    break
                a = a[np.einsum("ij,ij->i", x[a], x[a + step]) >= cosine]
                left.append(a)
                right.append(a + step)
                step += 1
            a, b = np.concatenate(left), np.concatenate(right)
            kept = [~earlier(x[a[i:i + 512]], x[b[i:i + 512]], tab[a[i:i + 512]]) for i in range(0, len(a), 512)]
            kept = np.concatenate(kept) if kept else np.empty(0, bool)
            yield _linked(rows["node"].to_numpy()[at], rows["n"].to_numpy()[at], a[kept], b[kept])

    def many(key: tuple, rows: pd.DataFrame) -> pd.DataFrame | None:
        g, h, i, j, tab = key
        one = rows["side"].to_numpy() == 0
        alone = tab >= 0 and i == j
        if not alone and (one.all() or not one.any()):
            return None
        left, other = (rows, rows) if alone else (rows[one], rows[~one])
        x, y = _matrix(left["unit"]), _matrix(other["unit"])
        hit = x @ y.T >= cosine
        a, b = np.nonzero(np.triu(hit, 1) if alone else hit)
        if tab > 0 and len(a):
            names, before = [buckets(m, k, tables)[:, :tab] for m in (x, y)], np.zeros(len(a), bool)
            for t in range(tab):
                before |= names[0][a, t] == names[1][b, t]
            a, b = a[~before], b[~before]
        if alone:
            return _linked(rows["node"].to_numpy(), rows["n"].to_numpy(), a, b)
        node, n = (np.concatenate([left[c].to_numpy(), other[c].to_numpy()]) for c in ("node", "n"))
        item = None if tab >= 0 else np.where(np.arange(len(node)) < len(left), g, h)
        return _linked(node, n, a, b + len(left), item, min(g, h))

    def settle(rows: pd.DataFrame, start: np.ndarray) -> pd.DataFrame | None:
        """Whole blocks that begin at ``start``."""
        size = np.diff(np.append(start, len(rows)))
        first = rows.iloc[start]
        small = (size <= _FEW) & (first["tab"] >= 0).to_numpy() & (first["i"] == first["j"]).to_numpy()
        member, block = np.repeat(small, size), np.repeat(np.arange(len(size)), size)
        found = list(few(rows[member], block[member])) if small.any() else []
        for at in np.flatnonzero(~small):
            found.append(many(tuple(first.iloc[at][["g", "h", "i", "j", "tab"]].tolist()), rows.iloc[start[at]:start[at] + size[at]]))
        found = [x for x in found if x is not None]
        return pd.concat(found) if found else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the block that may go on
        for batch in batches:
            if not len(batch):
                continue
            keys = batch[["g", "h", "i", "j", "tab"]].to_numpy()
            new = np.append(True, (keys[1:] != keys[:-1]).any(axis=1))
            if held and (keys[0] == held[-1][["g", "h", "i", "j", "tab"]].to_numpy()[-1]).all():
                new[0] = False
            start = np.flatnonzero(new)
            if not len(start):
                held.append(batch)
                continue
            rows = pd.concat([*held, batch.iloc[:start[-1]]])
            before = len(rows) - start[-1]
            whole = np.append(0, before + start[:-1]) if before else start[:-1]
            out = settle(rows, np.unique(whole)) if len(rows) else None
            held = [batch.iloc[start[-1]:]]
            if out is not None:
                yield out
        if held:
            out = settle(pd.concat(held), np.array([0]))
            if out is not None:
                yield out

    return run


_BLOCKS = ["g", "h", "i", "j", "tab", "side", "node", "n", "unit"]
_LINKS = "node long, item long, n_links long, mate long"


def _met(rows: DataFrame, cosine: float, k: int, tables: int) -> DataFrame:
    dealt = rows.select(*_BLOCKS).repartition("g", "h", "i", "j").sortWithinPartitions("g", "h", "i", "j", "tab", "side")
    return materialize(dealt.mapInPandas(_compared(cosine, k, tables), _LINKS))


def _blocks_of(size: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(size / BLOCK)).cast("int")


def _part(node: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(node), blocks).cast("int")


def _single_pairs(shared: DataFrame, nodes: DataFrame) -> DataFrame:
    """Blocks of single vectors that share a bucket: block i of it meets block j >= i."""
    size = materialize(shared.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"))
    at = shared.join(size, "bucket").withColumn("blocks", _blocks_of(F.col("size"))).withColumn("mine", _part(F.col("node"), F.col("blocks")))
    met = at.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(nodes.select("node", "n", "unit"), "node")
    return met.select(F.col("bucket").alias("g"), F.lit(0).cast("long").alias("h"), F.least("mine", "to").alias("i"), F.greatest("mine", "to").alias("j"), "tab",
                      F.when(F.col("mine") <= F.col("to"), 0).otherwise(1).alias("side"), "node", "n", "unit")


def _ball_pairs(close: DataFrame, members: DataFrame) -> DataFrame:
    """Blocks of the members of two balls (x, y) that their centres leave open."""
    def side(k: int, mine: str, other: str) -> DataFrame:
        rows = close.join(members.withColumnRenamed("item", mine), mine)
        rows = rows.withColumn("part", _part(F.col("node"), _blocks_of(F.col(f"size_{mine}"))))
        rows = rows.withColumn("to", F.explode(F.sequence(F.lit(0), _blocks_of(F.col(f"size_{other}")) - 1)))
        i, j = ("part", "to") if k == 0 else ("to", "part")
        return rows.select(F.col("x").alias("g"), F.col("y").alias("h"), F.col(i).alias("i"), F.col(j).alias("j"), F.lit(-1).alias("tab"), F.lit(k).alias("side"), "node", "n", "unit")

    return side(0, "x", "y").unionByName(side(1, "y", "x"))


def _placed_in_balls(at: DataFrame, nodes: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """``node, item`` for the nodes of ``at`` (bucket, node, lead), and ``item, centre, r, n, size`` for their balls.

    A node follows the lead that it shares most buckets with, if they are linked; the mean of those who follow is a
    centre, and who lies within half the angle of the threshold around it is in its ball.  All others are balls of their own.
    """
    votes = at.where("node != lead").groupBy("node", "lead").agg(F.count("*").alias("votes"))
    best = votes.groupBy("node").agg(F.max(F.struct("votes", (-F.col("lead")).alias("less"))).alias("b")).select("node", (-F.col("b.less")).alias("lead"))
    chosen = best.join(nodes.select("node", "n", "unit"), "node").join(nodes.select(F.col("node").alias("lead"), F.col("unit").alias("to")), "lead")
    follow = materialize(chosen.where(cosine_of("unit", "to") >= cosine).select("node", "lead", "n", "unit"))
    centre = materialize(follow.mapInPandas(_sums, "lead long, total binary").groupBy("lead").applyInPandas(_centre, "lead long, centre binary"))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine_of("unit", "centre"))))
    inside = materialize(follow.join(centre, "lead").withColumn("r", angle).where(F.col("r") <= acos(cosine) / 2 - SLACK).select("node", "lead", "n", "r"))
    ball = inside.groupBy("lead").agg(F.min("node").alias("item"), F.max("r").alias("r"), F.sum("n").alias("n"), F.count("*").alias("size")).where("size > 1")
    ball = materialize(ball.join(centre, "lead"))
    placed = materialize(inside.join(ball.select("lead", "item"), "lead").select("node", "item"))
    return placed, ball.select("item", "centre", "r", "n", "size")


def _grouped(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, miss: float = MISS) -> tuple[DataFrame, DataFrame]:
    """``vectors`` with locators, and what :func:`near_groups` returns."""
    key, vector = F.col("row").getField(id_col), F.col("row").getField(vector_col)
    base = located(vectors)
    rows = materialize(base.select("at", key.alias("id"), unit(vector.cast("array<double>")).alias("unit")))
    own = F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("at").alias("at"))
    known = rows.where("unit IS NOT NULL").groupBy("unit").agg(F.count("*").alias("n"), F.min(own).alias("first"))
    nodes = materialize(known.withColumn("node", F.monotonically_increasing_id()))
    k, tables = shape(nodes.count(), cosine, miss)
    banded = materialize(nodes.select("node", "unit").mapInPandas(_banded(k, tables), "bucket long, tab int, node long"))
    lead = materialize(banded.groupBy("bucket").agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64("node").alias("by"), "node")).alias("m"))
                       .where("size > 1").select("bucket", F.col("m.node").alias("lead")))
    at = materialize(banded.join(lead, "bucket"))
    placed, balls = _placed_in_balls(at, nodes, cosine)

    item = F.coalesce("item", "node")
    where = materialize(at.join(placed, "node", "left").select("bucket", "tab", "node", item.alias("item"), F.col("item").isNotNull().alias("in_ball")))
    mixed = where.groupBy("bucket").agg(F.min("item").alias("lo"), F.max("item").alias("hi")).where("lo < hi").select("bucket")
    open_ = materialize(where.join(materialize(mixed), "bucket"))
    single = open_.where("NOT in_ball").select("bucket", "tab", "node")
    found = _met(_single_pairs(single, nodes), cosine, k, tables)

    # a ball and whatever shares a bucket with one of its members
    inside = materialize(open_.where("in_ball").select("bucket", F.col("item").alias("ball")).distinct())
    beside = open_.select("bucket", "item").distinct().join(inside, "bucket").where("item != ball")
    pairs = materialize(beside.select(F.least("item", "ball").alias("x"), F.greatest("item", "ball").alias("y")).distinct())
    ends = materialize(pairs.select(F.explode(F.array("x", "y")).alias("item")).distinct())
    alone = nodes.join(placed.select("node"), "node", "left_anti").select(F.col("node").alias("item"), F.col("unit").alias("centre"), F.lit(0.0).alias("r"), "n", F.lit(1).cast("long").alias("size"))
    items = materialize(balls.unionByName(alone).join(ends, "item"))
    named = lambda c: items.select(*[F.col(f).alias(c if f == "item" else f"{f}_{c}") for f in items.columns])
    both = pairs.join(named("x"), "x").join(named("y"), "y").withColumn("cosine", cosine_of("centre_x", "centre_y")).where("cosine IS NOT NULL")
    both = both.withColumn("d", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "cosine")))).withColumn("reach", F.col("r_x") + F.col("r_y"))
    near = materialize(both.select("x", "y", "n_x", "n_y", "size_x", "size_y", "d", "reach").where(F.col("d") - F.col("reach") <= acos(cosine) + SLACK))
    sure = F.col("d") + F.col("reach") <= acos(cosine) - SLACK
    whole = near.where(sure)
    members = nodes.select("node", "n", "unit").join(placed, "node", "left").withColumn("item", item)
    close = materialize(near.where(~sure).select("x", "y", "size_x", "size_y"))
    wanted = materialize(close.select(F.explode(F.array("x", "y")).alias("item")).distinct())
    between = _met(_ball_pairs(close, materialize(members.join(wanted, "item"))), cosine, k, tables)

    by_node = found.unionByName(between).groupBy("node").agg(F.sum("n_links").alias("by_node"))
    by_item = whole.select(F.col("x").alias("item"), F.col("n_y").alias("n")).unionByName(whole.select(F.col("y").alias("item"), F.col("n_x").alias("n"))).groupBy("item").agg(F.sum("n").alias("by_item"))
    edges = found.unionByName(between).where("item != mate").select(F.col("item").alias("a"), F.col("mate").alias("b")).unionByName(whole.select(F.col("x").alias("a"), F.col("y").alias("b")))
    label = components(materialize(edges.distinct())).select(F.col("node").alias("item"), "comp")
    full = nodes.select("node", "n", "first", "unit").join(placed, "node", "left").withColumn("item", item).join(balls.select("item", F.col("n").alias("in_ball")), "item", "left")
    full = full.join(by_node, "node", "left").join(by_item, "item", "left").join(label, "item", "left")
    zero = F.lit(0).cast("long")
    links = F.coalesce("in_ball", "n") - 1 + F.coalesce("by_node", zero) + F.coalesce("by_item", zero)
    full = materialize(full.select("unit", "first", links.alias("n_links"), F.coalesce("comp", "item").alias("comp")))
    least = materialize(full.groupBy("comp").agg(F.min("first").alias("least")))
    group = full.join(least, "comp").select("unit", "n_links", "least")
    linked = rows.where("unit IS NOT NULL").join(group, "unit").select("at", "id", "n_links", F.col("least.id").alias("component_id"), (F.col("at") == F.col("least.at")).alias("kept"))
    none = rows.where("unit IS NULL").select("at", "id", zero.alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return base, linked.unionByName(none)


def near_groups(vectors: DataFrame, **how) -> DataFrame:
    """A row per row of ``vectors``: ``at, id, n_links, component_id, kept``.

    ``n_links`` counts the other rows of cosine ``cosine`` or more, rows repeated whole included; ``component_id`` is the
    smallest id that links reach, itself included.  Of each component the row with that id is kept (null ids last, then the first
    in the input).  Vectors that are null, empty, zero or hold null or non-finite components link with nothing and are
    kept, and vectors of different dimension never link.  No link is found below the threshold; a pair at the threshold
    is missed with probability ``miss`` at most, a closer one less often.
    """
    return _grouped(vectors, **how)[1]


def near_dedup(vectors: DataFrame, **how) -> DataFrame:
    """The rows of ``vectors`` that are kept (see :func:`near_groups`), with the columns of ``vectors``."""
    base, groups = _grouped(vectors, **how)
    return unboxed(base.join(groups.where("kept").select("at"), "at", "left_semi"))
