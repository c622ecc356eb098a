"""Small graphs whole in a task, many at a time.

Tables are dealt by graph once; the joins and distinct rows that one graph needs then follow in its task, in Arrow and numpy.
Graphs of more than ``SMALL`` rows are left to joins over all of Spark, which have no bound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.session import materialize, ship_code

#: Rows of a graph, in all its tables, up to which it is worked on in a task: its closure has some 500,000 pairs at most.
SMALL = 1_000
#: Hash buckets of graphs, and the rows from which a bucket's graphs are not dealt to single tasks at all.
BUCKETS, CROWDED = 65_536, 500_000


def in_tasks(tables: dict[str, DataFrame], solve: Callable[[pa.Table], dict], schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows that ``solve`` makes of small graphs, graphs left over).

    ``solve`` gets all rows of many whole graphs, graph by graph, with the name of their table in ``_table`` and NULL where their table lacks a
    column; it returns the columns of ``schema``. Rows without a graph take no part.
    """
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [
        t.filter("graph_id is not null").withColumn("_table", F.lit(name)) for name, t in tables.items()])
    small, large = uncrowded(rows)
    return solved(small.repartition("graph_id"), _run(solve, SMALL), schema, large)


def uncrowded(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to deal to tasks, graphs in crowded buckets, which are not)."""
    bucket = F.pmod(F.hash("graph_id"), F.lit(BUCKETS)).alias("_bucket")
    crowded = materialize(rows.groupBy(bucket).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > CROWDED).select("_bucket"))
    if crowded.isEmpty():
        return rows, rows.select("graph_id").limit(0)
    small = rows.withColumn("_bucket", bucket).join(crowded, "_bucket", "left_anti").drop("_bucket")
    return small, rows.select("graph_id", bucket).join(crowded, "_bucket", "left_semi").select("graph_id")


def solved(dealt: DataFrame, run: Callable, schema: str, large: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows of ``schema`` that ``run`` makes of rows dealt by graph, graphs that it leaves over and ``large`` ones)."""
    ship_code(dealt.sparkSession)  # before the function is made
    made = materialize(dealt.sortWithinPartitions("graph_id").mapInArrow(run, f"{schema}, _left boolean"))
    left = made.filter("_left").select("graph_id")
    return made.filter("not _left").drop("_left"), materialize((left if large is None else left.unionByName(large)).distinct())


def _run(solve: Callable[[pa.Table], dict], most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, left in whole_graphs(batches, most):
            made = solve(table)
            flag = np.arange(len(made["graph_id"]) + len(left)) >= len(made["graph_id"])
            more = lambda c, v: left if c == "graph_id" else pa.nulls(len(left), v.type)
            yield from pa.table({**{c: pa.concat_arrays([v, more(c, v)]) for c, v in made.items()}, "_left": pa.array(flag)}).to_batches()
    return run


def whole_graphs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Table, pa.Array]]:
    """Tables of whole graphs, with the ids of graphs of more than ``most`` rows that they leave out; batches come sorted by graph."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        if not table.num_rows:
            continue
        graph, names = graphs(table)
        start = int(np.searchsorted(graph, graph[-1]))
        held = table.slice(start, min(table.num_rows - start, most + 1))  # a large graph is not kept whole
        yield _parted(table.slice(0, start), graph[:start], names, most)
    if held is not None:
        yield _parted(held, *graphs(held), most)


def _parted(table: pa.Table, graph: np.ndarray, names: pa.Array, most: int) -> tuple[pa.Table, pa.Array]:
    many = np.bincount(graph, minlength=len(names)) > most
    return (table.filter(pa.array(~many[graph])) if many.any() else table), names.take(pa.array(np.flatnonzero(many)))


# ---------------------------------------------------------------- helpers of the solvers

def encoded(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Number of each value (-1: NULL), and the values."""
    one = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    one = one.dictionary_encode()
    return pc.fill_null(one.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64), one.dictionary


def graphs(table: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """Number of each row's graph, rising with the rows, and the graphs' ids."""
    return encoded(table["graph_id"])


class Ids:
    """Ids of the graphs of a table as whole numbers; an id of another graph has another number, a NULL has one that ``known`` rejects."""

    def __init__(self, table: pa.Table, *columns: str):
        self.graph, self.graph_names = graphs(table)
        codes, self.names = encoded(pa.chunked_array([chunk for c in columns for chunk in table[c].chunks], table[columns[0]].type))
        self.width = len(self.names) + 1
        self.of = {c: self.graph * self.width + codes[i * table.num_rows:(i + 1) * table.num_rows] + 1 for i, c in enumerate(columns)}

    def known(self, ids: np.ndarray) -> np.ndarray:
        return ids % self.width > 0

    def graph_of(self, ids: np.ndarray) -> pa.Array:
        return self.graph_names.take(pa.array(ids // self.width))

    def name(self, ids: np.ndarray) -> pa.Array:
        code = ids % self.width - 1
        return self.names.take(pa.array(code, mask=code < 0))

    def matches(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of all pairs of equal ids, NULLs left out."""
        order = np.argsort(right, kind="stable")
        ids = right[order]
        low = np.searchsorted(ids, left, "left")
        n = np.where(self.known(left), np.searchsorted(ids, left, "right") - low, 0)
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.repeat(np.arange(len(left)), n), order[at]

    def closed(self, child: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node, ancestor, shortest distance) for all that lie above each node; each round doubles the distance covered."""
        ids, place = np.unique(np.concatenate([child, parent]), return_inverse=True)
        m, known = len(ids), self.known(ids)
        pair = np.unique(place[:len(child)] * m + place[len(child):])
        dist, reach, front = np.ones(len(pair), np.int64), 1, pair
        while len(front):
            node, top = front // m, front % m
            low, high = np.searchsorted(pair, top * m), np.searchsorted(pair, (top + 1) * m)  # the rows of ``top`` lie together
            n = np.where(known[top], high - low, 0)
            at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            far, more = np.repeat(node, n) * m + pair[at] % m, reach + dist[at]
            order = np.lexsort((more, far))
            far, first = np.unique(far[order], return_index=True)
            more = more[order][first]
            new = ~np.isin(far, pair)
            far, more = far[new], more[new]
            order = np.argsort(np.concatenate([pair, far]), kind="stable")
            pair, dist = np.concatenate([pair, far])[order], np.concatenate([dist, more])[order]
            reach *= 2
            front = far[more == reach]
        return ids[pair // m], ids[pair % m], dist


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(a):
        return a, b
    size = int(b.max()) + 1
    if (int(a.max()) + 1) * size < 2 ** 62:
        pair = np.unique(a * size + b)
        return pair // size, pair % size
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    pair = np.unique(place[:len(a)] * len(ids) + place[len(a):])
    return ids[pair // len(ids)], ids[pair % len(ids)]
