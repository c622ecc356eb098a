"""Large uncompressed trace files, read by many tasks each.

A file is read as text that ends at closing braces, so Spark cuts it into splits wherever it likes.  Whether a split begins
inside a string, and how deep, depends on all bytes before it: a first pass finds, for both cases, what a split
changes, and one row per split and file is folded in order.  A second pass knows where it stands and emits the objects that
lie in arrays of the root, or are values of the root, as texts.  An object that goes on in the next splits is
emitted in pieces and put together; its place in the array is its place in its split plus what came before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepweave.session import materialize

_OPEN, _CLOSE, _QUOTE, _BACKSLASH, _COLON = (93 - 2, 123), (93, 125), 34, 92, 58
_LEVELS = 3  # the root lies this far above the least depth of a split at most


class _Text:
    """Structure of a text that begins right behind a brace: strings, brackets and depth after each byte."""

    def __init__(self, text: bytes, in_string: bool, depth: int):
        self.text, d = text, np.frombuffer(text, np.uint8)
        q = np.flatnonzero(d == _QUOTE)
        if len(q) and (d == _BACKSLASH).any():
            at = np.arange(len(d))
            plain = np.maximum.accumulate(np.where(d != _BACKSLASH, at, -1))
            before = np.where(q > 0, plain[np.maximum(q - 1, 0)], q - 1)
            q = q[(q - 1 - before) % 2 == 0]
        flips = np.zeros(len(d), np.int8)
        flips[q] = 1
        inside = (np.cumsum(flips) + in_string) % 2 == 1
        opens, closes = ((d == pair[0]) | (d == pair[1]) for pair in (_OPEN, _CLOSE))
        self.quotes, self.inside, self.bytes = q, inside, d
        self.step = np.where(inside, 0, opens.astype(np.int8) - closes.astype(np.int8))
        self.depth = depth + np.cumsum(self.step)
        self.in_string = bool(inside[-1]) if len(d) else in_string

    def colons(self) -> np.ndarray:
        return np.flatnonzero((self.bytes == _COLON) & ~self.inside)

    def key(self, colon: int) -> tuple[str, str]:
        """Name in front of a colon, and the first byte of its value."""
        k = int(np.searchsorted(self.quotes, colon))
        name = self.text[self.quotes[k - 2] + 1:self.quotes[k - 1]].decode("utf-8", "replace") if k >= 2 else ""
        return name, self.text[colon + 1:colon + 200].lstrip()[:1].decode("latin-1")


def _by_split(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int, bytes, bool]]:
    """File, start of the split, text of a stretch of it, and whether the split ends there; splits come one after the other."""
    held = None
    for batch in batches:
        parts = batch["value"].str.encode("utf-8", "surrogatepass").to_numpy()
        names, starts = batch["file"].to_numpy(), batch["start"].to_numpy()
        new = np.append(0, np.flatnonzero((names[1:] != names[:-1]) | (starts[1:] != starts[:-1])) + 1) if len(batch) else []
        for a, b in zip(new, np.append(new[1:], len(batch))):
            if held is not None:
                yield *held, (held[0], held[1]) != (names[a], starts[a])
            held = (names[a], int(starts[a]), b"}".join(parts[a:b]) + b"}")
    if held is not None:
        yield *held, True


def _changes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per split, for a begin outside and inside a string: string state and depth at the end, and the last key at its least depths."""
    state: list[dict] = []
    for file, start, text, ends in _by_split(batches):
        state = state or [{"in_string": h, "depth": 0, "low": 0, "keys": {}} for h in (False, True)]
        for s in state:
            t = _Text(text, s["in_string"], s["depth"])
            s["in_string"], s["depth"], s["low"] = t.in_string, int(t.depth[-1]), min(s["low"], int(t.depth.min()))
            colons = t.colons()
            level = t.depth[colons]
            for r in range(s["low"], s["low"] + _LEVELS):
                last = np.flatnonzero(level == r)
                if len(last):
                    s["keys"][r] = t.key(int(colons[last[-1]]))
            s["keys"] = {r: k for r, k in s["keys"].items() if r < s["low"] + _LEVELS}
        if ends:
            rows = [(file, start, h, s["in_string"], s["depth"], [(r, *k) for r, k in s["keys"].items()]) for h, s in zip((False, True), state)]
            yield pd.DataFrame(rows, columns=["file", "start", "if_string", "in_string", "depth", "keys"])
            state = []


def _states(rows: pd.DataFrame) -> pd.DataFrame:
    """Where each split of a file stands at its begin."""
    in_string, depth, key, kind, out = False, 0, "", "", []
    by = {(int(r.start), bool(r.if_string)): r for r in rows.itertuples(index=False)}
    for start in sorted({k[0] for k in by}):
        out.append((rows["file"].iloc[0], start, in_string, depth, key, kind))
        r = by[start, in_string]
        for k in r.keys:
            if k["level"] == 1 - depth:
                key, kind = k["key"], k["kind"]
        in_string, depth = bool(r.in_string), depth + int(r.depth)
    return pd.DataFrame(out, columns=["file", "start", "in_string", "depth", "key", "kind"])


def _objects(states: dict):
    """Objects of the root's arrays and values: ``file, start, key, place, goes_on, ends, text``; a piece that only goes on has place -1."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None
        for file, start, text, ends in _by_split(batches):
            if now is None:
                in_string, depth, key, kind = states[file, start]
                count: dict[str, int] = {}
                now, place = True, -1
                open_ = [] if depth >= {"[": 3, "{": 2}.get(kind, 1 << 30) else None  # bytes of the object that is open
            t = _Text(text, in_string, depth)
            rows = []
            colons = t.colons()
            roots = colons[t.depth[colons] == 1]
            cuts = [0, *(roots + 1).tolist(), len(text)]
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                if k:
                    key, kind = t.key(int(roots[k - 1]))
                level = {"[": 3, "{": 2}.get(kind)
                if level is None or a == b:
                    continue
                step, deep = t.step[a:b], t.depth[a:b]
                begin = (np.flatnonzero((step > 0) & (deep == level) & (t.bytes[a:b] == 123)) + a).tolist()
                end = (np.flatnonzero((step < 0) & (deep == level - 1) & (t.bytes[a:b] == 125)) + a).tolist()
                if open_ is not None and end and (not begin or end[0] < begin[0]):
                    open_.append(text[a:end[0] + 1])
                    rows.append((file, start, key, place, False, True, b"".join(open_)))
                    open_ = None
                    end = end[1:]
                for x, y in zip(begin, end):
                    place = count[key] = count.get(key, -1) + 1
                    rows.append((file, start, key, place, False, True, text[x:y + 1]))
                if len(begin) > len(end):
                    place = count[key] = count.get(key, -1) + 1
                    open_ = [text[begin[-1]:b]]
                elif open_ is not None:
                    open_.append(text[a:b])
            in_string, depth = t.in_string, int(t.depth[-1])
            if ends:
                if open_:
                    rows.append((file, start, key, place, True, False, b"".join(open_)))
                now = None
            if rows:
                yield pd.DataFrame(rows, columns=["file", "start", "key", "place", "goes_on", "ends", "text"])

    return run


_ROW = "file string, start long, key string, place long, goes_on boolean, ends boolean, text binary"


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """``file, key, idx, text``: every object in an array of a file's root, or that is a value of it, with its place among those of its key.

    The driver holds one small row per split of the input, as many as ``spark.sql.files.maxPartitionBytes`` makes.  Compressed files are one split.
    """
    text = spark.read.option("lineSep", "}").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    changes = text.mapInPandas(_changes, "file string, start long, if_string boolean, in_string boolean, depth long, keys array<struct<level: long, key: string, kind: string>>")
    states = materialize(changes).groupBy("file").applyInPandas(_states, "file string, start long, in_string boolean, depth long, key string, kind string")
    known = {(r["file"], r["start"]): (r["in_string"], r["depth"], r["key"], r["kind"]) for r in states.collect()}
    found = materialize(text.mapInPandas(_objects(known), _ROW))
    by_file = Window.partitionBy("file").orderBy("start", "place")
    pieces = found.where("goes_on OR place < 0").withColumn("whole", F.sum(F.when(F.col("place") >= 0, 1).otherwise(0)).over(by_file))  # two per split at most
    part = F.array_sort(F.collect_list(F.struct("start", "text")))
    joined = pieces.groupBy("file", "whole").agg(F.min_by("key", "start").alias("key"), F.min("start").alias("start"), F.max("place").alias("place"), part.alias("parts"))
    joined = joined.select("file", "start", "key", "place", F.expr("aggregate(parts, cast('' as binary), (s, p) -> concat(s, p.text))").alias("text"))
    whole = found.where("NOT goes_on AND place >= 0").select("file", "start", "key", "place", "text").unionByName(joined)
    earlier = Window.partitionBy("file", "key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    sizes = found.where("place >= 0").groupBy("file", "key", "start").agg(F.count("*").alias("n"))  # a row per split and key
    before = materialize(sizes.select("file", "key", "start", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")))
    return whole.join(before, ["file", "key", "start"]).select("file", "key", (F.col("before") + F.col("place")).alias("idx"), F.col("text").cast("string").alias("text"))
