"""Removal of every byte that a repeated 200-byte string covers, over all texts at once.

The method dealt for this operator sorts suffixes bucket by bucket and resolves long ties by ranks of cover samples.  This
is not that method: no suffix is sorted by its bytes, and there are no ranks.  What is kept of it is the difference cover (positions
whose offset in their text leaves, modulo 133, one of 12 residues: any two offsets have a distance below 133 at which both stand
on it) and the work in buckets, one round of them at a time.  README.md gives the sizes that speak against the true form.

1.  The samples on the cover are named by a 64-bit fingerprint of the 68 bytes that follow (200 - 133 + 1).  If two 200-byte
    strings are equal, then also the samples at their common cover position, whose 68 bytes lie inside.  A start that
    no repeated sample covers is unique to depth 200 and is settled.
2.  The starts left are grouped by 128-bit fingerprints of their 200 bytes, in buckets, and of all buckets only those of
    one round are in the shuffle at a time.  Equal fingerprints count as equal strings; their bytes are not compared.
3.  Each text block takes its repeated starts back and cuts what they cover.

Texts lie in blocks of some megabytes; a longer text is cut into several blocks that overlap by 199 bytes, so the memory of a
task does not grow with it, until its pieces are joined again at the end.  A block first settles ties among its own
starts and sends each string once, so a passage that a third of all texts share costs one record per block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm.common import located, scratch, unboxed
from stepweave.session import materialize

LENGTH = 200
#: A perfect difference set modulo 133.
PERIOD, COVER = 133, (1, 10, 11, 13, 27, 31, 68, 75, 83, 110, 115, 121)
#: Bytes of text per block; longer texts are cut.
BLOCK_BYTES = 1 << 22
#: Records that a bucket holds about, and rounds in which the buckets of samples and of suffixes are dealt.
BUCKET, SAMPLE_ROUNDS, SUFFIX_ROUNDS = 1 << 20, 2, 5

_U = np.uint64
_MANY = np.uint32(0xFFFFFFFF)  # in place of a position: the block has settled this string itself
_ROWS = "bucket long, block long, keys binary, more binary, places binary"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class Windows:
    """Fingerprints of any window of ``data``: sums of random byte values times powers of an odd number, modulo 2**64."""

    def __init__(self, data: np.ndarray, seed: int) -> None:
        r = np.random.default_rng(seed)
        values = r.integers(0, 1 << 64, 256, dtype=np.uint64)
        base = int(r.integers(0, 1 << 62)) * 8 + 5
        n = len(data)
        rising, falling = np.full(n + 1, base, np.uint64), np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
        rising[0] = falling[0] = 1
        np.cumprod(rising, out=rising)
        np.cumprod(falling, out=falling)
        self.falling = falling
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values[data] * rising[:n], out=self.sums[1:])

    def at(self, places: np.ndarray, length: int) -> np.ndarray:
        return _mixed((self.sums[places + length] - self.sums[places]) * self.falling[places])


def _runs(keys: np.ndarray, more: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Order that puts equal keys together, and the starts of the runs."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = k[1:] == k[:-1]
    if more is not None:
        m = more[order]
        if (same & (m[1:] != m[:-1])).any():
            order = np.lexsort((more, keys))
            k, m = keys[order], more[order]
            same = k[1:] == k[:-1]
        same &= m[1:] == m[:-1]
    return order, np.flatnonzero(np.concatenate([[True], ~same])) if len(keys) else np.empty(0, np.int64)


def _pack(places: np.ndarray) -> bytes:
    return zlib.compress(np.diff(np.sort(places.astype(np.uint32)), prepend=np.uint32(0)).astype("<u4").tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), "<u4"), dtype=np.int64)


def _deal(block: int, places: np.ndarray, keys: np.ndarray, more: np.ndarray | None, buckets: int, rounds: int, now: int) -> Iterator[pd.DataFrame]:
    """Records of one block for the buckets of one round; bucket -1 holds the places that the block itself found repeated."""
    group = ((keys >> _U(32)) * _U(buckets * rounds) >> _U(32)).astype(np.int64)
    mine = group // buckets == now
    places, keys, group = places[mine], keys[mine], group[mine] % buckets
    more = None if more is None else more[mine]
    order, first = _runs(keys, more)
    if not len(order):
        return
    size = np.diff(np.append(first, len(order)))
    several = np.repeat(size > 1, size)
    rows = [(-1, block, b"", b"", _pack(places[order[several]]))] if several.any() else []
    lead = order[first]
    place = np.where(size > 1, _MANY, places[lead].astype(np.uint32)).astype("<u4")
    keys, group = keys[lead], group[lead]
    by = np.argsort(group, kind="stable")
    cut = np.flatnonzero(np.diff(group[by], prepend=-1))
    for part in np.split(by, cut[1:]):
        rows.append((int(group[part[0]]), block, keys[part].astype("<u8").tobytes(), b"" if more is None else more[lead][part].astype("<u8").tobytes(), place[part].tobytes()))
    yield pd.DataFrame(rows, columns=["bucket", "block", "keys", "more", "places"])


def _settle(rows: pd.DataFrame) -> pd.DataFrame:
    """Sorts one bucket; per block, the places whose string occurs again."""
    if rows["bucket"].iloc[0] < 0:
        return rows[["block", "places"]]
    keys = np.frombuffer(b"".join(rows["keys"]), "<u8")
    more = np.frombuffer(b"".join(rows["more"]), "<u8")
    places = np.frombuffer(b"".join(rows["places"]), "<u4")
    block = np.repeat(rows["block"].to_numpy(), [len(p) // 4 for p in rows["places"]])
    order, first = _runs(keys, more if len(more) else None)
    size = np.diff(np.append(first, len(order)))
    held = np.logical_or.reduceat(places[order] == _MANY, first)
    hit = order[np.repeat((size > 1) | held, size)]
    hit = hit[places[hit] != _MANY]
    hit = hit[np.argsort(block[hit], kind="stable")]
    cut = np.flatnonzero(np.diff(block[hit])) + 1
    return pd.DataFrame([(int(block[p[0]]), _pack(places[p])) for p in np.split(hit, cut) if len(p)], columns=["block", "places"])


def _repeated(source: DataFrame, emit, total: int, rounds: int, bucket: int) -> DataFrame:
    """``block, places`` of all repeated strings that ``emit`` names; one round of buckets after the other."""
    buckets = max(1, -(-total // (bucket * rounds)))
    out = None
    for now in range(rounds):
        def records(batches: Iterator[pd.DataFrame], now: int = now) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.itertuples(index=False):
                    for block, places, keys, more in emit(row):
                        yield from _deal(block, places, keys, more, buckets, rounds, now)

        dealt = source.mapInPandas(records, _ROWS).withColumn("_group", F.when(F.col("bucket") < 0, -1 - F.col("block")).otherwise(F.col("bucket")))
        part = materialize(dealt.groupBy("_group").applyInPandas(lambda rows: _settle(rows), "block long, places binary"))
        out = part if out is None else out.unionByName(part)
    return out


def _blocks(block_bytes: int, length: int):
    whole = max(1, block_bytes // PERIOD) * PERIOD  # cuts keep offsets on the cover

    def joined(entries: list[tuple[int, int, int, bytes]]) -> pd.DataFrame:
        return pd.DataFrame([{"nodes": [e[0] for e in entries], "bases": [e[1] for e in entries], "owned": [e[2] for e in entries],
                              "sizes": [len(e[3]) for e in entries], "data": b"".join(e[3] for e in entries)}])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Texts joined to blocks: their row numbers, lengths and bytes.

        A text longer than a block is cut: each piece has the starts of its own, and the bytes that the last of them take.
        """
        held: list[tuple[int, int, int, bytes]] = []
        size = 0
        for batch in batches:
            for node, text in zip(batch["node"], batch["text"]):
                if len(text) > whole:
                    for at in range(0, len(text), whole):
                        yield joined([(node, at, min(whole, len(text) - at), text[at:at + whole + length - 1])])
                    continue
                held.append((node, 0, len(text), text))
                size += len(text)
                if size >= block_bytes:
                    yield joined(held)
                    held, size = [], 0
        if held:
            yield joined(held)

    return run


def _offsets(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per byte of a block: offset in its text, and bytes left in it."""
    start = np.repeat(np.cumsum(sizes) - sizes, sizes)
    offset = np.arange(len(start)) - start
    return offset, np.repeat(sizes, sizes) - offset


def _samples(length: int):
    depth = length - PERIOD + 1
    on = np.zeros(PERIOD, bool)
    on[list(COVER)] = True

    def emit(row):
        data = np.frombuffer(row.data, np.uint8)
        offset, left = _offsets(np.asarray(row.sizes))
        places = np.flatnonzero(on[offset % PERIOD] & (left >= depth))
        yield row.block, places, Windows(data, 1).at(places, depth), None

    return emit


def _open_ranges(length: int):
    def cut(blocks: pd.DataFrame, ties: pd.DataFrame) -> pd.DataFrame:
        """The ranges of starts that a tied sample covers, with the bytes that their strings take."""
        if blocks.empty or ties.empty:
            return pd.DataFrame(columns=["block", "starts", "sizes", "data"], dtype=object)
        row = blocks.iloc[0]
        offset, left = _offsets(np.asarray(row["sizes"]))
        s = np.concatenate([_unpack(p) for p in ties["places"]])
        edge = np.zeros(len(offset) + 1, np.int32)
        np.add.at(edge, np.maximum(s - (PERIOD - 1), s - offset[s]), 1)
        np.add.at(edge, s + 1, -1)
        open_ = (np.cumsum(edge[:-1]) > 0) & (left >= length) & (offset < np.repeat(row["owned"], row["sizes"]))
        # a range ends where the next text begins
        begin = np.flatnonzero(open_ & ~(np.concatenate([[False], open_[:-1]]) & (offset > 0)))
        end = np.flatnonzero(open_ & ~(np.concatenate([open_[1:], [False]]) & (np.concatenate([offset[1:], [0]]) > 0)))
        data = memoryview(row["data"])
        parts = [data[b:e + length] for b, e in zip(begin.tolist(), end.tolist())]
        if not parts:
            return pd.DataFrame(columns=["block", "starts", "sizes", "data"], dtype=object)
        return pd.DataFrame([{"block": row["block"], "starts": begin, "sizes": [len(p) for p in parts], "data": b"".join(parts)}])

    return cut


def _suffixes(length: int):
    def emit(row):
        data = np.frombuffer(row.data, np.uint8)
        sizes = np.asarray(row.sizes)
        offset, left = _offsets(sizes)
        places = np.flatnonzero(left >= length)
        in_block = (np.repeat(np.asarray(row.starts), sizes) + offset)[places]
        yield row.block, in_block, Windows(data, 2).at(places, length), Windows(data, 3).at(places, length)

    return emit


def _removed(length: int):
    def cut(blocks: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
        """Per text: the spans that repeated strings cover, and the bytes that stay; of a cut text, the spans and the piece itself."""
        columns = ["node", "base", "starts", "ends", "kept"]
        if blocks.empty:
            return pd.DataFrame(columns=columns, dtype=object)
        row = blocks.iloc[0]
        data = np.frombuffer(row["data"], np.uint8)
        edge = np.zeros(len(data) + 1, np.int32)
        for p in hits["places"]:
            s = _unpack(p)
            np.add.at(edge, s, 1)
            np.add.at(edge, s + length, -1)
        gone = np.cumsum(edge[:-1]) > 0
        out, at = [], 0
        for node, base, owned, n in zip(row["nodes"], row["bases"], row["owned"], row["sizes"]):
            g = gone[at:at + n]
            cut_text = base > 0 or owned < n
            if cut_text or g.any():
                turn = np.flatnonzero(np.diff(np.concatenate([[0], g.view(np.int8), [0]])))
                stays = data[at:at + owned].tobytes() if cut_text else data[at:at + n][~g].tobytes()
                out.append((node, base if cut_text else None, (turn[::2] + base).tolist(), (turn[1::2] + base).tolist(), stays))
            at += n
        return pd.DataFrame(out, columns=columns, dtype=object)

    return cut


def _joined(pieces: pd.DataFrame) -> pd.DataFrame:
    """A cut text in one: the spans of all pieces, and the bytes that stay."""
    pieces = pieces.sort_values("base")
    start, end = (np.concatenate(pieces[c].tolist()).astype(np.int64) for c in ("starts", "ends"))
    if not len(start):
        return pd.DataFrame(columns=["node", "starts", "ends", "kept"], dtype=object)
    reach = np.maximum.accumulate(end)
    first = np.flatnonzero(np.append(True, start[1:] > reach[:-1]))
    start, end = start[first], reach[np.append(first[1:] - 1, len(reach) - 1)]
    data = b"".join(pieces["kept"])
    stays = [data[a:b] for a, b in zip(np.append(0, end), np.append(start, len(data)))]
    return pd.DataFrame([(pieces["node"].iloc[0], start.tolist(), end.tolist(), b"".join(stays))], columns=["node", "starts", "ends", "kept"])


def _cut_texts(docs: DataFrame, id_col: str, text_col: str, length: int, block_bytes: int, bucket: int) -> tuple[DataFrame, DataFrame]:
    """A row per document with what is known of its text, and ``row`` (the columns of ``docs``) with the locator ``at``."""
    if length < PERIOD:
        raise ValueError(f"length must be at least {PERIOD}")
    # shuffle files of a round go when the round ends, in a session of its own
    spark: SparkSession = docs.sparkSession.newSession()
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 * BLOCK_BYTES))
    base = located(docs)
    text = F.coalesce(F.col("row").getField(text_col), F.lit("")).cast("binary")
    at = base.select(F.col("at").alias("_at"), F.col("row").getField(id_col).alias("_id"), text.alias("text"))
    text = F.col("text")
    path = scratch(spark)
    at.select("_at", "_id", F.octet_length(text).cast("long").alias("_n_bytes"), F.sha2(text, 256).alias("_sha")).write.parquet(path)
    facts = docs.sparkSession.read.parquet(path)
    whole = facts.where(f"_n_bytes >= {length}").groupBy("_sha").agg(F.count("*").alias("_copies"), F.min("_at").alias("_at"))
    whole = materialize(whole.withColumn("node", F.monotonically_increasing_id()))
    path = scratch(spark)
    at.select("_at", "text").join(whole.select("_at", "node"), "_at").select("node", "text").mapInPandas(
        _blocks(block_bytes, length), "nodes array<long>, bases array<long>, owned array<long>, sizes array<long>, data binary").withColumn(
        "block", F.monotonically_increasing_id()).write.parquet(path)
    blocks = spark.read.parquet(path)

    total = blocks.select(F.sum(F.octet_length("data"))).first()[0] or 0
    ties = _repeated(blocks, _samples(length), total * len(COVER) // PERIOD, SAMPLE_ROUNDS, bucket)
    ranges = materialize(blocks.groupBy("block").cogroup(ties.groupBy("block")).applyInPandas(
        _open_ranges(length), "block long, starts array<long>, sizes array<long>, data binary"))
    total = ranges.select(F.sum(F.octet_length("data") - F.size("starts") * (length - 1))).first()[0] or 0
    hits = _repeated(ranges, _suffixes(length), total, SUFFIX_ROUNDS, bucket)
    path = scratch(spark)
    blocks.groupBy("block").cogroup(hits.groupBy("block")).applyInPandas(
        _removed(length), "node long, base long, starts array<long>, ends array<long>, kept binary").write.parquet(path)

    parts = docs.sparkSession.read.parquet(path)
    long_texts = parts.where("base IS NOT NULL").groupBy("node").applyInPandas(_joined, "node long, starts array<long>, ends array<long>, kept binary")
    found = parts.where("base IS NULL").drop("base").unionByName(long_texts)
    by_text = materialize(whole.select("_sha", "_copies", "node").join(found.select("node", F.col("starts").alias("_starts"), F.col("ends").alias("_ends"), F.col("kept").alias("_cut")), "node", "left"))
    known = facts.join(by_text, "_sha", "left")
    twice, empty = F.col("_copies") > 1, F.array().cast("array<long>")
    return known.select(
        "_at", "_id", "_n_bytes", "_sha", F.when(twice, F.lit("").cast("binary")).otherwise(F.col("_cut")).alias("_cut"),
        F.when(twice, F.array(F.lit(0).cast("long"))).otherwise(F.coalesce("_starts", empty)).alias("_starts"),
        F.when(twice, F.array("_n_bytes")).otherwise(F.coalesce("_ends", empty)).alias("_ends")), base


def span_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                block_bytes: int = BLOCK_BYTES, bucket: int = BUCKET) -> DataFrame:
    """Per document: ``_id, _n_bytes, _starts, _ends`` (spans removed, in bytes), ``_n_removed`` and ``_kept_sha256`` of the bytes that stay.

    A byte goes if a string of ``length`` bytes (133 or more) that covers it also starts elsewhere, in the same document or
    another.  Strings do not cross documents and are judged on the input.  Null texts are empty; texts
    shorter than ``length`` stay whole; texts that occur twice go whole, repeated rows included.
    """
    known, _ = _cut_texts(docs, id_col, text_col, length, block_bytes, bucket)
    gone = F.aggregate(F.zip_with("_starts", "_ends", lambda s, e: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return known.select("_id", "_n_bytes", "_starts", "_ends", gone.alias("_n_removed"), F.coalesce(F.sha2("_cut", 256), F.col("_sha")).alias("_kept_sha256"))


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
            block_bytes: int = BLOCK_BYTES, bucket: int = BUCKET) -> DataFrame:
    """``docs`` with ``_kept``, the bytes of each text that stay (see :func:`span_report`); they may split a character.

    Raises if ``docs`` has a column ``_kept``; others may have any names.
    """
    known, base = _cut_texts(docs, id_col, text_col, length, block_bytes, bucket)
    text = F.coalesce(F.col("row").getField(text_col), F.lit("")).cast("binary")
    return unboxed(base.join(known.select(F.col("_at").alias("at"), "_cut"), "at").withColumn("_kept", F.coalesce("_cut", text)), "_kept")
