"""Best-fit packing with several bin sizes.

Documents are cut into pieces of at most the largest permitted length.  Pieces are dealt by hash into shards of
bounded size, and each shard is packed by itself: longest piece first, into the open bin that it leaves
with the least room.  Where none has room, a bin opens with the size whose cost per word is least, given how
much of it the shorter pieces of the shard can still fill.  When all pieces lie, each bin shrinks to the
smallest permitted size that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.llm.common import WORD, word_count
from stepweave.session import materialize

#: Permitted sequence lengths in words.
SIZES = (512, 1024, 2048, 4096)
#: A sequence of n words costs n * (1 + n / ATTENTION): linear layers and attention.
ATTENTION = 16384
#: Expected pieces per shard; bounds the memory and time of a task.
SHARD_PIECES = 16384
#: Rows of equal id, length and text are unfolded in blocks of this many.
BLOCK = 1024


def cost(size: int) -> float:
    return size * (1 + size / ATTENTION)


def pack(lengths: np.ndarray, sizes: Sequence[int] = SIZES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``bin, start, size`` per piece, for lengths in falling order of 1 to ``max(sizes)``.

    Of bins with equal room the one opened first is taken; of sizes with equal cost per word the smaller one.
    """
    sizes = sorted(sizes)
    left = np.append(np.cumsum(lengths[::-1])[::-1], 0)  # words from piece i on
    rising = -lengths
    open_bins: list[tuple[int, int]] = []  # (room, bin)
    room_left = 0
    used: list[int] = []
    bins, starts = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        at = bisect_left(open_bins, (n, -1))
        if at < len(open_bins):
            room, b = open_bins.pop(at)
        else:
            best = None
            for size in sizes:
                if size >= n:
                    short = max(i + 1, int(np.searchsorted(rising, n - size)))  # pieces that fit beside this one
                    filled = n + min(size - n, max(0, int(left[short]) - room_left))
                    price = cost(size) / filled
                    if best is None or price < best[0]:
                        best = (price, size)
            b, room = len(used), best[1]
            used.append(0)
            room_left += room
        bins[i], starts[i] = b, used[b]
        used[b] += n
        room_left -= n
        if room > n:
            insort(open_bins, (room - n, b))
    final = np.array(sizes)[np.searchsorted(sizes, used)] if used else np.empty(0, np.int64)
    return bins, starts, final[bins] if len(bins) else final


def _pack_shard(sizes: Sequence[int]):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_words", "id", "text_key", "copy", "piece"], ascending=[False, True, True, True, True], na_position="last", kind="stable")
        bins, starts, final = pack(rows["n_words"].to_numpy(), sizes)
        rows["bin_id"], rows["bin_start"], rows["bin_size"] = (rows["shard"].to_numpy() << 32) + bins, starts, final
        return rows[["id", "text_key", "copy", "piece", "piece_start", "n_words", "bin_id", "bin_start", "bin_size"]]

    return run


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sizes: Sequence[int] = SIZES,
           shard_pieces: int = SHARD_PIECES, size: Column | None = None) -> DataFrame:
    """A row per piece: ``id, text_key, copy, piece, piece_start, n_words, bin_id, bin_start, bin_size``.

    ``copy`` numbers rows of equal id, length and text from 1, ``piece`` and ``piece_start`` place a piece in its
    document, ``bin_start`` places it in its bin.  A text without words, or null, is one piece of 0 words without
    a bin.  Null ids are packed like others.  Ties are broken by id, text and copy, so reruns on equal rows agree.
    ``size`` replaces the number of words.
    """
    top = max(sizes)
    rows = docs.select(F.col(id_col).alias("id"), (word_count(F.col(text_col)) if size is None else size).alias("n"), F.xxhash64(text_col).alias("text_key"))
    same = materialize(rows.groupBy("id", "n", "text_key").agg(F.count("*").alias("copies")))
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / BLOCK)))
    copies = same.withColumn("block", block)
    copies = copies.withColumn("copy", F.explode(F.sequence(F.col("block") * BLOCK + 1, F.least(F.col("copies"), (F.col("block") + 1) * BLOCK))))
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil(F.col("n") / top) - 1)))
    pieces = copies.withColumn("piece", piece).withColumn("piece_start", F.col("piece") * top)
    pieces = pieces.withColumn("n_words", F.least(F.lit(top), F.col("n") - F.col("piece_start")))
    pieces = pieces.select("id", "text_key", "copy", "piece", "piece_start", "n_words")
    total = pieces.where("n_words > 0").count()
    shards = max(1, round(total / shard_pieces))
    dealt = pieces.where("n_words > 0").withColumn("shard", F.pmod(F.xxhash64("id", "text_key", "copy", "piece"), F.lit(shards)))
    kind = dict(pieces.dtypes)["id"]
    schema = f"id {kind}, text_key long, copy long, piece long, piece_start long, n_words long, bin_id long, bin_start long, bin_size long"
    out = dealt.groupBy("shard").applyInPandas(_pack_shard(sizes), schema)
    none = F.lit(None).cast("long")
    return out.unionByName(pieces.where("n_words = 0").withColumn("bin_id", none).withColumn("bin_start", none).withColumn("bin_size", none))


def sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sizes: Sequence[int] = SIZES, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """A row per training sequence: ``bin_id, bin_size, n_words, doc_ids, text``, with the texts of its pieces in the order of the bin.

    A text is cut into words once; the words of a piece, and the pieces of a bin, are joined by one space, and ``doc_ids`` has
    the id of each piece.  A bin holds ``max(sizes)`` words at most, so no group is unbounded.  A text without words, or null,
    is a row of its own without a bin (``bin_id`` and ``bin_size`` null, no words, empty text).  Rows repeated whole
    are cut once and placed as often as they occur.  An empty table gives no rows (see :func:`packed`).
    """
    top = max(sizes)
    names = ["no_id", "id_key", "text_key", "piece"]  # grouped and joined by the same columns, so that a text is dealt out once
    key = lambda c: [F.col(c).isNull().alias("no_id"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("id_key")]
    texts = docs.select(*key(id_col), F.xxhash64(text_col).alias("text_key"), word_count(F.col(text_col)).alias("n"), F.regexp_extract_all(F.col(text_col), F.lit(f"({WORD})")).alias("words"))
    cut = F.expr(f"transform(sequence(0L, (n - 1) div {top}), p -> array_join(slice(words, cast(p * {top} + 1 as int), {top}), ' '))")
    pieces = texts.where("n > 0").select(*names[:-1], F.posexplode(cut).alias("piece", "text")).withColumn("piece", F.col("piece").cast("long"))
    pieces = pieces.groupBy(*names).agg(F.min("text").alias("text"))
    placed = materialize(packed(docs, id_col, text_col, sizes, shard_pieces))
    found = placed.where("n_words > 0").select("*", *key("id")).join(pieces, names).select("id", "bin_id", "bin_start", "bin_size", "n_words", "text")
    part = F.array_sort(F.collect_list(F.struct("bin_start", "id", "text")))
    bins = found.groupBy("bin_id").agg(F.min("bin_size").alias("bin_size"), F.sum("n_words").alias("n_words"), part.alias("parts"))
    bins = bins.select("bin_id", "bin_size", "n_words", F.col("parts.id").alias("doc_ids"), F.array_join(F.col("parts.text"), " ").alias("text"))
    none = placed.where("n_words = 0").select("bin_id", "bin_size", "n_words", F.array("id").alias("doc_ids"), F.lit("").alias("text"))
    return bins.unionByName(none)
