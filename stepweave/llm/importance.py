"""Importance resampling toward a target distribution over hashed n-grams.

Texts become columns of words by Arrow kernels: ``ascii_lower``, ``split_pattern_regex``, ``list_flatten`` and
``dictionary_encode``.  Shifted dictionary indices form the n-grams; each distinct n-gram of a batch gets its CRC-32 once, put
together from the CRCs of its words.  The buckets of a document's features are stored, so that a text is cut into words only
once.  A first pass over them counts buckets: a task sends one row per bucket, however much it read.  The two histograms
become a gain per bucket, and a second pass takes the gains of a document's features and reduces them by segments.  A
hashed Gumbel term turns the highest scores into a draw without replacement.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepweave.llm.common import located, ranked, unboxed
from stepweave.session import materialize

#: What separates words after A-Z are lower-cased, and before.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SEPARATOR = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
ORDER, BUCKETS, MIN_WORDS, PERCENT, SEED = 2, 10_000, 20, 25, "7"
#: Bytes of text that are words, codes and indices at the same time; longer texts pass in pieces cut between words.
PIECE_BYTES = 8 << 20
#: Words up to this many bytes get their CRC by columns of bytes, longer ones one by one.
_SHORT = 48
_ENCODED = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_features", T.LongType()), T.StructField("codes", T.BinaryType())])


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)  # fixed value: the polynomial of CRC-32
    return c


_CRC = _crc_table()


def word_crcs(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 and length in bytes of each word."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    start, size = offsets[:-1], np.diff(offsets)
    crc = np.full(len(size), 0xFFFFFFFF, np.uint32)
    for k in range(min(int(size.max(initial=0)), _SHORT)):
        at = np.flatnonzero(size > k)
        crc[at] = (crc[at] >> 8) ^ _CRC[(crc[at] ^ data[start[at] + k]) & 255]
    crc ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > _SHORT):
        crc[i] = zlib.crc32(data[start[i]:start[i] + size[i]])
    return crc, size


def _after(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRCs moved on by ``size`` bytes, so that the CRC of what follows can be added."""
    out = crc.copy()
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        c = out[at]
        for _ in range(int(n)):
            c = (c >> 8) ^ _CRC[c & 255]
        out[at] = c
    return out


def _joined(left: np.ndarray, right: np.ndarray, right_size: np.ndarray) -> np.ndarray:
    """CRC-32 of ``left``, a space and ``right``, from the CRC-32 of both."""
    space = np.uint32(zlib.crc32(b" "))
    return _after(_after(left, np.ones(len(left), np.int64)) ^ space, right_size) ^ right


def _pieces(texts: pa.Array, order: int) -> Iterator[tuple[np.ndarray, pa.Array, int]]:
    """Row numbers, texts, and how many leading words of the first text only lead up to those that follow.

    Short texts come together up to ``PIECE_BYTES``; a longer one comes alone, in pieces.
    """
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(size) // PIECE_BYTES
    long = size > PIECE_BYTES
    begin = 0
    while begin < len(size):
        if long[begin]:
            data = texts[begin].as_py().encode()
            at, carried = 0, []
            while at < len(data):
                cut = _SEPARATOR.search(data, min(at + PIECE_BYTES, len(data)))
                end = cut.end() if cut else len(data)
                piece = pa.array([b" ".join([*carried, data[at:end]])], pa.binary()).cast(pa.string())
                yield np.array([begin]), piece, len(carried)
                words = [w for w in re.split(SEPARATORS.encode(), data[max(at, end - (1 << 16)):end].lower()) if w] if order > 1 else []
                carried = (carried + words)[1 - order:] if order > 1 else []
                at = end
            begin += 1
            continue
        end = begin + 1
        while end < len(size) and not long[end] and group[end] == group[begin]:
            end += 1
        yield np.arange(begin, end), pc.fill_null(texts.slice(begin, end - begin), ""), 0
        begin = end


def _features(rows: np.ndarray, texts: pa.Array, carried: int, order: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n-grams of 1 to ``order`` words: row and bucket of each feature, in the order of the texts."""
    split = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=SEPARATORS)
    words = pc.list_flatten(split)
    row = rows[pc.list_parent_indices(split).to_numpy()]
    there = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    if not there.all():
        words, row = words.filter(pa.array(there)), row[there]
    coded = words.dictionary_encode()
    first = coded.indices.to_numpy().astype(np.int64)
    word_crc, word_size = word_crcs(coded.dictionary)
    index, crc = first, word_crc
    for n in range(1, order + 1):
        if n > 1:  # an index of n - 1 words with the word that follows them
            pairs = pa.array(index[:len(first) - n + 1] * len(word_crc) + first[n - 1:]).dictionary_encode()
            left, right = np.divmod(pairs.dictionary.to_numpy(), len(word_crc))
            index, crc = pairs.indices.to_numpy().astype(np.int64), _joined(crc[left], word_crc[right], word_size[right])
        if len(first) < n:
            return
        whole = row[:len(row) - n + 1] == row[n - 1:]
        if carried:  # what ends in a carried word was a feature of the piece before
            whole[:max(0, carried - n + 1)] = False
        yield row[:len(row) - n + 1][whole], (crc % np.uint32(buckets)).astype(np.int64)[index[whole]]
        if len(first) == n:
            return


def _width(buckets: int) -> np.dtype:
    return np.dtype("<u2" if buckets <= 1 << 16 else "<u4")


def _encoder(order: int, buckets: int):
    width = _width(buckets)

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            n_words, n_features = np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
            rows_of, codes = [np.empty(0, np.int64)], [np.empty(0, width)]
            for rows, texts, carried in _pieces(column, order):
                lo, kinds = int(rows[0]), len(rows)
                for k, (row, bucket) in enumerate(_features(rows, texts, carried, order, buckets)):
                    count = np.bincount(row - lo, minlength=kinds)
                    n_features[lo:lo + kinds] += count
                    if k == 0:
                        n_words[lo:lo + kinds] += count
                    rows_of.append(row)
                    codes.append(bucket.astype(width))
            by_row = np.argsort(np.concatenate(rows_of), kind="stable")
            data = pa.py_buffer(np.concatenate(codes)[by_row].tobytes())
            offsets = pa.py_buffer((np.append(0, np.cumsum(n_features)) * width.itemsize).astype(np.int64).tobytes())
            packed = pa.Array.from_buffers(pa.large_binary(), len(column), [None, offsets, data]).cast(pa.binary())
            yield pa.StructArray.from_arrays([pa.array(n_words), pa.array(n_features), packed], ["n_words", "n_features", "codes"])

    encode.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(encode, _ENCODED)


def encoded(texts: Column, order: int = ORDER, buckets: int = BUCKETS) -> Column:
    """``n_words, n_features, codes`` of each text: the buckets of its features, two bytes each (four above 65,536 buckets).

    Null texts have none.  A text is cut into words once; both passes read its codes.
    """
    return _encoder(order, buckets)(texts.cast("string"))


def _codes(column: pa.Array, width: np.dtype) -> np.ndarray:
    """The codes of all rows of a column, one after the other."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]].view(width)


def histogram(codes: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: how many features of all rows of ``codes`` fall into each bucket; a task sends a row per bucket at most."""
    width = _width(buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            if len(batch):
                total += np.bincount(_codes(batch.column(0), width), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return codes.select("codes").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Per bucket the floor of 1000 times the log of its smoothed share in ``target`` over that in ``raw`` (bucket, n).

    Both are at most ``buckets`` rows, a parameter, which is why they may come to the driver.
    """
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, found in ((s, raw), (t, target)):
        for r in found.where(F.col("bucket").between(0, buckets - 1)).collect():
            counts[r["bucket"]] = r["n"]
    over, under = float(int(s.sum()) + buckets), float(int(t.sum()) + buckets)
    return np.array([floor(1000 * log((b + 1) * over / ((a + 1) * under))) for a, b in zip(s.tolist(), t.tolist())], np.int64)


def _weights(shared, buckets: int):
    width = _width(buckets)

    def weigh(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            n = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // width.itemsize
            total, some = np.zeros(len(n), np.int64), n > 0
            if some.any():
                start = (np.cumsum(n) - n)[some]
                total[some] = np.add.reduceat(np.take(shared.value, _codes(column, width)), start)
            yield pa.array(np.floor_divide(total, np.maximum(n, 1)))

    weigh.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(weigh, T.LongType())


def gumbel(id_col: Column, seed: str = SEED) -> Column:
    """Thousandths of a standard Gumbel variable, hashed from seed and id (null ids hash as ``null``)."""
    digest = F.sha2(F.concat_ws(":", F.lit(seed), F.coalesce(id_col.cast("string"), F.lit("null"))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def _drawn(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", order: int = ORDER,
           buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """``docs`` with locators, and ``at, id, n_words, n_features, weight, score, rank`` for each row of ``docs``."""
    text, key = F.col("row").getField(text_col), F.col("row").getField(id_col)
    # texts stay behind; the rows are found again by their locator if they are wanted
    base = located(docs)
    rows = materialize(base.select("at", key.alias("id"), encoded(text, order, buckets).alias("e")).select("at", "id", "e.*"))
    wanted_text = target.select(encoded(F.col(target_text_col), order, buckets).alias("e")).select("e.codes")
    gain = gains(histogram(rows, buckets), histogram(wanted_text, buckets), buckets)
    weight = _weights(docs.sparkSession.sparkContext.broadcast(gain), buckets)(F.col("codes"))
    table = rows.select("at", "id", "n_words", "n_features", weight.alias("weight"))
    table = materialize(table.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)))
    enough = table.where(F.col("n_words") >= min_words)
    wanted = enough.count() * percent // 100
    order_by = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("at").asc()]
    place = ranked(enough, order_by, "place")
    rank = F.when(F.col("place") < wanted, F.col("place") + 1).cast("long")
    rest = table.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return base, place.withColumn("rank", rank).drop("place").unionByName(rest)


def importance_report(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """A row per row of ``docs``: ``id, n_words, n_features, weight, score, rank`` (1 is the first drawn; null: not drawn).

    Features are all runs of 1 to ``order`` words.  ``weight`` is the floored mean of the gains of a row's features, 0 for texts
    without any (null and empty ones).  Of the rows with at least ``min_words`` words ``percent`` per cent are drawn, highest score
    first; ties go to the smaller id (null last), then to the first in the input, so rows repeated whole take ranks of their own.
    An empty ``docs`` gives no rows; an empty ``target`` leaves the smoothing alone to decide.
    """
    return _drawn(docs, target, **how)[1].drop("at")


def scored(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """``docs`` with ``_n_features, _weight, _score, _rank`` (see :func:`importance_report`); raises if it has such columns."""
    base, drawn = _drawn(docs, target, **how)
    found = drawn.select("at", *[F.col(c).alias(f"_{c}") for c in ("n_features", "weight", "score", "rank")])
    return unboxed(base.join(found, "at"), "_n_features", "_weight", "_score", "_rank")


def resampled(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that are drawn (see :func:`importance_report`), with the columns of ``docs``."""
    base, drawn = _drawn(docs, target, **how)
    return unboxed(base.join(drawn.where("rank IS NOT NULL").select("at"), "at", "left_semi"))
