"""Language identification by prediction by partial matching.

Per language a tree of byte contexts of order 0 to 3 is counted over a bounded, hashed sample.  The statistics are
then frozen: each pair of context and next byte has one code length, found by escape method C with exclusion (a byte
seen in the longer context is not counted again in the shorter one), down to a uniform choice among bytes never
seen.  A text gets the language under which its code is shortest.

Because nothing is updated while scoring, the code length of a byte depends on its last three bytes only.  All code
lengths are laid out in one table, and a text is scored by looking up its positions with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepweave.llm.common import boxed, unboxed, uniform

ORDER = 3
#: Expected number of sampled texts per language; all of them if there are fewer.
SAMPLE_ROWS = 1500
#: Bytes that the table of code lengths, a copy of which every worker holds, may take at most.
MODEL_BYTES = 1 << 30
#: Positions of a text that are scored at a time.
STEP = 1 << 20
UNDETERMINED = "und"


@dataclass
class Model:
    """``table[state, symbol, language]`` in bits; ``symbol_of`` maps bytes to symbols, ``state_of`` three symbols to states."""

    languages: list[str]
    symbol_of: np.ndarray
    state_of: np.ndarray
    table: np.ndarray

    def bits(self, text: str) -> np.ndarray:
        """Exact code length of the whole text in bits, per language."""
        n = self.table.shape[1]
        flat = self.table.reshape(-1, self.table.shape[2])
        data = np.frombuffer(b"\0" * ORDER + text.encode("utf-8", "surrogatepass"), np.uint8)
        total = np.zeros(len(self.languages))
        for start in range(ORDER, len(data), STEP):
            s = self.symbol_of[data[start - ORDER:start + STEP]]
            state = self.state_of[(s[:-3] * n + s[1:-2]) * n + s[2:-1]]
            total += np.take(flat, state * n + s[ORDER:], axis=0).sum(axis=0, dtype=np.float64)
        return total


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``lang, k, gram, n``: how often each run of k + 1 bytes occurs; texts are preceded by three zero bytes."""
    for rows in batches:
        for lang, texts in rows.groupby("lang")["text"]:
            found: dict[int, list[np.ndarray]] = {k: [] for k in range(ORDER + 1)}
            for text in texts:
                d = np.frombuffer(b"\0" * ORDER + text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64)
                gram = d[ORDER:]
                for k in range(ORDER + 1):
                    if k:
                        gram = gram | (d[ORDER - k:len(d) - k] << (8 * k))
                    found[k].append(gram)
            for k, grams in found.items():
                values, n = np.unique(np.concatenate(grams), return_counts=True)
                yield pd.DataFrame({"lang": lang, "k": k, "gram": values, "n": n})


def _code_lengths(seen: list[np.ndarray], parent: list[np.ndarray]) -> list[np.ndarray]:
    """Bits of each symbol in each context, for one language.

    ``seen[k][c, s]`` counts symbol s after context c of order k; ``parent[k][c]`` is that context less its oldest byte.
    """
    bits = []
    below = None  # per context of the order below: bits of a symbol after an escape out of it
    for k, counts in enumerate(seen):
        c = counts.astype(np.float64)
        total, kinds = c.sum(axis=1, keepdims=True), (c > 0).sum(axis=1, keepdims=True)
        if k == 0:
            escaped = np.full(c.shape, np.log2(max(1, 256 - int(kinds[0, 0]))))
        else:
            up = seen[k - 1][parent[k]].astype(np.float64)
            up[c > 0] = 0  # exclusion
            left, new = up.sum(axis=1, keepdims=True), (up > 0).sum(axis=1, keepdims=True)
            with np.errstate(divide="ignore", invalid="ignore"):
                further = np.where(new > 0, np.log2((left + new) / new), 0.0) + below[parent[k]]
                escaped = np.where(up > 0, np.log2((left + new) / up), further)
        with np.errstate(divide="ignore", invalid="ignore"):
            out = np.where(total > 0, np.log2((total + kinds) / kinds), 0.0) + escaped
            bits.append(np.where(c > 0, np.log2((total + kinds) / c), out).astype(np.float32))
        below = escaped
    return bits


def build(counts: pd.DataFrame) -> Model:
    """Freeze counts ``lang, k, gram, n`` into a table of code lengths."""
    languages = sorted(counts["lang"].unique())
    known = np.unique(np.append(counts.loc[counts["k"] == 0, "gram"].to_numpy(), 0))
    symbol_of = np.zeros(256, np.int64)
    symbol_of[known] = np.arange(1, len(known) + 1)  # symbol 0: any byte that the sample lacks
    n = len(known) + 1
    contexts, rows = [], []
    for k in range(ORDER + 1):
        part = counts[counts["k"] == k]
        gram = part["gram"].to_numpy()
        code = np.zeros(len(part), np.int64)  # the context in symbols
        for j in range(k, 0, -1):
            code = code * n + symbol_of[(gram >> (8 * j)) & 255]
        contexts.append(np.unique(code))
        rows.append((part["lang"].to_numpy(), np.searchsorted(contexts[k], code), symbol_of[gram & 255], part["n"].to_numpy()))
    parent = [np.zeros(1, np.int64)] + [np.searchsorted(contexts[k - 1], contexts[k] % n ** (k - 1)) for k in range(1, ORDER + 1)]
    start = np.cumsum([0] + [len(c) for c in contexts])
    table = np.empty((start[-1], n, len(languages)), np.float32)
    for i, lang in enumerate(languages):
        seen = []
        for k, (langs, c, s, m) in enumerate(rows):
            at = langs == lang
            dense = np.zeros((len(contexts[k]), n), np.int32)
            dense[c[at], s[at]] = m[at]
            seen.append(dense)
        bits = _code_lengths(seen, parent)
        for k in range(1, ORDER + 1):  # a context that this language never saw: the longest that it did
            unseen = ~seen[k].any(axis=1)
            bits[k][unseen] = bits[k - 1][parent[k][unseen]]
        for k, b in enumerate(bits):
            table[start[k]:start[k + 1], :, i] = b
    state = np.zeros(1, np.int64)
    for k in range(1, ORDER + 1):  # of every k symbols: the state of the longest context that any language saw
        state = np.tile(state, n)
        state[contexts[k]] = start[k] + np.arange(len(contexts[k]))
    return Model(languages, symbol_of, state.astype(np.int32), table)


def held_out(id_col: Column) -> Column:
    """Rows kept from training: CRC-32 of the id as text leaves 1 modulo 3.  Null ids are not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """The model of a hashed sample of about ``sample_rows`` training rows per language; None without any.

    The sample is drawn from the distinct pairs of id and text, by the hash of both: ids may repeat or be null, and rows
    repeated whole count once, so no language with a text is left without a sample.  The model is no larger than the
    sample allows: contexts of its bytes times distinct bytes times languages.  Its size is checked before it is made
    (``MODEL_BYTES``); the counts that come to the driver are one per language and run of up to four bytes of the sample.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(~held_out(F.col("id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.withColumn("u", uniform(F.col("id"), F.xxhash64("text"), seed="ppm"))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("u").alias("kinds")).collect()  # a row per language
    if not sizes:
        return None
    share = F.element_at(F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], sample_rows / r["kinds"] if r["kinds"] > 1.2 * sample_rows else 1.0)]), F.col("lang"))
    sample = rows.where(F.col("u") < share).groupBy("lang", "u").agg(F.min("text").alias("text")).select("lang", "text")
    grams = sample.mapInPandas(_count, "lang string, k int, gram long, n long").groupBy("lang", "k", "gram").agg(F.sum("n").alias("n"))
    size = grams.agg(F.count_distinct("k", "gram"), F.count_distinct(F.when(F.col("k") == 0, F.col("gram")))).first()
    if size[0] * (size[1] + 1) * len(sizes) * 4 > MODEL_BYTES:
        raise ValueError(f"the model would exceed {MODEL_BYTES} bytes; take fewer sample_rows")
    counts = grams.toPandas()
    return build(counts) if len(counts) else None


def has_letter(text: Column) -> Column:
    """False for null."""
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def guessed(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``row`` (the columns of ``docs``), ``lang`` and ``score`` (see :func:`predicted`)."""
    if model is None or not model.languages:
        return docs.select(boxed(docs), F.lit(UNDETERMINED).alias("lang"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def guess(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        bits = np.array([m.bits(t or "") for t in texts]).reshape(len(texts), len(m.languages))
        best = bits.argmin(axis=1)
        lead = bits - bits[np.arange(len(texts)), best][:, None]
        return pd.DataFrame({"lang": [m.languages[b] for b in best], "score": 1.0 / np.exp2(-np.minimum(lead, 1000)).sum(axis=1)})

    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])
    out = docs.select(boxed(docs), F.pandas_udf(guess, kind)(F.col(text_col)).alias("guess"), has_letter(F.col(text_col)).alias("letters"))
    return out.select("row", F.when(F.col("letters"), F.col("guess.lang")).otherwise(UNDETERMINED).alias("lang"),
                      F.when(F.col("letters"), F.col("guess.score")).otherwise(0.0).alias("score"))


def predicted(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_lang`` and ``_score``, the probability of the language given that it is one of those learned.

    Texts that are null or have no letter get ``und`` and 0, and so does everything without a model.  Ties go to the
    language first in order.  Raises if ``docs`` has such columns; others may have any names.
    """
    return unboxed(guessed(docs, model, text_col).select("row", F.col("lang").alias("_lang"), F.col("score").alias("_score")), "_lang", "_score")


def identified(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with ``_lang`` and ``_score``, by a model fitted on their own labelled rows (see :func:`fit`)."""
    return predicted(docs, fit(docs, **how), how.get("text_col", "text"))
