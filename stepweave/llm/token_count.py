"""Token counts of a unigram tokenizer without making the tokens.

An Aho-Corasick automaton finds every vocabulary piece in a text.  Dynamic programming over end positions carries the
best score and the number of pieces on the best path; no path is kept.

Tie rules are the tokenizer's: candidates for an end are tried from the earliest start on, and only a strictly better
score replaces the one before, so the longest of equally good last pieces wins.  A character that no piece
covers alone costs the least score of the vocabulary less 10 and is written as its UTF-8 bytes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepweave.llm.common import boxed, unboxed

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Counted words that a Python worker remembers; longer words are counted each time.
REMEMBERED, LONGEST_REMEMBERED = 500_000, 64


def vocabulary(path: str = MODEL) -> list[tuple[str, float]]:
    """Pieces that text can match, with their scores, from a tokenizer's file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in plain]


class Counts:
    """Counts pieces under one vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        self.find = ahocorasick.Automaton()
        for piece, score in pieces:
            self.find.add_word(piece, (len(piece), score))
        if pieces:
            self.find.make_automaton()
        self.any = bool(pieces)
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        # a text may be cut before a space mark if no piece goes on over it
        self.cut = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _ in pieces)
        self.words = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.memo: dict[str, tuple[float, int]] = {}

    def best(self, text: str) -> tuple[float, int]:
        """Score and number of pieces of the best segmentation of ``text``, taken as it is."""
        n = len(text)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        end = 0  # ends before this one are settled

        def step(to: int) -> None:
            """Settle ends up to ``to`` that no piece reaches: their last character is unknown."""
            nonlocal end
            while end < to:
                end += 1
                score[end] = score[end - 1] + self.unknown
                count[end] = count[end - 1] + len(text[end - 1].encode("utf-8", "surrogatepass"))

        here, top, pieces, alone = 0, 0.0, 0, False

        def settle() -> None:
            nonlocal end
            if not here:
                return
            best, k = top, pieces
            if not alone:  # the unknown character is tried last
                other = score[here - 1] + self.unknown
                if other > best:
                    best, k = other, count[here - 1] + len(text[here - 1].encode("utf-8", "surrogatepass"))
            score[here], count[here] = best, k
            end = here

        for last, (length, value) in self.find.iter(text) if self.any else ():
            if last + 1 != here:
                settle()
                step(last)
                here, alone = last + 1, False
                top, pieces = score[here - length] + value, count[here - length] + 1
            elif score[here - length] + value > top:
                top, pieces = score[here - length] + value, count[here - length] + 1
            alone = alone or length == 1
        settle()
        step(n)
        return score[n], count[n]

    def of(self, text: str) -> tuple[float, int]:
        """Score and token count of a text: blanks become space marks, one is put in front."""
        if not text:
            return 0.0, 0
        marked = SPACE + text.replace(" ", SPACE)
        if not self.cut:
            return self.best(marked)
        score, n = 0.0, 0
        for word, times in Counter(self.words.findall(marked)).items():
            known = self.memo.get(word)
            if known is None:
                known = self.best(word)
                if len(word) <= LONGEST_REMEMBERED:
                    if len(self.memo) >= REMEMBERED:
                        self.memo.clear()
                    self.memo[word] = known
            score += known[0] * times
            n += known[1] * times
        return score, n


def counted(docs: DataFrame, text_col: str = "text", model: str = MODEL) -> DataFrame:
    """``docs`` with ``_n_tokens`` and ``_score``, the score of the best segmentation.  Null and empty texts have no tokens.

    Raises if ``docs`` has such columns; others may have any names.  A text is held in memory a few times over.
    ``model`` is read by the driver; its pieces go to the executors.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(model))

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counts = Counts(shared.value)
        for texts in batches:
            yield pd.DataFrame([counts.of(t or "") for t in texts], columns=["score", "n"])

    kind = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("n", T.LongType())])
    out = docs.select(boxed(docs), F.pandas_udf(count, kind)(F.col(text_col)).alias("t"))
    return unboxed(out.select("row", F.col("t.n").alias("_n_tokens"), F.col("t.score").alias("_score")), "_n_tokens", "_score")
