"""Importance resampling against plain Python."""

import hashlib
import re
import zlib
from collections import Counter
from math import floor, log

import pyarrow as pa
import pytest

from stepweave.llm import importance
from stepweave.llm.queries import op11_importance_resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
ODD = ["Abc déf, abc  x1 " + "q" * 70 + " ü", "", None, "...", "one", "A b c " * 50, "\0a\0b", "ÀB ſtrange İ", "x" * 200, "É é"]


def features(text, order=2):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i:i + k]).encode()) % 10000 for k in range(1, order + 1) for i in range(len(w) - k + 1)]


def brute(docs, target):
    """(doc_id, n_features, weight, score, rank) of (doc_id, text)."""
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    size_s, size_t = sum(s.values()), sum(t.values())
    gain = lambda b: floor(1000 * log((t[b] + 1) * (size_s + 10000) / ((s[b] + 1) * (size_t + 10000))))
    rows = []
    for key, text in docs:
        n_words, f = features(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'null' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append((n_words, key, len(f), weight, weight + floor(-1000 * log(-log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[0] >= 20), key=lambda r: (-r[4], r[1] is None, r[1]))
    drawn = len(able) * 25 // 100
    ranks = Counter((r[1:], k + 1) for k, r in enumerate(able[:drawn]))
    rest = Counter((r[1:], None) for r in [r for r in rows if r[0] < 20] + able[drawn:])
    return Counter({(*r, k): n for (r, k), n in (ranks + rest).items()})


@pytest.mark.parametrize("piece", [8 << 20, 64, 7, 1])
@pytest.mark.parametrize("order", [1, 2, 3])
def test_features_of_pieces(monkeypatch, piece, order):
    monkeypatch.setattr(importance, "PIECE_BYTES", piece)
    got = Counter()
    for rows, texts, carried in importance._pieces(pa.array(ODD, pa.string()), order):
        for row, bucket in importance._features(rows, texts, carried, order, 10000):
            got.update(zip(row.tolist(), bucket.tolist()))
    assert got == Counter((i, b) for i, text in enumerate(ODD) for b in features(text, order)[1])


def test_crc_of_words_and_pairs():
    words = ["a", "é", "", "x" * 47, "x" * 48, "y" * 300, "b" * 5]
    crc, size = importance.word_crcs(pa.array(words))
    assert crc.tolist() == [zlib.crc32(w.encode()) for w in words] and size.tolist() == [len(w.encode()) for w in words]
    assert importance._joined(crc, crc[::-1], size[::-1]).tolist() == [zlib.crc32(f"{a} {b}".encode()) for a, b in zip(words, words[::-1])]


def test_odd_rows_against_plain_python(make_docs):
    rows = [(i, t, "en", "a") for i, t in enumerate(ODD * 3)] + [(5, ODD[5]), (None, "z " * 30), (None, "z " * 30), (7, "word " * 40_000)] + [(i, f"Some words {i} " * (i % 9 + 5)) for i in range(60, 90)]
    docs, target = make_docs(rows), make_docs([(1, "some words abc"), (2, None), (3, "")])
    got = Counter(tuple(r[c] for c in ("id", "n_features", "weight", "score", "rank")) for r in importance.importance_report(docs, target).collect())
    assert got == brute([r[:2] for r in rows], ["some words abc", None, ""])
    drawn = importance.resampled(docs, target)
    assert drawn.columns == docs.columns and drawn.count() == sum(n for r, n in got.items() if r[-1] is not None)


def test_empty_tables_and_clashing_columns(make_docs, no_docs, odd_docs):
    assert importance.importance_report(no_docs, odd_docs).count() == 0
    assert importance.importance_report(odd_docs, no_docs).count() == odd_docs.count()
    docs = make_docs([(1, "a b " * 20, "en", "a", 7, 8, 9)], "doc_id long, text string, lang string, source string, row long, rank long, codes long")
    out = importance.scored(docs, odd_docs)
    assert out.columns == [*docs.columns, "_n_features", "_weight", "_score", "_rank"] and out.first()["rank"] == 8
    with pytest.raises(ValueError, match="_score"):
        importance.scored(docs.withColumnRenamed("rank", "_score"), odd_docs)


def test_query_against_plain_python(spark):
    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert Counter(tuple(r) for r in op11_importance_resampling(spark, folder).collect()) == brute(docs, target)
