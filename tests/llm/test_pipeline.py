"""The pipeline against a version in plain Python, and the guard around the subpackage."""

import hashlib
import os
import re
import shutil
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from stepweave.llm import packing
from test_dedup import brute_groups, norm
from test_text import water_fill

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """(doc_id, words) of each piece of what the stages leave of (doc_id, text, source)."""
    docs = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    best = {}
    for r in sorted(docs, key=lambda r: (-len(r[1]), r[0])):
        best.setdefault(norm(r[1]), r)
    docs = list(best.values())
    group, _ = brute_groups({r[0]: r[1] for r in docs}, 5, 80)
    docs = [r for r in docs if group[r[0]] == r[0]]
    size, of = {r[0]: len(WORD.findall(r[1])) for r in docs}, defaultdict(int)
    for r in docs:
        of[r[2]] += size[r[0]]
    goal = water_fill(dict(of))
    pieces = []
    for key, text, source in docs:
        rate = goal[source] / of[source]
        u = int(hashlib.md5(f"mix-1:{key}".encode()).hexdigest()[:13], 16) / 2**52
        words = WORD.findall(text)
        for _ in range(int(rate) + (u < rate - int(rate))):
            pieces += [(key, tuple(words[at:at + 4096])) for at in range(0, max(1, len(words)), 4096)]
    return pieces


def pieces_of(sequences, pieces):
    """Cuts sequences into the pieces that their ids name, each of the first kind that fits."""
    by_id = defaultdict(set)
    for key, words in pieces:
        by_id[key].add(words)
    out = []
    for r in sequences:
        words = r["text"].split(" ")
        for key in r["doc_ids"]:
            fits = max((p for p in by_id[key] if tuple(words[:len(p)]) == p), key=len)
            out.append((key, fits))
            words = words[len(fits):]
        assert not words
    return out


def test_pipeline_against_plain_python(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source").collect()
    got = corpus_pipeline.run(spark, folder).collect()
    want = brute([tuple(r) for r in docs])
    assert len(want) < packing.SHARD_PIECES  # one shard
    assert Counter(pieces_of(got, want)) == Counter(want)  # word for word
    lengths = np.sort([len(words) for _, words in want])[::-1].copy()
    bins, starts, final = packing.pack(lengths)
    used = np.bincount(bins, weights=lengths).astype(int)
    assert Counter((r["n_words"], r["bin_size"]) for r in got) == Counter(zip(used.tolist(), final[np.unique(bins, return_index=True)[1]].tolist()))
    assert all(len(r["text"].split(" ")) == r["n_words"] for r in got)


def test_stages_keep_the_columns(spark, odd_docs):
    docs = odd_docs.select("doc_id", "text", "lang", "source")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/none")
        assert out.columns == docs.columns, name
        docs = out
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "/none").count() > 0


def test_run_on_an_empty_table(spark, no_docs, tmp_path):
    no_docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = corpus_pipeline.keep_languages(spark, docs, "/none")
    assert kept.count() == docs.where(r"text rlike '\\p{L}'").count()


def test_documents_stay_without_labels(spark, make_docs):
    texts = ["alpha beta", "élan vital", None, "", "12 34", "你好"]
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 3 == 1][:len(texts)]
    for lang in (None, "en"):  # none labelled; all labelled rows held out
        docs = make_docs([(i, t, lang, "a") for i, t in zip(held, texts)])
        kept = corpus_pipeline.keep_languages(spark, docs, "/none")
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.collect()) == [held[0], held[1], held[5]]


def test_the_rest_works_without_the_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "stepweave", "workload"):
        at = os.path.join(ROOT, name)
        if os.path.isdir(at):
            shutil.copytree(at, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(at, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 130 and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_nothing_else_imports_the_subpackage():
    for top, _, names in os.walk(os.path.join(ROOT, "stepweave")):
        if os.path.basename(top) != "llm":
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(top, name)) as f:
                        assert "stepweave.llm" not in f.read()
