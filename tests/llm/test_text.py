"""Mixing, packing, language ID and token counts."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stepweave.llm import language_id, mixing, packing, token_count


def water_fill(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full: set = set()
    while True:
        left = sum(sizes.values()) - sum(most * sizes[s] for s in full)
        share = {s: left * weight[s] / (sum(weight[x] for x in names if x not in full) or 1) for s in names}
        more = {s for s in names if s not in full and share[s] >= most * sizes[s]}
        if not more:
            return {s: most * sizes[s] if s in full else share[s] for s in names}
        full |= more


def test_targets(make_docs):
    r = random.Random(4)
    for k in range(4):
        rows = [(i, "w " * r.choice([0, 1, 5, 400 if i % 9 == 0 else 2]), None, r.choice(["a", "B", "é", "z", None, f"s{k}"])) for i in range(120)]
        plan = mixing.planned(make_docs(rows)).collect()
        sizes = defaultdict(int)
        for i, text, _, source in rows:
            sizes[source] += len(text.split())
        want = water_fill(sizes)
        for p in plan:
            assert p["_target"] == pytest.approx(want[p.source]) and p["_source_size"] == sizes[p.source] and 0 <= p["_copies"] <= 3
        assert sum({p.source: p["_target"] for p in plan}.values()) == pytest.approx(sum(sizes.values()))


def test_mix_odd_rows(odd_docs, no_docs):
    plan = {(r.doc_id, r.text): r for r in mixing.planned(odd_docs).collect()}
    assert plan[(None, None)]["_size"] == 0 and plan[(2, None)]["_source_size"] == 0
    out = mixing.mix(odd_docs)
    assert out.columns == odd_docs.columns
    assert out.count() == mixing.planned(odd_docs).agg(F.sum("_copies")).first()[0] == mixing.mix(odd_docs).count()
    assert mixing.mix(no_docs).count() == 0


def test_mix_comes_near_its_targets(make_docs):
    docs = make_docs([(i, "w " * 5, None, f"s{i % 5}") for i in range(20_000)])
    taken = mixing.planned(docs).groupBy("source").agg(F.sum(F.col("_copies") * F.col("_size")).alias("t"), F.first("_target").alias("g")).collect()
    assert all(abs(r.t / r.g - 1) < 0.05 for r in taken)


def slow_pack(lengths, sizes):
    """Best fit by looking at every open bin."""
    bins = []
    for i, n in enumerate(lengths):
        fit = [(b["size"] - b["used"], k) for k, b in enumerate(bins) if b["size"] - b["used"] >= n]
        if fit:
            k = min(fit)[1]
        else:
            free = sum(b["size"] - b["used"] for b in bins)
            price = lambda s: packing.cost(s) / (n + min(s - n, max(0, sum(m for m in lengths[i + 1:] if m <= s - n) - free)))
            k = len(bins)
            bins.append({"size": min((s for s in sizes if s >= n), key=lambda s: (price(s), s)), "used": 0})
        yield k, bins[k]["used"]
        bins[k]["used"] += n


def test_pack_is_best_fit():
    r = np.random.default_rng(2)
    for n in (0, 1, 40, 300):
        lengths = np.sort(r.integers(1, 65, n))[::-1].copy()
        bins, starts, final = packing.pack(lengths, (16, 32, 64))
        assert list(zip(bins.tolist(), starts.tolist())) == list(slow_pack(lengths.tolist(), (16, 32, 64)))
        used = np.bincount(bins, weights=lengths) if n else np.empty(0)
        assert all(final[i] == min(s for s in (16, 32, 64) if s >= used[bins[i]]) for i in range(n))


def test_packed_rows(odd_docs, no_docs):
    out = packing.packed(odd_docs, sizes=(64, 512), shard_pieces=20).toPandas()
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in odd_docs.collect())
    assert out.n_words.sum() == words and (out.n_words == 0).sum() == 4 and out[out.n_words == 0].bin_id.isna().all()
    real = out[out.n_words > 0].sort_values(["bin_id", "bin_start"])
    for _, b in real.groupby("bin_id"):
        assert (b.bin_start == b.n_words.cumsum() - b.n_words).all() and b.n_words.sum() <= b.bin_size.iloc[0] and b.bin_size.nunique() == 1
    for _, d in real.sort_values("piece").groupby(["text_key", "copy", real.id.isna()]):
        assert (d.piece_start == d.n_words.cumsum() - d.n_words).all()
    again = packing.packed(odd_docs, sizes=(64, 512), shard_pieces=20).toPandas()
    key = list(out.columns)
    pd.testing.assert_frame_equal(out.sort_values(key, ignore_index=True), again.sort_values(key, ignore_index=True))
    assert packing.packed(no_docs).count() == 0


def test_sequences_hold_all_words(odd_docs, no_docs):
    rows = packing.sequences(odd_docs, sizes=(64, 512), shard_pieces=20).collect()
    want = Counter(w for r in odd_docs.collect() for w in re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    assert Counter(w for r in rows for w in r["text"].split()) == want
    full = [r for r in rows if r["n_words"]]
    assert all(len(r["text"].split(" ")) == r["n_words"] <= r["bin_size"] and len(r["doc_ids"]) for r in full)
    assert Counter((r["bin_id"], r["text"], *r["doc_ids"]) for r in rows if not r["n_words"]) == Counter((None, "", i) for i in (2, 3, 4, None))
    packed = packing.packed(odd_docs, sizes=(64, 512), shard_pieces=20).where("n_words > 0")
    ids = {r["bin_id"]: [x["id"] for x in sorted(r["p"])] for r in packed.groupBy("bin_id").agg(F.collect_list(F.struct("bin_start", "id")).alias("p")).collect()}
    assert {r["bin_id"]: r["doc_ids"] for r in full} == ids
    assert packing.sequences(no_docs).count() == 0


def test_many_equal_rows_unfold(make_docs):
    out = packing.packed(make_docs([(1, "a b")] * 2500)).toPandas()
    assert sorted(out["copy"]) == list(range(1, 2501))


def slow_bits(counts, text):
    """PPM code length with escape C and exclusion, byte by byte."""
    data = b"\0" * 3 + text.encode()
    total = 0.0
    for i in range(3, len(data)):
        out: set = set()
        for k in (3, 2, 1, 0):
            seen = counts[k].get(data[i - k:i], {})
            if not seen:
                continue
            live = {s: n for s, n in seen.items() if s not in out}
            size, kinds = sum(live.values()), len(live)
            if data[i] in live:
                total -= math.log2(live[data[i]] / (size + kinds))
                break
            if kinds:
                total -= math.log2(kinds / (size + kinds))
            out |= set(seen)
        else:
            total += math.log2(256 - len(out))
    return total


def test_ppm_code_lengths_are_exact():
    sample = {"x": ["abracadabra", "abc abd", "é"], "y": ["zzz", "abba zab", ""]}
    rows = pd.DataFrame([(k, t) for k, ts in sample.items() for t in ts], columns=["lang", "text"])
    counted = pd.concat(language_id._count([rows])).groupby(["lang", "k", "gram"], as_index=False)["n"].sum()
    model = language_id.build(counted)
    for at, (lang, texts) in enumerate(sorted(sample.items())):
        counts = {k: defaultdict(Counter) for k in range(4)}
        for t in texts:
            d = b"\0" * 3 + t.encode()
            for i in range(3, len(d)):
                for k in range(4):
                    counts[k][d[i - k:i]][d[i]] += 1
        for probe in ("abracadabra", "zab", "q", "été", "", "abd zzzz?"):
            assert model.bits(probe)[at] == pytest.approx(slow_bits(counts, probe), rel=1e-5)


def test_language_odd_rows(odd_docs, no_docs):
    rows = language_id.identified(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r["_lang"] == "und") != letters and 0 <= r["_score"] <= 1
    assert language_id.identified(no_docs).count() == 0


def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    right = language_id.identified(docs).where(language_id.held_out(F.col("doc_id"))).agg(F.avg((F.col("_lang") == F.col("lang")).cast("int"))).first()[0]
    assert right > 0.98


def test_labels_and_ids_are_no_inputs(make_docs):
    base = [(i, "le chat et la souris" if i % 2 else "the cat and the mouse", "fr" if i % 2 else "en", "s") for i in range(40)]
    one = language_id.identified(make_docs(base))
    held = {r.doc_id: (r["_lang"], r["_score"]) for r in one.where(language_id.held_out(F.col("doc_id"))).collect()}
    changed = [(i, t, "fr" if i in held else lang, s) for i, t, lang, s in base]
    again = language_id.identified(make_docs(changed))
    assert held == {r.doc_id: (r["_lang"], r["_score"]) for r in again.collect() if r.doc_id in held}


def test_token_counts_match_the_tokenizer_library():
    from tokenizers import Tokenizer, models

    r = random.Random(3)
    for _ in range(60):
        pieces = {"".join(r.choice("abc▁é") for _ in range(r.randint(1, 4))): -float(r.randint(0, 5)) for _ in range(12)}
        counts = token_count.Counts(list(pieces.items()))
        bytes_ = [(f"<0x{i:02X}>", 0.0) for i in range(256)]
        other = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces.items(), *bytes_], 0, True))
        for _ in range(20):
            text = "".join(r.choice("abc éß") for _ in range(r.randint(1, 30)))
            assert counts.of(text)[1] == len(other.encode("▁" + text.replace(" ", "▁")).ids), (pieces, text)


def test_token_counts_of_documents(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer, models

    pieces = token_count.vocabulary()
    least = min(s for _, s in pieces)
    other = Tokenizer(models.Unigram([("<unk>", least), *pieces, *[(f"<0x{i:02X}>", least) for i in range(256)]], 0, True))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for r in token_count.counted(docs).collect():
        assert r["_n_tokens"] == len(other.encode("▁" + r.text.replace(" ", "▁")).ids)
    rows = token_count.counted(odd_docs).collect()
    assert all((r["_n_tokens"] == 0) == (not r.text) for r in rows) and len(rows) == odd_docs.count()
    assert token_count.counted(no_docs).count() == 0
