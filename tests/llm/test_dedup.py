"""Exact, near and substring deduplication against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepweave.llm import exact_dedup, minhash, substring_dedup
from stepweave.llm.common import with_locator


def norm(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


def test_exact_odd_rows(odd_docs, no_docs):
    rows = exact_dedup.dedup_report(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert sum(r["_kept"] for r in rows) == len({norm(r.text) for r in odd_docs.collect()})
    groups = {r["_digest"]: r for r in rows}
    assert groups[hashlib.sha256(b"").hexdigest()]["_keep_id"] == 4  # the white space is the longest original
    assert groups[hashlib.sha256(b"alphabetagammadelta").hexdigest()]["_keep_id"] == 1
    kept = exact_dedup.exact_dedup(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == 6
    assert exact_dedup.exact_dedup(no_docs).count() == 0


def test_rows_repeated_in_the_plan_count_as_copies(spark, make_docs, tmp_path):
    path = str(tmp_path / "docs")
    make_docs([(i, f"text {i % 3} " + "one two three four five", "en", "a") for i in range(9)]).write.parquet(path)
    docs = spark.read.parquet(path)
    twice = docs.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))).drop("k")
    for rows in (docs.select("doc_id", "text").where("doc_id >= 0"), twice, twice.select("doc_id", "text"), spark.read.parquet(path, path)):
        placed = with_locator(rows)
        assert placed.select("_at").distinct().count() == placed.count() == rows.count()
        assert exact_dedup.exact_dedup(rows).count() == 3
    assert minhash.near_dedup(twice).count() == minhash.near_dedup(docs).count()


def test_exact_survives_digest_collisions(make_docs):
    docs = make_docs([(i, f"{i % 7} {'x' * (i % 3)}") for i in range(60)])
    weak = lambda text: F.substring(F.sha2(text.cast("binary"), 256), 1, 0)  # noqa: E731  one digest for all
    rows = exact_dedup.dedup_report(docs, digest=weak).collect()
    texts = {r.doc_id: norm(r.text) for r in docs.collect()}
    size = Counter(texts.values())
    for r in rows:
        assert texts[r["_id"]] == texts[r["_keep_id"]] and r["_group_size"] == size[texts[r["_id"]]]
    assert sum(r["_kept"] for r in rows) == len(size)


def test_state_goes_on_with_later_facts(spark, make_docs, tmp_path):
    land, check = str(tmp_path / "facts"), str(tmp_path / "state")
    for ids in (range(5), range(3, 9)):
        facts = spark.createDataFrame([(f"d{i}", i, 1, {"file": "f", "row": i}) for i in ids], "digest string, id long, n_chars int, at struct<file:string,row:long>")
        facts.write.mode("append").parquet(land)
        state = exact_dedup.stream_state(land, facts, check)
    assert {r.digest: r.n for r in state.collect()} == {f"d{i}": 2 if 3 <= i < 5 else 1 for i in range(9)}


def brute_groups(texts, width, percent):
    sets = {i: set(minhash.shingles(t, width).tolist()) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in texts}, {i: len(s) for i, s in sets.items()}


def near_copies(seed, n, spread):
    """Copies of one text with up to ``spread`` edits: many far from each other, linked by few."""
    r = random.Random(seed)
    base = [f"w{r.randrange(500)}" for _ in range(150)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(r.randrange(spread)):
            at = r.randrange(len(words))
            words[at:at + 1] = r.choice([[f"n{r.randrange(10**6)}"], [], [words[at], "again"]])
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("width, percent, spread", [(3, 85, 6), (5, 80, 8)])
def test_near_groups_are_those_of_all_pairs(make_docs, width, percent, spread):
    texts = dict(enumerate(near_copies(1, 120, spread) + near_copies(2, 40, 2) + ["One two", "one TWO", "one", "", " "]))
    rows, _ = minhash.near_groups(make_docs(list(texts.items())), width=width, percent=percent)
    want, sizes = brute_groups(texts, width, percent)
    got = {r["_id"]: r for r in rows.collect()}
    assert {i: r["_component_id"] for i, r in got.items()} == want
    assert {i: r["_n_shingles"] for i, r in got.items()} == sizes
    assert all(r["_kept"] == (i == want[i]) for i, r in got.items())


def test_near_odd_rows(odd_docs, no_docs):
    rows, _ = minhash.near_groups(odd_docs)
    rows = rows.collect()
    assert len(rows) == odd_docs.count()
    words = [r for r in rows if r["_n_shingles"] == 1]
    assert sum(r["_kept"] for r in rows if r["_component_id"] == 1) == 1 and words
    kept = minhash.near_dedup(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.where("text IS NULL").count() == 2
    assert minhash.near_dedup(no_docs).count() == 0


def test_sketch_fills_and_estimates():
    r = np.random.default_rng(5)
    for n in (1, 2, 30, 2000):
        assert (minhash.sketch(r.integers(0, 1 << 63, n, dtype=np.uint64)) >> np.uint64(48)).max() < 2 * minhash.SLOTS
    errors = []
    for _ in range(60):
        both, a, b = (r.integers(0, 1 << 63, n, dtype=np.uint64) for n in (300, 60, 40))
        same = minhash.sketch(np.concatenate([both, a])) == minhash.sketch(np.concatenate([both, b]))
        errors.append(same.mean() - 300 / 400)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def brute_spans(texts, length):
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        turns = [i for i in range(len(t) + 1) if (gone[i - 1] if i else 0) != (gone[i] if i < len(t) else 0)]
        out.append((turns[::2], turns[1::2], hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("block_bytes, bucket", [(1 << 22, 1 << 20), (3000, 200), (300, 100)])
def test_spans_are_those_of_all_strings(make_docs, block_bytes, bucket):
    r = random.Random(9)
    letters = lambda n: "".join(r.choice("abé ") for _ in range(n))
    shared = [letters(k) for k in (120, 170, 199, 200, 300, 900)]
    texts = [letters(r.randrange(300)) + r.choice(shared) + letters(r.randrange(200)) + r.choice(shared)[r.randrange(40):] for _ in range(50)]
    texts += ["x" * 199, "x" * 200, "y" * 201, "ab" * 150, "", texts[0], texts[0], "x" * 150]
    docs = make_docs(list(enumerate(texts)) + [(len(texts), None)])
    got = {r["_id"]: r for r in substring_dedup.span_report(docs, block_bytes=block_bytes, bucket=bucket).collect()}
    raw = [t.encode() for t in texts] + [b""]
    for i, (starts, ends, kept) in enumerate(brute_spans(raw, 200)):
        assert (got[i]["_starts"], got[i]["_ends"], got[i]["_kept_sha256"]) == (starts, ends, kept), i
        assert got[i]["_n_bytes"] == len(raw[i]) and got[i]["_n_removed"] == sum(ends) - sum(starts)


def test_spans_odd_rows(odd_docs, no_docs):
    out = substring_dedup.cleaned(odd_docs)
    assert set(out.columns) == {*odd_docs.columns, "_kept"} and out.count() == odd_docs.count()
    assert bytes(out.where("doc_id = 5").first()["_kept"]) == b"" and bytes(out.where("doc_id = 6").first()["_kept"]) == b"end"
    assert substring_dedup.cleaned(no_docs).count() == 0


def test_a_long_text_is_many_blocks(make_docs):
    r = random.Random(12)
    passage = "".join(r.choice("abcdé ") for _ in range(700))
    long = "".join(passage[:250 + 90 * (i % 4)] + "".join(r.choice("xyz ") for _ in range(300)) for i in range(40))
    texts = [long, "other " + passage, long[5:9000], "z" * 5000]
    got = {x["_id"]: x for x in substring_dedup.span_report(make_docs(list(enumerate(texts))), block_bytes=1000).collect()}
    for i, (starts, ends, kept) in enumerate(brute_spans([t.encode() for t in texts], 200)):
        assert (got[i]["_starts"], got[i]["_ends"], got[i]["_kept_sha256"]) == (starts, ends, kept), i
