"""Columns of the input keep their names and values, whatever the operators call their own."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stepweave.llm import exact_dedup, importance, language_id, minhash, mixing, substring_dedup, token_count, url_filter

SAME = [exact_dedup.exact_dedup, minhash.near_dedup, mixing.mix, lambda d: importance.resampled(d, d, min_words=1)]
MORE = [(mixing.planned, ["_size", "_source_size", "_target", "_rate", "_copies"]), (language_id.identified, ["_lang", "_score"]), (token_count.counted, ["_n_tokens", "_score"]),
        (substring_dedup.cleaned, ["_kept"]), (lambda d: url_filter.judged(d, "text"), ["_host", "_path", "_rule", "_verdict"])]


def own_values_kept(out, names):
    for r in out.collect():
        assert all(r[n] == f"{n}{r['doc_id']}" for n in names)


@pytest.mark.parametrize("operator", SAME)
def test_operators_that_choose_rows(clashing_docs, operator):
    docs, names = clashing_docs()
    out = operator(docs)
    assert out.columns == docs.columns and out.count() > 0
    own_values_kept(out, names)


@pytest.mark.parametrize("operator, added", MORE)
def test_operators_that_add_columns(clashing_docs, operator, added):
    docs, names = clashing_docs(leave=added)
    out = operator(docs)
    assert out.columns == [*docs.columns, *added] and out.count() == docs.count()
    own_values_kept(out, names)
    with pytest.raises(ValueError, match=added[0]):
        operator(docs.withColumn(added[0], F.lit(1)))


def test_stages(spark, clashing_docs):
    docs, names = clashing_docs()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/none")
        assert out.columns == docs.columns and out.count() > 0
        own_values_kept(out, names)
        docs = out


@pytest.mark.parametrize("key", [7, None])
def test_language_sample_with_one_id(make_docs, key):
    texts = {"en": "the house of the rising sun number {}", "fr": "la maison du soleil levant numéro {}"}
    docs = make_docs([(key, texts[k].format(i), k, "a") for i in range(2500) for k in texts] + [(1, "the house", None, "a"), (2, "la maison", None, "a")])
    got = {r.doc_id: r["_lang"] for r in language_id.identified(docs).where("lang IS NULL").collect()}
    assert got == {1: "en", 2: "fr"}


def test_language_sample_of_repeated_rows(make_docs):
    docs = make_docs([(7, "the house", "en", "a")] * 4000 + [(8, "la maison", "fr", "a")])
    assert {(r.lang, r["_lang"]) for r in language_id.identified(docs).distinct().collect()} == {("en", "en"), ("fr", "fr")}
