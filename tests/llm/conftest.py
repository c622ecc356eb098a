import pytest


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text, lang, source) with shorter rows filled by null."""
    def make(rows, schema="doc_id long, text string, lang string, source string"):
        width = len(schema.split(","))
        return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], schema)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls in every column, empty and long texts, repeated rows, and columns whose names the operators also use."""
    long = "word " * 30_000
    rows = [(1, "alpha beta gamma delta", "en", "a"), (1, "alpha beta gamma delta", "en", "a"), (2, None, None, None), (3, "", "en", "b"),
            (None, "alpha beta gamma delta", None, "a"), (4, " \t\n", "fr", None), (5, long, "en", "a"), (6, long + "end", "en", "b"),
            (7, "élan vital ß 你好", "fr", "b"), (None, None, None, None), (8, "1234 5678", "en", "a")]
    schema = "doc_id long, text string, lang string, source string, n long, node long, bucket long, size long, digest string, at string, block long, id long, copy long"
    return make_docs(rows, schema)


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])


#: Names that the operators give their own columns, in the tables between and in results.
OWN_NAMES = ("row at id n norm digest keep_id keep_at n_chars first node key bands bucket names component least size source_key copies copy guess letters lang2 "
             "t judged place u kinds share _at _id _size _copy _rate _target _source_size _source_key _copies _digest _keep_at _keep_id _kept _cut _guess _letters _t "
             "_lang _score _host _path _rule _verdict _n_tokens _judged _n_shingles _component_id _group_size _sha _n_bytes _starts _ends _metadata2").split()


@pytest.fixture(scope="session")
def clashing_docs(spark):
    """Documents whose other columns have all names that the operators use themselves, each with values of its own."""
    def make(leave=()):
        names = [n for n in OWN_NAMES if n not in leave]
        texts = ["alpha beta gamma delta epsilon zeta eta theta", "alpha beta gamma delta epsilon zeta eta theta", "Un texte tout autre, sans rien de commun", None, "", "x " * 300]
        rows = [(i, t, ("en", "fr")[i % 2], ("a", "b")[i % 2], *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names)), names

    return make
