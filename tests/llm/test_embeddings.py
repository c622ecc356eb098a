"""Near-duplicate vectors against all cosines."""

import numpy as np
import pytest

from stepweave.llm import embedding_dedup as dedup
from stepweave.llm.queries import op13_embedding_near_dedup

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, cosine=0.95):
    """(id, links, component id) per row of (id, vector)."""
    units = []
    for _, v in rows:
        ok = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        units.append(np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None)
    links = [[j for j, w in enumerate(units) if j != i and u is not None and w is not None and len(u) == len(w) and u @ w >= cosine] for i, u in enumerate(units)]
    low = [r[0] for r in rows]
    least = lambda a, b: a if b is None or (a is not None and a <= b) else b
    while True:
        new = list(low)
        for i, at in enumerate(links):
            for j in at:
                new[i] = least(new[i], low[j])
        if new == low:
            return sorted(((r[0], len(n), c) for r, n, c in zip(rows, links, low)), key=str)
        low = new


def found(df, **how):
    return sorted(((r["id"], r["n_links"], r["component_id"]) for r in dedup.near_groups(df, **how).collect()), key=str)


def clustered(seed, sizes, d, spread):
    """Clusters of noisy copies whose angles stay clear of the threshold or do not, by ``spread``."""
    r = np.random.default_rng(seed)
    rows = []
    for n in sizes:
        centre = r.standard_normal(d)
        centre /= np.linalg.norm(centre)
        rows += [(centre + r.standard_normal(d) / np.sqrt(d) * s) * r.choice([0.01, 1.0, 300.0]) for s in r.choice(spread, n)]
    return [(i, [float(x) for x in rows[k]]) for i, k in enumerate(r.permutation(len(rows)))]


@pytest.mark.parametrize("spread", [[0.0, 0.05, 0.12], [0.05, 0.2, 0.3, 0.34], [0.6]])
def test_clusters_against_all_cosines(spark, spread):
    rows = clustered(len(spread), [1] * 30 + [2] * 20 + [7] * 5 + [150, 500], 32, spread)
    assert found(spark.createDataFrame(rows, SCHEMA), miss=1e-9) == brute(rows)


def test_blocks_meet_each_other(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK", 16)
    rows = clustered(11, [200, 90, 3], 16, [0.1, 0.31, 0.35])
    assert found(spark.createDataFrame(rows, SCHEMA), miss=1e-9) == brute(rows)


def test_few_links_are_missed_at_the_threshold(spark):
    r = np.random.default_rng(2)
    rows, angle = [], np.arccos(0.9501)
    for i in range(600):
        a, b = r.standard_normal((2, 48))
        a /= np.linalg.norm(a)
        b -= (b @ a) * a
        rows += [(2 * i, a.tolist()), (2 * i + 1, (np.cos(angle) * a + np.sin(angle) * b / np.linalg.norm(b)).tolist())]
    got = found(spark.createDataFrame(rows, SCHEMA))
    assert sum(n for _, n, _ in got) >= 2 * 600 * 0.99


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (1, v), (2, None), (3, []), (4, [0.0, 0.0, 0.0]), (5, [1.0, None, 2.0]), (6, [float("nan"), 1.0, 1.0]), (7, [float("inf"), 1.0, 1.0]),
            (None, v), (None, None), (0, [10.0, 20.0, 30.0]), (8, [-1.0, -2.0, -3.0]), (9, [1.0, 2.0]), (10, [1e300, 2e300, 3e300]), (11, [1e-300, 2e-300, 3e-300]), (12, [-0.0, 0.0, 1.0]), (13, [0.0, -0.0, 1.0])]
    got = found(spark.createDataFrame(rows, SCHEMA))
    scaled = [(i, [x / 1e300 for x in e] if i == 10 else [x * 1e300 for x in e] if i == 11 else e) for i, e in rows]
    assert got == brute(scaled)
    assert dedup.near_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_clashing_columns_and_copies(spark):
    rows = [(i, [1.0, float(i % 3)], *range(9)) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA + ", row long, at long, node long, unit long, n long, item long, bucket long, lead long, first long")
    kept = dedup.near_dedup(df)
    assert kept.columns == df.columns and sorted(r.vec_id for r in kept.collect()) == [0, 1, 2]
    assert kept.first()["unit"] == 3


def test_float_vectors_of_the_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in op13_embedding_near_dedup(spark, folder).collect()), key=str)
    assert got == brute(rows)
