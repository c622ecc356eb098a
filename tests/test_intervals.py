import random

import pytest

from stepweave.operators import intervals
from stepweave.operators.chunks import chunked, previous_row, running


def random_spans(seed, n=400, hot=0.6, span=3000):
    r = random.Random(seed)
    return [("hot" if r.random() < hot else f"k{r.randrange(4)}", i, r.randrange(span), r.randrange(60)) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(k, i, s, s + d) for k, i, s, d in rows], "k string, idx long, s long, e long")


@pytest.mark.parametrize("rows", [25, 10_000])
def test_windows_across_chunks(spark, rows):
    data = random_spans(1)
    df = frame(spark, data)
    c = chunked(df, ["k"], "s", rows)
    assert c.split == (rows == 25)
    c = previous_row(c, ["s", "idx"], ["idx"], "prev")
    c = running(c, ["s", "idx"], {"upto": "e"}, "sum")
    c = running(c, ["s", "idx"], {"reach": "e"}, "max", before=True)
    got = {(r.k, r.idx): (r.prev.idx if r.prev else None, r.upto, r.reach) for r in c.frame.collect()}
    want = {}
    for key in {d[0] for d in data}:
        prev, total, reach = None, 0, None
        for k, i, s, d in sorted((x for x in data if x[0] == key), key=lambda x: (x[2], x[1])):
            total += s + d
            want[k, i] = (prev, total, reach)
            prev, reach = i, max(reach or 0, s + d)
    assert got == want


def union(spans):
    out = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("rows", [20, 10_000])
def test_merge_matches_sorted_scan(spark, rows):
    data = random_spans(2, n=300)
    got = sorted(tuple(r) for r in intervals.merge_intervals(frame(spark, data), ["k"], "s", "e", rows).collect())
    want = sorted((k, s, e) for k in {d[0] for d in data} for s, e in union([(s, s + d) for kk, _, s, d in data if kk == k]))
    assert got == want


def test_touching_intervals_merge(spark):
    df = spark.createDataFrame([("a", 0, 10), ("a", 10, 20), ("a", 21, 22)], "k string, s long, e long")
    assert sorted((r.s, r.e) for r in intervals.merge_intervals(df, ["k"], "s", "e").collect()) == [(0, 20), (21, 22)]


@pytest.mark.parametrize("rows", [20, 10_000])
def test_union_overlap_matches_unit_cells(spark, rows):
    r = random.Random(3)
    data = [("hot" if i % 3 else "b", r.choice(["x", "y"]), r.randrange(500), r.randrange(1, 20)) for i in range(200)]
    df = spark.createDataFrame([(k, c, s, s + d) for k, c, s, d in data], "k string, c string, s long, e long")
    got = {r.k: (r.x_ns, r.y_ns, r.y_overlap_ns) for r in intervals.union_overlaps(df, ["k"], "s", "e", "c", ["x", "y"], "x", rows).collect()}
    for key in ("hot", "b"):
        cells = {c: {t for k, cc, s, d in data if k == key and cc == c for t in range(s, s + d)} for c in "xy"}
        assert got[key] == (len(cells["x"]), len(cells["y"]), len(cells["x"] & cells["y"]))


@pytest.mark.parametrize("closed", [True, False])
def test_point_join_matches_all_pairs(spark, closed):
    data = random_spans(4, n=250, span=800)
    points = [("hot" if i % 2 else "k1", i, random.Random(i).randrange(900)) for i in range(250)]
    p = spark.createDataFrame(points, "k string, pt long, at long")
    got = {(r.k, r.pt, r.idx) for r in intervals.join_points_to_intervals(p, frame(spark, data), ["k"], "at", "s", "e", closed).collect()}
    inside = lambda t, s, e: s <= t <= e if closed else s <= t < e
    assert got == {(k, i, j) for k, i, t in points for kk, j, s, d in data if kk == k and inside(t, s, s + d)}


@pytest.mark.parametrize("closed", [True, False])
def test_overlap_join_gives_each_pair_once(spark, closed):
    a, b = random_spans(5, n=150, span=600), [x for x in random_spans(6, n=150, span=600) if x[3] > 0]
    left = frame(spark, a).withColumnsRenamed({"idx": "i", "s": "ls", "e": "le"})
    right = frame(spark, b).withColumnsRenamed({"idx": "j", "s": "rs", "e": "re"})
    rows = intervals.join_overlapping(left, right, ["k"], "ls", "le", "rs", "re", closed).select("k", "i", "j").collect()
    got = [tuple(r) for r in rows]
    def meets(s, e, s2, e2):
        return e >= s2 and s <= e2 if closed else e > s2 and s < e2
    want = {(k, i, j) for k, i, s, d in a for kk, j, s2, d2 in b if k == kk and meets(s, s + d, s2, s2 + d2)}
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("rows", [15, 10_000])
def test_as_of(spark, rows):
    r = random.Random(7)
    points = [("hot", i, r.randrange(300)) for i in range(100)]
    marks = [("hot", r.randrange(300)) for _ in range(60)] + [("other", 5)]
    got = intervals.last_mark_at(spark.createDataFrame(points, "k string, i long, at long"), spark.createDataFrame(marks, "k string, m long"),
                                 ["k"], "at", "m", "last", rows)
    want = {i: max((m for k, m in marks if k == "hot" and m <= t), default=None) for _, i, t in points}
    assert {x.i: x["last"] for x in got.collect()} == want
