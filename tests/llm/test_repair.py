"""Conversation repair against a plain search over all edits."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from stepweave.llm import conversation_repair as repair
from stepweave.llm.queries import op12_conversation_repair

SPACE = " \t\n\x0b\x0c\r"


def sort_key(row):
    turn, role, text = row
    return (turn is not None, turn or 0, role, hashlib.md5(text.encode()).hexdigest())


def brute_damage(rows):
    """conv -> rows after damage, of (conv, turn, role, text)."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        out[conv]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(r, key=sort_key) for c, r in out.items()}


def brute_repair(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, digest of one conversation, by Dijkstra over (row, state)."""
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    roles = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
    grammar = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, turns_out = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            break
        if (i, state) in done:
            continue
        done.add((i, state))
        for role in ("user", "assistant"):
            if (state, role[0]) in grammar:
                heapq.heappush(heap, (cost + 3, audit + "I", i, role[0], (*turns_out, f"{role}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, turns_out))
            if faults[i] not in ("blank", "duplicate"):
                extra = 3 if faults[i] == "truncated" else 0
                if (state, roles[i]) in grammar:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, grammar[state, roles[i]], (*turns_out, f"{role}:{text}")))
                for to in ("user", "assistant"):
                    if (state, to[0]) in grammar:
                        heapq.heappush(heap, (cost + extra + 3, audit + "R", i + 1, to[0], (*turns_out, f"{to}:{text}")))
    digest = hashlib.sha256("\n".join(turns_out).encode()).hexdigest()
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, digest)


def tuples(report):
    return {r["conv"]: tuple(r)[1:] for r in report.collect()}


def random_rows(seed, convs, most):
    r = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(r.randint(1, most)):
            role = r.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]) if r.random() < 0.4 else ("user", "assistant")[t % 2]
            text = r.choice(["Hi.", "Yes!", "no end", " \t", "", None, "Why? ", "é.", f"text {t}."])
            rows.append((c, r.choice([t, t, t, 2 * t, None]), role, text))
    return rows


@pytest.fixture(scope="module")
def make_convs(spark):
    return lambda rows, schema="conv_id long, turn long, role string, text string": spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("chunk", [1, 3, 1024])
def test_repair_against_search(make_convs, chunk):
    rows = random_rows(chunk, 60, 12) + [(None, t, "user", "Hello.") for t in range(3)] + [(9, None, None, None)]
    convs = make_convs(rows)
    report, text = repair.repair(repair.damaged(repair.named(convs)), chunk=chunk)
    want = {c: brute_repair(r) for c, r in brute_damage(rows).items()}
    assert tuples(report) == want
    parts = defaultdict(list)
    for r in text.orderBy("chunk").collect():
        if r["text"]:
            parts[r["conv"]].append(bytes(r["text"]))
    for conv, values in want.items():
        assert hashlib.sha256(b"\n".join(parts[conv])).hexdigest() == values[-1]


def test_one_hot_conversation_is_many_chunks(make_convs):
    r = random.Random(5)
    rows = [(1, t, r.choice(["user", "assistant", "user", "assistant", "system"]), r.choice(["Yes.", "No", f"t{t}."])) for t in range(3000)] + random_rows(6, 40, 5)[:80]
    rows = [(c if c == 1 else c + 10, *x) for c, *x in rows]
    chunks = repair._chunked(repair.named(make_convs(rows)), 64, False)
    assert chunks.where("conv = '1'").count() >= 3000 // 64
    report, _ = repair.repair(repair.damaged(repair.named(make_convs(rows))), chunk=64)
    assert tuples(report) == {c: brute_repair(x) for c, x in brute_damage(rows).items()}


def test_speculative_runs_meet_the_true_ones():
    r = random.Random(3)
    for _ in range(300):
        codes = "".join(r.choice("suax") + r.choice("-dt-") for _ in range(r.randint(0, 30)))
        first, second = ([r.randint(0, 6) for _ in range(4)] for _ in range(2))
        first, second = repair._closed(first), repair._closed([c + r.randint(0, 50) for c in second])
        assert repair.begin_again(codes, first, repair.begin(codes, first), second) == repair.begin(codes, second)


def test_odd_tables(make_convs, spark):
    assert repair.repair(repair.named(make_convs([])))[0].count() == 0
    schema = "conv_id string, turn int, role string, text string, row string, at long, conv long, chunk long, alive boolean, salt long, kind long, again long, part long"
    long = "word " * 200_000
    rows = [("a", 0, "user", long + ".") + ("x",) + (1, 2, 3, False, 4, 5, 6, 7), ("a", 1, "assistant", long + "!") + (None,) * 9, (None, None, None, None) + (None,) * 9]
    got = tuples(repair.repair(repair.named(make_convs(rows, schema)))[0])
    assert got["a"][:7] == (0, 0, 0, 0, 0, 0, "KK") and got[None][:7] == (0, 1, 0, 0, 0, 4, "D")
    assert got["a"][7] == hashlib.sha256(f"user:{long}.\nassistant:{long}!".encode()).hexdigest()


def test_query_against_search(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r)[1:] for r in op12_conversation_repair(spark, folder).collect()}
    assert got == {c: brute_repair(r) for c, r in brute_damage(rows).items()}
