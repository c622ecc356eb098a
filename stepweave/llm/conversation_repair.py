"""Repair of conversation structure by parallel Viterbi with rank convergence.

A conversation's turns should read ``(s?(ua)+)?``: at most one system turn, then user and assistant in turn, ending with the
assistant.  Four states (nothing yet, after system, after user, after assistant) and four edits (Delete, Insert, Keep,
Rerole) make this a shortest path; the costs to go are computed from the end, and the audit is traced from the start.

Rows are range-sorted and cut into chunks of ``CHUNK`` rows, wherever a conversation is, so a hot one is many chunks in
many tasks.  A chunk first computes its costs from a speculative vector at its end.  In fix-up passes a chunk whose successor
begins with another vector runs again from its end, only until old and new vectors differ by a constant: from there on
both choose the same edits.  Tracing stitches the chunks: each gives the state that it leaves for every state that it can be
entered with, and these maps are composed by doubling.  Only the codes of the rows, a byte each, take part in the passes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepweave.llm.common import located
from stepweave.session import materialize

#: Rows and bytes of text per chunk; a longer text is a chunk of its own.
CHUNK, CHUNK_BYTES = 1024, 8 << 20
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3

# States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
_NEXT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
_TURN = ("user", "user", "assistant", "user")  # what Insert and Rerole write in each state
_AFTER = (2, 2, 3, 2)
_END = (0, 2 * INSERT, INSERT, 0)
_SPACE = " \t\n\x0b\x0c\r"


def _closed(v: list[int]) -> list[int]:
    """Costs to go from each state if turns may be inserted before what follows."""
    u, a = min(v[2], v[3] + INSERT), min(v[3], v[2] + INSERT)
    return [min(v[0], u + INSERT), min(v[1], u + INSERT), u, a]


def _step(code: str, after: list[int]) -> list[int]:
    """Costs to go before a row, from those behind it.  ``code``: initial, and ``d`` (must go), ``t`` (truncated) or ``-``."""
    out = [DELETE + c for c in after]
    if code[1] != "d":
        extra = TRUNCATED if code[1] == "t" else 0
        for s in range(4):
            out[s] = min(out[s], REROLE + extra + after[_AFTER[s]])
            kept = _NEXT[code[0]][s] if code[0] in _NEXT else None
            if kept is not None:
                out[s] = min(out[s], extra + after[kept])
    return _closed(out)


def _parallel(a: list[int], b: list[int]) -> bool:
    return all(x - a[0] == y - b[0] for x, y in zip(a, b))


def _codes(codes: str) -> list[str]:
    return [codes[i:i + 2] for i in range(0, len(codes), 2)]


def begin(codes: str, end: list[int]) -> list[int]:
    """Costs to go at the begin of a chunk, from those at its end."""
    for code in reversed(_codes(codes)):
        end = _step(code, end)
    return end


def begin_again(codes: str, old_end: list[int], old_begin: list[int], end: list[int]) -> list[int]:
    """As :func:`begin`, but only until the vectors of both runs differ by a constant; the rest is the old run, moved by it."""
    old = old_end
    for code in reversed(_codes(codes)):
        if _parallel(old, end):
            break
        old, end = _step(code, old), _step(code, end)
    shift = end[0] - old[0]
    return [c + shift for c in old_begin] if _parallel(old, end) else end


def trace(codes: str, end: list[int], state: int, last: bool) -> tuple[str, int, int]:
    """Least audit among the cheapest, state at the end and cost, entering in ``state``.

    Letters come in the order D, I, K, R, so the first edit that is still cheapest gives the least audit.
    """
    rows = _codes(codes)
    costs = [end]
    for code in reversed(rows):
        costs.append(_step(code, costs[-1]))
    costs.reverse()
    audit, spent = [], 0
    for i, code in enumerate(rows):
        while True:
            togo, after = costs[i][state], costs[i + 1]
            extra = TRUNCATED if code[1] == "t" else 0
            if DELETE + after[state] == togo:
                audit.append("D")
                spent += DELETE
                break
            if INSERT + costs[i][_AFTER[state]] == togo:
                audit.append("I")
                spent += INSERT
                state = _AFTER[state]
                continue
            kept = _NEXT[code[0]][state] if code[1] != "d" and code[0] in _NEXT else None
            if kept is not None and extra + after[kept] == togo:
                audit.append("K")
                spent += extra
                state = kept
            else:
                audit.append("R")
                spent += REROLE + extra
                state = _AFTER[state]
            break
    while last and costs[-1][state]:
        audit.append("I")
        spent += INSERT
        state = _AFTER[state]
    return "".join(audit), state, spent


def repaired(audit: str, roles: list[str], texts: list[str], state: int, codes: str) -> list[str]:
    """``role:text`` of the turns that ``audit`` leaves."""
    out, i, kinds = [], 0, _codes(codes)
    for edit in audit:
        if edit in "IR":
            out.append(f"{_TURN[state]}:{texts[i] if edit == 'R' else ''}")
            state = _AFTER[state]
        elif edit == "K":
            out.append(f"{roles[i]}:{texts[i]}")
            state = _NEXT[kinds[i][0]][state]
        if edit != "I":
            i += 1
    return out


def _key(role: str, text: str) -> bytes:
    return hashlib.md5(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass")).digest()


def _initial(role: str) -> str:
    return role[:1] if role[:1] in ("s", "u", "a") else "x"


def _faults(roles: list[str], texts: list[str], before: set[bytes]) -> tuple[str, int, int, int]:
    """Codes of the rows, and how many are blank, duplicate and truncated; ``before``: keys of rows in earlier chunks."""
    codes, blank, twice, cut = [], 0, 0, 0
    seen = set(before)
    for role, text in zip(roles, texts):
        key = _key(role, text)
        bare = text.rstrip(_SPACE)
        kind = "-"
        if not bare:
            blank, kind = blank + 1, "d"
        elif key in seen:
            twice, kind = twice + 1, "d"
        elif bare[-1] not in ".!?":
            cut, kind = cut + 1, "t"
        seen.add(key)
        codes.append(_initial(role) + kind)
    return "".join(codes), blank, twice, cut


def _illegal(codes: str) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(codes[::2], codes[2::2]))


#: Of a chunk: what the statistics need, the audit and digest if it is a whole conversation, else its rows.
_CHUNK = ("conv string, chunk long, lo long, hi long, turns long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, digest string, "
          "text binary, roles array<string>, texts array<string>")


def _chunks(size: int, keep: bool):
    """Rows in order, cut at every change of conversation and after ``size`` rows.

    A conversation that is one chunk, and neither the first nor the last of its task, is whole: it is settled at once.
    """
    def settled(turns: list, roles: list[str], texts: list[str], whole: bool) -> tuple:
        known = [t for t in turns if t is not None]
        span = (min(known, default=None), max(known, default=None), len(set(known)))
        if not whole:
            return (*span, None, None, None, None, None, None, None, None, roles, texts)
        codes, blank, twice, cut = _faults(roles, texts, set())
        audit, _, cost = trace(codes, list(_END), 0, True)
        text = "\n".join(repaired(audit, roles, texts, 0, codes)).encode("utf-8", "surrogatepass")
        return (*span, blank, twice, cut, _illegal(codes), cost, audit, hashlib.sha256(text).hexdigest(), text if keep else None, None, None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, part, count, parts, first, heavy, ready = None, 0, 0, 0, True, 0, []
        turns: list[int | None] = []
        roles: list[str] = []
        texts: list[str] = []

        def cut(whole: bool) -> None:
            nonlocal turns, roles, texts, heavy, count, parts
            ready.append((now, (part << 32) + count, *settled(turns, roles, texts, whole)))
            turns, roles, texts, heavy = [], [], [], 0
            count, parts = count + 1, parts + 1

        def out() -> pd.DataFrame:
            frame = pd.DataFrame(ready, columns=[c.split()[0] for c in _CHUNK.split(", ")])
            ready.clear()
            return frame.astype({c: "Int64" for c in ("lo", "hi", "blank", "duplicate", "truncated", "illegal", "cost")})

        begun = False
        for batch in batches:
            for conv, part, turn, no_turn, alive, role, text in zip(*[batch[c].tolist() for c in ("conv", "part", "turn", "no_turn", "alive", "role", "text")]):
                if begun and conv != now:
                    cut(whole=parts == 0 and not first)
                    first, parts = False, 0
                elif begun and (len(texts) >= size or (texts and heavy + len(text) > CHUNK_BYTES)):
                    cut(whole=False)
                now, begun = conv, True
                if alive:
                    turns.append(None if no_turn else turn)
                    roles.append(role)
                    texts.append(text)
                    heavy += len(text)
            if ready:
                yield out()
        if begun:
            cut(whole=False)
            yield out()

    return run


def _summary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Faults of each chunk whose conversation goes on elsewhere, and the codes of its rows."""
    for batch in batches:
        rows = []
        for r in batch.itertuples(index=False):
            codes, blank, twice, cut = _faults(list(r.roles), list(r.texts), set(r.before) if r.before is not None else set())
            rows.append((r.chunk, blank, twice, cut, _illegal(codes), codes[:1] or None, codes[-2:-1] or None, codes))
        yield pd.DataFrame(rows, columns=["chunk", "blank", "duplicate", "truncated", "illegal", "head", "tail", "codes"])


_SUMMARY = "chunk long, blank long, duplicate long, truncated long, illegal long, head string, tail string, codes string"
_VECTOR = T.ArrayType(T.IntegerType())


@F.udf(_VECTOR)
def _begin(codes, end):
    return begin(codes, list(end))


@F.udf(_VECTOR)
def _again(codes, old_end, old_begin, end):
    return old_begin if end is None else begin_again(codes, list(old_end), list(old_begin), list(end))


@F.udf(_VECTOR)
def _exits(codes, end, last):
    return [trace(codes, list(end), s, last)[1] for s in range(4)]


def _ends(parts: DataFrame) -> DataFrame:
    """``chunk, end, entry`` for the chunks of conversations that have several (conv, chunk, before, behind, codes).

    A pass costs each open chunk a few rows only; costs differ by 6 at most between states, so vectors soon agree.
    """
    accept = F.array(*[F.lit(c) for c in _END])
    now = materialize(parts.select("chunk", "codes", "behind", accept.alias("end"), _begin("codes", accept).alias("begin")))
    while True:
        next_ = now.select(F.col("chunk").alias("behind"), F.col("begin").alias("true_end"))
        met = now.join(next_, "behind", "left")
        differ = F.expr("true_end IS NOT NULL AND exists(zip_with(true_end, end, (x, y) -> (x - true_end[0]) - (y - end[0])), d -> d != 0)")
        again = materialize(met.select("chunk", "codes", "behind", differ.alias("moved"), F.when(differ, F.col("true_end")).otherwise(F.col("end")).alias("end"),
                                       F.when(differ, _again("codes", "end", "begin", "true_end")).otherwise(F.col("begin")).alias("begin")))
        if again.where("moved").isEmpty():
            break
        now = again.drop("moved")
    # state at the begin of a chunk: maps[state at the begin of ``from``], or a state that no longer depends on it
    exits = now.select(F.col("chunk").alias("before"), _exits("codes", "end", F.col("behind").isNull()).alias("map"))
    at = parts.select("chunk", "before").join(exits, "before", "left")
    start = F.array(*[F.lit(0)] * 4)  # the first chunk is entered with nothing before it
    at = materialize(at.select("chunk", F.col("before").alias("from"), F.coalesce("map", start).alias("map")))
    while True:
        far = at.select(F.col("chunk").alias("from"), F.col("from").alias("further"), F.col("map").alias("base"))
        settled = F.expr("`from` IS NULL OR size(array_distinct(map)) = 1")
        if at.where(~settled).isEmpty():
            break
        hop = at.where(~settled).join(far, "from").select("chunk", F.col("further").alias("from"), F.expr("transform(base, s -> map[s])").alias("map"))
        at = materialize(at.where(settled).unionByName(hop))
    return now.select("chunk", "end").join(at.select("chunk", F.col("map")[0].alias("entry")), "chunk")


def _edits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Audit, cost and repaired turns of each chunk."""
    for batch in batches:
        rows = []
        for r in batch.itertuples(index=False):
            alone = r.end is None
            state = 0 if alone else int(r.entry)
            audit, _, cost = trace(r.codes, list(_END if alone else r.end), state, r.is_last)
            turns = repaired(audit, list(r.roles), list(r.texts), state, r.codes)
            rows.append((r.chunk, audit, cost, len(turns), "\n".join(turns).encode("utf-8", "surrogatepass")))
        yield pd.DataFrame(rows, columns=["chunk", "audit", "cost", "n_turns", "text"])


def _stitched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digest per conversation, from the texts of its chunks in order; a text is let go as soon as it is hashed."""
    now, digest, some = None, None, False
    for batch in batches:
        for first, n, text in zip(batch["first"], batch["n_turns"], batch["text"]):
            if first != now:
                if now is not None:
                    yield pd.DataFrame({"first": [now], "digest": [digest.hexdigest()]})
                now, digest, some = first, hashlib.sha256(), False
            if n:
                digest.update(b"\n" + text if some else text)
                some = True
    if now is not None:
        yield pd.DataFrame({"first": [now], "digest": [digest.hexdigest()]})


def named(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv, turn, role, text, alive`` and ``salt``, a number from where the row lies; null roles and texts are one space."""
    row = F.col("row")
    blank = lambda c: F.coalesce(row.getField(c).cast("string"), F.lit(" "))
    return located(convs).select(row.getField(conv_col).alias("conv"), row.getField(turn_col).cast("long").alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"),
                                 F.lit(True).alias("alive"), F.xxhash64("at").alias("salt"))


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (see :func:`named`) after damage by CRC-32 of ``conv:turn`` modulo 20; null counts as one space.

    0 drops a row (it stays here, not alive), 1 empties its text, 2 takes ``.``, ``!`` and ``?`` out, 3 repeats it, 4 makes it a user's.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.col("kind")
    rows = rows.withColumn("kind", F.crc32(F.concat(blank("conv"), F.lit(":"), blank("turn")).cast("binary")) % 20)
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text).withColumn("role", F.when(kind == 4, "user").otherwise(F.col("role"))).withColumn("alive", kind != 0)
    return rows.withColumn("again", F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "again")


def _chunked(rows: DataFrame, chunk: int, keep: bool) -> DataFrame:
    # the hash and the salt let Spark split rows that are equal in conversation, turn and role; rows equal in all may lie in any order
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.md5(F.col("text").cast("binary")).asc(), F.col("salt").asc()]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.select(F.col("conv").cast("string").alias("conv"), F.spark_partition_id().cast("long").alias("part"), F.coalesce("turn", F.lit(0).cast("long")).alias("turn"),
                         F.col("turn").isNull().alias("no_turn"), "alive", "role", "text")
    return materialize(dealt.mapInPandas(_chunks(chunk, keep), _CHUNK))


def _repeats(chunks: DataFrame) -> DataFrame:
    """``chunk, before``: keys of rows that a chunk has and an earlier chunk of its conversation had."""
    keys = F.udf(lambda roles, texts: sorted({_key(a, b) for a, b in zip(roles, texts)}), T.ArrayType(T.BinaryType()))
    each = materialize(chunks.select("conv", "chunk", F.explode(keys("roles", "texts")).alias("key")))
    first = each.groupBy("conv", "key").agg(F.min("chunk").alias("first"), F.max("chunk").alias("last")).where("first < last").select(F.col("conv").alias("c"), F.col("key").alias("k"), "first")
    later = each.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k"))).where("chunk > first")
    return materialize(later.groupBy("chunk").agg(F.collect_list("key").alias("before")))


def repair(rows: DataFrame, chunk: int = CHUNK, keep: bool = True) -> tuple[DataFrame, DataFrame]:
    """A row per conversation, and the repaired text, for ``rows`` (see :func:`named`; those that are not alive only name their conversation).

    The first has ``conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``; the second ``conv, chunk, text``: the
    repaired ``role:text`` in the order of chunks, joined by newlines (without ``keep`` only of conversations of several chunks).
    Rows are taken by turn (null first), then role and MD5 of the text.  The null conversation is one of its own.  A role
    whose initial is none of s, u, a must be deleted or reroled.  A conversation without rows that are alive has zeros, an empty
    audit and the hash of nothing; without any rows there is no result row.  A role and text repeated whole are a duplicate.

    The hash of a conversation is one stream by nature: its repaired chunks pass one task in order, a batch at a time.
    """
    kind = dict(rows.dtypes)["conv"]
    chunks = _chunked(rows, chunk, keep)
    typed = F.col("conv").cast(kind).alias("conv")
    settled = chunks.where("audit IS NOT NULL")
    several = chunks.where("audit IS NULL")
    by_conv = Window.partitionBy("conv").orderBy("chunk")
    order = materialize(several.select("conv", "chunk", "lo", "hi", "turns").withColumns({
        "before": F.lag("chunk").over(by_conv), "behind": F.lead("chunk").over(by_conv), "first": F.min("chunk").over(Window.partitionBy("conv"))}))
    told = several.select("conv", "chunk", "roles", "texts")
    facts = materialize(told.join(_repeats(told), "chunk", "left").select("chunk", "roles", "texts", "before").mapInPandas(_summary, _SUMMARY))
    known = order.select("chunk", "before", "behind").join(facts.select("chunk", "codes"), "chunk")
    control = materialize(_ends(known.where("before IS NOT NULL OR behind IS NOT NULL")))
    ready = told.join(known.select("chunk", "codes", F.col("behind").isNull().alias("is_last")), "chunk").join(control, "chunk", "left")
    edits = materialize(ready.select("chunk", "roles", "texts", "codes", "is_last", "end", "entry").mapInPandas(_edits, "chunk long, audit string, cost long, n_turns long, text binary"))

    stitched = edits.join(order.select("chunk", "first"), "chunk").select("first", "chunk", "n_turns", "text").repartition("first").sortWithinPartitions("first", "chunk")
    stitched = materialize(stitched.mapInPandas(_stitched, "first long, digest string"))
    # what happens between the chunks of a conversation
    last = lambda c: F.last(c, ignorenulls=True).over(by_conv.rowsBetween(Window.unboundedPreceding, -1))
    linked = order.join(facts.drop("codes"), "chunk").join(edits.select("chunk", "audit", "cost"), "chunk").withColumns({"left_role": last("tail"), "left_turn": last("hi")})
    linked = linked.withColumn("illegal", F.col("illegal") + F.expr("CASE WHEN left_role IS NULL OR head IS NULL OR concat(left_role, head) IN ('su', 'ua', 'au') THEN 0 ELSE 1 END"))
    linked = linked.withColumn("turns", F.col("turns") - F.expr("CASE WHEN left_turn = lo THEN 1 ELSE 0 END"))
    sums = [F.sum(c).alias(c) for c in ("turns", "blank", "duplicate", "truncated", "illegal", "cost")]
    audit = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("chunk", "audit"))), lambda x: x["audit"]))
    joint = linked.groupBy("conv").agg(F.min("first").alias("first"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), *sums, audit.alias("audit")).join(stitched, "first")
    fields = ["conv", "lo", "hi", "turns", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "digest"]
    gaps = F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("turns"), F.lit(0).cast("long"))
    report = settled.select(*fields).unionByName(joint.select(*fields)).select(
        typed, gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("digest").alias("repaired_sha256"))
    text = settled.select("conv", "chunk", "text").unionByName(edits.join(order.select("conv", "chunk"), "chunk").select("conv", "chunk", "text"))
    return report, text.select(typed, "chunk", "text")
