"""WARC archives: records written by Spark's text writer, and read back in splits with verified boundaries.

Reading: a file is cut at every magic line ``WARC/1.1``, wherever it stands.  Each piece is a candidate record; its
header says where its successor begins.  A task follows these links inside its own split; between splits, pointers are
doubled from the start of the file.  Only candidates that the chain reaches are records, so a magic line (or a whole record)
inside a payload is payload.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepweave.llm.common import scratch
from stepweave.session import materialize

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Payloads of fewer bytes are always stored.
LEAST_SHARED = 1000
#: Rows per archive file.
RECORDS_PER_FILE = 100_000
_ID = "urn:page:"


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   least_shared: int = LEAST_SHARED) -> None:
    """A record per row: a response, or a revisit of the row with the largest id among those with an equal payload.

    Null payloads are empty, null URLs leave out the target; line breaks in URLs become blanks.  Payloads of
    fewer than ``least_shared`` bytes are never shared.  Rows without an id never stand for others; of rows that
    repeat the largest id, all are responses.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    size = F.octet_length("payload").cast("long")
    keyed = rows.withColumn("n", size).withColumn("key", F.when(size >= least_shared, F.sha2(F.col("payload").cast("binary"), 256)))
    first = materialize(keyed.where("key IS NOT NULL").groupBy("key").agg(F.max("id").alias("first"), F.count("*").alias("rows")).where("rows > 1").drop("rows"))
    # payloads that are never shared have no key: they stay where they are, and do not meet in one task
    alone = keyed.where("key IS NULL").withColumn("first", F.lit(None).cast(first.schema["first"].dataType))
    told = keyed.where("key IS NOT NULL").join(first, "key", "left").unionByName(alone).withColumn("again", F.coalesce(F.col("first") != F.col("id"), F.col("first").isNotNull()))

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(name + ": "), value, F.lit("\r\n")), F.lit(""))

    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    told = told.withColumn("block", F.concat(http, F.when(~F.col("again"), F.col("payload")).otherwise("")))
    urn = lambda c: F.concat(F.lit(f"<{_ID}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    record = F.concat(
        F.lit(MAGIC), line("WARC-Type", F.when(F.col("again"), "revisit").otherwise("response")), line("WARC-Record-ID", urn(F.col("id"))), line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.regexp_replace("url", "[\r\n]", " ")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1(F.col("payload").cast("binary")))),
        F.when(F.col("again"), F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", urn(F.col("first"))))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length("block").cast("string")), F.lit("\r\n"), F.col("block"))
    told.select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """Pieces between magic lines, in order within each split."""
    lines = spark.read.option("lineSep", MAGIC).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("chunk"))


def _fields(head: bytes) -> dict[bytes, bytes]:
    pairs = (x.partition(b":") for x in head.split(b"\r\n"))
    return {name.strip().lower(): value.strip() for name, colon, value in pairs if colon}


def parse(record: bytes) -> dict | None:
    """Header facts of a record (without its magic line), and those of its payload as far as ``record`` has it; None if it is no record.

    ``size`` is what header and block take up, ``whole`` says whether all of that is there.
    """
    head, gap, rest = record.partition(b"\r\n\r\n")
    named = _fields(head) if gap else {}
    length, kind = named.get(b"content-length", b""), named.get(b"warc-type")
    if not length.isdigit() or kind is None:
        return None
    n = int(length)
    block = rest[:n]
    http, gap, payload = block.partition(b"\r\n\r\n")
    told = _fields(http).get(b"content-length", b"")
    text = lambda name: named[name].decode("utf-8", "replace") if name in named else None
    revisit = kind == b"revisit"
    return {
        "size": len(head) + 4 + n, "whole": len(rest) >= n, "type": kind.decode("utf-8", "replace"), "id": text(b"warc-record-id"), "refers": text(b"warc-refers-to"), "url": text(b"warc-target-uri"),
        "payload_bytes": int(told) if revisit and told.isdigit() else len(payload),
        "digest": (text(b"warc-payload-digest") or "").removeprefix("sha1:") if revisit else hashlib.sha1(payload).hexdigest()}


FACTS = "size long, whole boolean, type string, id string, refers string, url string, payload_bytes long, digest string"
_NONE = dict.fromkeys(("size", "whole", "type", "id", "refers", "url", "payload_bytes", "digest"))


def _splits(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int, int, bytes]]:
    """``file, block, place, chunk``: place of each chunk's magic line from where its split begins.  Text before a file's first magic line is place -1."""
    now, at = None, 0
    for batch in batches:
        for file, block, chunk in zip(batch["file"], batch["block"], batch["chunk"]):
            if (file, block) != now:
                now, at = (file, block), 0
                if block == 0:
                    yield file, block, -1, chunk
                    at = len(chunk)
                    continue
            yield file, block, at, chunk
            at += len(MAGIC) + len(chunk)


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row per candidate: its place, its successor's, and where the chain through it leaves the split.

    Holds the facts (not the bytes) of one split at a time.
    """
    rows: list[dict] = []

    def leave() -> pd.DataFrame:
        length = sum(r["length"] for r in rows)
        out: dict[int, int | None] = {}
        for r in reversed(rows):
            to = r["next"]
            out[r["place"]] = r["exit"] = to if to is None or to >= length else out.get(to)
        frame = pd.DataFrame(rows)
        rows.clear()
        return frame.astype({"next": "Int64", "exit": "Int64", "size": "Int64", "payload_bytes": "Int64"})

    for file, block, place, chunk in _splits(batches):
        if rows and (rows[0]["file"], rows[0]["block"]) != (file, block):
            yield leave()
        facts = parse(chunk) if place >= 0 else None
        length = len(chunk) + (len(MAGIC) if place >= 0 else 0)
        nxt = place + len(MAGIC) + facts["size"] + len(END) if facts else None
        rows.append({"file": file, "block": block, "place": place, "length": length, "next": nxt, "exit": None, **(facts or _NONE)})
    if rows:
        yield leave()


def _follow(rows: pd.DataFrame) -> pd.DataFrame:
    """Marks the candidates of one split that the chain from ``entry`` reaches; ``owner`` is the record that a piece belongs to."""
    rows = rows.sort_values("place")
    target = rows["entry"].iloc[0]
    real, owner, last = [], [], None
    for place, nxt in zip(rows["place"], rows["next"]):
        hit = not pd.isna(target) and place == target
        if hit:
            target, last = nxt, place
        real.append(hit)
        owner.append(last)
    rows["real"], rows["owner"] = real, pd.array(owner, "Int64")
    return rows.drop(columns="entry")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``file, offset, type, id, refers, url, payload_bytes, digest`` of every record below ``path``.

    Digest and size of a response are those of the payload read; a revisit has those that it states.  A file that does not
    begin with a record has none, and a chain that breaks off ends its file.
    """
    kind = "file string, block long, place long, length long, next long, exit long, " + FACTS
    found = materialize(_chunks(spark, path).mapInPandas(_candidates, kind))
    lengths = found.groupBy("file", "block").agg(F.sum("length").alias("length"))
    base = F.coalesce(F.sum("length").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = materialize(lengths.withColumn("base", base))  # a row per split

    # between splits: from the file's start, with pointers that double
    absolute = found.where("place >= 0").join(splits.select("file", "block", "base"), ["file", "block"])
    jump = materialize(absolute.where("exit IS NOT NULL").select("file", (F.col("base") + F.col("place")).alias("at"), (F.col("base") + F.col("exit")).alias("to")))
    entries = jump.select("file", F.col("to").alias("at")).distinct()
    jump = materialize(jump.join(entries.unionByName(jump.where("at = 0").select("file", "at")).distinct(), ["file", "at"], "left_semi"))
    reached = materialize(splits.where("block = 0").select("file", F.lit(0).cast("long").alias("at")))
    while True:
        further = reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))
        more = materialize(further.join(reached, ["file", "at"], "left_anti").distinct())
        if more.isEmpty():
            break
        reached = materialize(reached.unionByName(more))
        twice = jump.select("file", F.col("at").alias("to"), F.col("to").alias("next"))
        jump = materialize(jump.join(twice, ["file", "to"]).select("file", "at", F.col("next").alias("to")))

    into = reached.join(splits, "file").where("at >= base AND at < base + length").select("file", "block", (F.col("at") - F.col("base")).alias("entry"))
    split_facts = found.where("place >= 0").join(into.groupBy("file", "block").agg(F.min("entry").alias("entry")), ["file", "block"], "left")
    followed = materialize(split_facts.groupBy("file", "block").applyInPandas(_follow, kind + ", real boolean, owner long"))
    followed = followed.join(splits.select("file", "block", "base"), ["file", "block"])
    facts = [c.split()[0] for c in FACTS.split(", ")]
    records = followed.where("real").withColumn("offset", F.col("base") + F.col("place")).select("file", "offset", *facts)
    complete = records.where("whole")

    # records whose payload holds magic lines or reaches into the next split: put their pieces together
    torn = materialize(records.where("NOT whole").select("file", "offset"))
    if torn.isEmpty():
        return complete.drop("size", "whole")
    last = F.last(F.when(F.col("last").isNotNull(), F.col("last") + F.col("base")), ignorenulls=True)
    carried = splits.join(followed.groupBy("file", "block").agg(F.max("owner").alias("last")), ["file", "block"], "left").select(
        "file", "block", last.over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    owned = followed.join(carried, ["file", "block"]).select("file", "block", "place", (F.col("base") + F.col("place")).alias("at"), F.coalesce(F.col("base") + F.col("owner"), "before").alias("offset"))
    parts = materialize(owned.join(torn, ["file", "offset"]))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for file, block, place, chunk in _splits(batches):
            yield pd.DataFrame({"file": [file], "block": [block], "place": [place], "chunk": [chunk]})

    bytes_of = _chunks(spark, path).mapInPandas(placed, "file string, block long, place long, chunk binary")

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        facts = parse(MAGIC.encode().join(rows["chunk"])) or _NONE
        return pd.DataFrame([{"file": rows["file"].iloc[0], "offset": rows["offset"].iloc[0], **facts}])

    mended = bytes_of.join(parts, ["file", "block", "place"]).groupBy("file", "offset").applyInPandas(joined, "file string, offset long, " + FACTS)
    return complete.unionByName(mended).drop("size", "whole")


def page_of(urn: Column) -> Column:
    """The page id in a record id; null if it has none."""
    return F.regexp_extract(urn, f"<{_ID}(.*)>", 1).try_cast("long")


def archived(pages: DataFrame, **how) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back (see :func:`write_archives`, :func:`read_archives`)."""
    path = scratch(pages.sparkSession)
    write_archives(pages, path, **how)
    return read_archives(pages.sparkSession, path)
