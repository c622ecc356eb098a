"""GIF, URL rules and WARC."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepweave.llm import gif, url_filter, warc
from stepweave.llm.common import scratch


@pytest.mark.parametrize("payload", [bytes(64), b"a" * 64 * 9000, os.urandom(64 * 5000), bytes(range(256)) * 300])
def test_gif_round_trip(payload):
    shown = list(gif.frames(gif.encode(payload)))
    assert b"".join(f.own()[..., 0].tobytes() for f in shown) == payload
    assert [f.start_cs for f in shown] == [gif.DELAY * i for i in range(len(shown))]


@pytest.mark.parametrize("bits", range(2, 9))
def test_lzw_of_every_depth(bits):
    r = random.Random(bits)
    for n in (0, 1, 2, 5000, 40_000):
        data = bytes(r.randrange(1 << bits) if r.random() < 0.5 else 0 for _ in range(n))
        assert gif.lzw_decode(gif.lzw_encode(data, bits), bits) == data


def test_lzw_goes_on_with_a_full_table():
    data = os.urandom(3000)
    more = os.urandom(4000)  # 12-bit codes without a clear code
    codes = [256, *data, *more, 257]
    width, free, bits = 9, 258, []
    for i, c in enumerate(codes):
        bits += [c >> b & 1 for b in range(width)]
        if i > 1 and free < 4096:
            free += 1
        width = min(12, max(9, free.bit_length()))
    stream = np.packbits(np.array(bits, np.uint8), bitorder="little").tobytes()
    assert gif.lzw_decode(stream, 8) == data + more


def picture(*blocks, size=(4, 4), flags=0x80, palette=bytes([0, 0, 0, 255, 0, 0])):
    return b"GIF89a" + bytes([size[0], 0, size[1], 0, flags, 0, 0]) + palette + b"".join(blocks) + b";"


def image(x, y, w, h, pixels, local=b"", interlaced=False):
    codes = gif.lzw_encode(bytes(pixels), 2)
    flags = (0x80 if local else 0) | (0x40 if interlaced else 0)
    return b"," + bytes([x, 0, y, 0, w, 0, h, 0, flags]) + local + b"\2" + bytes([len(codes)]) + codes + b"\0"


def control(disposal=0, delay=7, transparent=None):
    return b"!\xf9\4" + bytes([disposal << 2 | (transparent is not None), delay, 0, transparent or 0]) + b"\0"


def test_disposal_transparency_palettes_and_interlacing():
    green = bytes([0, 0, 0, 0, 255, 0])
    data = picture(
        control(1), image(0, 0, 4, 4, [1] * 16),  # red
        control(2, transparent=0), image(1, 1, 2, 2, [0, 1, 1, 0], green),  # two green pixels, then the rectangle is cleared
        b"!\xfe\5hello\0", control(3), image(0, 0, 1, 1, [0]),  # one black pixel, then what was before comes back
        image(3, 3, 1, 1, [1], green))
    a, b, c, d = gif.frames(data)
    assert (a.canvas[..., 0] == 255).all() and (a.delay_cs, b.start_cs, d.start_cs) == (7, 7, 21)
    assert b.canvas[1, 1].tolist() == [255, 0, 0, 255] and b.canvas[1, 2].tolist() == [0, 255, 0, 255] and b.transparent
    assert c.canvas[1, 2].tolist() == [0, 0, 0, 0] and c.canvas[0, 0].tolist() == [0, 0, 0, 255]
    assert d.canvas[0, 0].tolist() == [255, 0, 0, 255] and d.canvas[3, 3].tolist() == [0, 255, 0, 255]
    assert d.histogram().tolist()[1] == [0] * 7 + [1]
    rows = list(gif.frames(picture(image(0, 0, 1, 8, [1, 0, 0, 1, 0, 1, 0, 1], interlaced=True), size=(1, 8))))
    order = [0, 4, 2, 6, 1, 3, 5, 7]
    want = [0] * 8
    for value, row in zip([1, 0, 0, 1, 0, 1, 0, 1], order):
        want[row] = 255 * value
    assert rows[0].canvas[:, 0, 0].tolist() == want


def test_media_odd_rows(odd_docs, no_docs):
    rows = {(r.id, r.n_bytes): r for r in gif.media_features(odd_docs.drop("id")).collect()}
    for d in odd_docs.collect():
        raw = (d.text or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = rows[(d.doc_id, len(raw))]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media = gif.encode(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert gif.media_features(no_docs).count() == 0
    frames = gif.timed_frames(gif.stored(odd_docs.where("doc_id = 5"))).collect()
    assert [f.frame for f in frames] == list(range(len(frames))) and sum(sum(f.red_hist) for f in frames) == sum(f.width * f.height for f in frames)


def test_automaton_against_regular_expressions():
    r = random.Random(8)
    globs = ["".join(r.choice(["a", "b", "/", "*", "**", "."]) for _ in range(r.randint(0, 7))) for _ in range(90)]
    auto = url_filter.Automaton([url_filter.tokens(g) for g in globs])
    assert len(auto.start) > 2
    texts = ["".join(r.choice("ab/.c") for _ in range(r.randint(0, 12))) for _ in range(300)]
    rules = [re.compile("".join(".*" if t == url_filter.ANY else "[^/]*" if t == url_filter.STAR else re.escape(chr(t)) for t in url_filter.tokens(g)), re.S) for g in globs]
    want = np.array([[bool(x.fullmatch(t)) for x in rules] for t in texts])
    assert (auto.matches([t.encode() for t in texts]) == want).all()
    assert url_filter.tokens("a\\*") == [97, 42]


def test_url_odd_rows(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.Org/ES/x", "http://a.example.org/es/?q#f", "x://example.org/en/12", "x://example.org?/en/1", "x://notorg/", "x://org/",
            "x://b.com/fr/é", "x://com/de/", "x://com.evil/de/", "x://evil/x.org/", "x://a.net/f.exe", "x://ads.a.net/", "x://a://b.org/", "x://" + "s." * 3000 + "org/", "x://org/"]
    pages = spark.createDataFrame([(i, u, "extra") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r.page_id: (r["_host"], r["_path"], r["_rule"], r["_verdict"]) for r in url_filter.judged(pages).collect()}
    assert got[0] == ("", "", None, "block") and got[2] == ("", "", None, "block")
    assert got[4] == ("example.org", "/ES/x", "org/", "allow") and got[5] == ("a.example.org", "/es/", "example.org/es/", "block")
    assert got[6][2:] == ("example.org/en/1", "block") and got[7] == ("example.org", "", None, "allow") and got[8][2] is None
    assert got[9][2:] == ("org/", "allow") and got[10][2:] == ("com/fr/", "allow") and got[11][2:] == ("com/de/", "block") and got[12][2] is None and got[13][2] is None
    assert got[14][2:] == (None, "block") and got[15][2:] == (None, "block") and got[16][:3] == ("a:", "//b.org/", None) and got[17][2] == "org/" and got[18] == got[9]
    assert url_filter.judged(pages.where("false")).count() == 0


INNER = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


@pytest.mark.parametrize("split", ["128m", "20000b"])
def test_warc_against_the_rows_written(spark, split):
    r = random.Random(1)
    body = lambda: "".join(r.choice(["x" * 50, "WARC/1.1\r\n", INNER, "é\r\n\r\n", "\0"]) for _ in range(r.randint(0, 40)))
    rows = [(i, f"http://a/{i}", body()) for i in range(200)]
    rows += [(i, None, rows[i - 200][2]) for i in range(200, 230)] + [(230, "u", None), (231, "u\r\nX: y", ""), (None, "u", "z" * 2000), (233, "u", "z" * 2000), (233, "u", "z" * 2000)]
    want = []
    for key, _, html in rows:
        raw = (html or "").encode()
        top = max((k for k, _, h in rows if (h or "").encode() == raw and k is not None), default=None) if len(raw) >= 1000 else None
        again = top is not None and top != key
        want.append((key, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", top if again else None))
    pages = spark.createDataFrame([(*x, 1) for x in rows], "page_id long, url string, html string, id long").drop("id")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = warc.archived(pages.repartition(2)).select(warc.page_of(F.col("id")), "payload_bytes", "digest", "type", warc.page_of(F.col("refers"))).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_warc_broken_files(spark):
    path = scratch(spark)
    good = INNER.replace("999", "1")
    files = ["junk" + good, good + INNER.replace("Length: 5", "Length: none") + good, good * 2]
    for x in files:
        spark.createDataFrame([(x,)], "value string").coalesce(1).write.mode("append").option("lineSep", "\r\n").text(path)
    found = warc.read_archives(spark, path).groupBy("file").count().collect()
    assert sorted(r["count"] for r in found) == [1, 2]
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archived(empty).count() == 0
