"""Providers asked in turn, against asking all; files and pictures read in ranges."""

import io
import random
import struct

from pyspark.sql import functions as F

from curatrix.functions.pictures import picture_size, size_of
from curatrix.operators import files, matching, providers
from curatrix.sources import catalog, ranged
from tests.test_catalog import item


def record(provider, title, minutes, asin, author="Ana Reyes"):
    return {"provider": provider, "title": title, "author": author, "duration_min": minutes, "asin": asin}


def table(spark, rows):
    kind = catalog.schema("provider_record")
    return catalog.settled(spark.createDataFrame([tuple(r.get(f.name) for f in kind) for r in rows], kind))


def book(i, title, hours=10.0, **more):
    return {"id": i, "title": title, "authors": ["Ana Reyes"], "duration": hours * 3600} | more


def test_cascade(spark):
    items = item(spark, [
        book("a", "Winter Song"), book("b", "Spring Song"), book("c", "Summer: A Tale of Heat"), book("d", "Autumn Song"), book("e", "Nowhere"),
        book("f", "Winter Song", tags=["zz-p:none"]), book("g", "Winter Song", media_type="podcast"), book("h", "Winter Song", tags=["zz-p:FAR"]), book("i", "Own Store", tags=["zz-p:third"]),
    ])
    records = table(spark, [
        record("near", "Winter Song", 600.0, "N1"), record("far", "Winter Song", 600.0, "F1"), record("near", "Spring Song", 500.0, "N2"), record("far", "Spring Song", 600.0, "F2"),
        record("far", "Summer", 600.0, "F3"), record("near", "Autumn Song", 500.0, "N4"), record("far", "Autumn Song", 480.0, "F4"), record("third", "Own Store", 600.0, "T1"), record("near", "Winter Song", 601.0, "N0"),
    ])
    best, asked = providers.cascade(items, providers.answers(records), ["near", "far"], prefix="zz-p:")
    got = {r.id: (r.provider, r.asin, r.confidence) for r in best.collect()}
    assert got == {
        "a": ("near", "N1", "exact"), "b": ("far", "F2", "exact"), "c": ("far", "F3", "likely"), "d": ("near", "N4", "edition"), "e": (None, None, "none"), "h": ("near", "N1", "exact"), "i": ("third", "T1", "exact"),
    }
    said = {(r.round, r.provider, r.form): (r.asked, r.found) for r in asked.collect()}
    assert said[0, "near", "whole"] == (5, 3) and said[0, "near", "main"] == (1, 0) and said[1, "far", "whole"] == (4, 2) and said[1, "far", "main"] == (1, 1)
    assert said[0, "third", "whole"] == (1, 1) and (1, "third", "whole") not in said  # an exact match asks no one else
    assert providers.cascade(items.where("false"), providers.answers(records), ["near"])[0].count() == 0


def test_cascade_equals_asking_all(spark):
    rng = random.Random(5)
    items = [book(f"i{k:02}", f"Song {k}" + (": A Tale" if k % 4 == 0 else "")) for k in range(30)]
    records = [record(p, f"Song {k}", rng.choice([600.0, 601.0, 500.0]), f"{p}{k}{n}", rng.choice(["Ana Reyes", "Bo Lind"])) for k in range(30) for p in ("x", "y", "z") for n in range(rng.randrange(3))]
    df, theirs = item(spark, items), table(spark, records)
    best, asked = providers.cascade(df, providers.answers(theirs), ["x", "y", "z"])
    pairs = df.select("id", "title", "authors", "narrators", "duration").join(theirs.select("provider", "asin", F.col("title").alias("p_title"), F.col("author").alias("p_author"), F.col("narrator").alias("p_narrator"), F.col("duration_min").alias("p_minutes")), F.split("title", ":")[0] == F.col("p_title"))
    want = {}
    for r in sorted(matching.score(pairs).collect(), key=lambda r: (r.rank, r.provider, int(abs(r.delta) * 1000), r.asin)):
        want.setdefault(r.id, (r.provider, r.asin, r.confidence))
    assert {r.id: (r.provider, r.asin, r.confidence) for r in best.where("confidence != 'none'").collect()} == want
    whole = asked.where("form = 'whole'").agg(F.sum("asked")).first()[0]
    assert 30 < whole < 90  # fewer than all items at all providers


# ---- Pictures -------------------------------------------------------------------------------------


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", w, h) + bytes(9)


def jpeg(w, h, profile=0):
    more = b"".join(b"\xff\xe2" + struct.pack(">H", 65_000) + bytes(64_998) for _ in range(profile))
    return b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + bytes(14) + more + b"\xff\xff\xc4" + struct.pack(">H", 4) + bytes(2) + b"\xff\xc2" + struct.pack(">HBHH", 17, 8, h, w) + bytes(40)


def webp(kind, body):
    return b"RIFF" + struct.pack("<I", 4 + 8 + len(body)) + b"WEBP" + kind + struct.pack("<I", len(body)) + body + bytes(20)


PICTURES = {
    "a.png": (png(600, 800), ("png", 600, 800)), "b.jpg": (jpeg(500, 501), ("jpeg", 500, 501)), "c.gif": (b"GIF89a" + struct.pack("<HH", 10, 20) + bytes(20), ("gif", 10, 20)), "d.jpg": (jpeg(3000, 2000, 3), ("jpeg", 3000, 2000)),
    "e.webp": (webp(b"VP8X", bytes(4) + (999).to_bytes(3, "little") + (499).to_bytes(3, "little")), ("webp", 1000, 500)), "f.webp": (webp(b"VP8L", b"\x2f" + (299 | 199 << 14).to_bytes(4, "little") + bytes(5)), ("webp", 300, 200)),
    "g.webp": (webp(b"VP8 ", b"\x10\x00\x00\x9d\x01\x2a" + struct.pack("<HH", 640, 480 | 0x4000)), ("webp", 640, 480)),
    "h.png": (png(0, 5), ("broken", None, None)), "i.jpg": (jpeg(1, 1)[:30], ("broken", None, None)), "j.txt": (b"no picture", ("unknown", None, None)), "l.jpg": (b"\xff\xd8\xff\xda\x00\x04", ("broken", None, None)),
}


def test_picture_sizes(spark, tmp_path):
    for name, (data, _) in PICTURES.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r for r in ranged.picture_sizes(spark, str(tmp_path)).collect()}
    assert {n: (r.kind, r.width, r.height) for n, r in got.items()} == {n: want for n, (_, want) in PICTURES.items()}
    assert got["a.png"].reads == 1 and all(r.bytes <= max(r.size, 1) for r in got.values()) and got["d.jpg"].size > 190_000
    df = spark.createDataFrame([(n, d[:64]) for n, (d, _) in PICTURES.items()] + [("none", None)], "n string, b binary").select("n", picture_size("b").alias("s")).select("n", "s.*")
    heads = {r.n: r for r in df.collect()}
    assert (heads["a.png"].width, heads["none"].kind) == (600, "missing") and heads["d.jpg"].width is None and heads["d.jpg"].wanted > 64
    assert size_of(PICTURES["d.jpg"][0][:64])[3] > 64
    # they feed the audit of covers
    sizes = ranged.picture_sizes(spark, str(tmp_path)).select(F.element_at(F.split("path", "/"), -1).alias("item_id"), "width", "height")
    items = item(spark, [{"id": n, "cover_path": n} for n in ("a.png", "b.jpg", "c.gif", "h.png")])
    assert sorted((r.id, r.problem) for r in files.cover_problems(items, sizes, least=300).collect()) == [("a.png", "ratio"), ("c.gif", "ratio")]


# ---- Containers -----------------------------------------------------------------------------------


def mbox(kind, *body, size=None, wide=False):
    data = b"".join(body)
    if wide:
        return struct.pack(">I", 1) + kind + struct.pack(">Q", 16 + len(data)) + data
    return struct.pack(">I", 8 + len(data) if size is None else size) + kind + data


def track(entry, scheme=b""):
    inner = mbox(b"sinf", mbox(b"frma", b"mp4a"), mbox(b"schm", bytes(4) + scheme + bytes(4))) if scheme else b""
    return mbox(b"trak", mbox(b"tkhd", bytes(20)), mbox(b"mdia", mbox(b"mdhd", bytes(8)), mbox(b"minf", mbox(b"stbl", mbox(b"stsd", bytes(8), mbox(entry, bytes(28), inner))))))


FTYP, DATA = mbox(b"ftyp", b"M4B ", bytes(4)), mbox(b"mdat", bytes(300_000))
ASF = ranged.ASF_HEADER + struct.pack("<Q", 200) + bytes(100)
FILES = {
    "first.m4b": (FTYP + mbox(b"moov", track(b"mp4a")) + DATA, ("mp4", "", "")), "last.m4b": (FTYP + DATA + mbox(b"moov", track(b"mp4a"), track(b"drms", b"itun")), ("mp4", "itun", "")), "wide.m4b": (FTYP + mbox(b"mdat", bytes(300_000), wide=True) + mbox(b"moov", track(b"enca", b"cenc")), ("mp4", "cenc", "")),
    "bare.m4b": (FTYP + mbox(b"moov", track(b"aavd")), ("mp4", "aavd", "")), "shop.aax": (mbox(b"ftyp", b"aax ", bytes(4)) + DATA, ("mp4", "aax", "")), "cut.m4b": ((FTYP + DATA)[:100_000], ("mp4", "", "")), "bad.m4b": (FTYP + mbox(b"moov", mbox(b"trak", size=4)) + DATA, ("mp4", "", "broken")),
    "free.wma": (ASF + bytes(500), ("asf", "", "")), "locked.wma": (ASF + ranged.ASF_LOCKS[0] + bytes(500), ("asf", "drm", "")), "short.wma": (ranged.ASF_HEADER + bytes(4), ("asf", "", "broken")), "x.mp3": (b"ID3" + bytes(50), ("unknown", "", "")),
    "many.m4b": (FTYP + b"".join(mbox(b"free", bytes(9000)) for _ in range(60)), ("mp4", "", "scattered")),
}


def test_probes(spark, tmp_path):
    for name, (data, _) in FILES.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r for r in ranged.probes(spark, str(tmp_path)).collect()}
    assert {n: (r.container, r.locked, r.error) for n, r in got.items()} == {n: want for n, (_, want) in FILES.items()}
    assert got["cut.m4b"].wanted == len(FTYP + DATA) > got["cut.m4b"].size and got["last.m4b"].wanted == got["last.m4b"].size
    # an index at the end costs its own blocks, not the file
    assert got["last.m4b"].reads <= 3 and got["last.m4b"].bytes <= 3 * ranged.BLOCK and got["many.m4b"].reads == ranged.READS
    small = ranged.probed(io.BytesIO(FILES["last.m4b"][0]), len(FILES["last.m4b"][0]), block=64)
    assert small["locked"] == "itun" and small["bytes"] < 1500
