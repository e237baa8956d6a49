"""Readings against each other: blocks and classes against all pairs."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from curatrix.functions import display as d
from curatrix.operators import chapters, readings
from curatrix.sources import catalog

NAMES = [f"{i}. The {w} of Autumn" for i, w in enumerate("fall rain wind moon field crow frost leaf fire gate".split(), 1)]


def book(i, title, lengths, author="Ana Reyes", names=NAMES, start=datetime(2024, 1, 1), **more):
    item = {"id": i, "media_type": "book", "title": title, "authors": [author], "rel_path": f"{author}/{i}", "num_chapters": len(lengths), "added_at": start + timedelta(hours=int(i[1:])), "duration": float(sum(lengths))} | more
    rows, at = [], 0.0
    for k, n in enumerate(lengths):
        rows.append((i, k, names[k], at, at + n))
        at += n
    return item, rows


def tables(spark, books):
    items = catalog.settled(spark.createDataFrame([{f: b[0].get(f) for f in catalog.schema("item").names} for b in books], catalog.schema("item")))
    return items, spark.createDataFrame([r for b in books for r in b[1]], catalog.schema("chapter"))


EVEN = [600, 500, 700, 400, 650, 550, 620, 480, 530, 700]
CUT = [600, 500, 700, 200, 650, 550, 300, 480, 530, 350]


def test_a_cut_reading_is_found_against_the_widest(spark):
    books = [
        book("i1", "Home", EVEN), book("i2", "Home (Bo Lind)", [x * 1.2 for x in EVEN]), book("i3", "Home", CUT), book("i4", "Home", CUT, abridged=True), book("i5", "Home", [x * 0.95 for x in EVEN]),
        book("i6", "Other", CUT), book("i7", "Home", EVEN, names=[f"Track {k}" for k in range(10)]), book("i8", "Home", CUT, author="Cy Day"), book("i9", "Home", EVEN, media_type="podcast"), book("i10", "Home", CUT),
    ]
    found, pairs = readings.sweep(*tables(spark, books))
    rows = {r.id: r for r in found.collect()}
    assert set(rows) == {"i3", "i10"}  # i4 says that it is abridged, others are even, of another book, or told by tracks alone
    assert rows["i3"].long_id == "i1" and rows["i3"].problem == "uneven_chapters" and rows["i3"].chapters == 10 and rows["i3"].spread > chapters.SPREAD
    # three cut copies with three longer whole ones, and those two that are twenty percent apart and more
    assert pairs.first().pairs == 3 * 3 + 2


def test_equal_to_all_pairs(spark):
    rng = random.Random(4)
    books = []
    for i in range(40):
        cut = rng.choice([1.0, 1.0, 0.2, 0.5])
        pace = rng.uniform(0.8, 1.3)
        lengths = [x * pace * (cut if rng.random() < 0.3 else 1) * rng.uniform(0.97, 1.03) for x in EVEN[: rng.choice([4, 8, 10])]]
        books.append(book(f"i{i}", rng.choice(["Home", "Away"]), lengths, abridged=rng.random() < 0.1))
    books += [book(f"i{40 + k}", "Home", CUT) for k in range(3)]
    items, rows = tables(spark, books)
    all_pairs = chapters.spreads(items.withColumn("reading", d.reading_key(F.col("title"), F.array_join("authors", ", "))), rows)
    said = {r.id for r in items.where("abridged").collect()}
    want = {}
    for r in all_pairs.where("cut").collect():
        if r.short_id not in said:
            want[r.short_id] = max(want.get(r.short_id, 0), r.spread)
    compared = all_pairs.where("spread is not null").count()
    for block in (200, 3):
        found, pairs = readings.sweep(items, rows, block)
        got = {r.id: r.spread for r in found.collect()}
        assert set(got) == set(want) and all(0 <= want[i] - got[i] < 0.011 for i in got)
        assert pairs.first().pairs == compared
    assert readings.sweep(items.where("false"), rows)[0].count() == 0
