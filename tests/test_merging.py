"""Missing records and the new ones of the same audio: pairs, why some are left, what goes across."""

from datetime import datetime, timedelta

from curatrix.operators import merging
from curatrix.sources import catalog
from tests.test_catalog import item

DAY = datetime(2024, 5, 1)


def shelf(spark, *records):
    """(id, missing?, days when added and last seen, files as (name, size, length), more)"""
    items, files = [], []
    for i, gone, added, seen, held, *more in records:
        items.append({"id": i, "is_missing": gone, "added_at": DAY + timedelta(days=added), "updated_at": DAY + timedelta(days=seen), "duration": float(sum(x[2] for x in held)), "num_audio_files": len(held), "title": "A"} | (more[0] if more else {}))
        files += [{"item_id": i, "idx": k, "filename": n, "size": s, "duration": float(d)} for k, (n, s, d) in enumerate(held)]
    kind = catalog.schema("audio_file")
    return item(spark, items), catalog.settled(spark.createDataFrame([tuple(f.get(x.name) for x in kind) for f in files], kind))


BOOK = [("1.mp3", 100, 600), ("2.mp3", 200, 700)]
RECORDS = [
    ("moved", True, 0, 10, BOOK), ("moved-new", False, 11, 11, [("2.mp3", 200, 702), ("1.mp3", 100, 601)]),
    ("two", True, 0, 10, [("x", 1, 50), ("y", 2, 50)]), ("two-a", False, 11, 11, [("x", 1, 50), ("y", 2, 50)]), ("two-b", False, 12, 12, [("x", 1, 50), ("y", 2, 55)]),
    ("copy", True, 0, 10, [("c", 7, 50), ("d", 7, 50)]), ("copy-old", False, 1, 20, [("c", 7, 50), ("d", 7, 50)]),
    ("named", True, 0, 10, [("old.m4b", 5000, 3600)]), ("named-new", False, 10, 10, [("new.m4b", 5000, 3600.5)]), ("far", False, 10, 10, [("new.m4b", 5000, 3605)]),
    ("alone", True, 0, 10, [("q", 3, 50), ("r", 3, 50)]), ("silent", True, 0, 10, []), ("cast", True, 0, 10, BOOK, {"media_type": "podcast"}),
    ("left", True, 0, 10, [("s", 9, 50), ("t", 9, 50)]), ("right", True, 0, 10, [("s", 9, 50), ("t", 9, 50)]), ("both", False, 11, 11, [("s", 9, 50), ("t", 9, 50)]),
    ("heard", True, 0, 10, [("u", 4, 50), ("v", 4, 50)]), ("heard-new", False, 11, 11, [("u", 4, 50), ("v", 4, 50)]), ("long", True, 0, 10, [("w", 6, 500), ("z", 6, 500)]), ("long-new", False, 11, 11, [("w", 6, 500), ("z", 6, 550)]),
]


def test_pairs(spark):
    items, files = shelf(spark, *RECORDS)
    feeds = spark.createDataFrame([("heard",)], "item_id string")
    got = {r.old_id: (r.new_id, r.how, r.why) for r in merging.pairs(items, files, feeds).collect()}
    assert got == {
        "moved": ("moved-new", "files", ""), "two": (None, None, "several"), "copy": (None, None, "standing"), "named": ("named-new", "renamed", ""), "alone": (None, None, "none"), "silent": (None, None, "no_audio"),
        "cast": (None, None, "podcast"), "left": ("both", "files", "shared"), "right": ("both", "files", "shared"), "heard": ("heard-new", "files", "feed"), "long": (None, None, "none"),
    }
    assert merging.pairs(items.where("false"), files).count() == 0


def test_very_many_copies_make_no_pairs(spark):
    items, files = shelf(spark, *[(f"m{k}", True, 0, 10, BOOK) for k in range(40)], *[(f"n{k}", False, 11, 11, BOOK) for k in range(40)])
    assert {r.why for r in merging.pairs(items, files).collect()} == {"several"}
    keyed = merging.contents(items, files).join(items.select("id", "is_missing", "added_at", items["updated_at"].alias("since")), "id")
    assert merging._looked_up(keyed.where("is_missing"), keyed.where("not is_missing")).count() == 40


def test_plan(spark):
    records = [("old", True, 0, 10, BOOK, {"title": "Mort", "genres": ["b", "a"], "tags": ["x"], "asin": "B1", "series": [("1", "Discworld", "4")]}), ("new", False, 11, 11, BOOK, {"title": "Mort ", "genres": ["a", "b"], "asin": "", "series": [("2", "Discworld", "4")]})]
    items, files = shelf(spark, *records)
    progress = spark.createDataFrame([("ann", "old", "", 5.0), ("bob", "old", "", 7.0), ("bob", "new", "", 1.0)], "user_id string, item_id string, episode_id string, current_time double")
    marks = spark.createDataFrame([("ann", "old", 3.0, "a"), ("ann", "old", 4.0, "b"), ("ann", "new", 3.0, "a"), ("cy", "new", 9.0, "c")], "user_id string, item_id string, position double, title string")
    lists = spark.createDataFrame([(1, "old"), (2, "old"), (2, "new")], "list_id int, item_id string")
    (row,) = merging.merge_plan(items, files, progress, marks, lists).collect()
    assert (row.old_id, row.new_id, row.action, row.why, row.details, row.progress, row.bookmarks, row.lists) == ("old", "new", "merge", "", ["tags", "asin"], ["ann"], ["ann"], ["1"])
    told = merging.pairs(items, files)
    assert [tuple(r) for r in merging.carried(progress, told, ["user_id"]).collect()] == [("ann", "new", "", 5.0)]
    assert [r.position for r in merging.carried(marks, told, ["user_id", "position"]).collect()] == [4.0]
