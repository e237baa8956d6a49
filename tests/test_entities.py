"""Display texts, look-ups and edits of entities."""

import pytest
from pyspark.sql import functions as F

from curatrix.functions import display as d
from curatrix.operators import entities
from tests.test_duplicates import item, one, pairs


@pytest.mark.parametrize(("seconds", "said"), [(45296.4, "12h 34m"), (2045.0, "34m 5s"), (5.4, "5s"), (0.0, ""), (-1.0, ""), (3599.6, "1h 0m"), (None, "")])
def test_durations(spark, seconds, said):
    assert one(spark, d.duration_text(F.lit(seconds).cast("double"))) == said


@pytest.mark.parametrize(("size", "said"), [(5, "5 bytes"), (2048, "2 KB"), (5 << 20, "5 MB"), (int(1.5 * (1 << 30)), "1.5 GB")])
def test_sizes(spark, size, said):
    assert one(spark, d.bytes_text(F.lit(size).cast("long"))) == said


@pytest.mark.parametrize(("text", "said"), [("  short ", "short"), ("one two three four", "one two..."), ("abcdefghijklmnop", "abcdefghijkl..."), (None, ""), ("a bcdefghijklmnop", "a bcdefghijk...")])
def test_clips(spark, text, said):
    assert one(spark, d.clip(F.lit(text).cast("string"), 12)) == said


def test_series_texts(spark):
    assert tuple(one(spark, d.series_ref(F.lit("A #1 #2")))) == ("A", "1 #2") and tuple(one(spark, d.series_ref(F.lit("A")))) == ("A", "")
    assert [tuple(x) for x in one(spark, d.series_refs(F.lit("One #1, Two #x #2, Three")))] == [("One", "1"), ("Two #x", "2"), ("Three", "")]
    assert one(spark, d.placed_series(F.lit("Lock, Stock #2, Alone, Two #1"))) == ["Lock, Stock #2", "Alone, Two #1"]
    assert one(spark, d.series_core(F.lit("The Foundation Saga"))) == "foundation"


def test_names(spark):
    assert one(spark, d.clean_people(F.array(*map(F.lit, ("Dr. Jane Roe, PhD", "Larry Page - introduction", "Recorded Books", "Ann Lee"))))) == ["Jane Roe", "Ann Lee"]
    said = {n: one(spark, d.plausible_reader(F.lit(n))) for n in ("A.J. Smith", "A Memoir", "John Lee", "", "1 of 5")}
    assert said == {"A.J. Smith": True, "A Memoir": False, "John Lee": True, "": False, "1 of 5": False}
    assert one(spark, d.reading_key(F.lit("Heartfire (Nana Visitor)"), F.lit("Card, Orson & Other"))) == "heartfire|card"
    assert one(spark, d.joined_words(F.lit("Heart_fire–Abridged"))) == "Heart fire-Abridged"


def test_small_texts(spark):
    assert one(spark, d.visible_spaces(F.lit("a b c"))) == "a␣b[U+00A0]c" and one(spark, d.disk_fixed(F.lit(".x"))) == ""
    assert one(spark, d.feed_address(F.lit("http://s/"), F.lit("/f/1"))) == "http://s/f/1" and one(spark, d.feed_address(F.lit("http://s"), F.lit("https://o/f"))) == "https://o/f"
    valid = {e: one(spark, d.schedule_valid(F.lit(e))) for e in ("0 5 * * 1-5", "*/15 * * * *", "61 * * * *", "* * * *", "a * * * *", "0,30 1 1 12 7")}
    assert valid == {"0 5 * * 1-5": True, "*/15 * * * *": True, "61 * * * *": False, "* * * *": False, "a * * * *": False, "0,30 1 1 12 7": True}
    assert d.filter_code("genres", "Sci-Fi?") == "genres.U2NpLUZpPw%3D%3D"
    assert one(spark, d.date_text(F.lit("2024-02-03 04:05:06").cast("timestamp"))) == "2024-02-03" and one(spark, d.timestamp_text(F.lit(None).cast("timestamp"))) == ""


@pytest.fixture(scope="module")
def shelf(spark):
    return item(
        spark,
        [
            {"id": "1", "library_id": "l", "title": "One", "authors": ["Ann Lee"], "duration": 10.0, "series": [("s", "Saga", "2"), ("t", "Other", "")]},
            {"id": "2", "library_id": "l", "title": "Two", "authors": ["Lee, Ann"], "duration": 20.0, "series": [("s", "saga", "1")]},
            {"id": "3", "library_id": "l", "title": "Three", "authors": [], "duration": 5.0, "series": []},
        ],
    )


def test_series_listing(spark, shelf):
    got = {r.key: (r.books, r.seconds, r.sequences) for r in entities.series_rows(shelf).collect()}
    assert got == {"saga": (2, 30.0, ["1", "2"]), "other": (1, 10.0, [])}
    assert pairs(entities.series_books(shelf), "key", "place", "id") == [("other", 1, "1"), ("saga", 1, "2"), ("saga", 2, "1")]
    listed = spark.createDataFrame([("l", "SAGA ")], "library_id string, name string")
    assert pairs(entities.unlisted_series(shelf, listed), "name", "books") == [("Other", 1)]
    authors = spark.createDataFrame([("a", "Ann Lee"), ("b", "Nobody")], "id string, name string")
    assert pairs(entities.author_books(authors, shelf).fillna("-"), "author_id", "id") == [("a", "1"), ("a", "2"), ("b", "-")]
    assert pairs(entities.named(shelf, "t", {"book": "title"}), "name") == [("Three",), ("Two",)]


def test_lookup_by_name(spark):
    rows = spark.createDataFrame([("1", "Books"), ("2", "books"), ("3", "1")], "id string, name string")
    assert pairs(entities.by_name_or_id(rows, "1"), "id") == [("1",)] and pairs(entities.by_name_or_id(rows, "Books"), "id") == [("1",)]
    assert pairs(entities.by_name_or_id(rows, "BOOKS"), "id") == [("1",), ("2",)] and entities.by_name_or_id(rows, "x").count() == 0


def test_lists(spark):
    make = lambda xs, kind="list_id string, item_id string, pos int": spark.createDataFrame(xs, kind)
    held = make([("c", "a", 0), ("c", "b", 1), ("k", "z", 0)])
    out, told = entities.list_edit(held, make([("c", "x", 0), ("c", "a", 1), ("c", "b", 2), ("k", "y", 0), ("k", "y", 1)]), make([("c", "b"), ("c", "q"), ("k", "z")], "list_id string, item_id string"))
    assert pairs(out, "list_id", "pos", "item_id") == [("c", 0, "a"), ("c", 1, "b"), ("c", 2, "x"), ("k", 0, "y")]
    assert pairs(told, "list_id", "item_id", "outcome") == [("c", "a", "already_held"), ("c", "b", "both"), ("c", "q", "not_held"), ("c", "x", "added"), ("k", "y", "added"), ("k", "z", "removed")]
    assert pairs(entities.reordered(held, make([("c", "b", 0)])), "list_id", "pos", "item_id") == [("c", 0, "b"), ("c", 1, "a"), ("k", 0, "z")]


def test_upsert(spark):
    rows = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, v string, w double")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "k int, v string")
    assert sorted((r.k, r.v, r.w or 0.0) for r in entities.upsert(rows, new, ["k"]).collect()) == [(1, "a", 1.0), (2, "d", 2.0), (3, "e", 0.0)]


def test_bookmarks(spark):
    kind = "user_id string, item_id string, time double, title string"
    held = spark.createDataFrame([("u", "i", 1.0, "x"), ("u", "i", 2.0, "y")], kind)
    out, told = entities.bookmark_edit(held, spark.createDataFrame([("u", "i", 1.0, "new"), ("u", "j", 3.0, "z")], kind), spark.createDataFrame([("u", "i", 2.0), ("u", "i", 9.0)], "user_id string, item_id string, time double"))
    assert pairs(out, "item_id", "time", "title") == [("i", 1.0, "new"), ("j", 3.0, "z")]
    assert pairs(told, "time", "outcome") == [(1.0, "renamed"), (2.0, "removed"), (3.0, "added"), (9.0, "missing")]


def test_edits(spark, shelf):
    got = shelf.where("id = '1'").select(entities.series_edit(F.col("series"), [("SAGA", "5"), ("New", "1")], ["other"]).alias("s")).first().s
    assert [(s.name, s.sequence) for s in got] == [("Saga", "5"), ("New", "1")]
    after = shelf.withColumn("title", F.lit("match")).withColumn("publisher", F.lit("p"))
    assert {(r.title, r.publisher) for r in entities.kept_fields(shelf, after, ["title"]).collect()} == {("One", "p"), ("Two", "p"), ("Three", "p")}
    tags = spark.createDataFrame([("1", ["Horror", "x"], ["horror"]), ("2", ["y"], [])], "id string, tags array<string>, genres array<string>")
    assert [(r.id, r.tags, r.genres) for r in entities.moved_values(tags, "horror", "tags", "genres").collect()] == [("1", ["x"], ["horror"])]


def test_users(spark, shelf):
    progress = spark.createDataFrame([("u", "1", "", 5.0, 0.5, False, False, 3), ("u", "2", "", 5.0, 1.0, True, False, 4), ("u", "3", "", 1.0, 0.1, False, True, 5), ("v", "2", "", 1.0, 0.2, False, False, 1)], "user_id string, item_id string, episode_id string, current_time double, progress double, is_finished boolean, hidden boolean, last_update int")
    assert pairs(entities.in_progress(progress, shelf), "user_id", "item_id", "percent", "place") == [("u", "1", 50, 1), ("v", "2", 20, 1)]
    users = spark.createDataFrame([("u", "Uma"), ("w", "Wes")], "id string, username string")
    assert sorted((r.id, r.finished, r.in_progress) for r in entities.accounts(users, progress).collect()) == [("u", 1, 2), ("w", 0, 0)]
    mine = {r.id: r.is_finished for r in entities.with_progress(shelf, progress, "u").collect()}
    assert mine == {"1": False, "2": True, "3": False}


def test_equal_sums_go_by_item(spark):
    rows = [("u", "p2", 0.1), ("u", "p2", 0.2), ("u", "p1", 0.3)]
    got = entities.top_listened(spark.createDataFrame(rows, "user_id string, item_id string, time_listening double"), 2)
    assert [(r.item_id, r.seconds) for r in got.orderBy("place").collect()] == [("p1", 0.3), ("p2", 0.3)]


def test_sums_that_differ_little_go_by_size(spark):
    """Before, sums were rounded to the millionth, and so were seconds, before what reads them rounds them again."""
    rows = [("u", "p1", 1.0000001), ("u", "p2", 1.0000002), ("u", "p3", 0.9), ("v", "p1", 0.00004999995), ("w", "p1", 1e300), ("w", "p2", 1e-20), ("w", "p3", float("nan")), ("w", "p4", None)]
    got = entities.top_listened(spark.createDataFrame(rows, "user_id string, item_id string, time_listening double"), 4).orderBy("user_id", "place").collect()
    assert [(r.user_id, r.item_id, r.seconds) for r in got if r.user_id != "w"] == [("u", "p2", 1.0000002), ("u", "p1", 1.0000001), ("u", "p3", 0.9), ("v", "p1", 0.00004999995)]
    assert [r.item_id for r in got if r.user_id == "w"] == ["p3", "p1", "p2", "p4"] and [r.seconds for r in got if r.user_id == "w"][1:] == [1e300, 1e-20, None]


def test_sums_agree_in_any_order(spark):
    seconds = [113.12, 18.33, 120.59, 234.34, 23.25, 53.18]
    rows = [("u", "p46", x) for x in seconds] + [("u", "p39", x) for x in reversed(seconds)]
    got = entities.top_listened(spark.createDataFrame(rows, "user_id string, item_id string, time_listening double").coalesce(1), 2)
    assert [(r.item_id, r.seconds) for r in got.orderBy("place").collect()] == [("p39", 562.81), ("p46", 562.81)]
