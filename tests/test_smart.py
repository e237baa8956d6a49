"""Smart matches: a rule of each field, the update that follows, batches."""

from functools import reduce

from pyspark.sql import functions as F

from curatrix.operators import smart
from curatrix.sources import catalog

LONG = "A text that says what happens in the book, who tells it and why, at a length that no stub has, so that it is longer than the bound."


def pair(spark, ours, theirs):
    item = {"id": "i", "media_type": "book", "series": []} | ours
    rec = {"provider": "p", "provider_rank": 1, "series": []} | theirs
    item["series"] = [{"id": None, "name": n, "sequence": s} for n, s in item["series"]]
    rec["series"] = [{"series": n, "sequence": s} for n, s in rec["series"]]
    items = catalog.settled(spark.createDataFrame([{f: item.get(f) for f in catalog.schema("item").names}], catalog.schema("item")))
    records = catalog.settled(spark.createDataFrame([{f: rec.get(f) for f in catalog.schema("provider_record").names}], catalog.schema("provider_record")))
    return items, records


def decided(spark, ours, theirs):
    items, records = pair(spark, ours, theirs)
    return {r.field: r for r in smart.decisions(smart.beside(items, records, F.lit(True))).collect()}


def test_file_tags_are_written(spark):
    got = decided(
        spark,
        {"title": "07 Winter Song.mp3", "authors": ["Ana Reyes"], "narrators": ["Blue Door Media", "Tall Tree Studios"], "series": [("Seasons", "4")], "genres": ["Audiobooks"], "publisher": "Old", "published_year": "2011-05-02T00:00:00", "language": "eng", "description": "Read by Y"},
        {"title": "Winter Song", "author": "Dr. Ana Reyes, Someone Else - translator", "narrator": "Ida Holm", "series": [("The Seasons Series", "4")], "genres": ["Literary Fiction"], "publisher": "New House", "published_year": "2011", "language": "English", "description": LONG},
    )
    want = {"title": "written", "authors": "kept", "narrators": "written", "series": "kept", "genres": "written", "publisher": "written", "year": "written", "language": "written", "description": "written"}
    assert {f: r.action for f, r in got.items()} == want
    assert got["description"].theirs == f"{len(LONG)} characters"


def test_curated_values_stay(spark):
    got = decided(
        spark,
        {"title": "Winter Song", "authors": ["Ana Reyes"], "narrators": ["Ida Holm"], "series": [("Seasons", "7")], "genres": ["Poetry", "Other"], "published_year": "1996", "description": LONG},
        {"title": "WINTER-SONG", "author": "Ana Reyes", "narrator": "Jon Ek, Per Ask", "series": [("The Seasons Saga", "2")], "genres": ["Verse"], "published_year": "2023", "subtitle": "Seasons, Book 7", "description": "Short"},
    )
    assert {f: r.action for f, r in got.items()} == {"narrators": "review", "genres": "kept", "year": "kept", "subtitle": "filled", "series": "review"}
    assert "7 here and 2 there" in got["series"].rule


def test_titles_subtitles_and_names(spark):
    title = lambda a, b, *series: ({"title": a, "series": list(series)}, {"title": b}, "title")
    sub = lambda a, b: ({"subtitle": a}, {"subtitle": b}, "subtitle")
    reader = lambda a, b: ({"authors": ["Ana Reyes"], "narrators": [a]}, {"narrator": b}, "narrators")
    cases = [
        (title("Chapter One", "Something"), "written"), (title("Seasons", "Winter Song", ("Seasons", "1")), "written"), (title("The Winter Song", "Winter Song"), "kept"), (title("Winter Song: A Tale", "Winter Song"), "written"), (title("Spring", "Winter Song"), "review"),
        (sub("Seasons, Book 3", "A Novel of the North"), "written"), (sub("A Tale", "Another"), "review"), (sub("Book 3", "Volume 4"), "review"), (reader("Ana Reyes", "Ida Holm"), "written"), (reader("I. Holm", "Ida Holm"), "kept"), (reader("Bo Lind", "Ida Holm"), "review"),
        (({"authors": ["Ana Reyes"]}, {"author": "Ana Reyes, Bo Lind"}, "authors"), "review"), (({"authors": ["Ana Reyes", "Cy Day"]}, {"author": "Ana Reyes, Bo Lind"}, "authors"), "review"),
    ]
    both = [pair(spark, {"id": str(k)} | ours, {"query_item_id": str(k)} | theirs) for k, ((ours, theirs, _), _) in enumerate(cases)]
    items, records = (reduce(lambda x, y: x.unionByName(y), side) for side in zip(*both))
    got = {(int(r.id), r.field): r for r in smart.decisions(smart.beside(items, records, F.col("id") == F.col("p_query_item_id"))).collect()}
    assert [got[k, field].action for k, ((_, _, field), _) in enumerate(cases)] == [want for _, want in cases]
    assert got[11, "authors"].theirs == "Ana Reyes, Bo Lind" and got[12, "authors"].rule == "another author"


def test_update_rows_and_items_after(spark):
    items, records = pair(spark, {"title": "03 - Song", "narrators": ["Blue Door Media"], "publisher": "", "genres": ["Poetry"], "asin": ""}, {"title": "Winter Song", "narrator": "Ida Holm; Bo Lind", "publisher": "New House", "genres": ["Verse"], "asin": "B1", "author": "Dr. Ana Reyes"})
    rows = smart.beside(items, records, F.lit(True))
    new = smart.updates(rows).first()
    assert (new.new_title, new.new_narrators, new.new_publisher, new.new_genres) == ("Winter Song", ["Ida Holm", "Bo Lind"], None, None)
    after = smart.applied(rows, items.columns).first()
    assert (after.title, after.narrators, after.publisher, after.genres, after.asin, after.authors) == ("Winter Song", ["Ida Holm", "Bo Lind"], "New House", ["Poetry"], "B1", ["Ana Reyes"])
    assert smart.decisions(smart.beside(smart.applied(rows, items.columns), records, F.lit(True))).where("action != 'kept'").count() == 0
    assert smart.updates(rows.where("false")).count() == 0


def test_batch(spark):
    items, _ = pair(spark, {"title": "01 x.mp3"}, {})
    items = items.unionByName(items.withColumns({"id": F.lit("cast"), "media_type": F.lit("podcast")}))
    _, one = pair(spark, {}, {"provider": "far", "provider_rank": 2, "asin": "b7", "title": "Far", "publisher": "Q"})
    _, two = pair(spark, {}, {"provider": "near", "provider_rank": 1, "asin": "B7", "isbn": "978", "title": "Near"})
    asked = [("i", "B7", "", ""), ("i", "b7", "", "far"), ("i", "", "978", ""), ("i", "", "", ""), ("gone", "B7", "", ""), ("cast", "B7", "", ""), ("i", "B8", "", ""), ("i", None, "978", "far")]
    matches = spark.createDataFrame(asked, "item string, asin string, isbn string, provider string")
    got = sorted((r.item, r.asin, r.isbn, r.provider, r.error, r.filled, r.written) for r in smart.apply_batch(items, matches, one.unionByName(two)).collect())
    assert got == sorted([("i", "B7", "", "near", "", 0, 1), ("i", "b7", "", "far", "", 1, 1), ("i", "", "978", "near", "", 0, 1), ("i", "", "", "", "no_id", 0, 0), ("gone", "B7", "", "near", "no_item", 0, 0), ("cast", "B7", "", "near", "not_book", 0, 0), ("i", "B8", "", "", "no_record", 0, 0), ("i", "", "978", "far", "no_record", 0, 0)])


def test_rules_are_computed_once(spark):
    """No filter or projection repeats what tells a field."""
    items, records = pair(spark, {"title": "A"}, {"title": "B"})
    plan = smart.decisions(smart.beside(items, records, F.lit(True)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"\(uab\)") <= 2  # action and rule


def test_all_fields_are_one_projection(spark):
    """Rows pass few generated columns (15 before), and a key that rules share is written out once (156 keys before)."""
    items, records = pair(spark, {"title": "One"}, {"title": "Two"})
    plan = smart.decided(smart.beside(items, records, F.lit(True)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") <= 4 and 0 < plan.count("translate(") <= 50
