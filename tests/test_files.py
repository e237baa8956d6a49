import datetime as dt

from pyspark.sql import functions as F

from curatrix.operators import files
from curatrix.sources import catalog
from tests.test_catalog import item, one, rows


def test_paths(spark):
    shelf = item(
        spark,
        [
            {"id": "ok", "title": "Mort", "authors": ["Terry Pratchett"], "rel_path": "Terry Pratchett/Discworld/Discworld - 04 - Mort", "series": one("Discworld", "4")},
            {"id": "turned", "title": "Mort (Unabridged)", "authors": ["Terry Pratchett"], "rel_path": "Pratchett Terry/Mort"},
            {"id": "title", "title": "Small Gods", "authors": ["Terry Pratchett"], "rel_path": "Terry Pratchett/Pyramids"},
            {"id": "author", "title": "Mort", "authors": ["Terry Pratchett"], "rel_path": "Isaac Asimov/Mort"},
            {"id": "year", "title": "Dune", "authors": ["F H"], "published_year": "1965", "rel_path": "F H/Dune (1999)"},
            {"id": "1984", "title": "1984", "authors": ["G O"], "published_year": "1949", "rel_path": "G O/1984"},
            {"id": "series", "title": "Mort", "authors": ["Terry Pratchett"], "rel_path": "Terry Pratchett/Mort", "series": one("Discworld", "4")},
            {"id": "vs", "title": "Alcatraz Versus the Lens", "authors": ["B S"], "rel_path": "B S/Alcatraz vs. the Lens"},
            {"id": "lower", "title": "Mort", "authors": ["X"], "rel_path": "incoming/Mort"},
            {"id": "file", "title": "Mort", "authors": ["X"], "rel_path": "Other.m4b", "is_file": True},
        ],
    )
    assert rows(files.path_problems(shelf), "id", "problem") == [("author", "author"), ("series", "series"), ("title", "title"), ("year", "year")]


def audio(spark, listed):
    return spark.createDataFrame([(i, k, 1.0, "mp3", False, None, n, n[n.rfind(".") :], 1, "audio/mpeg", tags) for i, l in listed.items() for k, (n, tags) in enumerate(l)], catalog.AUDIO_FILE)


def test_file_names(spark):
    shelf = item(spark, [{"id": "a", "title": "Guards! Guards!", "authors": ["T P"], "rel_path": "T P/Guards"}, {"id": "b", "title": "Mort", "authors": ["T P"], "rel_path": "T P/Mort"}, {"id": "c", "title": "X", "authors": [], "rel_path": "X"}])
    names = audio(spark, {"a": [("Men at Arms - 01.mp3", {}), ("Men at Arms - 02.mp3", {})], "b": [("01 Mort.mp3", {}), ("02 Mort.mp3", {})], "c": [("Track 01.mp3", {}), ("Track 02.mp3", {})]})
    assert rows(files.file_name_problems(shelf, names), "id", "stem") == [("a", "men at arms")]


def test_embedded(spark):
    shelf = item(spark, [{"id": "a", "title": "Mort", "authors": ["T P"], "genres": ["Fantasy", "Humor"], "published_year": "1987"}, {"id": "b", "title": "Dune", "authors": ["F H"]}])
    good = {"title": "mort", "artist": "T P", "genre": "humor; fantasy", "date": "1987-01-01"}
    tagged = audio(spark, {"a": [("1.mp3", good), ("2.mp3", good | {"genre": "Rock"}), ("3.mp3", {"title": " "})], "b": [("1.mp3", {"album": "Dune (book)", "album_artist": "f h"})]})
    assert rows(files.embedded_problems(shelf, tagged), "id", "files", "untagged", "stale", "reasons") == [("a", 3, 1, 1, ["genres"])]


def test_players(spark):
    df = spark.createDataFrame(
        [("a", "1.m4b", ".m4b", "", "mp4", "drms", 10, 10, 0), ("a", "2.m4b", ".m4b", "", "mp4", "", 10, 30, 0), ("b", "1.mp3", ".mp3", "bad", "mp3", "", 1, 1, 0), ("c", "1.mp3", ".mp3", "", "mp4", "", 1, 1, 0), ("d", "1.mp3", ".mp3", "", "unknown", "", 1, 1, 0), ("e", "1.mp3", ".mp3", "", "mp3", "", 1, 1, 4), ("f", "1.mp3", ".mp3", "", "mp3", "", 1, 1, 0)],
        "item_id string, filename string, ext string, error string, container string, locked string, size long, wanted long, complaints int",
    )
    assert rows(files.unplayable(df), "item_id", "problem") == [("a", "cut_short"), ("a", "locked"), ("b", "unread"), ("c", "wrong_extension"), ("d", "unknown"), ("e", "damaged")]
    asked = spark.createDataFrame([(".m4b", "aac"), (".mp3", "mp3"), (".mp3", "aac"), (".xyz", "x")], "e string, k string").select(files.needs_probe(F.col("e"), F.col("k")).alias("n"))
    assert [r.n for r in asked.collect()] == [True, False, True, True]
    shelf = item(spark, [{"id": "x"}, {"id": "y", "num_tracks": 1}])
    beside = spark.createDataFrame([("x", "unknown", "b.AAX", "b.AAX", 1), ("y", "unknown", "c.aax", "c.aax", 1)], catalog.LIBRARY_FILE)
    assert rows(files.locked_only(shelf, beside), "id", "files") == [("x", ["b.AAX"])]


def test_covers_and_episodes(spark):
    shelf = item(spark, [{"id": "a"}, {"id": "b", "cover_path": "x"}, {"id": "c", "cover_path": "x"}, {"id": "d", "cover_path": "x"}])
    sizes = spark.createDataFrame([("b", 300, 300), ("c", 900, 600), ("d", 900, 900)], "item_id string, width int, height int")
    assert rows(files.cover_problems(shelf, sizes), "id", "problem") == [("a", "missing"), ("b", "small"), ("c", "ratio")]
    cover = lambda p, w: spark.createDataFrame([("b", p, 5, w, w)], "id string, p long, d long, width int, height int")
    assert rows(files.cover_upgrades(cover(7, 300), cover(3, 900)), "verdict") == [("upgrade",)]
    assert rows(files.cover_upgrades(cover(0, 300), cover((1 << 40) - 1, 900)), "verdict") == [("differs",)]
    ep = lambda i, g, u, d: ("p", i, i, g, u, d, dt.datetime(2026, 1, 1), 1.0)
    feed = spark.createDataFrame([ep("1", "g1", "u1", dt.datetime(2026, 1, 3)), ep("2", "", " u2 ", dt.datetime(2026, 1, 2)), ep("3", "g3", "u3", None), ep("4", "", "u4", None)], catalog.EPISODE)
    held = spark.createDataFrame([ep("x", "g1", "old", None), ep("y", "", "u2", None)], catalog.EPISODE)
    queue = spark.createDataFrame([("p", "u3 ")], "item_id string, url string")
    assert rows(files.to_download(feed, held, queue), "id") == [("4",)]
    assert [r.id for r in files.newest_episodes(feed, 2).orderBy("place").collect()] == ["1", "2"]
