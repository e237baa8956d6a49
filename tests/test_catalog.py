"""Small shelves with known faults, through the operators that find them."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix import queries as library
from curatrix.functions import media
from curatrix.operators import chapters, changes, duplicates, joins, listing, matching, predicates, series, vocabulary
from curatrix.operators.rows import spread
from curatrix.plans.audit_all import audit_all
from curatrix.sources import catalog
from curatrix.streaming import sessions

H = 3600.0


def item(spark, rows):
    wanted = catalog.schema("item")
    full = [tuple({"media_type": "book", **r}.get(f.name) for f in wanted) for r in rows]
    return catalog.settled(spark.createDataFrame(full, wanted))


def one(name, sequence=""):
    return [("s", name, sequence)]


SHELF = [
    {"id": f"d{n}", "title": t, "rel_path": f"Pratchett/Discworld/Discworld - {n:02d} - {t}", "authors": ["Terry Pratchett"], "narrators": ["Nigel Planer"], "series": one("Discworld", s), "duration": 8 * H, "num_tracks": 1, "genres": ["Fantasy"], "tags": ["fantasy", "zz-provider:none"], "language": "English"}
    for n, t, s in [(1, "The Colour of Magic", "01"), (2, "The Light Fantastic", "2"), (4, "Mort", "04"), (5, "Sourcery", "05"), (12, "Witches Abroad", "12")]
] + [
    {"id": "m1", "title": "Mort", "rel_path": "Old/Mort (old rip)", "authors": ["Terry Pratchett"], "narrators": ["Nigel Planer"], "duration": 8 * H + 60, "asin": "B1", "genres": ["Audiobook", "Fantasy, Humor"], "language": "en"},
    {"id": "m2", "title": "Mort", "rel_path": "Other/Mort", "authors": ["Terry Pratchett"], "narrators": ["Someone Else"], "duration": 8 * H, "language": "Klingon"},
    {"id": "m3", "title": "Mort - short", "rel_path": "Short/Mort", "authors": ["Terry Pratchett"], "narrators": ["Nigel Planer"], "duration": 3 * H, "asin": "b1 "},
    {"id": "f3", "title": "Equal Rites", "rel_path": "Pratchett/Discworld/Discworld - 03 - Equal Rites", "authors": ["Pratchett, Terry"], "narrators": ["Terry Pratchett"]},
    {"id": "x1", "title": "Warbreaker", "authors": ["Warbreaker"], "rel_path": "Warbreaker", "description": "Read by A"},
    {"id": "x2", "title": "Foundation  and Empire", "authors": ["Isaac Asimov"], "narrators": ["Michael Kramer"], "series": one("Foundation Series", "2"), "is_missing": True, "rel_path": "F/a"},
    {"id": "x3", "title": "Second", "authors": ["Isac Asimov"], "narrators": ["Micheal Kramer"], "series": one("The Foundation", ""), "rel_path": "Foundation/03 - Second"},
    {"id": "p1", "title": "A show", "media_type": "podcast", "feed_url": "http://x", "num_episodes": 2, "last_episode_check": dt.datetime(2026, 1, 1)},
    {"id": "p2", "title": "No feed", "media_type": "podcast"},
]


@pytest.fixture(scope="module")
def items(spark):
    return item(spark, SHELF).cache()


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_checks(spark, items):
    found = predicates.findings(items, prefix="zz-provider:")
    assert rows(found.where("check = 'author_as_title'"), "id") == [("x1",)]
    assert "d1" not in {r.id for r in found.where("check = 'unmatched'").collect()}
    assert rows(found.where("check = 'issues'"), "id", "detail") == [("x2", "missing from disk")]
    assert rows(found.where("check = 'no_episodes'"), "id") == [("p2",)]
    table = predicates.checks("zz-provider:")
    counted = {r.check: r.found for r in predicates.counts(items, {k: v[0] for k, v in table.items()}).collect()}
    assert counted == {k: found.where(F.col("check") == k).count() for k in table}
    episodes = spark.createDataFrame([("p1", dt.datetime(2025, 1, 1))], "item_id string, published_at timestamp")
    assert rows(predicates.stale_feeds(items, episodes, F.lit("2026-01-01").cast("timestamp")), "id", "detail") == [("p1", "no new episode in 365 days"), ("p2", "no feed url")]


def test_series(items):
    gaps = series.gaps(items)
    assert [(r.key, sorted(r.missing)) for r in gaps.collect()] == [("discworld", [3, 6, 7, 8, 9, 10, 11])]
    assert rows(series.unlinked_fillers(items, gaps), "id", "number") == [("f3", 3.0)]
    found = series.numbering(items)
    assert rows(found.where("problem = 'padding'"), "id", "suggest") == [("d2", "Discworld #02")]
    assert rows(found.where("problem = 'unlinked'"), "id") == [("f3",)]
    assert rows(found.where("problem = 'unnumbered'"), "id") == [("x3",)]
    assert rows(series.names(items).where("size(problems) > 0"), "series", "suggest") == [("Foundation Series", "Foundation")]


def test_folder_styles(spark):
    shelf = item(spark, [{"id": str(n), "title": t, "rel_path": f"A/Saga/{f}", "series": one("Saga", str(n))} for n, t, f in [(1, "One", "Saga - 01 - One"), (2, "Two", "Saga - 02 - Two"), (3, "Three", "03 - Three"), (4, "Four (Unabridged)", "Four")]])
    assert rows(series.folder_styles(shelf), "id", "suggest") == [("3", "Saga - 03 - Three"), ("4", "Saga - 04 - Four")]
    shelf = item(spark, [{"id": "a", "title": "Saga", "rel_path": "A/Saga - 01 - One", "series": one("Saga", "1")}, {"id": "b", "title": "Saga, Book 2", "rel_path": "A/Saga - 02 - Two", "series": one("Saga", "2")}])
    assert rows(series.titles(shelf), "id", "problem", "suggest") == [("a", "series_as_title", "One"), ("b", "series_in_title", "Two")]


def chapter(spark, listed):
    return spark.createDataFrame([(i, n, t, float(a), float(z)) for i, l in listed.items() for n, (t, a, z) in enumerate(l)], catalog.CHAPTER)


def test_chapters(spark):
    shelf = item(spark, [{"id": i, "title": i, "duration": d} for i, d in [("ok", 7200.0), ("past", 100.0), ("late", 100.0), ("order", 100.0), ("short", 7200.0), ("one", 7200.0)]])
    listed = chapter(spark, {"ok": [("a", 0, 3600), ("b", 3600, 7203)], "past": [("a", 0, 50), ("b", 120, 130)], "late": [("a", 0, 50), ("b", 50, 106)], "order": [("a", 0, 60), ("b", 50, 100)], "short": [("a", 0, 60), ("b", 60, 7000)], "one": [("a", 0, 7200)]})
    assert rows(chapters.problems(shelf, listed), "id", "problem") == [("late", "past_end"), ("one", "single"), ("order", "out_of_order"), ("past", "past_end"), ("short", "short")]
    fitted = {r.id: r for r in chapters.fit(shelf, listed).collect()}
    assert fitted["past"].dropped == 1 and fitted["past"].kept[-1].end == 100.0 and fitted["order"].error == "out of order"
    assert fitted["short"].kept[-1].end == 7200.0
    before = spark.createDataFrame([("i", "a", 0.0, 60.0), ("i", "b", 60.0, 40.0)], "item_id string, filename string, start_offset double, duration double")
    after = spark.createDataFrame([("i", "b", 0.0, 40.0), ("i", "a", 40.0, 60.0)], "item_id string, filename string, start_offset double, duration double")
    moved = chapters.moved(chapter(spark, {"i": [("x", 0, 30), ("y", 60, 90)]}), before, after).collect()
    assert [(r.title, r.start, r.end, r.split) for r in moved] == [("y", 0.0, 30.0, False), ("x", 40.0, 70.0, False)]


def test_spread_tells_cut_readings(spark):
    def reading(ratio):
        at, out = 0.0, []
        for n, r in enumerate(ratio):
            out.append((f"{n}. Title {chr(97 + n)}", at, at + 600 * r))
            at += 600 * r
        return out

    shelf = item(spark, [{"id": "long", "title": "W", "duration": 6000.0}, {"id": "even", "title": "W", "duration": 4800.0}, {"id": "cut", "title": "W", "duration": 4080.0}]).withColumn("reading", F.lit("w"))
    listed = chapter(spark, {"long": reading([1] * 10), "even": reading([0.8] * 10), "cut": reading([0.8] * 7 + [0.4] * 3)})
    got = {r.short_id: r for r in chapters.spreads(shelf, listed).where("long_id = 'long'").collect()}
    assert not got["even"].cut and abs(got["even"].spread - 1) < 1e-9
    assert got["cut"].cut and got["cut"].n == 10


def test_vocabulary(spark, items):
    spelt = vocabulary.spellings(spark.createDataFrame([("Michael Kramer", 3), ("Micheal Kramer", 1), ("Read by Sean Barrett", 1), ("Sean Barrett", 2), ("Jack R B Evans", 1), ("Jack Evans", 1), ("Ph.D.", 1), ("A One/B Two", 1)], "value string, items long"), "narrators")
    groups = {r.key: (r.kind, r.keep) for r in vocabulary.spelling_groups(spelt, "narrators").collect()}
    assert groups == {"sean barrett": ("affix", "Sean Barrett")}
    found = {(r.kind, r.keep) for r in vocabulary.clusters(spelt, "narrators").collect()}
    assert found == {("near", "Michael Kramer"), ("contains", "Jack R B Evans")}
    assert rows(vocabulary.fragments(spelt), "key", "kind") == [("a oneb two", "split"), ("ph d", "fragment")]
    genres = vocabulary.genre_findings(items, least=2)
    assert rows(genres.where("section = 'placeholder'"), "value", "items") == [("Audiobook", 1)]
    assert rows(genres.where("section = 'compound'"), "value") == [("Fantasy, Humor",)]
    assert rows(genres.where("section = 'redundant'"), "value", "items") == [("fantasy", 5)]
    assert rows(vocabulary.roles(items), "name", "read_only") == [("terry pratchett", [])] or rows(vocabulary.roles(items), "name") == []
    assert rows(vocabulary.odd_languages(items.select(F.col("language").alias("value")).distinct()), "value") == [("Klingon",)]
    assert rows(vocabulary.space_findings(items.select(F.lit("title").alias("where"), F.col("title").alias("name"))), "problem", "fixed") == [("double_space", "Foundation and Empire")]


def test_near_keys_equal_all_pairs(spark):
    import random

    r = random.Random(3)
    base = ["".join(r.choices("abcd ", k=r.randrange(6, 18))).strip() or "abcdef" for _ in range(40)]
    names = set(base)
    for b in base:
        for _ in range(3):
            w = list(b)
            for _ in range(r.randrange(1, 3)):
                at = r.randrange(len(w))
                r.choice([lambda: w.pop(at) if len(w) > 1 else None, lambda: w.insert(at, r.choice("abcd")), lambda: w.__setitem__(at, r.choice("abcd"))])()
            names.add("".join(w).strip())
    from curatrix.functions import text

    df = spark.createDataFrame([(n,) for n in sorted(names) if n], "key string")
    pairs = df.select(F.col("key").alias("a")).crossJoin(df.select(F.col("key").alias("b"))).where("a < b").where(text.typo_apart(F.col("a"), F.col("b")))
    assert rows(vocabulary.near_keys(df, "tags", text.typo_apart), "a", "b") == rows(pairs, "a", "b")


def test_duplicates(spark, items):
    found = duplicates.groups(items)
    assert rows(found, "group", "id") == [("d4", "d4"), ("d4", "m1"), ("d4", "m3")]
    many = item(spark, [{"id": f"i{n:03d}", "title": "Track 01", "authors": ["Unknown"], "duration": 60.0} for n in range(51)])
    assert duplicates.groups(many).count() == 0
    assert rows(duplicates.placeholder_titles(many), "n") == [(51,)]
    tracks = spark.createDataFrame([("a", 0, 10.0, "1", 5), ("a", 1, 20.0, "2", 6), ("b", 0, 10.0, "1", 5), ("b", 1, 15.0, "x", 1), ("b", 2, 20.0, "2", 6)], "item_id string, idx int, duration double, filename string, size long")
    held = duplicates.incomplete(spark.createDataFrame([("a", "b")], "short_id string, long_id string"), tracks)
    assert rows(held, "short_id", "long_id", "held", "missing") == [("a", "b", 2, ["x"])]
    near = item(spark, [{"id": "a", "title": "Dune (Unabridged)", "authors": ["Frank Herbert"], "duration": 1000.0}, {"id": "b", "title": "Dune: A Novel", "authors": ["Frank Herbert"], "duration": 1050.0}, {"id": "c", "title": "Other", "authors": ["Frank Herbert"], "duration": 1001.0}])
    albums = spark.createDataFrame([("c", "Dune"), ("b", "Nothing")], "item_id string, album string")
    assert rows(duplicates.candidates(near, duplicates.judged(near), albums), "a", "b", "why") == [("a", "b", "edition"), ("a", "c", "album")]
    files = lambda i, s: (i, 0, 100.0, None, False, None, "a.mp3", "mp3", s, None, None)
    a, b = (duplicates.content_key(spark.createDataFrame([files(i, 7)], catalog.AUDIO_FILE)) for i in ("old", "new"))
    assert rows(duplicates.relinked(a, b), "old_id", "new_id", "how", "choices") == [("old", "new", "same files", 1)]


def test_band_join_equals_all_pairs(spark):
    df = spark.createDataFrame([(i, float((i * 37) % 101 + 1), i % 3) for i in range(150)] + [(999, 0.0, 0), (998, None, 0)], "id int, v double, k int")
    got = rows(joins.band_pairs(df, "v", "id", 0.05, ["k"]), "a_id", "b_id")
    a, b = df.alias("a"), df.alias("b")
    all_pairs = a.join(b, F.col("a.k") == F.col("b.k")).where("a.id < b.id and a.v > 0 and b.v > 0 and greatest(a.v, b.v) - least(a.v, b.v) <= 0.05 * greatest(a.v, b.v)").select(F.col("a.id").alias("x"), F.col("b.id").alias("y"))
    assert got == rows(all_pairs, "x", "y")


def test_matching(spark, items):
    record = lambda q, p, rank, asin, title, author, narrator, minutes, abridged=False: (p, rank, q, asin, None, title, None, author, narrator, minutes, abridged, None, None, None, None, None, None)
    records = spark.createDataFrame(
        [record("d4", "one", 0, "A", "Mort", "Terry Pratchett", "Nigel Planer", 480.0), record("d4", "two", 1, "B", "Mort", "Terry Pratchett", "Nigel Planer", 480.0), record("d5", "one", 0, "C", "Sourcery", "T. Pratchett", "Celia Imrie", 480.0), record("d2", "one", 0, "D", "Wyrd Sisters", "Terry Pratchett", "Nigel Planer", 480.0)],
        catalog.PROVIDER_RECORD,
    )
    got = {r.id: (r.provider, r.confidence) for r in matching.best(items, records).collect()}
    assert got["d4"] == ("one", "exact") and got["d5"] == ("one", "edition") and got["d2"] == ("one", "unsure") and got["d1"] == (None, "none")
    whole = spark.createDataFrame([record("m3", "one", 0, "E", "Mort", "Terry Pratchett", "x y", 480.0), record("m3", "one", 0, "F", "Mort", "Terry Pratchett", "x y", 181.0, True)], catalog.PROVIDER_RECORD)
    assert rows(matching.editions(items, whole), "id", "problem") == [("m3", "abridged_length")]
    pairs = spark.createDataFrame([("a", "Dune", "", ["X Y"], "dune", "A Publisher", ["y x"])], "id string, title string, publisher string, authors array<string>, p_title string, p_publisher string, p_authors array<string>")
    assert rows(matching.field_diffs(pairs), "field", "theirs") == [("authors", "y x"), ("publisher", "A Publisher")]
    assert rows(matching.check_matched(items, records.withColumn("asin", F.lit("B1"))), "id", "problem") == [("m3", "duration_off")]


def test_readers(spark):
    df = spark.createDataFrame(
        [(1, ["A Bee"], "X (read by C Dee)", "a/b", "", ["A Bee"]), (2, [], "X", "a/X [Narrated by Ann Lee]", "<p>Read by Ann Lee and Bob Roe, with an introduction by Z.</p>", ["A. Lee"]), (3, [], "X: a full-cast drama", "a", "", ["Ann Lee"]), (4, [], "X", "a", "", ["Ann Lee"]), (5, ["Lee"], "X", "a", "", [])],
        "i int, n array<string>, t string, p string, d string, c array<string>",
    )
    sources = matching.reader_sources(F.col("n"), F.col("t"), F.col("p"), F.col("d"))
    got = df.withColumn("s", sources).select("i", F.size("s").alias("k"), matching.judged_readers(F.col("s"), F.col("c"), matching.says_production(F.col("t"))).alias("v"))
    assert rows(got, "i", "k", "v") == [(1, 2, "differs"), (2, 2, "same"), (3, 0, "differs"), (4, 0, "unknown"), (5, 1, "unknown")]
    line = spark.createDataFrame([("Read by Ann B. Lee. A great book",), ("Narrated by Ann Lee with Bob",), ("Another",)], "l string").select(F.array_join(matching.credit_names(F.col("l")), "|").alias("x"))
    assert [r.x for r in line.collect()] == ["Ann B. Lee", "Ann Lee", ""]


def test_listing(spark, items):
    assert rows(items.where(listing.where("genres:Fantasy")), "id") == [(f"d{n}",) for n in sorted(("1", "12", "2", "4", "5"))]
    assert rows(items.where(listing.where("Missing:series")).where("media_type = 'book'"), "id")[0] == ("f3",)
    assert items.where(listing.where("authors:terry pratchett")).count() == 8
    with pytest.raises(ValueError):
        listing.where("nonsense")
    with pytest.raises(ValueError):
        listing.where("series:x", podcast=True)
    page = listing.page(items.select("id"), [F.col("id")], 5, 10).collect()
    assert [(r.id, r._total, r._next) for r in page] == [(i, 14, 0) for i in sorted(r["id"] for r in SHELF)[10:]]
    assert {(r.field, r.value): r["items"] for r in listing.list_facets(items, ["genres"]).collect()}[("genres", "Fantasy")] == 5
    total = listing.totals(items).first()
    assert total["items"] == 14 and total.authors == 5
    assert listing.summary(items).where("id = 'd2'").first().series == ["Discworld #2"]
    s = spark.createDataFrame([("u", 10.0, dt.datetime(2026, 1, 30)), ("u", 5.0, dt.datetime(2026, 1, 10)), ("u", 1.0, dt.datetime(2025, 1, 1))], "user_id string, time_listening double, started_at timestamp")
    assert rows(listing.usage_days(s, F.lit("2026-01-31").cast("timestamp"), ["user_id"]), "total", "last_7_days", "last_30_days") == [(16.0, 10.0, 15.0)]


def test_changes(spark, items):
    change = changes.rename(items, "genres", "Fantasy", "Epic")
    assert change.count() == 5
    assert changes.apply(items, change, "genres").where(F.array_contains("genres", "Epic")).count() == 5
    assert rows(changes.split(items, "genres", "Fantasy, Humor", ["Fantasy", "Humor"]), "id", "after") == [("m1", ["Audiobook", "Fantasy", "Humor"])]
    assert rows(changes.remove(items, "tags", "FANTASY").limit(1), "after") == [(["zz-provider:none"],)]
    merged = changes.merge_series(items, "Foundation Series", "The Foundation").first()
    assert merged.after[0].name == "The Foundation" and merged.after[0].sequence == "2"
    pairs = spark.createDataFrame([("a", "x", "", "y", "z")], "id string, old_t string, new_t string, old_u string, new_u string")
    assert rows(changes.carry_over(pairs, ["t", "u"]), "field", "action") == [("t", "fill"), ("u", "differs")]
    f = spark.createDataFrame([("i", "a"), ("i", "b")], "item_id string, filename string")
    assert rows(changes.track_order(f, spark.createDataFrame([("i", "a"), ("i", "c")], "item_id string, filename string")), "filename", "problem") == [("b", "left out"), ("c", "unknown")]


def test_audit_all(spark, items):
    got = {(r.check, r.field): r.found for r in audit_all(items, prefix="zz-provider:").collect()}
    assert got[("gaps", "missing")] == 1 and got[("numbering", "padding")] == 1 and got[("author_as_title", "")] == 1
    empty = audit_all(items.where("false")).collect()
    assert all(r.found == 0 for r in empty)


def test_loading(spark, tmp_path):
    path = str(tmp_path / "items")
    spark.createDataFrame([("a", None, ["x"])], "id string, title string, genres array<string>").write.parquet(path)
    got = catalog.load(spark, "item", path).first()
    assert (got.title, got.genres, got.tags, got.duration, got.added_at) == ("", ["x"], [], 0.0, None)
    files = spark.createDataFrame([("i", 2, 5.0, False), ("i", 1, 3.0, False), ("i", 3, 9.0, True)], "item_id string, idx int, duration double, exclude boolean").withColumn("filename", F.lit("f"))
    assert rows(catalog.play_order(files), "idx", "start_offset") == [(1, 0.0), (2, 3.0)]


def test_pictures(spark):
    r = np.random.default_rng(1)
    small = r.integers(0, 255, (24, 24, 3), dtype=np.uint8)
    big = np.kron(small, np.ones((4, 4, 1), np.uint8))
    other = r.integers(0, 255, (96, 96, 3), dtype=np.uint8)
    df = spark.createDataFrame([(0, bytes(small.tobytes()), 24, 24), (1, bytes(big.tobytes()), 96, 96), (2, bytes(other.tobytes()), 96, 96), (3, None, 1, 1)], "i int, px binary, w int, h int")
    h = df.select("i", media.picture_hashes("px", "w", "h").alias("h")).select("i", "h.p", "h.d")
    a, b = h.alias("a"), h.alias("b")
    same = a.join(b, F.col("a.i") < F.col("b.i")).where(media.same_picture(F.col("a.p"), F.col("a.d"), F.col("b.p"), F.col("b.d"))).select(F.col("a.i").alias("x"), F.col("b.i").alias("y"))
    assert rows(same, "x", "y") == [(0, 1)]


def test_sound(spark):
    r = np.random.default_rng(2)
    haystack = (r.standard_normal(60_000) * np.repeat(r.random(300) * 9000, 200)).astype(int)
    needle = haystack[20_000:40_000]
    df = spark.createDataFrame([(0, needle.tolist(), haystack.tolist()), (1, r.permutation(needle).tolist(), haystack.tolist()), (2, [], [])], "i int, n array<int>, h array<int>")
    got = {x.i: x.c for x in df.select("i", media.compare_point("n", "h", F.lit(8000)).alias("c")).collect()}
    assert got[0].score > 0.99 and got[0].offset == 100 and got[1].score < 0.7 and got[2].quiet
    assert media.spectral_score(media.spectrogram(needle, 8000), media.spectrogram(needle, 8000)) > 0.999
    verdicts = spark.createDataFrame([(5, 5, 4, 0.9), (5, 1, 0, 0.4), (5, 3, 2, 0.7), (5, 4, 1, 0.9), (0, 0, 0, 0.0)], "p int, h int, f int, m double")
    assert [x.v for x in verdicts.select(media.compare_verdict(F.col("p"), F.col("h"), F.col("f"), F.col("m")).alias("v")).collect()] == ["same", "different", "unsure", "different", "unsure"]


def test_containers(spark):
    mp4 = (24).to_bytes(4, "big") + b"ftypM4B " + bytes(12) + (16).to_bytes(4, "big") + b"moov" + b"drmsdrms" + (500).to_bytes(4, "big") + b"mdat"
    df = spark.createDataFrame([(0, mp4), (1, b"OggS...."), (2, bytes([0xFF, 0xFB, 0, 0])), (3, b""), (4, b"ID3x")], "i int, b binary")
    assert [r.c for r in df.select("i", media.container(F.col("b")).alias("c")).orderBy("i").collect()] == ["mp4", "ogg", "mp3", "unknown", "id3"]
    report = df.where("i = 0").select(media.mp4_report("b").alias("r")).first().r
    assert (report.locked, report.wanted) == ("drms", 540)


def test_sessions_stream(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    rows_ = [(f"s{i}", "u", "i", None, 60.0, dt.datetime(2026, 1, d), dt.datetime(2026, 1, d, 12)) for i, d in enumerate([1, 1, 2, 20])]
    spark.createDataFrame(rows_ + rows_[:1], catalog.schema("session")).coalesce(1).write.parquet(src)
    sessions.write(sessions.daily(sessions.read(spark, src)), out, ck).awaitTermination()
    got = {(str(r.day), r.seconds, r.sessions) for r in spark.read.parquet(out).collect()}
    assert {("2026-01-01", 120.0, 2), ("2026-01-02", 60.0, 1)} <= got


def test_ordered_subsequence_of_large_groups(spark, tmp_path):
    """All pairs by hand, where 150 conversations have one opening."""
    import random

    from curatrix import queries
    from curatrix.functions.arrays import _held

    r = random.Random(4)
    convs = {i: ["you are kind"] + ["x" * r.choice([3, 5, 9, 14, 40]) + r.choice("ab") for _ in range(r.randrange(0, 7))] for i in range(140)}
    convs |= {i: list(convs[i - 140]) for i in range(140, 150)}
    convs |= {200: ["other", "abc"], 201: ["other", "abc", "xyz123"], 202: ["alone"]}
    rows = [(i, k, "user", x) for i, said in convs.items() for k, x in enumerate(said)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    tracks = {i: [{"duration": float(len(x)), "filename": x, "size": 0} for x in said] for i, said in convs.items()}
    want = {}
    for a, short in tracks.items():
        for b, long in tracks.items():
            h = _held(short, long) if convs[a][0] == convs[b][0] else None
            if h:
                want[str(a)] = max(want.get(str(a), (0, "")), (len(long), str(b), h[0], len(h[1])))
    got = {x.short_id: (x.long_id, x.held, x.missing) for x in queries.ordered_subsequence(spark, str(tmp_path)).collect()}
    assert len(want) > 50 and got == {a: x[1:] for a, x in want.items()}


def test_audit_all_has_every_audit(spark, items):
    table = lambda name, *said: catalog.settled(spark.createDataFrame([tuple(r.get(f.name) for f in catalog.schema(name)) for r in said], catalog.schema(name)))
    # candidates are told by titles and authors, not by length alone
    pair = item(spark, [{"id": f"e{k}", "title": title, "authors": ["Orson Scott Card"], "duration": 40_000.0 + k} for k, title in enumerate(("Ender's Game", "Ender's Game: A Novel"))])
    got = {(r.check, r.field): r.found for r in audit_all(
        items.unionByName(pair), prefix="zz-provider:",
        authors=table("author", {"id": "a", "name": "Nobody"}),
        audio=table("audio_file", {"item_id": "d1", "idx": 1, "filename": "a  b.mp3", "ext": ".mp3", "duration": 8 * H}),
        library_files=table("library_file", {"item_id": "x1", "file_type": "ebook", "filename": "b.aax"}),
        probes=spark.createDataFrame([("d1", "a.mp3", ".mp3", "no", "", "", 1, 1, 0)], "item_id string, filename string, ext string, error string, container string, locked string, size long, wanted long, complaints int"),
        covers=spark.createDataFrame([("d1", 10, 10)], "item_id string, width int, height int"),
        records=table("provider_record", {"asin": "B9", "query_item_id": "d1"}),
        episodes=table("episode", {"item_id": "p1", "id": "e"}),
    ).collect()}
    assert {"spellings", "near_names", "odd_languages", "paths", "candidates", "author_records", "embedded", "locked_only", "unplayable", "covers", "matched", "stale_feeds"} <= {k for k, _ in got}
    assert got[("author_records", "no_books")] == got[("embedded", "untagged")] == got[("locked_only", "locked")] == got[("unplayable", "unread")] == got[("odd_languages", "language")] == 1
    assert got[("spellings", "authors")] == 1 and got[("matched", "not_found")] == 2 and got[("whitespace", "double_space")] == 2 and got[("stale_feeds", "feed")] == 1


def test_near_hashes_equal_all_pairs(spark):
    import random

    r = random.Random(4)
    base = [r.getrandbits(64) - (1 << 63) for _ in range(6)]
    rows_ = [(i, (base[i % 6] ^ sum(1 << r.randrange(63) for _ in range(r.randrange(7)))) if i % 11 else None) for i in range(120)]
    df = spark.createDataFrame(rows_, "id long, h long")
    want = sorted((a, b, ((x ^ y) & (2**64 - 1)).bit_count()) for a, x in rows_ for b, y in rows_ if a != b and x is not None and y is not None and ((x ^ y) & (2**64 - 1)).bit_count() <= 9)
    assert rows(joins.near_hashes(df, df, "h", "id", 9), "a", "b", "apart") == want


def test_links_of_either_key(spark):
    """Rows that share a name or a price are counted as listed, and a name that very many share makes no pairs."""
    some = spark.createDataFrame([(1, "a", "5"), (2, "", "5"), (3, "b", None), (4, "c", ""), (5, None, None)], "k int, n string, p string")
    other = spark.createDataFrame([(10, "a", "5"), (11, "a", "6"), (12, "b", "5"), (13, "", ""), (14, None, "5")], "k int, n string, p string")
    keys = (("n", "n"), ("p", "p"))
    listed = joins.either_key(some, other, keys, "k", "k").groupBy("left_id").count()
    got = {r.left_id: r.links for r in joins.either_key_links(some, other, keys, "k").collect()}
    assert got == {r["left_id"]: r["count"] for r in listed.collect()} == {1: 4, 2: 3, 3: 1}
    many = spark.range(200_000).selectExpr("id AS k", "'x' AS n", "cast(id as string) AS p")
    assert joins.either_key_links(many, many, keys, "k").agg({"links": "sum"}).first()[0] == 200_000**2


def test_planted_copies_are_found_whatever_their_lengths(spark, tmp_path):
    """A last turn as long as all before it, and conversations that are copies of others."""
    rows = [(k, turn, "user", "x" * n) for k in (4, 8, 12) for turn, n in enumerate((150, 1117, 300, 1540))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = [tuple(r) for r in library.planted_subsequence(spark, str(tmp_path)).orderBy("short_id").collect()]
    assert got == [("c12", "12", 3, 1), ("c4", "4", 3, 1), ("c8", "8", 3, 1)]


def test_spread_bounds_the_rows_of_a_task(spark):
    rows = spread(spark.range(4000), "id", most=200)
    assert rows.rdd.getNumPartitions() == 20
    assert max(r[0] for r in rows.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).select("n").collect()) < 400
