"""What tells copies and books apart, grouping, and what is left out as incomplete."""

import time
from collections import namedtuple

import pytest
from pyspark.sql import functions as F

from curatrix.functions import text as t
from curatrix.operators import book_facts, duplicates
from curatrix.operators.rows import in_groups
from curatrix.sources import catalog


def item(spark, records):
    wanted = catalog.schema("item")
    return catalog.settled(spark.createDataFrame([tuple(r.get(f.name) for f in wanted) for r in records], wanted))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def pairs(df, *cols):
    return sorted(tuple(r[x] for x in cols) for r in df.collect())


@pytest.mark.parametrize(
    ("title", "core"),
    [("Ender's Game (20th Anniversary full cast)", "enders game"), ("The Redemption of Time: The Three-Body Problem, Book 4", "redemption of time"), ("Honor - 01 - Above All", "above all"), ("", ""), (None, "")],
)
def test_cores(spark, title, core):
    assert one(spark, book_facts.core(F.lit(title))) == core


@pytest.mark.parametrize(
    ("folder", "author", "names"),
    [
        ("Honor - 01 - Above All", "Radclyffe", ["above all"]),
        ("03 - Mort", "Terry Pratchett", ["mort"]),
        ("Frank Herbert - Dune", "Frank Herbert", ["frank herbert dune", "dune"]),
        ("Above All - Radclyffe", "Radclyffe", ["above all radclyffe", "above all"]),
        ("Dune - Copy", "Frank Herbert", ["dune"]),
        ("The Hobbit {Andy Serkis}", "J. R. R. Tolkien", ["hobbit"]),
        ("Honor - 1", "Radclyffe", ["honor 1"]),
        ("Honor Bound - Unabridged", "Radclyffe", ["honor bound unabridged", "honor bound"]),
    ],
)
def test_book_names(spark, folder, author, names):
    assert one(spark, book_facts.book_names(F.lit(folder), book_facts.name_words(F.lit(author)))) == names


def test_brackets(spark):
    told = one(spark, book_facts.bracketed(F.lit("Dune (Unabridged) [2007]"), F.lit("Dune (Scott Brick 2007) [Frank Herbert] (copy)"), book_facts.name_words(F.lit("Frank Herbert"))))
    assert told.readers == ["Scott Brick"] and told.labels == ["Unabridged"]
    assert one(spark, book_facts.turned_readers(F.array(*map(F.lit, ("Barrett", "Sean", "John Lee", "Cher"))))) == ["Sean Barrett", "John Lee", "Cher"]


def test_name_numbers(spark):
    got = lambda name: [(n.before, n.word, n.number) for n in one(spark, book_facts.name_numbers(F.lit(name)))]
    assert got("Mushoku Tensei: Jobless Reincarnation, Vol. 17") == [("mushoku tensei jobless reincarnation", "vol", "17")]
    assert got("Part 1 Volume Two") == [("", "part", "1"), ("part 1", "vol", "2")]
    assert got("Mort #4") == [("mort", "#", "4")] and got("CD1") == [("", "disc", "1")] and got("Nothing here") == []


BOOKS = [
    {"id": "a1", "title": "Honor", "authors": ["Radclyffe"], "duration": 30000.0, "rel_path": "Radclyffe/Honor - 01 - Above All"},
    {"id": "a2", "title": "Honor", "authors": ["Radclyffe"], "duration": 30100.0, "rel_path": "Radclyffe/Honor - 02 - Honor Bound"},
    {"id": "b1", "title": "Light Novel, Vol. 17", "authors": ["X Y"], "duration": 20000.0, "rel_path": "X/Light Novel, Vol. 17", "isbn": "9"},
    {"id": "b2", "title": "Light Novel, Vol. 18", "authors": ["X Y"], "duration": 20000.0, "rel_path": "X/Light Novel, Vol. 18", "isbn": "9"},
    {"id": "c1", "title": "Dune", "authors": ["Frank Herbert"], "duration": 70000.0, "rel_path": "Frank Herbert/Dune"},
    {"id": "c2", "title": "Dune", "authors": ["Frank Herbert"], "duration": 70500.0, "rel_path": "Frank Herbert/Dune 1965 Edition"},
    {"id": "c3", "title": "Dune", "authors": ["Frank Herbert"], "duration": 70200.0, "rel_path": "Frank Herbert/Dune (John Lee)"},
    {"id": "c4", "title": "Dune", "authors": ["Frank Herbert"], "duration": 70300.0, "rel_path": "Frank Herbert/Dune (Scott Brick)"},
    {"id": "d1", "title": "Book", "authors": ["N"], "duration": 9000.0, "asin": "B1"},
    {"id": "d2", "title": "Another", "authors": ["N"], "duration": 3000.0, "asin": "b1"},
    {"id": "e1", "title": "Alone", "authors": ["N"], "duration": 5000.0},
    {"id": "f1", "title": "Same", "authors": ["N"], "duration": 5000.0},
    {"id": "f2", "title": "same ", "authors": ["N"], "duration": 5000.0},
    {"id": "f3", "title": "Same", "authors": ["N"], "duration": 0.0},
]


def test_groups_keep_books_apart(spark):
    told = duplicates.judged(item(spark, BOOKS))
    assert pairs(told.where("kind = 'group'"), "a", "b") == [("c1", "c1"), ("c1", "c3"), ("d1", "d1"), ("d1", "d2"), ("f1", "f1"), ("f1", "f2")]
    assert pairs(told.where("kind = 'apart'"), "a", "b", "why") == [("d1", "d2", "asin")]
    assert [r.why for r in told.where("kind = 'close'").collect()] and set(pairs(told.where("kind = 'close'"), "why")) == {("folders",)}
    assert duplicates.judged(item(spark, BOOKS).where("false")).count() == 0


def test_equal_copies_stand_for_each_other(spark):
    many = [{"id": f"x{n:04d}", "title": "T", "authors": ["A"], "asin": "B9", "duration": 100.0 + n % 2} for n in range(400)]
    assert {r.a for r in duplicates.judged(item(spark, many)).where("kind = 'group'").collect()} == {"x0000"}
    assert duplicates.groups(item(spark, many)).count() == 400


def test_settled_leaves_incomplete_copies_out(spark):
    books = [{"id": "w", "title": "T", "authors": ["A"], "duration": 300.0, "num_tracks": 3}, {"id": "s", "title": "T", "authors": ["A"], "duration": 200.0, "num_tracks": 2}, {"id": "o", "title": "T", "authors": ["A"], "duration": 295.0, "num_tracks": 1}]
    tracks = spark.createDataFrame([("w", k, 100.0, f"{k}.mp3", 10 + k) for k in range(3)] + [("s", k, 100.0, f"{k}.mp3", 10 + k) for k in (0, 2)] + [("o", 0, 295.0, "all.mp3", 5)], "item_id string, idx int, duration double, filename string, size long")
    groups, found = duplicates.settled(item(spark, books), tracks)
    assert pairs(groups, "group", "id") == [("o", "o"), ("o", "w")]
    assert pairs(found, "short_id", "long_id", "held") == [("s", "w", 2)]


def test_candidates(spark):
    books = [
        {"id": "a", "title": "Ender's Game", "authors": ["Orson Scott Card"], "duration": 40000.0, "rel_path": "Orson Scott Card/Enders Game"},
        {"id": "b", "title": "Ender's Game (20th Anniversary)", "authors": ["Orson Scott Card"], "duration": 42400.0, "rel_path": "Orson Scott Card/Enders Game 20"},
        {"id": "c", "title": "Enders Game: A Novel", "authors": ["Enders Game 1"], "duration": 40100.0, "rel_path": "Orson Scott Card/Enders"},
        {"id": "d", "title": "Ender's Game: Told Anew", "authors": ["Someone Else"], "duration": 40050.0, "rel_path": "Fiction/Enders"},
        {"id": "e", "title": "Ender's Game, Book 2", "authors": ["Orson Scott Card"], "duration": 40000.0, "rel_path": "x/y"},
    ]
    books = item(spark, books)
    got = {(r.a, r.b): r.why for r in duplicates.candidates(books, duplicates.judged(books)).collect()}
    assert got[("a", "b")] == "edition" and got[("a", "c")] == "title" and got[("a", "d")] == "other_author" and ("a", "e") not in got


def test_relinked_many_single_files(spark):
    files = lambda i, name, size, s: (i, 0, s, None, False, None, name, "mp3", size, None, None)
    side = lambda xs: duplicates.content_key(spark.createDataFrame(xs, catalog.AUDIO_FILE))
    missing = side([files("o1", "a.mp3", 5, 100.0), files("o2", "b.mp3", 6, 50.0)])
    present = side([files("n1", "a.mp3", 5, 110.0), files("n2", "z.mp3", 6, 50.5), files("n3", "q.mp3", 6, 90.0), files("n4", "a.mp3", 5, 200.0)])
    assert pairs(duplicates.relinked(missing, present), "old_id", "new_id", "how") == [("o1", "n1", "same files"), ("o2", "n2", "renamed")]
    assert t.trim is not None


def test_many_copies_of_one_key():
    """One key that very many copies share costs a step for each pool, not for each two copies; the rules are the same."""
    row = namedtuple("Row", "id key seconds tracks asin field readers names numbers positions")
    one = lambda i, seconds, asin: row(f"i{i:05d}", "isbn:1", seconds, 1, asin, [], [], [], [], [])
    rows = [one(i, 1000.0 + i % 100, f"A{i % 3}" if i % 2 else "") for i in range(6000)]
    begun = time.monotonic()
    got = duplicates._grouped(rows + [one(6000, 500.0, "")])
    assert time.monotonic() - begun < 20
    grouped = {i: g for kind, g, i, _ in got if kind == "group"}
    assert len(grouped) == 6000 and len(set(grouped.values())) == 3
    assert [(b, why) for kind, _, b, why in got if kind == "apart"] == [("i06000", "isbn")] * 3


def test_groups_follow_each_other_in_a_task(spark):
    rows = spark.range(5000).selectExpr("cast(id % 1000 as string) AS k", "id AS n")
    got = in_groups(rows, ["k"], lambda g: [(g[0].k, len(g), sum(r.n for r in g))], "k string, rows long, total long").collect()
    assert len(got) == 1000 and all(r.rows == 5 and r.total == 5 * int(r.k) + 10_000 for r in got)


def test_facts_write_out_a_key_once(spark):
    """What a row's facts share is computed once: the keys that its plan writes out (86 of them before) stay few."""
    plan = duplicates.copy_facts(item(spark, [{"id": "a", "title": "One"}]))._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("translate(") <= 30


def test_let_computes_a_value_once(spark):
    assert one(spark, t.let(F.rand(), lambda x: x == x))
    assert one(spark, t.let(F.lit(None).cast("string"), lambda x: t.blank(x))) == ""
    assert one(spark, t.let(F.lit(2), lambda x: t.let(x + 1, lambda y: x * y))) == 6


def test_choices_are_counted_without_pairs(spark):
    """relink_choices() says of relinked() what its pairs say, and takes records without end that have one content."""
    files = spark.range(400).selectExpr("id AS item_id", "false AS exclude", "cast(id * 7 % 5 * 0.5 + if(id % 3 = 0, 40, 0) AS double) AS duration", "concat('f', id * id % 4) AS filename", "cast(id % 3 AS bigint) AS size")
    more = files.where("item_id % 4 = 0").withColumn("filename", F.lit("g"))
    key = duplicates.content_key(files.unionByName(more))
    missing, present = key.where("item_id % 8 < 3"), key.where("item_id % 8 >= 3")
    paired = duplicates.relinked(missing, present).groupBy("old_id").agg(F.count(F.lit(1)).alias("choices"), F.min("new_id").alias("first"))
    got = pairs(duplicates.relink_choices(missing, present), "old_id", "choices", "first")
    assert got == pairs(paired, "old_id", "choices", "first") and len(got) > 50
    many = duplicates.content_key(spark.range(60_000).selectExpr("id AS item_id", "false AS exclude", "10.0D AS duration", "'f' AS filename", "1L AS size"))
    counted = duplicates.relink_choices(many.where("item_id % 2 = 0"), many.where("item_id % 2 = 1"))
    assert counted.agg(F.count("*"), F.min("choices"), F.max("first")).first() == (30_000, 30_000, 1)


def test_near_keys_with_a_shared_head(spark):
    """Keys that share a long head and end are no candidates for that; those two edits apart all are, short and long."""
    from curatrix.operators import vocabulary

    keys = spark.range(600).selectExpr("concat('http www example org en ', conv(cast(id * 2654435761 % 4294967296 AS string), 10, 36), ' page html') AS key")
    assert vocabulary._left_out(keys).count() < 600
    ends = spark.createDataFrame([(f"{'long ' * k}title {x} of it",) for k in (0, 9, 10, 11) for x in ("abcd", "abed", "bacd", "abc", "abcdef", "xyzd")], "key string")
    got = pairs(vocabulary.near_keys(ends, "tags", t.typo_apart), "a", "b")
    both = ends.alias("p").join(ends.select(F.col("key").alias("q")), F.col("key") < F.col("q")).where(t.typo_apart(F.col("key"), F.col("q")))
    assert got == pairs(both, "key", "q") and len(got) > 12
