"""Pairs of candidates counted by classes, and pools told apart by what their books say together."""

import random
import time
from collections import namedtuple
from itertools import product

from pyspark.sql import functions as F

from curatrix.operators import duplicates
from curatrix.plans.audit_all import audit_all
from tests.test_duplicates import item

OTHER = (
    "numbering", "gaps", "series_names", "series_titles", "folder_styles", "genres", "roles", "spellings", "near_names", "fragments", "odd_languages", "whitespace", "paths", "duplicates", "placeholder_titles",
)
ROW = namedtuple("Row", "id key seconds tracks asin field readers names numbers positions")


def test_counts_are_those_of_the_pairs(spark):
    pick = random.Random(4).choice
    books = []
    for n in range(400):
        title, name = pick(("Ender's Game", "Mort", "Ender's Game: A Novel", "The Mort (Unabridged)", "Mort, Book 2", "Mort, Book 3", "Mort (read by Bo Lind)", " ", "Unknown")), pick(("Ann Lee", "Bo Lind", "Lee Ann", "Ann"))
        books.append({
            "id": f"x{n}", "media_type": pick(("book",) * 9 + ("podcast",)), "title": title, "authors": pick(([name], [name], [])), "narrators": pick(([], ["Bo Lind"], ["Cy Ray"], ["Cy Ray", "Bo Lind"])), "duration": pick((0.0, None, 900.0, 930.0, 950.0, 985.5, 1000.0, 1200.0)),
            "rel_path": pick(("", f"{name}/{title}", f"{name}/Saga/{n % 3} - {title}", f"Fiction/{pick(('Mort', 'Other Name'))}", f"{name}/{pick(('One', 'Two', 'Three'))}")), "asin": pick(("", "", f"B{n % 40}")), "isbn": pick(("", "", f"9{n % 30}")),
            "series": pick(([], [("1", "Saga", str(n % 3))], [("1", "Saga", f"0{n % 3}.0")], [("1", "Saga", ""), ("2", "Set", "x")])),
        })
    books = item(spark, books)
    told = duplicates.judged(books)
    listed = {r.why: r["count"] for r in duplicates.candidates(books, told).groupBy("why").count().collect()}
    assert set(listed) == {"close", "title", "edition", "other_author"}
    assert {r.why: r.found for r in duplicates.candidate_counts(books, told).collect()} == listed
    assert duplicates.candidate_counts(books.where("false"), told.where("false")).count() == 0


def test_copies_without_end_are_counted(spark):
    """Before, their 400 million pairs were listed."""
    first = item(spark, [{"id": "a", "title": "Mort", "authors": ["Ann Lee"], "duration": 1000.0, "rel_path": "Ann Lee/Mort"}, {"id": "b", "title": "Mort: A Novel", "authors": ["Ann Lee"], "duration": 1010.0, "rel_path": "Ann Lee/Mort"}])
    many = spark.range(20_000).crossJoin(first.withColumnRenamed("id", "name")).withColumn("id", F.concat("name", "id"))
    found = audit_all(many.select(*first.columns), skip=OTHER).where("check = 'candidates'").collect()
    assert [(r.field, r.found) for r in found] == [("title", 20_000 * 20_000)]


def _copies(n: int) -> list:
    pick = random.Random(n).choice
    numbers = lambda: [{"before": pick(("", "a", "a b", "b")), "word": pick(("book", "#")), "number": pick(("1", "01", "2", "nan"))} for _ in range(pick((0, 0, 0, 1, 2)))]
    positions = lambda: [{"key": pick(("s", "t")), "number": pick(("1", "1.0", "2", "x", " x"))} for _ in range(pick((0, 0, 1, 2)))]
    return [ROW(f"i{i}", "isbn:1", 1.0, 1, "", [], [], pick(([], ["m"], ["m", "n"], ["o"])), numbers(), positions()) for i in range(pick((1, 2, 3)))]


def test_pools_differ_as_their_books_do():
    book = lambda x: (tuple(sorted((n["before"], n["word"], n["number"]) for n in x.numbers)), tuple(sorted((n["key"], n["number"]) for n in x.positions)), tuple(x.names))
    seen = set()
    for n in range(0, 6000, 2):
        a, b = _copies(n), _copies(n + 1)
        by_book = {duplicates._two_books(book(x), book(y)) for x, y in product(a, b)}
        pools = []
        for copies in (a, b):
            pools.append(duplicates._Pool(copies[0]))
            for x in copies[1:]:
                pools[-1].absorb(duplicates._Pool(x))
        why = duplicates._two_pools(*pools)
        assert why == next((w for w in ("numbers", "positions", "folders") if w in by_book), "")
        seen.add(why)
    assert seen == {"numbers", "positions", "folders", ""}


def test_large_pools_are_told_apart_at_once():
    """A copy costs a step for each pool, not for each book that a pool has taken up."""
    rows = [ROW(f"a{i:05d}", key, 1000.0, 1, "A", [], [], [f"n{i}"], [{"before": "saga", "word": "book", "number": str(i % 500)}], [{"key": f"s{i}", "number": "1"}]) for i in range(4000) for key in ("asin:A", *(("isbn:1",) if i < 500 else ()))]
    rows += [ROW(f"b{i:05d}", "isbn:1", 1000.0, 1, "", [], [], ["n"], [{"before": "saga", "word": "book", "number": "7"}], []) for i in range(1500)]
    begun = time.monotonic()
    got = duplicates._grouped(rows)
    assert time.monotonic() - begun < 5
    assert len({a for kind, a, *_ in got if kind == "group"}) == 2
