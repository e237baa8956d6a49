"""Readings of one book held against each other, chapter by chapter: which short one is cut unevenly.

A reading's chapters become a list of titles and lengths once. Readings of a work that say the same (title words, chapters,
length) are one class, however many copies there are. Classes of a work stand by length in blocks of ``BLOCK``; a task holds
two blocks against each other, skips pairs nearer in length than ``READINGS_APART`` before it looks at their chapters, and
keeps for each short class only the widest spread, so what leaves a task is a row for each class, never its pairs.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions import arrays as ar
from curatrix.functions import display as d
from curatrix.functions import text as t
from curatrix.operators.chapters import READINGS_APART, SPLIT_WORDS, SPREAD, SPREAD_CHAPTERS, SPREAD_COVER, SPREAD_DRIFT, SPREAD_SECONDS
from curatrix.sources.storage import written

#: Classes of readings in one block, and, about, in a lot of small works.
BLOCK, LOT = 200, 2000
c = F.col


def readings(items: DataFrame, chapters: DataFrame) -> DataFrame:
    """work, id, place (in the listing), seconds, says (abridged), book (words of title and author), chapters (name, telling, len).

    Books with chapters whose work at least two items share; chapters by title without its number, the lengths of equal ones
    added. telling: the words of a chapter's title that neither number it nor name a part of a recording.
    """
    author = F.array_join("authors", ", ")
    books = items.where((c("media_type") != "podcast") & (c("num_chapters") > 0)).select(
        "id", "added_at", c("duration").alias("seconds"), t.says_abridged(c("abridged"), c("title"), c("subtitle")).alias("says"), d.reading_key(c("title"), author).alias("work"),
        F.array_sort(F.array_distinct(t.words(t.norm(F.concat_ws(" ", "title", author))))).alias("book"),
    )
    books = books.where("work != ''")
    shared = books.groupBy("work").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("work")
    books = books.join(shared, "work", "left_semi")
    name = F.lower(t.trim(F.regexp_replace(t.trim(c("title")), r"^\d+\s*[:.\-]?\s*", "")))
    telling = F.filter(t.words(t.norm(name)), lambda w: ~w.isin(*SPLIT_WORDS) & (F.regexp_replace(w, "^[0-9]+|[0-9]+$", "") != ""))
    parts = chapters.select(c("item_id").alias("id"), name.alias("name"), telling.alias("telling"), (c("end") - c("start")).alias("len")).where("name != ''")
    parts = parts.groupBy("id", "name").agg(F.first("telling").alias("telling"), F.sum("len").alias("len")).where(c("len") > SPREAD_SECONDS)
    lists = parts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("name", "telling", "len"))).alias("chapters"))
    place = F.struct(c("added_at").alias("at"), c("id").alias("id"))
    return books.join(lists, "id").select("work", "id", place.alias("place"), "seconds", "says", "book", "chapters")


def spread_of(long: dict, short: dict) -> tuple[float, float, float, int] | None:
    """spread, lowest and highest decile of the ratios and their number, of two readings; None if their chapters can't be compared.

    Only chapters that both name count, whose title tells something that neither's title or author does.
    """
    book = long["words"] | short["words"]
    both = [(n, long["names"][n]) for n in short["names"] if n in long["names"]]
    lengths = [(l, short["names"][n][0]) for n, (l, telling) in both if not telling <= book]
    if len(lengths) < SPREAD_CHAPTERS or sum(a for a, _ in lengths) < SPREAD_COVER * long["seconds"] or sum(b for _, b in lengths) < SPREAD_COVER * short["seconds"]:
        return None
    ratios = sorted(a / b for a, b in lengths)
    lo, mid, hi = (ar.decile_of(ratios, i) for i in (1, 5, 9))
    whole = long["seconds"] / short["seconds"]
    if lo <= 0 or mid > whole * SPREAD_DRIFT or mid < whole / SPREAD_DRIFT:
        return None
    return hi / lo, lo, hi, len(ratios)


def _told(r) -> dict:
    names = {x["name"]: (x["len"], frozenset(x["telling"])) for x in r.chapters}
    return {"cls": r.cls, "id": r.id, "place": r.at, "seconds": r.seconds, "says": r.says, "copies": r.copies, "words": set(r.book), "names": names}


_WIDEST = "work string, cls string, long_cls string, long_id string, place long, n int, lo double, hi double, spread double, shown double, compared long"


def _held(rows: pd.DataFrame) -> pd.DataFrame:
    """Of two blocks of each work in a lot (side 0: short, 1: long) the widest spread of each short class, and how many pairs were compared."""
    blocks: dict[tuple, tuple[list, list]] = {}
    for r in rows.itertuples(index=False):
        blocks.setdefault((r.work, r.i, r.j), ([], []))[r.side].append(_told(r))
    out = []
    for (work, *_), (shorts, longs) in blocks.items():
        for s in shorts:
            best, compared = None, 0
            for l in longs:
                if s["seconds"] <= 0 or s["seconds"] >= l["seconds"] * (1 - READINGS_APART):
                    continue
                found = spread_of(l, s)
                if found is None:
                    continue
                compared += s["copies"] * l["copies"]
                spread, lo, hi, n = found
                if spread <= SPREAD or s["says"]:
                    continue
                shown = ar.spread_shown(spread, SPREAD)
                if best is None or (-shown, l["place"]) < (-best[9], best[4]):
                    best = (work, s["cls"], l["cls"], l["id"], l["place"], n, lo, hi, spread, shown)
            if compared:
                out.append((*(best or (work, s["cls"], None, None, None, 0, None, None, None, None)), compared))
    return pd.DataFrame(out, columns=[x.split()[0] for x in _WIDEST.split(", ")])


def sweep(items: DataFrame, chapters: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The short readings that are cut unevenly (id, title, author, path, duration_s, problem, spread, chapters, lo, hi, long_id,
    long_path, long_s), each against the reading that it differs from most; and how many pairs were compared (a row: pairs).

    A copy counts for each reading that it is compared with, as if all pairs were compared. Of equal spreads, as they are
    shown, the long reading first in the listing (by time added, then id) counts.
    """
    rows = readings(items, chapters)
    content = F.sha2(F.to_json(F.struct("book", "chapters", "seconds", "says")), 256)
    members = written(rows.withColumn("cls", content), "readings")
    # a class is represented by its first member in the listing
    reps = members.groupBy("work", "cls").agg(F.min_by(F.struct("id", "seconds", "says", "book", "chapters"), "place").alias("r"), F.min("place").alias("place"), F.count(F.lit(1)).alias("copies"))
    order = Window.partitionBy("work")
    slim = reps.select("work", "cls", c("r.seconds").alias("seconds"), "place")
    slim = slim.withColumns({"b": F.floor((F.row_number().over(order.orderBy("seconds", "cls")) - 1) / block), "at": F.row_number().over(order.orderBy("place")).cast("long"), "last": F.max("seconds").over(order)})
    reps = written(reps.drop("place").join(slim.drop("seconds", "last"), ["work", "cls"]), "reading-classes")
    blocks = reps.groupBy("work", "b").agg(F.max("r.seconds").alias("most"), F.min("r.seconds").alias("least"))
    low, high = blocks.select("work", c("b").alias("i"), "least"), blocks.select("work", c("b").alias("j"), "most")
    tasks = low.join(high, "work").where((c("i") <= c("j")) & (c("least") < c("most") * (1 - READINGS_APART)))
    tasks = tasks.withColumn("whole", F.max("j").over(Window.partitionBy("work")) == 0)
    one = reps.select("work", "cls", "b", "at", "copies", "r.*")
    short, long = one.join(tasks.select("work", c("i").alias("b"), "i", "j", "whole"), ["work", "b"]), one.join(tasks.select("work", c("j").alias("b"), "i", "j", "whole"), ["work", "b"])
    both = short.withColumn("side", F.lit(0)).unionByName(long.withColumn("side", F.lit(1)))
    # works of one block share a lot with others, so that very many small ones are few groups
    lots = max(1, -(-reps.count() // LOT))
    lot = F.when(c("whole"), F.concat(F.lit("lot"), F.pmod(F.xxhash64("work"), F.lit(lots)).cast("string"))).otherwise(F.concat_ws("|", "i", "j", "work"))
    found = written(both.withColumn("lot", lot).drop("b", "whole").groupBy("lot").applyInPandas(_held, _WIDEST), "reading-spreads")
    widest = found.where("spread is not null").groupBy("work", "cls").agg(F.min_by(F.struct("long_id", "n", "lo", "hi", "shown"), F.struct(-c("shown"), c("place"))).alias("w"))
    named = lambda p, *more: items.select(c("id").alias(f"{p}id"), *more)
    told = members.select("work", "cls", "id").join(widest, ["work", "cls"]).select("id", "w.*")
    told = told.join(named("", "title", F.array_join("authors", ", ").alias("author"), c("rel_path").alias("path"), d.whole_seconds(c("duration")).alias("duration_s")), "id").join(named("long_", c("rel_path").alias("long_path"), d.whole_seconds(c("duration")).alias("long_s")), "long_id")
    out = told.select("id", "title", "author", "path", "duration_s", F.lit("uneven_chapters").alias("problem"), c("shown").alias("spread"), c("n").alias("chapters"), "lo", "hi", "long_id", "long_path", "long_s")
    return out, found.agg(F.coalesce(F.sum("compared"), F.lit(0)).alias("pairs"))
