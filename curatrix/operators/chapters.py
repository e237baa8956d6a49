"""Chapters: what is wrong with a list, fitting it to its audio, moving it with its tracks, spread between readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions import arrays as ar
from curatrix.functions import text as t

END_SLACK, GAP_LEAST, GAP_SHARE, OVERLAP_SLACK, LONG_HOURS = 5.0, 60.0, 0.01, 1.0, 2
SPREAD, SPREAD_CHAPTERS, SPREAD_SECONDS, SPREAD_COVER, SPREAD_DRIFT, READINGS_APART = 1.35, 5, 60.0, 0.5, 1.3, 0.10
#: Words of a chapter title that tell nothing of its text.
SPLIT_WORDS = ("track", "disc", "disk", "cd", "part", "side", "tape", "file", "of")
c = F.col


def order_problems(rows: DataFrame, keys: list[str], order: list, start: str, end: str, slack: float = OVERLAP_SLACK) -> DataFrame:
    """Rows that start no later than the one before, or that the one before runs into by more than the slack."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = rows.withColumns({"prev_start": F.lag(start).over(w), "prev_end": F.lag(end).over(w)})
    return before.withColumn("problem", F.when(c(start) <= c("prev_start"), "not_after").when(c("prev_end") > c(start) + slack, "overlap")).where("problem is not null")


def problems(items: DataFrame, chapters: DataFrame) -> DataFrame:
    """id, title, problem, detail: past_end, out_of_order, short, single. Podcasts and items without length have none."""
    listed = chapters.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("pos", "start", "end", F.col("title").alias("name")))).alias("l"))
    w = items.where((c("media_type") != "podcast") & (c("duration") > 0)).join(listed, c("id") == c("item_id"))
    last = F.array_max(F.transform("l", lambda x: F.struct(x["end"].alias("end"), x["pos"].alias("pos"), x["name"].alias("name"))))
    past = F.filter("l", lambda x: x["start"] >= c("duration"))
    gap = c("duration") - c("last.end")
    w = w.withColumns({"last": last, "past": past})
    bad = F.filter(F.transform(F.sequence(F.lit(1), F.size("l")), lambda i: F.when(i > 1, F.when(F.get("l", i - 1)["start"] <= F.get("l", i - 2)["start"], i).when(F.get("l", i - 2)["end"] > F.get("l", i - 1)["start"] + OVERLAP_SLACK, i))), lambda i: i.isNotNull())
    say = lambda cond, problem, detail: F.when(cond, F.struct(F.lit(problem).alias("problem"), detail.alias("detail")))
    secs = lambda x: F.format_string("%.1fs", x)
    found = F.array_compact(
        F.array(
            F.when(F.size("past") > 0, F.struct(F.lit("past_end").alias("problem"), F.concat(F.size("past").cast("string"), F.lit(" of "), F.size("l").cast("string"), F.lit(" chapters start at or past the end")).alias("detail"))).when(
                c("last.end") > c("duration") + END_SLACK, F.struct(F.lit("past_end").alias("problem"), F.concat(F.lit("the last chapter ends "), secs(c("last.end") - c("duration")), F.lit(" past the end")).alias("detail"))
            ),
            say(F.size(bad) > 0, "out_of_order", F.concat(F.lit("chapter "), F.get(bad, F.lit(0)).cast("string"), F.lit(" of "), F.size(bad).cast("string"), F.lit(" out of place"))),
            say((gap > GAP_LEAST) & (gap > GAP_SHARE * c("duration")), "short", F.concat(secs(gap), F.lit(" of audio after the last chapter"))),
            say((F.size("l") == 1) & (c("duration") >= LONG_HOURS * 3600), "single", F.lit("one chapter over the whole")),
        )
    )
    return w.select("id", "title", F.explode(found).alias("f")).select("id", "title", "f.problem", "f.detail")


def fit(items: DataFrame, chapters: DataFrame) -> DataFrame:
    """Chapters fitted to their audio: id, kept (array), dropped, error. Those that start past the end go, the last ends with
    the audio; a list out of order, or with nothing left, is refused."""
    listed = chapters.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("title").alias("name"), "start", "end"))), lambda x: F.struct(x["name"].alias("title"), x["start"].alias("start"), x["end"].alias("end"))).alias("l"))
    j = items.select("id", "duration").join(listed, c("id") == c("item_id"), "left").withColumn("k", F.filter("l", lambda x: x["start"] < c("duration")))
    disorder = F.exists(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size("k"))), lambda i: (F.get("k", i - 1)["start"] <= F.get("k", i - 2)["start"]) | (F.get("k", i - 2)["end"] > F.get("k", i - 1)["start"] + OVERLAP_SLACK))
    error = F.when(F.coalesce(F.size("l"), F.lit(0)) == 0, "no chapters").when(c("duration") <= 0, "no audio").when(F.size("k") == 0, "every chapter is past the end").when(F.coalesce(disorder, F.lit(False)), "out of order")
    ended = F.transform("k", lambda x, i: F.struct(i.alias("id"), x["title"].alias("title"), x["start"].alias("start"), F.when(i == F.size("k") - 1, c("duration")).otherwise(x["end"]).alias("end")))
    return j.withColumn("error", error).select("id", F.when(c("error").isNull(), ended).alias("kept"), F.when(c("error").isNull(), F.size("l") - F.size("k")).alias("dropped"), "error")


def moved(chapters: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Chapters re-based when tracks change places: item_id, title, start, end, split (it spanned two tracks).

    before, after: item_id, filename, start_offset, duration. A chapter belongs to the track that holds its start.
    """
    a = before.select("item_id", "filename", c("start_offset").alias("a"), (c("start_offset") + c("duration")).alias("z"))
    b = after.select("item_id", "filename", c("start_offset").alias("to"))
    j = chapters.join(a, "item_id").where((c("a") <= c("start")) & (c("start") < c("z"))).join(b, ["item_id", "filename"])
    return j.select("item_id", "title", (c("start") - c("a") + c("to")).alias("start"), (c("end") - c("a") + c("to")).alias("end"), (c("end") > c("z") + OVERLAP_SLACK).alias("split")).orderBy("item_id", "start")


def chapter_key(title, book_words):
    """A chapter's title without its number; empty if it says nothing of the book's own."""
    key = F.lower(t.trim(F.regexp_replace(t.trim(title), r"^\d+\s*[:.\-]?\s*", "")))
    telling = F.exists(t.words(t.norm(key)), lambda w: ~w.isin(*SPLIT_WORDS) & ~F.array_contains(book_words, w) & (F.regexp_replace(w, "^[0-9]+|[0-9]+$", "") != ""))
    return F.when(telling, key).otherwise("")


def spreads(items: DataFrame, chapters: DataFrame, reading: str = "reading") -> DataFrame:
    """Pairs of readings of one work (column ``reading``), ten percent apart or more: long_id, short_id, n, lo, hi, spread, cut.

    spread: ninth over first decile of the ratios of the lengths of chapters that both name, if they are enough, cover half
    of both and centre on the ratio of the whole lengths; else null. cut: the spread is over the limit.
    """
    side = lambda p: items.where(c(reading) != "").select(c(reading).alias("reading"), c("id").alias(f"{p}_id"), c("duration").alias(f"{p}_seconds"), c("title").alias(f"{p}_title"), F.array_join("authors", " ").alias(f"{p}_author"))
    pairs = side("long").join(side("short"), "reading").where((c("short_seconds") > 0) & (c("long_seconds") > c("short_seconds")) & (1 - c("short_seconds") / c("long_seconds") >= READINGS_APART))
    pairs = pairs.withColumn("book", t.words(t.norm(F.concat_ws(" ", "long_title", "long_author", "short_title", "short_author"))))
    ch = lambda p: chapters.select(c("item_id").alias(f"{p}_id"), c("title").alias("name"), (c("end") - c("start")).alias("len"))
    of = lambda p: pairs.join(ch(p), f"{p}_id").withColumn("k", chapter_key(c("name"), c("book"))).where("k != ''").groupBy("long_id", "short_id", "k").agg(F.sum("len").alias(p))
    both = of("long").join(of("short"), ["long_id", "short_id", "k"]).where((c("long") > SPREAD_SECONDS) & (c("short") > SPREAD_SECONDS))
    agg = both.groupBy("long_id", "short_id").agg(F.array_sort(F.collect_list(c("long") / c("short"))).alias("r"), F.sum("long").alias("cover_long"), F.sum("short").alias("cover_short"))
    j = pairs.select("long_id", "short_id", "long_seconds", "short_seconds").join(agg, ["long_id", "short_id"], "left")
    whole, mid = c("long_seconds") / c("short_seconds"), ar.decile(c("r"), 5)
    ok = (F.size("r") >= SPREAD_CHAPTERS) & (c("cover_long") >= SPREAD_COVER * c("long_seconds")) & (c("cover_short") >= SPREAD_COVER * c("short_seconds")) & (mid <= whole * SPREAD_DRIFT) & (mid >= whole / SPREAD_DRIFT)
    lo, hi = ar.decile(c("r"), 1), ar.decile(c("r"), 9)
    spread = F.when(ok & (lo > 0), hi / lo)
    return j.select("long_id", "short_id", F.coalesce(F.size("r"), F.lit(0)).alias("n"), lo.alias("lo"), hi.alias("hi"), spread.alias("spread"), F.coalesce(spread > SPREAD, F.lit(False)).alias("cut"))
