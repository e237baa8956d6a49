"""Named checks of catalogue items. Each is a pair of Columns over the item table: whether it applies, and what it says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions import text as t

LONG_HOURS, STALE_DAYS = 2, 90
c = F.col


def checks(prefix: str = "") -> dict[str, tuple[Column, Column]]:
    """name -> (applies, detail). prefix: of provider tags; a tag ``<prefix>none`` marks an item that no provider has."""
    book, podcast = c("media_type") != "podcast", c("media_type") == "podcast"
    author = F.array_join("authors", ", ")
    unmatchable = F.lower(t.provider_tag(c("tags"), prefix)) == "none" if prefix else F.lit(False)
    say = F.lit
    return {
        "unmatched": (book & (c("asin") == "") & (c("isbn") == "") & ~unmatchable, say("no asin or isbn")),
        "author_as_title": (book & (author != "") & (c("title") != "") & (t.norm(author) == t.norm(c("title"))), say("author and title are the same")),
        "cover": (c("cover_path") == "", say("no cover")),
        "description": (t.stub_description(c("description")).isNotNull(), F.concat(say("description: "), t.stub_description(c("description")))),
        "narrator": (book & (F.size("narrators") == 0), say("no narrator")),
        "series": (book & (F.size("series") == 0), say("no series")),
        "author": (F.size("authors") == 0, say("no author")),
        "genres": (F.size("genres") == 0, say("no genres")),
        "year": (book & (c("published_year") == ""), say("no published year")),
        "publisher": (book & (c("publisher") == ""), say("no publisher")),
        "language": (c("language") == "", say("no language")),
        "chapters": (book & (c("num_chapters") == 0) & (c("duration") >= LONG_HOURS * 3600), F.when(c("num_tracks") == 1, "one track without chapters").otherwise("many tracks without chapters")),
        "issues": (c("is_missing") | c("is_invalid"), F.when(c("is_missing"), "missing from disk").otherwise("invalid")),
        "no_audio": (book & (c("num_tracks") == 0) & (c("num_audio_files") == 0), say("no audio")),
        "no_episodes": (podcast & (c("num_episodes") == 0), say("no episodes")),
    }


def applying(conditions: dict[str, Column]) -> Column:
    """The names of the conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in conditions.items()]))


def stale(rows: DataFrame, key: str, at: str, days: int = STALE_DAYS) -> DataFrame:
    """key, newest of what is older than so many days before the newest of all rows."""
    newest = rows.groupBy(key).agg(F.max(at).alias("newest"))
    last = rows.agg(F.max(at).alias("_last"))  # one row
    return newest.join(F.broadcast(last), c("newest") < c("_last") - F.make_interval(days=F.lit(days))).select(key, "newest")


def findings(items: DataFrame, names: list[str] | None = None, prefix: str = "") -> DataFrame:
    """One row for each item and check that applies: id, title, author, path, check, detail."""
    table = checks(prefix)
    hits = F.filter(F.array(*[F.when(table[n][0], F.struct(F.lit(n).alias("check"), table[n][1].alias("detail"))) for n in names or table]), lambda x: x.isNotNull())
    return items.select("id", "title", F.array_join("authors", ", ").alias("author"), F.col("rel_path").alias("path"), F.explode(hits).alias("_f")).select("id", "title", "author", "path", "_f.check", "_f.detail")


def counts(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """check, found: all conditions counted in one pass, most first."""
    one = rows.agg(*[F.count_if(v).alias(k) for k, v in conditions.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("found")) for k in conditions])).alias("x")).select("x.check", "x.found").orderBy(F.desc("found"), "check")


def stale_feeds(podcasts: DataFrame, episodes: DataFrame, now: Column) -> DataFrame:
    """Podcasts without a feed, never checked, or whose newest episode is over 90 days old: id, title, detail."""
    newest = episodes.groupBy("item_id").agg(F.max("published_at").alias("newest"))
    j = podcasts.where(c("media_type") == "podcast").join(newest, c("id") == c("item_id"), "left")
    days = F.floor((F.unix_timestamp(now) - F.unix_timestamp("newest")) / 86400)
    detail = F.when(c("feed_url") == "", "no feed url").when(c("last_episode_check").isNull(), "feed never checked").when(F.unix_timestamp(now) - F.unix_timestamp("newest") > STALE_DAYS * 86400, F.concat(F.lit("no new episode in "), days, F.lit(" days")))
    return j.select("id", "title", detail.alias("detail")).where("detail is not null")
