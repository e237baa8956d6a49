"""Listings: the filter language, sorts, pages, facets, totals and top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions import text as t

RECENT_DAYS, MOST_ROWS = 60, 1000
c = F.col
PODCAST_GROUPS = ("genres", "tags", "languages", "explicit", "feed-open", "recent", "issues")


def _missing() -> dict[str, Column]:
    """Fields that the group ``missing`` knows, by how each is empty."""
    return {
        **{x: c(x) == "" for x in ("asin", "isbn", "subtitle", "publisher", "language", "description")},
        "publishedYear": c("published_year") == "", "cover": c("cover_path") == "", "ebook": c("ebook_format") == "",
        **{x: F.size(x) == 0 for x in ("authors", "narrators", "series", "genres", "tags")},
    }


def where(expression: str, podcast: bool = False, now: Column | None = None) -> Column:
    """A condition from ``group`` or ``group:value``; groups in any case. Unknown groups and values raise ValueError.

    feed-open, share-open and ebooks:supplementary ask for what entities.with_open() adds, progress for entities.with_progress().
    """
    group, _, value = expression.partition(":")
    g, value = group.strip().lower(), value.strip()
    if podcast and g not in PODCAST_GROUPS:
        raise ValueError(f"podcast libraries have no group {group!r}")
    if g in ("genres", "tags", "narrators"):
        return F.array_contains(g, value)
    if g == "authors":
        return F.exists("authors", lambda a: F.lower(a) == value.lower())
    if g == "series":
        return F.size("series") == 0 if value == "no-series" else F.exists("series", lambda s: F.lower(s["name"]) == value.lower())
    if g in ("languages", "publishers"):
        return c(g[:-1]) == value
    if g == "publisheddecades":
        return F.concat(F.substring("published_year", 1, 3), F.lit("0")) == value
    fixed = {
        "tracks": {"none": c("num_tracks") == 0, "single": c("num_tracks") == 1, "multi": c("num_tracks") > 1},
        "ebooks": {"ebook": c("ebook_format") != "", "no-ebook": c("ebook_format") == "", "supplementary": c("supplementary_ebooks") > 0, "no-supplementary": c("supplementary_ebooks") == 0},
        "missing": _missing(),
        "progress": {
            "finished": F.coalesce("is_finished", F.lit(False)),
            "not-started": F.coalesce("progress", F.lit(0.0)) == 0,
            "in-progress": (F.coalesce("progress", F.lit(0.0)) > 0) & ~F.coalesce("is_finished", F.lit(False)),
            "not-finished": ~F.coalesce("is_finished", F.lit(False)),
        },
    }
    if g in fixed:
        if value not in fixed[g]:
            raise ValueError(f"{group} knows {', '.join(fixed[g])}")
        return fixed[g][value]
    bare = {
        "abridged": c("abridged"), "explicit": c("explicit"), "issues": c("is_missing") | c("is_invalid"), "feed-open": c("feed_open"), "share-open": c("share_open"),
        "recent": c("added_at") >= (now if now is not None else F.current_timestamp()) - F.expr(f"interval {RECENT_DAYS} days"),
    }
    if g not in bare:
        raise ValueError(f"unknown group {group!r}")
    return bare[g]


#: Sorts by name. Fixed values.
SORTS = {
    "title": "title", "author": "author", "added": "added_at", "updated": "updated_at", "size": "size", "duration": "duration",
    "year": "published_year", "chapters": "num_chapters", "tracks": "num_tracks", "episodes": "num_episodes", "path": "rel_path",
}


def page(rows: DataFrame, order: list[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """Rows of a page with _total (of all rows) and _next (the offset that follows; 0 after the last)."""
    limit, offset = max(1, min(limit, MOST_ROWS)), max(0, offset)
    total = rows.agg(F.count(F.lit(1)).alias("_total"))
    held = rows.orderBy(*order).offset(offset).limit(limit)
    # one row joins at most a page of rows
    return held.join(F.broadcast(total)).withColumn("_next", F.when(c("_total") > offset + limit, offset + limit).otherwise(0).cast("long"))


def facets(rows: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """field, value, items: how many rows have each value, once for each row; empty values don't count."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), v.cast("string").alias("value")) for k, v in fields.items()]))
    return rows.select(each.alias("f")).select("f.field", "f.value").where("value is not null and value != ''").groupBy("field", "value").agg(F.count(F.lit(1)).alias("items"))


def list_facets(rows: DataFrame, fields: list[str]) -> DataFrame:
    """The same of list columns, a value that a row repeats counted once."""
    each = F.explode(F.flatten(F.array(*[F.transform(F.array_distinct(f), lambda v: F.struct(F.lit(f).alias("field"), v.alias("value"))) for f in fields])))  # noqa: B023
    return rows.select(each.alias("f")).select("f.field", "f.value").where("value != ''").groupBy("field", "value").agg(F.count(F.lit(1)).alias("items"))


def top(rows: DataFrame, order: list[Column], n: int = 10) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def refs_of(rows: DataFrame, keys: list[str], order: list[Column], ref: Column, n: int, to: str = "refs") -> DataFrame:
    """keys, items (how many rows have them) and the first n refs of each in the given order; no list grows beyond n."""
    ranked = top_each(rows.withColumn("_ref", ref), keys, order, n)
    first = ranked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "_ref"))), lambda x: x["_ref"]).alias(to))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("items")).join(first, keys)


def top_each(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key; the planner filters ranks before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(c("rank") <= n)


def sums(rows: DataFrame, keys: list[str], add: dict[str, str], count: dict[str, str]) -> DataFrame:
    """keys, items, sums of columns and numbers of distinct values, by name."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("items"), *[F.sum(x).alias(n) for n, x in add.items()], *[F.countDistinct(x).alias(n) for n, x in count.items()])


def totals(items: DataFrame) -> DataFrame:
    """Of a library: items, seconds, bytes, tracks, distinct authors and genres; one row, zeros for none."""
    nothing = lambda x: F.coalesce(F.sum(x), F.lit(0))
    sums = items.agg(F.count(F.lit(1)).alias("items"), nothing("duration").alias("seconds"), nothing("size").alias("bytes"), nothing("num_tracks").alias("tracks"))
    for field in ("authors", "genres"):  # one row each
        sums = sums.join(F.broadcast(items.select(F.explode(field).alias("v")).agg(F.countDistinct("v").alias(field))))
    return sums


def summary(items: DataFrame) -> DataFrame:
    """The universal projection of an item; a podcast's year is its newest date."""
    return items.select(
        "id", "library_id", "media_type", "title", "subtitle", F.array_join("authors", ", ").alias("author"), F.array_join("narrators", ", ").alias("narrator"),
        F.transform("series", lambda s: F.when(s["sequence"] != "", F.concat(s["name"], F.lit(" #"), s["sequence"])).otherwise(s["name"])).alias("series"),
        "genres", "tags", F.col("published_year").alias("year"), "publisher", "language", F.round("duration").cast("long").alias("duration_s"), "size",
        "num_tracks", "num_chapters", "num_episodes", "asin", "isbn", F.col("rel_path").alias("path"), "added_at", "updated_at", "is_missing", "is_invalid", "abridged", "explicit",
        (F.col("cover_path") != "").alias("has_cover"), (F.col("description") != "").alias("has_description"),
    )


def usage_days(sessions: DataFrame, now: Column, key: list[str]) -> DataFrame:
    """Seconds listened in all, in the last 7 and the last 30 days, by key."""
    age = F.datediff(F.to_date(now), F.to_date("started_at"))
    within = lambda d: F.sum(F.when((age >= 0) & (age < d), F.col("time_listening")).otherwise(0.0))
    return sessions.groupBy(*key).agg(F.sum("time_listening").alias("total"), within(7).alias("last_7_days"), within(30).alias("last_30_days"))


def session_summary(sessions: DataFrame, users: DataFrame) -> DataFrame:
    """Sessions with the user's name, percent done (null for unknown lengths) and one line for the device."""
    percent = F.when(F.col("duration") > 0, F.round(100 * F.col("current_time") / F.col("duration")).cast("int"))
    device = F.concat_ws(" on ", F.nullif(F.coalesce("client_name", F.lit("")), F.lit("")), F.coalesce(F.nullif("device_name", F.lit("")), F.nullif("os_name", F.lit(""))))
    return sessions.join(users.select(F.col("id").alias("user_id"), F.col("username")), "user_id", "left").withColumns({"percent": percent, "device": device})


def visible(items: DataFrame, tags: list[str] | None = None, explicit: bool = True) -> DataFrame:
    """What a restricted account may see: rows with one of its tags, and none explicit unless allowed."""
    out = items if tags is None else items.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    return out if explicit else out.where(~F.col("explicit"))


def name_tier(stored: Column, given: str) -> Column:
    """2: the very name, 1: but for case (if the given name has no space at its ends), else 0."""
    return F.when(stored == given, 2).when((F.lower(stored) == given.lower()) & F.lit(given == given.strip()), 1).otherwise(0)


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("t", "c")]
