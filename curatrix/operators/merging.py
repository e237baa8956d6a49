"""Records of moved folders put together again: which missing record became which new one, and what has to be carried across.

Two records hold the same book if they play the same files: as many, with the same names and sizes, or one file of the same
size and length under another name. Present records are looked up as classes, those of one content and length together; of a
class only its two newest and its oldest are kept, which is enough to tell none, one and several. So a content that very
many records share makes no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions import text as t
from curatrix.sources.storage import written

#: Seconds that two scans may put one book apart, or one file; how long before a record went missing its successor can appear.
LENGTH_SLACK, FILE_SLACK, FRESH_MINUTES = 30.0, 1.0, 10
DETAILS = ("title", "subtitle", "authors", "narrators", "series", "genres", "tags", "publisher", "published_year", "language", "description", "asin", "isbn")
c = F.col


def contents(items: DataFrame, files: DataFrame) -> DataFrame:
    """id, key, seconds, slack for all records that play something: by their files, and, if it is one, also by its size alone."""
    played = files.where(~F.coalesce("exclude", F.lit(False))).select(c("item_id").alias("id"), "filename", "size", "duration")
    per = played.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("filename", "size")))), 256).alias("files"), F.max("size").alias("size"), F.max("filename").alias("name"), F.max("duration").alias("length"))
    own = per.join(items.select("id", c("duration").alias("whole")), "id")
    same = F.struct(F.lit("files").alias("how"), F.concat(F.lit("f"), "files").alias("key"), c("whole").alias("seconds"), F.lit("").alias("name"))
    alone = F.when(c("n") == 1, F.struct(F.lit("renamed").alias("how"), F.concat(F.lit("s"), c("size").cast("string")).alias("key"), c("length").alias("seconds"), F.coalesce("name", F.lit("")).alias("name")))
    return own.select("id", "whole", F.explode(F.array_compact(F.array(same, alone))).alias("k")).select("id", "whole", "k.*")


def _looked_up(missing: DataFrame, present: DataFrame) -> DataFrame:
    """For each missing record and content: id, how, and of the classes within reach made (newest ones that count), standing."""
    cell = lambda df: df.withColumn("cell", F.floor(c("seconds") / LENGTH_SLACK))
    of = ["how", "key", "seconds", "whole", "name"]
    newest = present.groupBy(*of).agg(F.max(F.struct("added_at", "id")).alias("newest"), F.min("added_at").alias("oldest"))
    others = present.join(newest.select(*of, c("newest.id").alias("id")), [*of, "id"], "left_anti").groupBy(*of).agg(F.max("added_at").alias("second"))
    classes = cell(newest.join(others, of, "left")).select("how", "key", "cell", c("seconds").alias("c_seconds"), c("whole").alias("c_whole"), c("name").alias("c_name"), c("newest.id").alias("first"), c("newest.added_at").alias("newest"), "second", "oldest")
    near = cell(missing).withColumn("cell", F.explode(F.array(c("cell") - 1, c("cell"), c("cell") + 1)))
    whole = F.abs(c("whole") - c("c_whole")) <= LENGTH_SLACK
    fits = F.when(c("how") == "files", whole).otherwise(whole & (F.abs(c("seconds") - c("c_seconds")) <= FILE_SLACK) & (c("name") != c("c_name")))
    at = F.coalesce(c("since") - F.make_interval(mins=F.lit(FRESH_MINUTES)), F.lit(0).cast("timestamp"))
    hits = near.join(classes, ["how", "key", "cell"]).where(fits)
    made = F.when(c("second") >= at, 2).when(c("newest") >= at, 1).otherwise(0)
    told = hits.groupBy("id").agg(F.sum(made).alias("made"), F.max(F.when(made > 0, c("first"))).alias("into"), F.max(F.when(made > 0, c("how"))).alias("how"), F.max(c("oldest") < at).alias("standing"))
    return told


def pairs(items: DataFrame, files: DataFrame, feeds: DataFrame | None = None, since: str = "updated_at") -> DataFrame:
    """A row for each missing record: old_id, new_id, how (files, renamed), why it is left alone (empty: it isn't).

    why: podcast, no_audio, several (records made since it went missing hold its files), standing (only records that were
    there before do: a second copy), none, shared (the one record holds the files of several missing ones), feed (one is open on
    the old record; feeds: item_id). since: the column that says when a record was last seen.
    """
    gone = items.where("is_missing").select("id", "media_type", "num_audio_files", c(since).alias("since"))
    keyed = contents(items, files).join(items.select("id", "media_type", "is_missing", "added_at", c(since).alias("since")), "id").where("media_type != 'podcast'")
    found = _looked_up(keyed.where("is_missing"), keyed.where("not is_missing"))
    j = gone.join(found, "id", "left")
    why = F.when(c("media_type") == "podcast", "podcast").when(F.coalesce("num_audio_files", F.lit(0)) == 0, "no_audio").when(c("made") == 1, "").when(c("made") > 1, "several").when(c("standing"), "standing").otherwise("none")
    rows = written(j.select(c("id").alias("old_id"), F.when(why == "", c("into")).alias("new_id"), F.when(why == "", c("how")).alias("how"), why.alias("why")), "merge-pairs")
    twice = rows.where("new_id is not null").groupBy("new_id").agg(F.count(F.lit(1)).alias("claims")).where("claims > 1")
    out = rows.join(twice, "new_id", "left")
    if feeds is not None:
        out = out.join(feeds.select(c("item_id").alias("old_id"), F.lit(True).alias("feed")).distinct(), "old_id", "left")
    else:
        out = out.withColumn("feed", F.lit(None).cast("boolean"))
    left = F.when(c("why") != "", c("why")).when(c("claims") > 1, "shared").when(c("feed"), "feed").otherwise("")
    return out.select("old_id", "new_id", "how", left.alias("why"))


def details(items: DataFrame, told: DataFrame) -> DataFrame:
    """old_id, details: the fields in which the old record of a pair that is merged says something, and not what the new one does."""
    p = told.where("why = ''").select("old_id", "new_id")
    side = lambda name: items.select(c("id").alias(f"{name}_id"), *[c(f).alias(f"{name}_{f}") for f in DETAILS])

    def differs(f: str) -> Column:
        a, b = c(f"old_{f}"), c(f"new_{f}")
        if f == "series":
            bare = lambda s: F.transform(s, lambda x: F.struct(x["name"], x["sequence"]))
            return (F.size(a) > 0) & ~bare(a).eqNullSafe(bare(b))
        if dict(items.dtypes)[f].startswith("array"):
            return (F.size(a) > 0) & ~F.array_sort(a).eqNullSafe(F.array_sort(b))
        return (t.trim(a) != "") & (t.trim(a) != t.trim(b))

    j = p.join(side("old"), "old_id").join(side("new"), "new_id")
    return j.select("old_id", F.array_compact(F.array(*[F.when(differs(f), F.lit(f)) for f in DETAILS])).alias("details"))


def carried(table: DataFrame, told: DataFrame, keys: list[str], item: str = "item_id") -> DataFrame:
    """Rows of a table (progress, bookmarks, lists) that go from old to new records: those whose keys the new one lacks, re-addressed."""
    p = told.where("why = ''").select(c("old_id").alias("_old"), c("new_id").alias("_new"))
    moved = table.join(p, c(item) == c("_old")).withColumn(item, c("_new")).drop("_old", "_new")
    held = table.select(item, *keys).distinct()
    return moved.join(held, [item, *keys], "left_anti").select(*table.columns)


def merge_plan(items: DataFrame, files: DataFrame, progress: DataFrame, bookmarks: DataFrame, lists: DataFrame, feeds: DataFrame | None = None, since: str = "updated_at") -> DataFrame:
    """pairs() with action (merge, leave) and what goes across: details (fields), progress, bookmarks (users) and lists (ids), sorted.

    progress, bookmarks: user_id, item_id, episode_id or position; lists: list_id, item_id.
    """
    told = written(pairs(items, files, feeds, since), "merge-plan")
    back = told.where("why = ''").select("old_id", c("new_id").alias("item_id"))

    def who(table: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
        return carried(table, told, keys).join(back, "item_id").groupBy("old_id").agg(F.array_sort(F.collect_set(value)).alias(name))

    out = told.withColumn("action", F.when(c("why") == "", "merge").otherwise("leave"))
    for df in (details(items, told), who(progress, ["user_id"], "progress", "user_id"), who(bookmarks, ["user_id", "position"], "bookmarks", "user_id"), who(lists, ["list_id"], "lists", "list_id")):
        out = out.join(df, "old_id", "left")
    empty = F.array().cast("array<string>")
    return out.select("old_id", "new_id", "how", "action", "why", *[F.coalesce(c(x).cast("array<string>"), empty).alias(x) for x in ("details", "progress", "bookmarks", "lists")])
