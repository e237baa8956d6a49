"""Libraries, authors, series, collections, playlists, podcasts, users: scans, look-ups, and edits as new tables.

Edits take a table and give it as it will be, or give the rows to add, change and drop; nothing is changed in place. Rows of
ordered lists (collections, playlists) have a place (pos) in their list. Null keys match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions import display as d
from curatrix.functions import text as t
from curatrix.operators.listing import page

c = F.col


# ---- Look-ups -------------------------------------------------------------------------------------


def by_name_or_id(rows: DataFrame, given: str, name: str = "name") -> DataFrame:
    """The rows that a name or an id means: the id, else the very name, else the name in any case; with _tier (3, 2, 1)."""
    tier = F.when(c("id") == given, 3).when(c(name) == given, 2).when(F.lower(t.trim(c(name))) == given.strip().lower(), 1)
    found = rows.withColumn("_tier", tier).where("_tier is not null")
    best = found.agg(F.max("_tier").alias("_best"))  # one row
    return found.join(F.broadcast(best)).where("_tier = _best").drop("_best")


def listed(rows: DataFrame, order: list[Column], limit: int = 25, offset: int = 0, library: str | None = None) -> DataFrame:
    """A page of a table's rows, of one library or of all."""
    return page(rows if library is None else rows.where(c("library_id") == library), order, limit, offset)


def named(rows: DataFrame, query: str, fields: dict[str, str], n: int = 10) -> DataFrame:
    """kind, id, name of what has a text in its name, exact names first, the first n of each kind. fields: kind by column."""
    parts = None
    for kind, column in fields.items():
        hit = rows.where(t.title_contains(c(column), F.lit(query))).select(F.lit(kind).alias("kind"), "id", c(column).alias("name"))
        parts = hit if parts is None else parts.unionByName(hit)
    exact = F.lower(t.trim(c("name"))) == query.strip().lower()
    w = Window.partitionBy("kind").orderBy(F.desc(exact), "name", "id")
    return parts.withColumn("place", F.row_number().over(w)).where(c("place") <= n)


def author_books(authors: DataFrame, items: DataFrame) -> DataFrame:
    """author_id, id, title of the books of each author, by key of the name; authors without any have a row with nulls."""
    books = items.select("id", "title", F.explode("authors").alias("a")).select("id", "title", t.vocab_key("authors", c("a")).alias("k")).where("k != ''").distinct()
    return authors.select(c("id").alias("author_id"), "name", t.vocab_key("authors", c("name")).alias("k")).join(books, "k", "left").select("author_id", "name", "id", "title")


def series_rows(items: DataFrame) -> DataFrame:
    """library_id, key, name (the most frequent spelling, then the first), books, seconds, author, sequences, by series."""
    each = items.select("id", "library_id", "duration", F.coalesce(F.get("authors", F.lit(0)), F.lit("")).alias("author"), F.explode("series").alias("s")).select("*", c("s.name").alias("spelt"), t.trim(c("s.sequence")).alias("sequence"), t.vocab_key("series", c("s.name")).alias("key"))
    spelt = each.groupBy("library_id", "key", "spelt").agg(F.count(F.lit(1)).alias("n")).groupBy("library_id", "key").agg(F.min_by("spelt", F.struct(-c("n"), "spelt")).alias("name"))
    once = each.groupBy("library_id", "key", "id").agg(F.first("duration").alias("duration"), F.max("author").alias("author"), F.max("sequence").alias("sequence"))
    number = t.sequence_number(c("sequence"))
    told = once.groupBy("library_id", "key").agg(F.count(F.lit(1)).alias("books"), F.sum("duration").alias("seconds"), F.min(F.nullif("author", F.lit(""))).alias("author"), F.transform(F.array_sort(F.collect_set(F.when(c("sequence") != "", F.struct(number.alias("n"), "sequence")))), lambda x: x["sequence"]).alias("sequences"))
    return spelt.join(told, ["library_id", "key"])


def series_books(items: DataFrame, progress: DataFrame | None = None) -> DataFrame:
    """key, id, title, sequence, place of the books of every series in order (numbers first, then titles); with progress also
    whether each is finished."""
    each = items.select("id", "title", F.explode("series").alias("s")).select(t.vocab_key("series", c("s.name")).alias("key"), "id", "title", t.trim(c("s.sequence")).alias("sequence"))
    order = Window.partitionBy("key").orderBy(t.sequence_number(c("sequence")).asc_nulls_last(), "sequence", "title", "id")
    out = each.withColumn("place", F.row_number().over(order))
    if progress is None:
        return out
    done = progress.where("is_finished and coalesce(episode_id, '') = ''").select(c("item_id").alias("id")).distinct().withColumn("finished", F.lit(True))
    return out.join(done, "id", "left").withColumn("finished", F.coalesce("finished", F.lit(False)))


def unlisted_series(items: DataFrame, series: DataFrame) -> DataFrame:
    """Series that books name but the listing lacks: library_id, name, books, author. series: library_id, name."""
    each = items.select("id", "library_id", F.coalesce(F.get("authors", F.lit(0)), F.lit("")).alias("author"), F.explode("series").alias("s")).select("id", "library_id", "author", c("s.name").alias("name")).where(t.trim(c("name")) != "")
    key = lambda df: df.withColumn("_k", F.lower(t.trim(c("name"))))
    left = key(each).join(key(series).select("library_id", "_k").distinct(), ["library_id", "_k"], "left_anti")
    return left.groupBy("library_id", "_k").agg(F.min("name").alias("name"), F.countDistinct("id").alias("books"), F.min(F.nullif("author", F.lit(""))).alias("author")).drop("_k")


def one_author(clusters: DataFrame, authors: DataFrame) -> DataFrame:
    """Clusters of near spellings of series without those of which every spelling has an author and none is shared.

    clusters: cluster, kind, spellings (value, items); authors: value, author.
    """
    each = clusters.where("kind = 'near'").select("cluster", F.explode("spellings").alias("s")).select("cluster", c("s.value").alias("value"))
    told = each.join(authors.select("value", t.norm(c("author")).alias("a")), "value", "left").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(t.blank(c("a")) != "", 1)).alias("known"), F.countDistinct(F.nullif("a", F.lit(""))).alias("apart"))
    return clusters.join(told.where("known = n and apart = n").select("cluster"), "cluster", "left_anti")


def series_unclear(findings: DataFrame, placed: DataFrame) -> DataFrame:
    """Findings for books that are in several series, where a number alone doesn't say which: id, series (how many)."""
    many = placed.groupBy("id").agg(F.countDistinct("key").alias("series")).where("series > 1")
    return findings.join(many, "id")


# ---- Projections ----------------------------------------------------------------------------------


def library_rows(libraries: DataFrame) -> DataFrame:
    return libraries.select("id", "name", "media_type", "provider", "folders", d.timestamp_text(c("last_scan")).alias("last_scan"))


def episode_rows(episodes: DataFrame, items: DataFrame, progress: DataFrame | None = None, description: int | None = None) -> DataFrame:
    """Episodes with their podcast's title, day, whole seconds (its own length, else its file's) and, if asked, percent done and
    so many characters of description."""
    lengths = [F.when(c(x) > 0, c(x)) for x in ("duration", "file_duration") if x in episodes.columns]
    out = episodes.join(items.select(c("id").alias("item_id"), c("title").alias("podcast")), "item_id", "left").withColumns({"published": d.date_text(c("published_at")), "duration_s": d.whole_seconds(F.coalesce(*lengths, F.lit(0.0)))})
    if description is not None:
        out = out.withColumn("description", d.clip(F.regexp_replace(t.blank(c("description")), "<[^>]+>", ""), description))
    if progress is None:
        return out
    mine = progress.select("item_id", c("episode_id").alias("id"), d.percent(c("progress")).alias("percent"), c("is_finished").alias("finished"))
    return out.join(mine, ["item_id", "id"], "left")


def progress_rows(progress: DataFrame) -> DataFrame:
    """What is told of progress: percent, whether finished or hidden, whole seconds, when."""
    return progress.select("user_id", "item_id", "episode_id", d.percent(c("progress")).alias("percent"), c("is_finished").alias("finished"), d.whole_seconds(c("current_time")).alias("position_s"), c("hidden"), d.timestamp_text(c("last_update")).alias("last_update"))


# ---- Users ----------------------------------------------------------------------------------------


def in_progress(progress: DataFrame, items: DataFrame, n: int = 25) -> DataFrame:
    """Of each user what is begun, neither finished nor hidden, newest first: user_id, item_id, title, percent, place."""
    open_ = progress.where("not is_finished and not hidden and current_time > 0")
    order = Window.partitionBy("user_id").orderBy(F.desc("last_update"), "item_id", "episode_id")
    rows = open_.withColumn("place", F.row_number().over(order)).where(c("place") <= n)
    return rows.join(items.select(c("id").alias("item_id"), "title"), "item_id").select("user_id", "item_id", "episode_id", "title", d.percent(c("progress")).alias("percent"), "place")


def with_progress(items: DataFrame, progress: DataFrame, user: str) -> DataFrame:
    """Items with a user's progress and is_finished, as the filter language reads them; null for what was never begun."""
    mine = progress.where((c("user_id") == user) & (F.coalesce("episode_id", F.lit("")) == "")).groupBy("item_id").agg(F.max_by(F.struct("progress", "is_finished"), F.struct("last_update", "progress")).alias("p"))
    return items.join(mine, c("id") == c("item_id"), "left").select(*[items[x] for x in items.columns if x not in ("progress", "is_finished")], c("p.progress").alias("progress"), c("p.is_finished").alias("is_finished"))


def accounts(users: DataFrame, progress: DataFrame, newest: int = 10) -> DataFrame:
    """Users with how much they have finished and begun, and the newest things of each (item_id, percent)."""
    told = progress.groupBy("user_id").agg(F.count_if("is_finished").alias("finished"), F.count_if(~c("is_finished") & (c("current_time") > 0)).alias("in_progress"))
    order = Window.partitionBy("user_id").orderBy(F.desc("last_update"), "item_id")
    first = progress.withColumn("_n", F.row_number().over(order)).where(c("_n") <= newest).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "item_id", d.percent(c("progress")).alias("percent")))), lambda x: F.struct(x["item_id"].alias("item_id"), x["percent"].alias("percent"))).alias("newest"))
    return users.join(told, users["id"] == told["user_id"], "left").drop("user_id").join(first, users["id"] == first["user_id"], "left").drop("user_id").withColumns({x: F.coalesce(x, F.lit(0)) for x in ("finished", "in_progress")})


def history(sessions: DataFrame, now: Column, days: int = 60, n: int = 25, user: str | None = None) -> DataFrame:
    """Sessions of the last days, newest first, with how many there are in all time."""
    mine = sessions if user is None else sessions.where(c("user_id") == user)
    every = mine.agg(F.count(F.lit(1)).alias("all_time"))  # one row
    recent = mine.where(c("started_at") >= now - F.make_interval(days=F.lit(days))).orderBy(F.desc("started_at"), "id").limit(n)
    return recent.join(F.broadcast(every))


def year_review(sessions: DataFrame, year: int) -> DataFrame:
    """Of each user and month of a year: seconds listened, sessions, items and days listened on."""
    rows = sessions.where(F.year("started_at") == year).withColumn("month", F.month("started_at"))
    return rows.groupBy("user_id", "month").agg(F.sum("time_listening").alias("seconds"), F.count(F.lit(1)).alias("sessions"), F.countDistinct("item_id").alias("items"), F.countDistinct(F.to_date("started_at")).alias("days"))


def top_listened(sessions: DataFrame, n: int = 10) -> DataFrame:
    """Of each user the items listened to most: user_id, item_id, seconds, place.

    Sums of the same doubles in another order differ in their last bits, so seconds are added as decimals, which tells equal sums:
    those go by item. Where a decimal doesn't hold all of an item's seconds (nan, very large or small ones) they are added as they are.
    """
    made = c("time_listening").try_cast("decimal(38,18)")
    exact = F.when(made.cast("double") == c("time_listening"), made)
    told = F.when(F.count(exact) == F.count("time_listening"), F.try_sum(exact).cast("double"))
    sums = sessions.groupBy("user_id", "item_id").agg(F.coalesce(told, F.sum("time_listening")).alias("seconds"))
    order = Window.partitionBy("user_id").orderBy(F.desc("seconds"), "item_id")
    return sums.withColumn("place", F.row_number().over(order)).where(c("place") <= n)


def bookmarks_of(bookmarks: DataFrame, items: DataFrame) -> DataFrame:
    """Bookmarks with their item's title, by item and time; those of items that are gone have a null title."""
    return bookmarks.join(items.select(c("id").alias("item_id"), c("title").alias("item")), "item_id", "left").orderBy("item_id", "time")


def log_lines(lines: DataFrame, least: str = "info", contains: str = "", n: int = 100) -> DataFrame:
    """Log lines of a level or worse that contain a text, newest first, with how many there are."""
    levels = ("trace", "debug", "info", "warn", "error", "fatal")
    rank = F.array_position(F.array(*map(F.lit, levels)), F.lower(c("level")))
    return page(lines.where((rank >= levels.index(least) + 1) & t.title_contains(c("message"), F.lit(contains))), [F.desc("at"), c("message")], n)


# ---- Edits ----------------------------------------------------------------------------------------


def upsert(rows: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """rows with those of new put in the place of rows with their keys; of several new rows with one key the last by their other
    columns. Columns that new lacks keep their value, or are null in rows that are added."""
    own = [x for x in new.columns if x not in key]
    last = new.groupBy(*key).agg(F.max(F.struct(*own)).alias("_new")).withColumn("_is", F.lit(True))
    j = rows.withColumn("_was", F.lit(True)).join(last, key, "full")
    return j.select(*[c(x) if x in key else (F.when(c("_is"), c(f"_new.{x}")).otherwise(c(x)).alias(x) if x in own else c(x)) for x in rows.columns])


def without(rows: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """rows without those whose keys are in gone."""
    return rows.join(gone.select(*key).distinct(), key, "left_anti")


def not_there(rows: DataFrame, asked: DataFrame, key: list[str]) -> DataFrame:
    """Keys that were asked for but no row has."""
    return asked.select(*key).distinct().join(rows.select(*key).distinct(), key, "left_anti")


def name_taken(rows: DataFrame, name: str, scope: str = "library_id", but: str | None = None) -> DataFrame:
    """scope, id of rows that have a name already, in any case; but: the id of the one that is renamed."""
    other = rows if but is None else rows.where(c("id") != but)
    return other.where(F.lower(t.trim(c("name"))) == name.strip().lower()).select(scope, "id")


def list_edit(entries: DataFrame, add: DataFrame, drop: DataFrame, key: str = "list_id", member: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """Ordered lists with members added at their ends, in the given order, and others taken out, places closed up; and what was
    done: list, member, outcome (added, already_held, removed, not_held). entries: list, member, pos; add: list, member, pos;
    drop: list, member. A member in both is refused: outcome both, and nothing happens to it.
    """
    on = [key, member]
    add = add.groupBy(*on).agg(F.min("pos").alias("pos"))
    both = add.join(drop.select(*on).distinct(), on, "left_semi").select(*on)
    add, drop = add.join(both, on, "left_anti"), drop.select(*on).distinct().join(both, on, "left_anti")
    held = entries.select(*on).distinct()
    new, again = add.join(held, on, "left_anti"), add.join(held, on, "left_semi")
    kept = entries.join(drop, on, "left_anti").select(*on, F.lit(0).alias("_new"), "pos")
    order = Window.partitionBy(key).orderBy("_new", "pos", member)
    out = kept.unionByName(new.select(*on, F.lit(1).alias("_new"), "pos")).withColumn("pos", F.row_number().over(order) - 1).select(*on, "pos")
    say = lambda df, outcome: df.select(*on, F.lit(outcome).alias("outcome"))
    told = say(new, "added").unionByName(say(again, "already_held")).unionByName(say(drop.join(held, on, "left_semi"), "removed")).unionByName(say(drop.join(held, on, "left_anti"), "not_held")).unionByName(say(both, "both"))
    return out, told


def reordered(entries: DataFrame, wanted: DataFrame, key: str = "list_id", member: str = "item_id") -> DataFrame:
    """Lists with the wanted members first, in their order, and the others after them as they stood."""
    first = wanted.select(key, member, c("pos").alias("_want"))
    order = Window.partitionBy(key).orderBy(c("_want").asc_nulls_last(), "pos", member)
    return entries.join(first, [key, member], "left").withColumn("pos", F.row_number().over(order) - 1).select(entries.columns)


def copied_list(entries: DataFrame, source: str, target: str, key: str = "list_id") -> DataFrame:
    """The members of one list as those of a new one."""
    return entries.where(c(key) == source).withColumn(key, F.lit(target))


def list_contents(entries: DataFrame, items: DataFrame, key: str = "list_id", member: str = "item_id") -> DataFrame:
    """list, pos, item, title, seconds in order; members that are gone have a null title."""
    return entries.join(items.select(c("id").alias(member), "title", "duration"), member, "left").select(key, "pos", member, "title", "duration")


def list_rows(lists: DataFrame, entries: DataFrame, key: str = "list_id") -> DataFrame:
    """Lists with how many members they have."""
    n = entries.groupBy(key).agg(F.count(F.lit(1)).alias("members"))
    return lists.join(n, lists["id"] == n[key], "left").drop(key).withColumn("members", F.coalesce("members", F.lit(0)))


def bookmark_edit(bookmarks: DataFrame, add: DataFrame, drop: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bookmarks (user_id, item_id, time, title) with others added, or renamed where there is one at that time, and some taken
    out; and what was done: outcome (added, renamed, removed, missing), was_titled."""
    key = ["user_id", "item_id", "time"]
    old = bookmarks.select(*key, c("title").alias("was_titled"))
    told_add = add.select(*key).distinct().join(old, key, "left").withColumn("outcome", F.when(c("was_titled").isNull(), "added").otherwise("renamed"))
    told_drop = drop.select(*key).distinct().join(old, key, "left").withColumn("outcome", F.when(c("was_titled").isNull(), "missing").otherwise("removed"))
    return upsert(without(bookmarks, drop, key), add.select(*key, "title"), key), told_add.unionByName(told_drop)


def series_edit(field: Column, add: list[tuple[str, str]] = (), drop: list[str] = ()) -> Column:
    """A list of series with some added (name, number; one that is there gets the number) and others dropped, by name in any case."""
    gone = [x.lower() for x in drop]
    out = F.filter(field, lambda s: ~F.lower(s["name"]).isin(*gone)) if gone else field
    for name, number in add:
        is_it = lambda s: F.lower(s["name"]) == name.lower()  # noqa: B023, E731
        numbered = F.transform(out, lambda s: F.when(is_it(s), s.withField("sequence", F.lit(number))).otherwise(s))  # noqa: B023
        new = F.struct(F.lit(None).cast("string").alias("id"), F.lit(name).alias("name"), F.lit(number).alias("sequence"))
        out = F.when(F.exists(out, is_it), numbered).otherwise(F.array_append(out, new))
    return out


def kept_fields(before: DataFrame, after: DataFrame, keep: list[str], key: str = "id") -> DataFrame:
    """after, with the named fields as they were before; an empty field is restored as empty."""
    old = before.select(key, *[c(x).alias(f"_old_{x}") for x in keep])
    return after.join(old, key).select(*[c(f"_old_{x}").alias(x) if x in keep else c(x) for x in after.columns])


def tags_after(before: Column, matched: Column, keep: bool) -> Column:
    """An item's tags once a match is written: its own if they are kept, else the match's."""
    return before if keep else matched


def moved_values(rows: DataFrame, value: str, source: str, target: str, parts: list[str] | None = None, id_col: str = "id") -> DataFrame:
    """A value moved, or split into parts, from one list field to another: id, source and target as they will be."""
    has = F.exists(source, lambda v: F.lower(v) == value.lower())
    new = F.array(*map(F.lit, parts or [value]))
    left = F.filter(source, lambda v: F.lower(v) != value.lower())
    more = F.filter(new, lambda n: ~F.exists(target, lambda v: F.lower(v) == F.lower(n)))
    return rows.where(has).select(c(id_col).alias("id"), left.alias(source), F.concat(target, more).alias(target))


def decision_tally(decisions: DataFrame) -> DataFrame:
    """field, action, n: how often each field was filled, written, kept or left for review."""
    return decisions.groupBy("field", "action").agg(F.count(F.lit(1)).alias("n"))


def with_open(items: DataFrame, feeds: DataFrame | None = None, shares: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """items with feed_open, share_open (whether one is there) and supplementary_ebooks (files of that kind beside an item's own
    e-book), as the filters of these names ask for. feeds, shares: item_id; files: item_id, file_type, is_supplementary."""
    flag = lambda df, name: df.select(c("item_id").alias("id"), F.lit(True).alias(name)).distinct()
    for table, name in ((feeds, "feed_open"), (shares, "share_open")):
        items = items.withColumn(name, F.lit(False)) if table is None else items.join(flag(table, name), "id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    if files is None:
        return items.withColumn("supplementary_ebooks", F.lit(0).cast("long"))
    held = files.where((c("file_type") == "ebook") & c("is_supplementary")).groupBy(c("item_id").alias("id")).agg(F.count(F.lit(1)).alias("supplementary_ebooks"))
    return items.join(held, "id", "left").withColumn("supplementary_ebooks", F.coalesce("supplementary_ebooks", F.lit(0)))


def confidence_tally(best: DataFrame) -> DataFrame:
    """confidence, n of best matches."""
    return best.groupBy("confidence").agg(F.count(F.lit(1)).alias("n"))


def best_finding(findings: DataFrame, spread: str = "spread", key: str = "id") -> DataFrame:
    """Of several findings for one id that with the widest spread; of equal ones the first by its other columns, in their order."""
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last(spread), *[x for x in findings.columns if x not in (key, spread)])
    return findings.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def excluded(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Findings without those of a list of ids that are known and accepted."""
    return without(rows, ids.select(c(ids.columns[0]).alias(key)), [key])


def nth_window(items: DataFrame, offset: int, limit: int, order: list[Column]) -> DataFrame:
    """The matched books (with an asin or isbn) from one place on, in listing order, so many of them; with place."""
    matched = items.where("asin != '' or isbn != ''")
    return matched.orderBy(*order).offset(offset).limit(limit).withColumn("place", F.row_number().over(Window.orderBy(*order)) + offset)
