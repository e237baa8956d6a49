"""Series: gaps, padding, numbering against folders, folder styles, titles, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions import arrays as ar
from curatrix.functions import text as t


def placed(items: DataFrame) -> DataFrame:
    """One row for each item and series: id, title, rel_path, author, series, sequence, n (number or null), key."""
    s = F.explode("series").alias("s")
    return items.select("id", "title", "rel_path", F.get("authors", F.lit(0)).alias("author"), s).select("id", "title", "rel_path", "author", F.col("s.name").alias("series"), F.col("s.sequence").alias("sequence"), t.sequence_number(F.col("s.sequence")).alias("n"), t.vocab_key("series", F.col("s.name")).alias("key"))


def sequences(rows: DataFrame, key: str, number: Column) -> DataFrame:
    """key, kept, outliers, missing, width of each key's numbers."""
    found = rows.groupBy(key).agg(F.collect_set(number.cast("double")).alias("numbers")).withColumn("s", ar.settled(F.col("numbers")))
    return found.select(key, F.col("s.kept").alias("kept"), F.col("s.outliers").alias("outliers"), ar.missing_between(F.col("s.kept")).alias("missing"), ar.pad_width(F.col("s.kept")).alias("width"))


def gaps(items: DataFrame) -> DataFrame:
    """Series of two books or more with a whole number missing inside, or with a number far off."""
    rows = placed(items)
    books = rows.groupBy("key").agg(F.countDistinct("id").alias("books"), F.min("series").alias("series"))
    return sequences(rows.where("n is not null"), "key", F.col("n")).join(books, "key").where((F.col("books") > 1) & ((F.size("missing") > 0) | (F.size("outliers") > 0)))


def unlinked_fillers(items: DataFrame, found: DataFrame) -> DataFrame:
    """Books outside a series whose folder puts them where it has a gap: key, id, title, number."""
    own = items.withColumn("f", t.folder_number(F.col("rel_path"))).withColumn("in_folder", F.coalesce(F.nullif("f.series", F.lit("")), t.parent_folder(F.col("rel_path"))))
    free = own.where("f.number != ''").select("id", "title", t.vocab_key("series", F.col("in_folder")).alias("key"), t.sequence_number(F.col("f.number")).alias("number"))
    holds = placed(items).select("id", "key").distinct()
    holes = found.select("key", F.explode("missing").alias("number")).select("key", F.col("number").cast("double").alias("number"))
    return free.join(holds, ["id", "key"], "left_anti").join(holes, ["key", "number"])


def numbering(items: DataFrame) -> DataFrame:
    """id, title, problem, suggest: padding, unnumbered, folder_disagrees, unlinked, duplicate_sequence."""
    rows = placed(items).withColumn("f", t.folder_number(F.col("rel_path")))
    widths = sequences(rows.where("n is not null"), "key", F.col("n")).select("key", "width")
    j = rows.join(widths, "key", "left").withColumn("width", F.coalesce("width", F.lit(1)))
    styled = t.style_number(F.col("sequence"), F.col("width"))
    label = lambda number: F.concat(F.col("series"), F.lit(" #"), number)
    pick = lambda df, problem, suggest: df.select("id", "title", F.lit(problem).alias("problem"), suggest.alias("suggest"))
    own_folder = (F.col("f.series") == "") | (t.vocab_key("series", F.col("f.series")) == F.col("key"))
    padding = pick(j.where((F.col("n").isNotNull()) & (styled != t.trim(F.col("sequence")))), "padding", label(styled))
    unnumbered = pick(j.where((F.col("sequence") == "") & (F.col("f.number") != "") & own_folder), "unnumbered", label(t.style_number(F.col("f.number"), F.col("width"))))
    disagrees = pick(j.where((F.col("sequence") != "") & (F.col("f.number") != "") & own_folder & ~t.same_number(F.col("sequence"), F.col("f.number"))), "folder_disagrees", label(t.style_number(F.col("f.number"), F.col("width"))))
    keys = rows.select(F.col("key").alias("shelf"), "series").groupBy("shelf").agg(F.min("series").alias("series"))
    out = items.withColumn("f", t.folder_number(F.col("rel_path"))).where("f.series != ''").withColumn("shelf", t.vocab_key("series", F.col("f.series"))).drop("series").join(keys, "shelf")
    linked = rows.select("id", F.col("key").alias("shelf")).distinct()
    unlinked = pick(out.join(linked, ["id", "shelf"], "left_anti"), "unlinked", label(F.col("f.number")))
    # of titles on one number the later ones are named, unless an earlier one is the same book; of equal titles the first counts
    first = Window.partitionBy("key", "n", t.clean_title(F.col("title"))).orderBy("rel_path", "id")
    slot = Window.partitionBy("key", "n").orderBy("rel_path", "id").rowsBetween(Window.unboundedPreceding, -1)
    taken = rows.where("n is not null").withColumn("again", (F.row_number().over(first) > 1) & (t.clean_title(F.col("title")) != "")).where("not again").withColumn("before", F.collect_list("title").over(slot))
    twice = taken.where((F.size("before") > 0) & ~F.exists("before", lambda b: t.title_level(b, F.col("title")) > 0))
    return padding.unionByName(unnumbered).unionByName(disagrees).unionByName(unlinked).unionByName(pick(twice, "duplicate_sequence", F.get("before", F.lit(0)))).orderBy("problem", "id")


def mode(rows: DataFrame, keys: list[str], value: str, ties: list[Column]) -> DataFrame:
    """The most frequent value of each key; ties go by the given order."""
    counted = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy(*keys).orderBy(F.desc("n"), *ties)
    return counted.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def folder_styles(items: DataFrame) -> DataFrame:
    """Folders written unlike most of their series under one parent: id, folder, style, common, suggest."""
    rows = placed(items).withColumn("folder", t.base_name(F.col("rel_path"))).withColumn("parent", t.parent_folder(F.col("rel_path"))).withColumn("s", t.folder_style(F.col("folder")))
    rows = rows.withColumn("style", F.col("s.kind")).withColumn("digits", F.length("s.number")).where("sequence != ''")
    common = mode(rows, ["key", "parent"], "style", [F.col("style")]).where("n > 1").select("key", "parent", F.col("style").alias("common"))
    width = mode(rows.where("digits > 0"), ["key", "parent"], "digits", [F.desc("digits")]).select("key", "parent", F.col("digits").alias("width"))
    j = rows.join(common, ["key", "parent"]).join(width, ["key", "parent"], "left").withColumn("width", F.coalesce("width", F.lit(1)))
    name = F.when(F.col("style").isin("numbered", "lead") & (F.trim("s.title") != ""), F.trim("s.title")).otherwise(t.trim(F.regexp_replace("title", t.EDITION_MARKER, "")))
    suggest = t.styled_folder(F.col("common"), F.col("series"), F.col("sequence"), F.col("width"), name)
    return j.where((F.col("style") != F.col("common")) | F.col("s.loose")).select("id", "folder", "style", "common", suggest.alias("suggest"))


def titles(items: DataFrame) -> DataFrame:
    """Titles that are their series' name, or carry it with a number, where the folder says the title."""
    rows = placed(items).withColumn("s", t.folder_style(t.base_name(F.col("rel_path")))).where(F.col("s.kind") == "numbered")
    same = t.norm(F.col("title")) == t.norm(F.col("series"))
    rest = F.regexp_replace(F.expr("substring(title, length(series) + 1)"), r"^[\s,:#\-–]*", "")
    carries = F.startswith(F.lower("title"), F.lower("series")) & rest.rlike(r"(?i)^((book|vol\.?|volume|part|no\.?)\s*)?#?\d+(\.\d+)?\s*$")
    problem = F.when(same, "series_as_title").when(carries, "series_in_title")
    return rows.withColumn("problem", problem).where((F.col("problem").isNotNull()) & (t.norm(F.col("s.title")) != t.norm(F.col("title")))).select("id", "title", "problem", F.col("s.title").alias("suggest"))


def names(items: DataFrame) -> DataFrame:
    """Odd series names: series, problems, suggest, article (the name without its article)."""
    rows = placed(items).groupBy("series").agg(F.min("author").alias("author"), F.collect_set("title").alias("titles"))
    out = rows.withColumn("odd", t.odd_series_name(F.col("series"), F.col("author"))).withColumn("article", t.article_series_name(F.col("series"), F.col("titles")))
    return out.select("series", "odd.problems", "odd.suggest", "article").where((F.size("problems") > 0) | (F.col("article") != ""))
