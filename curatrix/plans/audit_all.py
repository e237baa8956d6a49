"""The audits of a catalogue in one result: check, field, found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions import text as t
from curatrix.operators import chapters, duplicates, files, matching, predicates, readings, series, vocabulary
from curatrix.sources.storage import written

#: Columns of spellings, by the field that says how they are keyed.
SPELT = {"authors": "authors", "narrators": "narrators", "series": "series.name", "publishers": "publisher", "genres": "genres", "tags": "tags", "languages": "language"}
LISTS = ("authors", "narrators", "series", "genres", "tags")
#: What series, roles and duplicates are judged by: no texts but titles and paths.
NARROW = ("id", "added_at", "media_type", "rel_path", "title", "authors", "narrators", "series", "asin", "isbn", "duration", "num_tracks")


def _listed(kind: str, field: str, part: str, values: Column) -> Column:
    """Postings of a list: each of its values once."""
    return F.transform(F.array_distinct(values), lambda v: F.struct(F.lit(kind).alias("kind"), F.lit(field).alias("field"), F.lit(part).alias("part"), v.alias("value")))


def _if(when: Column, kind: str, field: str, value: Column | None = None) -> Column:
    one = F.struct(F.lit(kind).alias("kind"), F.lit(field).alias("field"), F.lit("").alias("part"), (F.lit("") if value is None else value).alias("value"))
    return F.when(when, F.array(one)).otherwise(F.array().cast("array<struct<kind:string,field:string,part:string,value:string>>"))


def postings(items: DataFrame, prefix: str = "", skip: tuple[str, ...] = ()) -> DataFrame:
    """kind, field, part, value, items: all that an item says by itself, told in one reading of the items and counted.

    check: the checks of predicates; value: values by field, as spellings; space: names by where they stand; genre: values of
    a list by the section that they are in; title: titles with authors; path: what is wrong with a folder's name.
    """
    rows = files.with_path_problem(items) if "paths" not in skip else items.withColumn("path_problem", F.lit(None).cast("string"))
    book = F.col("media_type") != "podcast"
    title, author = F.lower(t.trim(F.col("title"))), F.lower(t.trim(F.array_join("authors", ", ")))
    made = [_if(F.coalesce(v[0], F.lit(False)), "check", k) for k, v in predicates.checks(prefix).items() if k not in skip]
    made += [_listed("value", f, "", F.col(x) if x.split(".")[0] in LISTS else F.array(x)) for f, x in SPELT.items()]
    folder = t.base_name(F.regexp_replace(F.when(F.col("is_file"), t.parent_folder(F.col("rel_path"))).otherwise(F.col("rel_path")), "/+$", ""))
    made += [_if(F.lit(True), "space", where, x) for where, x in (("title", F.col("title")), ("subtitle", F.col("subtitle")), ("folder", folder))]
    made += [_listed("space", where, "", F.col(x)) for where, x in (("author", "authors"), ("narrator", "narrators"), ("series", "series.name"))]
    made += [_if(F.col("is_file"), "space", "file", t.base_name(F.col("rel_path"))), _if(book & (title != ""), "title", "", F.concat(title, F.lit("|"), author)), _if(F.col("path_problem").isNotNull(), "path", "", F.col("path_problem"))]
    for field in ("genres", "tags"):
        for section, holds in vocabulary.genre_sections(field, prefix).items():
            made.append(_listed("genre", field, section, F.filter(field, holds)))
    told = rows.select(F.explode(F.concat(*made)).alias("p")).select("p.*").where("value is not null")
    return told.groupBy("kind", "field", "part", "value").agg(F.count(F.lit(1)).alias("items"))


def audit_all(
    items: DataFrame,
    chapter_rows: DataFrame | None = None,
    skip: tuple[str, ...] = (),
    prefix: str = "",
    *,
    authors: DataFrame | None = None,
    audio: DataFrame | None = None,
    library_files: DataFrame | None = None,
    probes: DataFrame | None = None,
    covers: DataFrame | None = None,
    records: DataFrame | None = None,
    episodes: DataFrame | None = None,
    now: Column | None = None,
) -> DataFrame:
    """check, field, found, most first.

    Items are read twice: once for postings(), from which checks, spellings, genres, white space, paths and placeholder titles
    are counted, and once for the few columns that series, roles and duplicates are judged by; both are written. Groups of
    duplicates are judged once.

    The further tables, each optional, add the audits that need them: chapters (what is wrong with them, readings cut
    unevenly); author records; audio files (file names, tags, incomplete copies, missing items' files under others); library
    files (locked ones); probes (files.unplayable); covers (files.cover_problems); provider records (matched items, abridged
    editions); episodes (stale feeds at now).
    """
    said = postings(items, prefix, skip)
    if audio is not None:
        names = audio.where(F.col("filename").isNotNull()).groupBy(F.lit("space").alias("kind"), F.lit("file").alias("field"), F.lit("").alias("part"), F.col("filename").alias("value")).agg(F.count(F.lit(1)).alias("items"))
        said = said.unionByName(names).groupBy("kind", "field", "part", "value").agg(F.sum("items").alias("items"))
    said = written(said, "audit-postings")
    narrow = written(items.select(*NARROW), "audit-items")
    of = lambda kind: said.where(F.col("kind") == kind)
    tally = lambda df, check, field: df.groupBy(F.col(field).alias("field")).agg(F.count(F.lit(1)).alias("found")).select(F.lit(check).alias("check"), "field", "found")
    flat = lambda df, check, what: tally(df.withColumn("p", F.lit(what)), check, "p")
    values = lambda field: of("value").where(F.col("field") == field).select("value", "items")
    spelt = lambda field: vocabulary.spellings(values(field), field)
    checks = [k for k in predicates.checks(prefix) if k not in skip]
    none = items.sparkSession.createDataFrame([(k,) for k in checks], "check string")
    out = none.join(of("check").select(F.col("field").alias("check"), "items"), "check", "left").select("check", F.lit("").alias("field"), F.coalesce("items", F.lit(0)).alias("found"))

    def each(check: str, make, fields) -> DataFrame:
        found = [flat(make(f), check, f) for f in fields]
        for more in found[1:]:
            found[0] = found[0].unionByName(more)
        return found[0]

    def genres() -> DataFrame:
        narrowed = of("value").where("field = 'genres' and value != ''").where(F.col("items") < vocabulary.GENRE_LEAST).select(F.lit("narrow").alias("part"))
        return tally(of("genre").select("part").unionByName(narrowed), "genres", "part")

    def spaces() -> DataFrame:
        rows = lambda file: vocabulary.space_problems_of(of("space").where((F.col("field") == "file") if file else (F.col("field") != "file")).select(F.col("field").alias("where"), F.col("value").alias("name"), "items"), file)
        return tally(rows(False).unionByName(rows(True)), "whitespace", "problem")

    told = None if {"duplicates", "candidates"} <= set(skip) else duplicates.judged(narrow)
    odd_names = lambda: series.names(narrow).select(F.explode(F.concat("problems", F.when(F.col("article") != "", F.array(F.lit("article"))).otherwise(F.array().cast("array<string>")))).alias("p"))
    parts = {
        "numbering": lambda: tally(series.numbering(narrow), "numbering", "problem"),
        "gaps": lambda: flat(series.gaps(narrow), "gaps", "missing"),
        "series_names": lambda: tally(odd_names(), "series_names", "p"),
        "series_titles": lambda: tally(series.titles(narrow), "series_titles", "problem"),
        "folder_styles": lambda: tally(series.folder_styles(narrow), "folder_styles", "style"),
        "genres": genres,
        "roles": lambda: flat(vocabulary.roles(narrow), "roles", "both"),
        "spellings": lambda: each("spellings", lambda f: vocabulary.spelling_groups(spelt(f), f), SPELT),
        "near_names": lambda: vocabulary.cluster_counts({f: spelt(f) for f in SPELT if f != "languages"}).select(F.lit("near_names").alias("check"), "field", "found"),
        "fragments": lambda: each("fragments", lambda f: vocabulary.fragments(spelt(f)), t.PERSON_FIELDS),
        "odd_languages": lambda: flat(vocabulary.odd_languages(values("languages")), "odd_languages", "language"),
        "whitespace": spaces,
        "paths": lambda: of("path").select(F.lit("paths").alias("check"), F.col("value").alias("field"), F.col("items").alias("found")),
        "duplicates": lambda: flat(told.where("kind = 'group'").select("a").distinct(), "duplicates", "groups"),
        "candidates": lambda: duplicates.candidate_counts(narrow, told).select(F.lit("candidates").alias("check"), F.col("why").alias("field"), "found"),
        "placeholder_titles": lambda: flat(of("title").where(F.col("items") > duplicates.PLACEHOLDER), "placeholder_titles", "title"),
    }
    if chapter_rows is not None:
        parts["chapters_fit"] = lambda: tally(chapters.problems(items, chapter_rows), "chapters_fit", "problem")
        parts["readings"] = lambda: tally(readings.sweep(items, chapter_rows)[0], "readings", "problem")
    if authors is not None:
        parts["author_records"] = lambda: tally(vocabulary.author_records(authors), "author_records", "problem")
    if audio is not None:
        tags = F.array_compact(F.array(F.when(F.col("untagged") > 0, "untagged"), F.when(F.col("stale") > 0, "stale")))
        played = audio.where(~F.coalesce("exclude", F.lit(False)))
        held = lambda gone: duplicates.content_key(audio.join(items.where("is_missing" if gone else "not is_missing").select(F.col("id").alias("item_id")), "item_id", "left_semi"))
        parts["file_names"] = lambda: flat(files.file_name_problems(items, audio), "file_names", "stem")
        parts["embedded"] = lambda: tally(files.embedded_problems(items, audio).select(F.explode(tags).alias("p")), "embedded", "p")
        parts["incomplete"] = lambda: flat(duplicates.incomplete_among(duplicates.keys(narrow).select(F.col("id").alias("item_id"), F.col("key").alias("shared")), played), "incomplete", "copy")
        parts["relinked"] = lambda: tally(duplicates.relinked(held(True), held(False)), "relinked", "how")
    if library_files is not None:
        parts["locked_only"] = lambda: flat(files.locked_only(items, library_files), "locked_only", "locked")
    if probes is not None:
        parts["unplayable"] = lambda: tally(files.unplayable(probes), "unplayable", "problem")
    if covers is not None:
        parts["covers"] = lambda: tally(files.cover_problems(items, covers), "covers", "problem")
    if records is not None:
        parts["matched"] = lambda: tally(matching.check_matched(items, records), "matched", "problem")
        parts["abridged"] = lambda: tally(matching.editions(items, records), "abridged", "problem")
    if episodes is not None:
        parts["stale_feeds"] = lambda: flat(predicates.stale_feeds(items, episodes, F.current_timestamp() if now is None else now), "stale_feeds", "feed")
    for name, make in parts.items():
        if name not in skip:
            out = out.unionByName(make())
    return out.orderBy(F.desc("found"), "check", "field")
