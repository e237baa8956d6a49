"""Matches that decide field by field: a table of rules for each field, compiled into one expression; the update that follows.

A row is an item beside the provider's record that it is matched to, whose columns are named p_<column of the record table>.
A field that the record says otherwise than the item is decided: ``filled`` (the item has nothing), ``written`` (a rule says
that the item's value is worth less), ``kept`` (a rule says that it is curated, or the difference is none) or ``review``.
All of it is one projection of the pair, in which what rules share is computed once: no field costs a pass or a join of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions import display as d
from curatrix.functions import text as t
from curatrix.operators.rows import once

FIELDS = ("title", "subtitle", "authors", "narrators", "series", "genres", "publisher", "year", "language", "description")
ACTIONS = ("filled", "written", "kept", "review")

# ---- Fixed values: what gives a value away --------------------------------------------------------

TITLE_OF_FILE = r"(?i)\.(mp3|m4b|m4a|flac|ogg|wav)\s*$|\(uab\)|\(unabridged\)|^\d{1,3}\s+\S|^chapter\b|^\d+\s*-\s*|\bdisc\s*\d"
SUBTITLE_OF_SERIES = r"(?i)\b(book|vol\.?|volume|novel|#)\s*\d"
YEAR_OF_TIMESTAMP = r"^\d{4}-\d{2}"
PLACEHOLDER_GENRE = r"(?i)^(audio ?books?.*|sci-?fi|fiction|non-?fiction|books?|unknown|other|general)$"

c = F.col


def beside(items: DataFrame, records: DataFrame, on: Column) -> DataFrame:
    """Items beside records, whose columns get the names p_<column>."""
    theirs = records.select(*[c(x).alias(f"p_{x}") for x in records.columns])
    return items.join(theirs, on)


def series_clash(ours: Column, theirs: Column) -> Column:
    """struct(ours, theirs) of the first series that both lists place, the words for a series aside, with other numbers; else null.

    ours: structs with name and sequence; theirs: with series and sequence.
    """
    placed = F.filter(ours, lambda s: t.blank(s["sequence"]) != "")
    other = lambda s, core, p: (t.blank(p["sequence"]) != "") & (core == d.series_core(p["series"])) & ~t.same_number(s["sequence"], p["sequence"])
    against = lambda s: t.let(d.series_core(s["name"]), lambda core: F.filter(theirs, lambda p: other(s, core, p)))
    found = F.flatten(F.transform(placed, lambda s: F.transform(against(s), lambda p: F.struct(s["sequence"].alias("ours"), p["sequence"].alias("theirs")))))
    return F.get(found, F.lit(0))


def _sides() -> dict[str, tuple[Column, Column]]:
    """What item and record say of each field, as one line."""
    numbered = lambda list_, name: F.transform(list_, lambda s: d.series_text(s[name], s["sequence"]))
    ours = {"authors": F.array_join("authors", ", "), "narrators": F.array_join("narrators", ", "), "genres": F.array_join("genres", ", "), "series": F.array_join(numbered(c("series"), "name"), ", "), "year": c("published_year")}
    theirs = {"authors": c("p_author"), "narrators": c("p_narrator"), "genres": F.array_join("p_genres", ", "), "series": F.array_join(numbered(c("p_series"), "series"), ", "), "year": c("p_published_year")}
    plain = [f for f in FIELDS if f not in ours]
    ours |= {f: c(f) for f in plain}
    theirs |= {f: c(f"p_{f}") for f in plain}
    return {f: (t.trim(ours[f]), t.trim(theirs[f])) for f in FIELDS}


def _differs(field: str, ours: Column, theirs: Column) -> Column:
    """Whether the record says something, and not the same."""
    if field == "series":
        return (theirs != "") & ~t.same_names(F.transform("series", lambda s: d.series_text(s["name"], s["sequence"])), F.transform("p_series", lambda s: d.series_text(s["series"], s["sequence"])))
    if field == "genres":
        return (theirs != "") & ~t.same_names(c("genres"), c("p_genres"))
    if field in ("authors", "narrators"):
        return (theirs != "") & ~t.same_names(c(f"_split_ours_{field}"), c(f"_split_theirs_{field}"))
    if field == "description":  # providers' mark-up differs, so texts are told by whether there is one
        return (F.octet_length(ours) < t.STUB_BYTES) & (F.octet_length(theirs) > F.octet_length(ours))
    return (theirs != "") & (t.norm(ours) != t.norm(theirs))


def _does(action: str, why: str | Column) -> Column:
    return F.struct(F.lit(action).alias("action"), (F.lit(why) if isinstance(why, str) else why).alias("rule"))


def _verdict(field: str, ours: Column, theirs: Column) -> Column:
    """struct(action, rule): the first rule of the field that holds counts."""
    if field == "title":
        named = lambda key: F.exists("series", lambda s: t.norm(F.substring_index(d.series_text(s["name"], s["sequence"]), " #", 1)) == key)
        by_level = lambda n: F.when(n == 2, _does("kept", "the same title with other signs")).when(n == 1, _does("written", "a form of the same title")).otherwise(_does("review", "another title"))
        return F.when(ours.rlike(TITLE_OF_FILE), _does("written", "a title of a file or chapter")).when(t.let(t.norm(ours), named), _does("written", "a series stood for the title")).otherwise(t.let(t.title_level(ours, theirs), by_level))
    if field == "subtitle":
        return F.when(ours.rlike(SUBTITLE_OF_SERIES) & ~theirs.rlike(SUBTITLE_OF_SERIES), _does("written", "only a place in a series")).otherwise(_does("review", "subtitles are taste"))
    if field == "narrators":
        keys = lambda names: F.transform(names, t.norm)
        by_keys = lambda mine, named, wrote: (
            F.when(t.shares_key(mine, wrote) & ~t.shares_key(named, wrote), _does("written", "the author stood for the reader"))
            .when(t.shares_key(mine, named), _does("kept", "the same reader in another spelling"))
            .otherwise(_does("review", "another reader, so perhaps another edition"))
        )
        wrote = keys(t.split_names(F.array_join("authors", ", ")))
        same = t.let(keys(c("_split_ours_narrators")), lambda mine: t.let(keys(c("_split_theirs_narrators")), lambda named: t.let(wrote, lambda w: by_keys(mine, named, w))))
        return F.when(F.exists("_split_ours_narrators", lambda n: n.rlike(d.COMPANY)), _does("written", "a company stood for the reader")).otherwise(same)
    if field == "series":
        told = lambda x: F.concat(F.lit("one series, number "), x["ours"], F.lit(" here and "), x["theirs"], F.lit(" there"))
        return t.let(series_clash(c("series"), c("p_series")), lambda x: F.when(x.isNotNull(), _does("review", told(x))).otherwise(_does("kept", "series are curated")))
    if field == "genres":
        return F.when(F.exists("genres", lambda g: ~t.trim(g).rlike(PLACEHOLDER_GENRE)), _does("kept", "genres are curated")).otherwise(_does("written", "genres that say nothing"))
    if field == "year":
        return F.when(ours.rlike(YEAR_OF_TIMESTAMP), _does("written", "a timestamp stood for the year")).otherwise(_does("kept", "a year is kept"))
    if field == "description":
        return F.when(F.octet_length(ours) < t.STUB_BYTES, _does("written", "a stub")).otherwise(_does("kept", "a text is kept"))
    return _does("written", {"publisher": "the publisher goes with the recording", "language": "the provider's spelling"}[field])


def _told(field: str, ours: Column, theirs: Column) -> Column:
    """What is told of a field that differs."""
    filled = lambda other: F.when(ours == "", _does("filled", "nothing was there")).otherwise(other)
    as_told = lambda verdict, shown: t.let(verdict, lambda v: F.struct(F.lit(field).alias("field"), ours.alias("ours"), shown.alias("theirs"), v["action"].alias("action"), v["rule"].alias("rule")))
    if field == "description":
        return as_told(filled(_verdict(field, ours, theirs)), F.concat(F.octet_length("p_description").cast("string"), F.lit(" characters")))
    if field != "authors":
        return as_told(filled(_verdict(field, ours, theirs)), theirs)

    def people(mine: Column, named: Column, same: Column, missing: Column) -> Column:
        added = (F.size(named) > 0) & ~missing
        verdict = F.when(same, _does("kept", "credits or honorifics")).when(added, _does("review", "one more name, as translators and pen names are listed too")).otherwise(_does("review", "another author"))
        return as_told(filled(verdict), F.when((ours != "") & added & ~same, F.array_join(named, ", ")).otherwise(theirs))

    same = lambda x: F.struct((F.array_sort(x["mine"]) == F.array_sort(x["named"])).alias("same"), (F.size(F.array_except(x["mine"], x["named"])) > 0).alias("missing"))
    keys = lambda mine, named: F.struct(F.transform(mine, t.norm).alias("mine"), F.transform(named, t.norm).alias("named"))
    both = lambda mine, named: t.let(t.let(keys(mine, named), same), lambda x: people(mine, named, x["same"], x["missing"]))
    return t.let(d.clean_people(c("_split_ours_authors")), lambda mine: t.let(d.clean_people(c("_split_theirs_authors")), lambda named: both(mine, named)))


def decided(rows: DataFrame) -> DataFrame:
    """rows with fields: array of struct(field, ours, theirs, action, rule), in the order of FIELDS.

    rows: items beside records, as beside() makes them. Null lists count as empty, null texts as blank. Texts compare by
    their keys, lists of names as sets; a description's record side is told by its size. Of added names the cleaned list is
    shown. An item beside no record (null columns) has no differences.
    """
    for name in ("authors", "narrators", "genres", "series", "p_genres", "p_series"):
        rows = rows.withColumn(name, F.coalesce(name, F.array().cast(rows.schema[name].dataType)))
    own = rows.columns
    rows = once(rows, {f"_{side}_{f}": x for f, both in _sides().items() for side, x in zip(("ours", "theirs"), both)})
    sides = {f: (c(f"_ours_{f}"), c(f"_theirs_{f}")) for f in FIELDS}
    rows = once(rows, {f"_split_{side}_{f}": t.split_names(x) for f in ("authors", "narrators") for side, x in zip(("ours", "theirs"), sides[f])})
    told = [F.when(F.coalesce(_differs(f, *both), F.lit(False)), _told(f, *both)) for f, both in sides.items()]
    return once(rows, {"fields": F.array_compact(F.array(*told))}).select(*own, "fields")


def decisions(rows: DataFrame, key: str = "id") -> DataFrame:
    """key, field, ours, theirs, action, rule: a row for each difference."""
    return decided(rows).select(key, F.explode_outer("fields").alias("d")).where("d is not null").select(key, "d.*")


def _written(field: str, actions: tuple[str, ...]) -> Column:
    return F.exists("fields", lambda x: (x["field"] == field) & x["action"].isin(*actions))


def _values() -> dict[str, tuple[str, Column]]:
    """For each field the item's column and what the record puts there."""
    refs = F.transform("p_series", lambda s: F.struct(F.lit(None).cast("string").alias("id"), s["series"].alias("name"), t.blank(s["sequence"]).alias("sequence")))
    own = {"authors": d.clean_people(t.split_names(c("p_author"))), "narrators": t.split_names(c("p_narrator")), "series": refs, "genres": c("p_genres"), "year": c("p_published_year")}
    own |= {f: c(f"p_{f}") for f in FIELDS if f not in own}
    return {f: ("published_year" if f == "year" else f, own[f]) for f in FIELDS}


def updates(rows: DataFrame, key: str = "id") -> DataFrame:
    """A row for each item with something ``written``: its key and new_<column>, null where nothing is written there."""
    out = decided(rows)
    some = F.exists("fields", lambda x: x["action"] == "written")
    return out.where(some).select(key, *[F.when(_written(f, ("written",)), value).alias(f"new_{column}") for f, (column, value) in _values().items()])


def applied(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Items (columns) as they are after the match: empty fields filled, written ones replaced; an empty asin or isbn filled too."""
    out = decided(rows)
    new = {column: F.when(_written(f, ("filled", "written")), value).otherwise(c(column)) for f, (column, value) in _values().items()}
    new |= {x: F.when((t.trim(c(x)) == "") & (t.trim(c(f"p_{x}")) != ""), c(f"p_{x}")).otherwise(c(x)) for x in ("asin", "isbn")}
    return out.select(*[new.get(x, c(x)).alias(x) for x in columns])


def apply_batch(items: DataFrame, matches: DataFrame, records: DataFrame) -> DataFrame:
    """One row for each match: item, asin, isbn, provider, error, filled, written, kept, review (numbers of fields), fields.

    matches: item, asin, isbn, provider (empty: the first provider, by provider_rank, that holds the asin or, without one, the
    isbn). error, in this order: no_id (neither asin nor isbn), no_item, not_book, no_record; a failed match changes nothing.
    A match may name an item again; each row stands by itself. An asin is compared without case, an isbn as it is.
    """
    wanted = matches.select("item", t.trim(c("asin")).alias("asin"), t.trim(c("isbn")).alias("isbn"), t.blank(c("provider")).alias("provider")).withColumn("_m", F.monotonically_increasing_id())
    held = records.select(F.struct(*records.columns).alias("r"))
    keys = F.array_compact(F.array(F.when(t.trim(c("r.asin")) != "", F.concat(F.lit("a"), F.lower(t.trim(c("r.asin"))))), F.when(t.trim(c("r.isbn")) != "", F.concat(F.lit("i"), t.trim(c("r.isbn"))))))
    held = held.withColumn("k", F.explode(keys))
    # a record is chosen once for each provider and key, so a key that many records share is one row of the join
    per = held.groupBy("k", c("r.provider").alias("p")).agg(F.min_by("r", F.struct("r.provider_rank", "r.title", "r.author")).alias("r"))
    key = F.when(c("asin") != "", F.concat(F.lit("a"), F.lower("asin"))).when(c("isbn") != "", F.concat(F.lit("i"), c("isbn")))
    ask = wanted.withColumn("k", key)
    found = ask.join(per, "k").where((c("provider") == "") | (c("provider") == c("p"))).groupBy("_m").agg(F.min_by("r", F.struct("r.provider_rank", "r.provider")).alias("r"))
    whole = wanted.join(found, "_m", "left").join(items.withColumn("_there", F.lit(True)).withColumnsRenamed({x: f"i_{x}" for x in ("asin", "isbn", "provider") if x in items.columns}), wanted["item"] == items["id"], "left")
    rows = whole.select(*whole.columns, *[c(f"r.{x}").alias(f"p_{x}") for x in records.columns]).drop("r")
    error = F.when((c("asin") == "") & (c("isbn") == ""), "no_id").when(c("_there").isNull(), "no_item").when(c("media_type") == "podcast", "not_book").when(c("p_provider").isNull(), "no_record").otherwise("")
    out = decided(rows.withColumn("error", error))
    fields = F.when(c("error") == "", c("fields")).otherwise(F.slice("fields", 1, 0))
    count = lambda a: F.size(F.filter("fields", lambda x: x["action"] == a)).alias(a)
    return out.withColumn("fields", fields).select("item", "asin", "isbn", F.coalesce(F.nullif(c("provider"), F.lit("")), "p_provider", F.lit("")).alias("provider"), "error", *map(count, ACTIONS), "fields")
