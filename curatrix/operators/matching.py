"""Matching items to provider records: scores, ranks, field differences, decisions, editions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions import text as t

TOLERANCE, TOLERANCE_MOST = 0.03, 0.10
CONFIDENCE = ("exact", "likely", "edition", "unsure", "none")
ROLE_WORDS = ("narrator", "narrated", "read", "by", "translator", "editor", "and", "with", "mr", "mrs", "ms", "dr", "sir", "jr", "sr", "ii", "iii", "phd")
EDITION_NEAR, FAR_SHORTER, SHORTER_WORK, ABRIDGED_LEAST = 0.05, 0.6, 0.2, 600
c = F.col


def reader_words(name: Column) -> Column:
    return F.filter(t.words(t.norm(name)), lambda w: ~w.isin(*ROLE_WORDS))


def same_reader(a: Column, b: Column, surnames: bool = False) -> Column:
    """Lists of words of two readers: equal, or one surname and first names equal or initial; surnames: a surname will do."""
    last = F.element_at(a, -1) == F.element_at(b, -1)
    x, y = F.get(a, F.lit(0)), F.get(b, F.lit(0))
    first = (x == y) | ((F.length(x) == 1) & F.startswith(y, x)) | ((F.length(y) == 1) & F.startswith(x, y))
    both = (F.size(a) > 0) & (F.size(b) > 0)
    alone = F.least(F.size(a), F.size(b)) == 1
    return both & ((a == b) | (last & ((~alone & first) | (F.lit(surnames) & alone))))


def readers_verdict(ours: Column, theirs: Column) -> Column:
    """same, differs, or unknown where either side names none."""
    a, b = (F.filter(F.transform(x, reader_words), lambda w: F.size(w) > 0) for x in (ours, theirs))
    hit = F.exists(a, lambda x: F.exists(b, lambda y: same_reader(x, y)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), "unknown").when(hit, "same").otherwise("differs")


_CREDIT = r"(?iu)^\s*(?:read|narrated|performed|narration)\s+by\s+(.+)$"
_CREDIT_END = r"(?i)\s+(?:with|featuring|and an?|plus)\s+(?:an?\s+)?(?:introduction|foreword|afterword|interview|music)\b.*$|\s+with\s+.*$|[;:\n(].*$"
_BRACKET = r"(?i)[(\[](?:read|narrated|performed) by ([^)\]]*)[)\]]"
_PRODUCTION = r"(?i)\b(full[- ]?cast|cast|dramati[sz](ed|ation)|graphic ?audio|audio ?drama|radio (play|drama)|bbc radio)\b"


def credit_names(line: Column) -> Column:
    """Names of a line such as ``Read by A and B``, up to the end of its clause or first sentence; empty for other lines."""
    said = F.regexp_replace(F.regexp_extract(t.blank(line), _CREDIT, 1), _CREDIT_END, "")
    return t.split_names(F.regexp_replace(said, r"(\p{L}{2,})\.\s.*$|\.$", "$1"))


def reader_sources(narrators: Column, title: Column, path: Column, description: Column) -> Column:
    """Where an item says who reads it: array of struct(source, readers): its field, its title's or folder's brackets, its
    description's credit line. Sources that name nobody are left out."""
    one = lambda name, readers: F.struct(F.lit(name).alias("source"), F.filter(readers, lambda r: F.size(reader_words(r)) > 0).alias("readers"))
    made = F.array(one("field", narrators), one("title", t.split_names(F.regexp_extract(t.blank(title), _BRACKET, 1))), one("folder", t.split_names(F.regexp_extract(t.base_name(path), _BRACKET, 1))), one("description", credit_names(t.plain_text(description))))
    return F.filter(made, lambda s: F.size(s["readers"]) > 0)


def says_production(*texts: Column) -> Column:
    """A full cast or a drama, by its words."""
    return F.concat_ws(" ", *texts).rlike(_PRODUCTION)


def judged_readers(sources: Column, theirs: Column, production: Column) -> Column:
    """differs if any source names other readers, or one reader stands for a production; same if all agree; else unknown."""
    other = F.exists(sources, lambda s: readers_verdict(s["readers"], theirs) == "differs")
    alone = production & (F.size(theirs) == 1) & ~F.get(theirs, F.lit(0)).rlike(_PRODUCTION)
    return F.when(F.size(theirs) == 0, "unknown").when(alone, "differs").when(F.size(sources) == 0, "unknown").when(other, "differs").otherwise("same")


def score(pairs: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """pairs with title_level, author_ok, delta, length, reader, confidence and rank (of the confidence).

    Columns: title, authors, narrators, duration of the item; p_title, p_author, p_narrator, p_minutes of the record.
    """
    tol = min(max(tolerance, 1e-9), TOLERANCE_MOST)
    level = t.title_level(c("title"), c("p_title"))
    ours, theirs = F.flatten(F.transform("authors", t.split_names)), t.split_names(c("p_author"))
    author = (F.size(ours) == 0) | (F.size(theirs) == 0) | t.shares_name(ours, theirs)
    seconds = F.coalesce(c("p_minutes"), F.lit(0.0)) * 60
    delta = F.when((c("duration") > 0) & (seconds > 0), (seconds - c("duration")) / c("duration"))
    out = pairs.withColumns({"title_level": level, "author_ok": author, "delta": delta, "reader": readers_verdict(c("narrators"), t.split_names(c("p_narrator")))})
    out = out.withColumn("length", F.when(c("delta").isNull(), "unknown").when(F.abs("delta") <= tol, "same").otherwise("off"))
    confidence = F.when((c("title_level") == 0) | ~c("author_ok"), "unsure").when((c("length") == "off") | (c("reader") == "differs"), "edition").when((c("title_level") == 2) & (c("length") == "same"), "exact").otherwise("likely")
    return out.withColumn("confidence", confidence).withColumn("rank", F.array_position(F.array(*map(F.lit, CONFIDENCE)), c("confidence")) - 1)


def ranked(scored: DataFrame, place: list[str], item: str = "id") -> DataFrame:
    """Records of each item by confidence, then by thousandths of length apart, then by their place."""
    order = Window.partitionBy(item).orderBy("rank", F.floor(F.abs(F.coalesce("delta", F.lit(0.0))) * 1000), *place)
    return scored.withColumn("place", F.row_number().over(order))


def best(items: DataFrame, records: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Each item's best record over all providers, the earlier provider first among equals; items without one are ``none``."""
    theirs = records.select(c("query_item_id").alias("id"), "provider", "provider_rank", c("asin").alias("p_asin"), c("title").alias("p_title"), c("author").alias("p_author"), c("narrator").alias("p_narrator"), c("duration_min").alias("p_minutes"))
    got = ranked(score(items.select("id", "title", "authors", "narrators", "duration").join(theirs, "id"), tolerance), ["provider_rank", "p_asin"]).where("place = 1")
    return items.select("id").join(got.select("id", "provider", "p_asin", "p_title", "delta", "confidence"), "id", "left").withColumn("confidence", F.coalesce("confidence", F.lit("none")))


def field_diffs(rows: DataFrame) -> DataFrame:
    """id, field, ours, theirs where a record says otherwise; a record's blank says nothing. Record columns are p_<field>."""
    text = lambda f: F.when((t.trim(c(f"p_{f}")) != "") & (t.norm(c(f)) != t.norm(c(f"p_{f}"))), F.struct(F.lit(f).alias("field"), t.trim(c(f)).alias("ours"), t.trim(c(f"p_{f}")).alias("theirs")))
    listed = lambda f: F.when((F.size(f"p_{f}") > 0) & ~t.same_names(c(f), c(f"p_{f}")), F.struct(F.lit(f).alias("field"), F.array_join(f, ", ").alias("ours"), F.array_join(f"p_{f}", ", ").alias("theirs")))
    about = F.when((F.octet_length(t.trim(c("description"))) < t.STUB_BYTES) & (F.octet_length(t.trim(c("p_description"))) > F.octet_length(t.trim(c("description")))), F.struct(F.lit("description").alias("field"), t.trim(c("description")).alias("ours"), F.concat(F.octet_length("p_description").cast("string"), F.lit(" characters")).alias("theirs")))
    made = [text(f) for f in ("title", "subtitle", "publisher", "published_year", "language") if f in rows.columns] + [listed(f) for f in ("authors", "narrators", "series_names", "genres") if f in rows.columns]
    if "description" in rows.columns:
        made.append(about)
    return rows.select("id", F.explode(F.array_compact(F.array(*made))).alias("d")).select("id", "d.*")


def check_matched(items: DataFrame, records: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Matched items whose record is gone or disagrees: id, problem (not_found, title_differs, duration_off, narrator_differs)."""
    mine = items.where("asin != ''").select("id", "title", "authors", "narrators", "duration", F.upper(t.trim(c("asin"))).alias("k"))
    first = Window.partitionBy("k").orderBy("provider_rank")
    theirs = records.where("asin != ''").select(F.upper(t.trim(c("asin"))).alias("k"), "provider_rank", c("title").alias("p_title"), c("author").alias("p_author"), c("narrator").alias("p_narrator"), c("duration_min").alias("p_minutes")).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    j = score(mine.join(theirs, "k", "left"), tolerance)
    problem = F.when(c("p_title").isNull(), F.array(F.lit("not_found"))).otherwise(F.array_compact(F.array(F.when(c("title_level") == 0, "title_differs"), F.when(c("length") == "off", "duration_off"), F.when(c("reader") == "differs", "narrator_differs"))))
    return j.select("id", F.explode(problem).alias("problem"))


def editions(items: DataFrame, records: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Items that look abridged beside a store's editions: id, problem, share.

    abridged_length: as long as an abridged edition, and no unabridged one is; far_shorter: under 60 % of the shortest
    unabridged one; shorter_work: under a fifth. An unabridged edition within 5 % clears an item.
    """
    theirs = records.select(c("query_item_id").alias("id"), c("title").alias("p_title"), c("author").alias("p_author"), c("narrator").alias("p_narrator"), c("duration_min").alias("p_minutes"), "abridged")
    own = items.where((c("duration") >= ABRIDGED_LEAST) & ~t.says_abridged(c("abridged"), c("title"), c("subtitle"))).select("id", "title", "authors", "narrators", "duration")
    j = score(own.join(theirs, "id"), tolerance).where((c("title_level") > 0) & c("author_ok") & c("delta").isNotNull())
    cut = F.coalesce("abridged", F.lit(False)) | c("p_title").rlike(t.ABRIDGED)
    seconds = c("p_minutes") * 60
    a = j.groupBy("id", "duration").agg(F.max(F.when(~cut & (F.abs("delta") <= EDITION_NEAR), 1).otherwise(0)).alias("cleared"), F.max(F.when(cut & (c("length") == "same"), 1).otherwise(0)).alias("fits"), F.min(F.when(~cut, seconds)).alias("whole"))
    share = c("duration") / c("whole")
    problem = F.when(c("fits") == 1, "abridged_length").when(share < SHORTER_WORK, "shorter_work").when(share < FAR_SHORTER, "far_shorter")
    return a.where("cleared = 0").withColumn("problem", problem).where("problem is not null").select("id", "problem", share.alias("share"))


def held_episodes(feed: DataFrame, held: DataFrame) -> DataFrame:
    """Feed episodes that an item has already, by guid or address: feed id, held id, each pair once."""
    from curatrix.operators.joins import either_key

    return either_key(feed.withColumn("url", t.trim(c("url"))), held.withColumn("url", t.trim(c("url"))), [("guid", "guid"), ("url", "url")], "id", "id")
