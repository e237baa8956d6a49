"""Items against their files: folders, file names, embedded tags, files that can't play, covers, episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions import text as t

c = F.col

# ---- Fixed values ---------------------------------------------------------------------------------

_SEGMENT = r"\s+[-–]\s*|\s*[-–]\s+"
_PARENTHESIS = r"\s*[(\[][^)\]]*[)\]]"
_TRAILER = r"(?i)(\s+(disc|cd|part)\s*\d+|\s+v\d+)\s*$"
#: Words of file names that name no book.
GENERIC = ("chapter", "chapters", "ch", "chap", "track", "trk", "part", "pt", "disc", "cd", "section", "sec", "of", "and", "the", "a")
#: Containers by extension; codecs that an extension should hold.
CONTAINERS = {
    ".m4a": "mp4", ".m4b": "mp4", ".mp4": "mp4", ".m4p": "mp4", ".mov": "mp4", ".aax": "mp4", ".aaxc": "mp4", ".mp3": "mp3", ".mp2": "mp3",
    ".aac": "aac", ".flac": "flac", ".ogg": "ogg", ".oga": "ogg", ".opus": "ogg", ".wav": "wav", ".wma": "asf", ".asf": "asf",
    ".webm": "matroska", ".mka": "matroska", ".aif": "aiff", ".aiff": "aiff", ".caf": "caf",
}
CODECS = {
    ".mp3": ["mp3", "mp2", "mp1"], ".mp2": ["mp3", "mp2", "mp1"], ".flac": ["flac"], ".ogg": ["vorbis", "opus", "flac", "speex"],
    ".oga": ["vorbis", "opus", "flac", "speex"], ".opus": ["opus"], ".aac": ["aac"],
}
#: Formats that only a shop's player opens.
LOCKED = (".aax", ".aaxc", ".aa", ".m4p")
SMALL_COVER, SQUARE = 500, 0.1


# ---- Folders --------------------------------------------------------------------------------------


def strip(s: Column) -> Column:
    """A folder or title without parentheses, without disc, part or version at its end and a track number in front."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t.blank(s), _PARENTHESIS, ""), _TRAILER, ""), r"^\d{1,3}\s+", "")


def _names(parts: Column) -> Column:
    """Comparable names: with a letter, or a number of three digits or more; each once."""
    return F.array_distinct(F.filter(F.transform(parts, t.path_words), lambda v: v.rlike(r"\p{L}") | v.rlike(r"^\d{3,}$")))


def title_names(title: Column) -> Column:
    """Names that a title may give its book: all of it, what stands before a colon, its first and last segments."""
    s = strip(title)
    seg = F.split(s, _SEGMENT)
    ends = F.when(F.size(seg) > 1, F.array(F.element_at(seg, -1), F.get(seg, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    return _names(F.concat(F.array(s, F.when(F.instr(s, ":") > 1, F.substring_index(s, ":", 1)).otherwise("")), ends))


def folder_names(folder: Column) -> Column:
    """Names that a folder may give its book: all of it, its last segment that is a name, and a number in front."""
    s = strip(folder)
    seg = F.split(s, _SEGMENT)
    last = F.filter(F.reverse(_names_kept(seg)), lambda v: (v != "") & (v != t.path_words(s)))
    first = t.path_words(F.get(seg, F.lit(0)))
    return F.array_distinct(F.concat(_names(F.array(s)), F.slice(last, 1, 1), F.when((F.size(seg) > 1) & first.rlike(r"^\d{3,}$"), F.array(first)).otherwise(F.array().cast("array<string>"))))


def _names_kept(parts: Column) -> Column:
    return F.filter(F.transform(parts, t.path_words), lambda v: v.rlike(r"\p{L}") | v.rlike(r"^\d{3,}$"))


def agree(a: Column, b: Column) -> Column:
    """A name of one list stands, word for word, in one of the other."""
    return F.exists(a, lambda x: F.exists(b, lambda y: t.contains_words(x, y) | t.contains_words(y, x)))


def _named_in(part: Column, names: Column) -> Column:
    return F.exists(names, lambda n: (n != "") & (F.contains(part, n) | F.contains(n, part)))


def parent_names(folder: Column) -> Column:
    """A parent folder's words, whole and by segment."""
    return F.filter(F.array_distinct(F.concat(F.array(t.path_words(folder)), F.transform(F.split(folder, _SEGMENT), t.path_words))), lambda w: w != "")


def year_clash(folder: Column, title: Column, subtitle: Column, year: Column) -> Column:
    """The least year that a folder gives in brackets or between dashes, outside the title, if the item's is earlier; else null."""
    have = F.regexp_extract(t.blank(year), r"^((?:19|20)\d\d)", 1)
    bracketed = F.flatten(F.transform(F.regexp_extract_all(folder, F.lit(r"[(\[]([^)\]]*)[)\]]"), 1), lambda b: F.regexp_extract_all(b, F.lit(r"\b((?:19|20)\d\d)\b"), 1)))
    seg = F.split(F.regexp_replace(folder, r"[(\[][^)\]]*[)\]]", ""), _SEGMENT)
    dashed = F.when(F.size(seg) > 1, F.filter(F.transform(seg, F.trim), lambda s: s.rlike(r"^(?:19|20)\d\d$"))).otherwise(F.array().cast("array<string>"))
    own = t.path_words(F.concat_ws(" ", t.blank(title), t.blank(subtitle)))
    years = F.filter(F.concat(bracketed, dashed), lambda y: ~t.contains_words(own, y))
    return F.when((have != "") & (F.size(years) > 0) & (have < F.array_min(years)), F.array_min(years))


def path_problems(items: DataFrame) -> DataFrame:
    """id, problem: title (the folder names another book), author (no parent names author, series, genre or tag), year, series
    (an item with a place in a series whose folder doesn't say so). Podcasts, single files and items without title have none."""
    return with_path_problem(items).select("id", c("path_problem").alias("problem")).where("problem is not null")


def with_path_problem(rows: DataFrame) -> DataFrame:
    """rows with path_problem, as path_problems() names them; null for none."""
    has_folder = (c("media_type") != "podcast") & ~c("is_file") & (c("rel_path") != "") & (t.trim(c("title")) != "")
    rel = F.regexp_replace("rel_path", "^/+|/+$", "")
    rows = rows.withColumn("_parts", F.split(rel, "/+")).withColumn("_base", F.element_at("_parts", -1)).withColumn("_parents", F.slice("_parts", 1, F.size("_parts") - 1))
    known = F.transform(F.concat("authors", F.transform("series", lambda s: s["name"]), "genres", "tags"), t.path_words)
    base = t.path_words(F.regexp_replace("_base", _PARENTHESIS, ""))
    turned = F.exists("authors", lambda a: F.exists("_parents", lambda p: F.contains(t.path_words(p), F.concat_ws(" ", F.element_at(t.words(t.path_words(a)), -1), F.get(t.words(t.path_words(a)), F.lit(0))))))
    author_ok = (F.size("_parents") == 0) | turned | F.exists("_parents", lambda p: (p == F.lower(p)) | F.exists(parent_names(p), lambda n: F.startswith(base, n) | _named_in(n, known)))
    title_ok = agree(folder_names(c("_base")), title_names(c("title")))
    placed = F.filter("series", lambda s: (t.trim(s["name"]) != "") & (s["sequence"] != ""))
    article = lambda w: F.regexp_replace(w, "^(the|a|an) ", "")
    in_series = F.transform(placed, lambda s: article(t.path_words(F.regexp_replace(s["name"], _PARENTHESIS, ""))))
    seg = F.split(F.regexp_replace(F.regexp_replace("_base", _PARENTHESIS, ""), _TRAILER, ""), _SEGMENT)
    whole = t.path_words(F.regexp_replace("_base", _TRAILER, ""))
    says = F.exists(seg, lambda s: F.trim(s).rlike(r"(^|\s)\d{1,2}(\.\d+)?$")) | (whole.rlike(r"(^| )\d{1,2}( |$)") & F.exists(in_series, lambda n: (n != "") & t.contains_words(whole, n)))
    says |= F.exists("_parents", lambda p: (p != F.lower(p)) & F.exists(parent_names(p), lambda n: F.startswith(F.concat(article(whole), F.lit(" ")), F.concat(article(n), F.lit(" "))) | F.exists(in_series, lambda s: (s != "") & (t.contains_words(article(n), s) | t.contains_words(s, article(n))))))
    year = year_clash(c("_base"), c("title"), c("subtitle"), c("published_year"))
    problem = F.when(~title_ok & ~author_ok, "title and author").when(~title_ok, "title").when(~author_ok, "author").when(year.isNotNull(), "year").when((F.size(placed) > 0) & ~says, "series")
    return rows.withColumn("path_problem", F.when(has_folder, problem)).drop("_parts", "_base", "_parents")


def _key_words(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.isin(*GENERIC) & w.rlike(r"\p{L}"))


def stem(names: Column) -> Column:
    """Words that all file names start or end with, generic ones and numbers dropped."""
    ws = F.transform(names, lambda n: t.words(t.path_words(strip(n))))
    first = F.get(ws, F.lit(0))
    same = lambda k, from_end: F.forall(ws, lambda w: F.coalesce((F.get(w, F.size(w) - 1 - k) == F.get(first, F.size(first) - 1 - k)) if from_end else (F.get(w, k) == F.get(first, k)), F.lit(False)))
    least = F.array_min(F.transform(ws, F.size))
    run = lambda end, most: F.aggregate(F.sequence(F.lit(0), F.greatest(most, F.lit(1)) - 1), F.lit(0), lambda n, k: F.when((n == k) & (k < most) & same(k, end), n + 1).otherwise(n))
    head = run(False, least)
    tail = run(True, least - head)
    return F.array_join(_key_words(F.concat(F.slice(first, 1, head), F.when(tail > 0, F.slice(first, -F.greatest(tail, F.lit(1)), F.greatest(tail, F.lit(1)))).otherwise(F.array().cast("array<string>")))), " ")


def file_name_problems(items: DataFrame, audio: DataFrame) -> DataFrame:
    """id, stem of items whose files share a name that is neither title, folder, author nor series."""
    names = audio.groupBy("item_id").agg(F.sort_array(F.collect_list(F.regexp_replace("filename", r"\.[^.]*$", ""))).alias("_files"))
    rows = items.where((c("media_type") != "podcast") & (t.trim(c("title")) != "")).join(names, c("id") == c("item_id")).withColumn("stem", stem(c("_files"))).where("stem != ''")
    known = F.concat(title_names(c("title")), F.when(~c("is_file"), folder_names(t.base_name(F.regexp_replace("rel_path", "/+$", "")))).otherwise(F.array().cast("array<string>")), F.transform("authors", t.path_words), F.transform("series", lambda s: t.path_words(s["name"])))
    keys = F.filter(F.transform(known, lambda k: F.array_join(_key_words(t.words(t.path_words(strip(k)))), " ")), lambda k: k != "")
    return rows.where(~agree(F.array("stem"), keys)).select("id", "stem")


# ---- Tags and players -----------------------------------------------------------------------------


def same_set(tag: Column, wanted: Column) -> Column:
    """A delimited tag holds the wanted values, in any order and case; by semicolons, or by commas and slashes as well."""
    want = F.array_sort(F.array_distinct(F.filter(F.transform(wanted, lambda w: F.lower(t.trim(w))), lambda w: w != "")))
    have = lambda p: F.array_sort(F.array_distinct(F.filter(F.transform(F.split(t.blank(tag), p), lambda w: F.lower(t.trim(w))), lambda w: w != "")))
    return (have(";") == want) | (have("[;/,]") == want)


def embedded_problems(items: DataFrame, audio: DataFrame) -> DataFrame:
    """id, files, untagged, stale, reasons: files without tags, and files whose tags say otherwise than the item.

    audio.tags is a map of title, album, artist, album_artist, composer, series, grouping, genre, date and publisher.
    """
    tag = lambda k: t.trim(F.try_element_at("f.tags", F.lit(k)))
    same = lambda a, b: F.lower(t.trim(a)) == F.lower(t.trim(b))
    author, reader = F.array_join("authors", ", "), F.array_join("narrators", ", ")
    series = F.lower(t.trim(F.coalesce(F.get("series", F.lit(0))["name"], F.lit(""))))
    mp3 = F.when(t.blank(c("f.mime")) != "", F.lower("f.mime") == "audio/mpeg").otherwise(F.lower(t.blank(c("f.ext"))) == ".mp3")
    rules = {
        "title": (t.trim(c("title")) != "") & ~same(tag("title"), c("title")) & ~F.startswith(F.lower(tag("album")), F.lower(t.trim(c("title")))),
        "author": (author != "") & ~same(tag("artist"), author) & ~same(tag("album_artist"), author),
        "narrator": (reader != "") & ~same(tag("composer"), reader),
        "series": (series != "") & ~F.contains(F.lower(F.concat_ws(" ", tag("grouping"), tag("series"))), series),
        "genres": (F.size("genres") > 0) & ~same_set(tag("genre"), c("genres")),
        "year": (c("published_year") != "") & ~F.startswith(tag("date"), t.trim(c("published_year"))),
        "publisher": (t.trim(c("publisher")) != "") & mp3 & ~same(tag("publisher"), c("publisher")),
    }
    empty = F.concat(*[tag(k) for k in ("title", "album", "artist", "album_artist")]) == ""
    j = items.join(audio.alias("f"), c("id") == c("f.item_id")).select("id", empty.alias("empty"), F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in rules.items()])).alias("why"))
    out = j.groupBy("id").agg(F.count(F.lit(1)).alias("files"), F.count_if("empty").alias("untagged"), F.count_if(~c("empty") & (F.size("why") > 0)).alias("stale"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(~c("empty"), c("why")))))).alias("reasons"))
    return out.where("untagged > 0 or stale > 0")


def needs_probe(ext: Column, codec: Column) -> Column:
    """A file whose header must be read: it may be locked, its extension is unknown, or its codec isn't the extension's."""
    e = F.lower(t.blank(ext))
    own = F.coalesce(*[F.when(e == x, F.lower(t.blank(codec)).isin(*names)) for x, names in CODECS.items()], F.lit(True))
    return e.isin(*[x for x, k in CONTAINERS.items() if k in ("mp4", "asf")]) | ~e.isin(*CONTAINERS) | ~own


def unplayable(files: DataFrame) -> DataFrame:
    """item_id, problem, files (names), by the first that holds of a file: unread, unknown, locked, cut_short, damaged; and
    wrong_extension. files: item_id, filename, ext, error, container, locked, size, wanted, complaints."""
    e = F.lower(t.blank(c("ext")))
    expected = F.coalesce(*[F.when(e == x, k) for x, k in CONTAINERS.items()], F.lit(""))
    short = c("wanted") > c("size")
    first = F.when(t.blank(c("error")) != "", "unread").when((t.blank(c("container")).isin("", "unknown")) & (expected != ""), "unknown").when(t.blank(c("locked")) != "", "locked").when(short, "cut_short").when(F.coalesce("complaints", F.lit(0)) > 0, "damaged")
    named = F.when((first.isNull() | (first == "damaged")) & (expected != "") & ~t.blank(c("container")).isin("", "unknown", "id3") & (c("container") != expected), "wrong_extension")
    return files.select("item_id", "filename", F.explode(F.array_compact(F.array(first, named))).alias("problem")).groupBy("item_id", "problem").agg(F.array_sort(F.collect_set("filename")).alias("files"))


def locked_only(items: DataFrame, files: DataFrame) -> DataFrame:
    """Items without audio that have a shop's locked file beside them: id, files."""
    held = files.where(F.lower("ext_of").isin(*LOCKED) if "ext_of" in files.columns else F.lower("filename").rlike(r"\.(aaxc?|aa|m4p)$")).where("file_type != 'audio'").groupBy("item_id").agg(F.array_sort(F.collect_set("filename")).alias("files"))
    return items.where("num_tracks = 0 and num_audio_files = 0").join(held, c("id") == c("item_id")).select("id", "files")


# ---- Covers and episodes --------------------------------------------------------------------------


def cover_problems(items: DataFrame, sizes: DataFrame, least: int = SMALL_COVER, tolerance: float = SQUARE) -> DataFrame:
    """id, problem: missing, ratio (not square), small. sizes: item_id, width, height."""
    j = items.select("id", "cover_path").join(sizes, c("id") == c("item_id"), "left")
    problem = F.when(c("cover_path") == "", "missing").when(F.abs(c("width") / c("height") - 1) > tolerance, "ratio").when(F.least("width", "height") < least, "small")
    return j.select("id", problem.alias("problem")).where("problem is not null")


def cover_upgrades(ours: DataFrame, theirs: DataFrame, factor: float = 1.5) -> DataFrame:
    """id, verdict of a shop's cover: upgrade (the same picture, larger by the factor), differs; equals are left out.

    Both: id, p, d, width, height (hashes of media.picture_hashes).
    """
    from curatrix.functions.media import same_picture

    j = ours.alias("o").join(theirs.alias("s"), "id")
    same = same_picture(c("o.p"), c("o.d"), c("s.p"), c("s.d"))
    return j.select("id", F.when(~same, "differs").when(c("s.width") * c("s.height") >= factor * factor * c("o.width") * c("o.height"), "upgrade").alias("verdict")).where("verdict is not null")


def newest_episodes(episodes: DataFrame, n: int = 10) -> DataFrame:
    """The newest episodes of each item, by when they came out, else when they were added."""
    w = Window.partitionBy("item_id").orderBy(F.coalesce("published_at", "added_at").desc_nulls_last(), "id")
    return episodes.withColumn("place", F.row_number().over(w)).where(c("place") <= n)


def to_download(feed: DataFrame, held: DataFrame, queue: DataFrame) -> DataFrame:
    """Feed episodes that are neither held (by guid or address) nor in the queue (by address)."""
    have = held.select("item_id", F.explode(F.array(F.concat(F.lit("g:"), t.blank(c("guid"))), F.concat(F.lit("u:"), t.trim(c("url"))))).alias("k")).where("length(k) > 2")
    keys = feed.select("item_id", "id", F.explode(F.array(F.concat(F.lit("g:"), t.blank(c("guid"))), F.concat(F.lit("u:"), t.trim(c("url"))))).alias("k")).where("length(k) > 2")
    known = keys.join(have, ["item_id", "k"], "left_semi").select("item_id", "id").distinct()
    waiting = queue.select("item_id", t.trim(c("url")).alias("_u")).distinct()
    return feed.join(known, ["item_id", "id"], "left_anti").withColumn("_u", t.trim(c("url"))).join(waiting, ["item_id", "_u"], "left_anti").drop("_u")
