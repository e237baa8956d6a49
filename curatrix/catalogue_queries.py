"""The operators of catalogues over record tables that are derived from the supplied tables, with the same in SQL for DuckDB.

Parts are the items (brands write them, sizes are places in series), line items their audio files and chapters, events the
sessions, episodes and bookmarks of users, orders the lists.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.functions import display as d
from curatrix.operators import chapters, changes, duplicates, entities, files, listing, matching, predicates, series, vocabulary
from curatrix.operators.rows import spread
from curatrix.sources import catalog

c = F.col
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Parts as items. dealt: over all tasks, for what computes much of each (the table is one file)."""
    k, size = "p_partkey", "p_size"
    rows = _read(spark, sf_dir, "part")
    made = (spread(rows, k) if dealt else rows).selectExpr(
        f"concat('p', {k}) AS id", f"concat('l', {size} % 3) AS library_id", "'f' AS folder_id", f"if({size} % 10 = 0, 'podcast', 'book') AS media_type",
        f"concat(p_brand, '/', p_brand, ' - ', lpad({size}, 2, '0'), ' - ', p_name) AS rel_path", "false AS is_file", f"{k} % 41 = 0 AS is_missing", f"{k} % 43 = 0 AS is_invalid",
        f"timestamp_seconds(1700000000 + {k} * 60) AS added_at", f"timestamp_seconds(1700000000 + {k} * 90) AS updated_at", f"cast({k} * 1000 AS bigint) AS size",
        f"if({k} % 6 = 0, '', 'c.jpg') AS cover_path", "p_retailprice * 10 AS duration", f"cast({k} % 4 AS int) AS num_tracks", f"cast({k} % 4 AS int) AS num_audio_files", f"cast({k} % 3 AS int) AS num_chapters",
        f"cast(if({size} % 10 = 0, {k} % 2, 0) AS int) AS num_episodes", f"if({k} % 5 = 0, 'epub', '') AS ebook_format", "cast(null AS timestamp) AS last_episode_check", "split(p_name, ' ') AS tags", "p_name AS title", "'' AS subtitle",
        f"if({k} % 9 = 0, array(), array(p_brand)) AS authors", f"if({k} % 8 = 0, array(), array(concat('Brand#', {size} % 25))) AS narrators",
        f"if({k} % 7 = 0, array(), array(named_struct('id', cast(null AS string), 'name', p_brand, 'sequence', if({k} % 11 = 0, '', cast({size} AS string))))) AS series",
        "array(lower(p_type), split(p_name, ' ')[0]) AS genres", f"if({k} % 3 = 0, '', concat('B', {k} % 700)) AS asin", f"if({k} % 13 = 0, concat('978-', {k} % 50), '') AS isbn",
        f"cast(1950 + {size} AS string) AS published_year", f"if({k} % 4 = 0, '', p_type) AS publisher", f"if({k} % 5 = 0, '', 'English') AS language",
        "concat('<p>', p_name, '</p> ', repeat('word ', cast(p_size AS int))) AS description", f"{k} % 17 = 0 AS abridged", f"{k} % 19 = 0 AS explicit", "'' AS feed_url",
    )
    return catalog.settled(made)


_ITEM = """item AS (SELECT 'p' || p_partkey AS id, 'l' || (p_size % 3) AS library_id, CASE WHEN p_size % 10 = 0 THEN 'podcast' ELSE 'book' END AS media_type, p_partkey AS k, p_size AS place,
  p_partkey % 41 = 0 AS is_missing, p_partkey % 43 = 0 AS is_invalid, p_partkey * 1000 AS size, CASE WHEN p_partkey % 6 = 0 THEN '' ELSE 'c.jpg' END AS cover_path, p_retailprice * 10 AS duration,
  p_partkey % 4 AS num_tracks, p_partkey % 3 AS num_chapters, CASE WHEN p_size % 10 = 0 THEN p_partkey % 2 ELSE 0 END AS num_episodes, CASE WHEN p_partkey % 5 = 0 THEN 'epub' ELSE '' END AS ebook_format,
  string_split(p_name, ' ') AS tags, p_name AS title, CASE WHEN p_partkey % 9 = 0 THEN [] ELSE [p_brand] END AS authors, CASE WHEN p_partkey % 8 = 0 THEN [] ELSE ['Brand#' || (p_size % 25)] END AS narrators,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_brand END AS series, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_size::VARCHAR END AS sequence, [lower(p_type), string_split(p_name, ' ')[1]] AS genres,
  CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'B' || (p_partkey % 700) END AS asin, CASE WHEN p_partkey % 13 = 0 THEN '978-' || (p_partkey % 50) ELSE '' END AS isbn, (1950 + p_size)::VARCHAR AS published_year,
  CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_type END AS publisher, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'English' END AS language, p_partkey % 17 = 0 AS abridged, p_partkey % 19 = 0 AS explicit,
  length(p_name) + 5 * p_size AS said FROM part)"""


def _with(sql: str, *more: str) -> str:
    return "WITH " + ", ".join([_ITEM, *more]) + " " + sql


def _sessions(spark, sf_dir) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("s"), "event_id").alias("id"), F.concat(F.lit("u"), "user_id").alias("user_id"), F.concat(F.lit("p"), (c("event_id") % 97)).alias("item_id"), F.lit("").alias("episode_id"), c("value").alias("time_listening"), c("ts").cast("timestamp").alias("started_at"))


_SESSION = "session AS (SELECT 's' || event_id AS id, 'u' || user_id AS user_id, 'p' || (event_id % 97) AS item_id, value AS seconds, ts AS started_at FROM events)"


def _progress(spark, sf_dir) -> DataFrame:
    e = _read(spark, sf_dir, "events").where("value > 0").groupBy("user_id", (c("event_id") % 97).alias("item")).agg(F.max("event_id").alias("last"))
    return e.select(F.concat(F.lit("u"), "user_id").alias("user_id"), F.concat(F.lit("p"), "item").alias("item_id"), F.lit("").alias("episode_id"), (c("last") % 50).cast("double").alias("current_time"), ((c("last") % 50) / 50).alias("progress"), (c("last") % 5 == 0).alias("is_finished"), (c("last") % 7 == 0).alias("hidden"), c("last").alias("last_update"))


_PROGRESS = "progress AS (SELECT 'u' || user_id AS user_id, 'p' || item AS item_id, last % 50 AS now, last % 5 = 0 AS finished, last % 7 = 0 AS hidden, last FROM (SELECT user_id, event_id % 97 AS item, max(event_id) AS last FROM events WHERE value > 0 GROUP BY ALL))"


# ---- Checks, filters, facets, totals --------------------------------------------------------------

_CHECKS = {
    "unmatched": "media_type = 'book' AND asin = '' AND isbn = ''", "cover": "cover_path = ''", "narrator": "media_type = 'book' AND len(narrators) = 0", "series": "media_type = 'book' AND series IS NULL",
    "author": "len(authors) = 0", "publisher": "media_type = 'book' AND publisher = ''", "language": "language = ''", "chapters": "media_type = 'book' AND num_chapters = 0 AND duration >= 7200",
    "issues": "is_missing OR is_invalid", "no_audio": "media_type = 'book' AND num_tracks = 0", "no_episodes": "media_type = 'podcast' AND num_episodes = 0", "description": "said < 120",
}


@query(_with(" UNION ALL ".join(f"SELECT '{k}' AS \"check\", id, title FROM item WHERE {v}" for k, v in _CHECKS.items())))
def item_findings(spark, sf_dir):
    """Every check that applies to an item."""
    return predicates.findings(items(spark, sf_dir), list(_CHECKS)).select("check", "id", "title")


_FILTERS = {
    "genres:economy": "list_contains(genres, 'economy')", "tags:ring": "list_contains(tags, 'ring')", "authors:brand#2": "list_contains(list_transform(authors, lambda x: lower(x)), 'brand#2')",
    "series:no-series": "series IS NULL", "languages:English": "language = 'English'", "publishedDecades:1960": "published_year[:3] = '196'", "tracks:multi": "num_tracks > 1", "ebooks:no-ebook": "ebook_format = ''",
    "missing:asin": "asin = ''", "missing:cover": "cover_path = ''", "issues": "is_missing OR is_invalid", "abridged": "abridged", "explicit": "explicit",
    "progress:finished": "coalesce(finished, false)", "progress:in-progress": "coalesce(now, 0) > 0 AND NOT coalesce(finished, false)", "progress:not-started": "coalesce(now, 0) = 0",
}


@query(_with(" UNION ALL ".join(f"SELECT '{k}' AS filter, count(*) AS items, coalesce(sum(k), 0)::BIGINT AS keys FROM j WHERE {v}" for k, v in _FILTERS.items()), _PROGRESS, "j AS (SELECT item.*, p.now, p.finished FROM item LEFT JOIN (SELECT * FROM progress WHERE user_id = 'u1') p ON item_id = id)"))
def filter_language(spark, sf_dir):
    """Items that each filter leaves, with one user's progress, all in one pass."""
    rows = entities.with_progress(items(spark, sf_dir), _progress(spark, sf_dir), "u1").withColumn("k", F.substring("id", 2, 20).cast("long"))
    one = rows.agg(*[f for i, x in enumerate(_FILTERS) for f in (F.count_if(listing.where(x)).alias(f"n{i}"), F.coalesce(F.sum(F.when(listing.where(x), c("k"))), F.lit(0)).alias(f"k{i}"))])
    return one.select(F.explode(F.array(*[F.struct(F.lit(x).alias("filter"), c(f"n{i}").alias("items"), c(f"k{i}").alias("keys")) for i, x in enumerate(_FILTERS)])).alias("x")).select("x.*")


@query(_with("SELECT field, value, count(*) AS items FROM (SELECT DISTINCT id, 'tags' AS field, unnest(tags) AS value FROM item UNION ALL SELECT DISTINCT id, 'genres', unnest(genres) FROM item) GROUP BY ALL"))
def list_facets(spark, sf_dir):
    return listing.list_facets(items(spark, sf_dir), ["tags", "genres"])


@query(_with("SELECT (SELECT count(*) FROM item) AS items, (SELECT round(sum(duration), 2) FROM item) AS seconds, (SELECT sum(size)::BIGINT FROM item) AS bytes, (SELECT sum(num_tracks)::BIGINT FROM item) AS tracks, (SELECT count(DISTINCT a) FROM (SELECT unnest(authors) AS a FROM item)) AS authors, (SELECT count(DISTINCT a) FROM (SELECT unnest(genres) AS a FROM item)) AS genres"))
def catalogue_totals(spark, sf_dir):
    return listing.totals(items(spark, sf_dir)).withColumn("seconds", F.round("seconds", 2))


@query(_with("""SELECT id, title, CASE WHEN len(authors) > 0 THEN authors[1] ELSE '' END AS author, CASE WHEN series IS NULL THEN '' WHEN sequence = '' THEN series ELSE series || ' #' || sequence END AS series, round(duration)::BIGINT AS duration_s,
  CASE WHEN round(duration) >= 3600 THEN (round(duration)::BIGINT // 3600) || 'h ' || (round(duration)::BIGINT // 60 % 60) || 'm' WHEN round(duration) >= 60 THEN (round(duration)::BIGINT // 60) || 'm ' || (round(duration)::BIGINT % 60) || 's' ELSE round(duration)::BIGINT || 's' END AS length,
  CASE WHEN big >= 1073741824 THEN printf('%.1f GB', big / 1073741824) WHEN big >= 1048576 THEN round_even(big / 1048576, 0)::BIGINT || ' MB' WHEN big >= 1024 THEN round_even(big / 1024, 0)::BIGINT || ' KB' ELSE big || ' bytes' END AS bytes
  FROM (SELECT *, CASE k % 4 WHEN 0 THEN k WHEN 1 THEN size WHEN 2 THEN size * 1000 ELSE size * 100000 END AS big FROM item)"""))
def item_rows(spark, sf_dir):
    """Items as a listing shows them, from some bytes to many gigabytes."""
    k = F.substring("id", 2, 20).cast("long")
    rows = items(spark, sf_dir).withColumn("size", F.when(k % 4 == 0, k).when(k % 4 == 1, c("size")).when(k % 4 == 2, c("size") * 1000).otherwise(c("size") * 100_000))
    told = listing.summary(rows).join(rows.select("id", d.duration_text(c("duration")).alias("length"), d.bytes_text(c("size")).alias("bytes")), "id")
    return told.select("id", "title", "author", F.coalesce(F.get("series", F.lit(0)), F.lit("")).alias("series"), "duration_s", "length", "bytes")


# ---- Vocabularies ---------------------------------------------------------------------------------

_SECTIONS = """rows AS (SELECT id, k, 'genres' AS field, unnest(list_distinct(genres)) AS value, genres FROM item UNION ALL SELECT id, k, 'tags', unnest(list_distinct(tags)), genres FROM item),
hits AS (SELECT 'redundant' AS section, field, value, id, k FROM rows WHERE field = 'tags' AND list_contains(list_transform(genres, lambda g: lower(g)), lower(value))
 UNION ALL SELECT 'narrow', field, value, id, k FROM rows WHERE field = 'genres' AND value IN (SELECT value FROM rows WHERE field = 'genres' GROUP BY 1 HAVING count(*) < 300)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY section, field, value ORDER BY k, id) AS r, count(*) OVER (PARTITION BY section, field, value) AS items FROM hits)"""


@query(_with("SELECT section, field, value, items, string_agg(id, ',' ORDER BY r) AS refs FROM ranked WHERE r <= 3 GROUP BY ALL", _SECTIONS))
def genre_findings(spark, sf_dir):
    """Redundant tags and narrow genres, with three items each."""
    return vocabulary.genre_findings(items(spark, sf_dir), least=300).select("section", "field", "value", "items", F.array_join("refs", ",").alias("refs"))


@query(_with("""SELECT name, n_wrote, n_read_only FROM (SELECT name, count(DISTINCT id) AS n_wrote FROM w GROUP BY 1) JOIN (SELECT name, count(DISTINCT id) AS n_read_only FROM r WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.name = r.name AND w.id = r.id) GROUP BY 1) USING (name)""",
    "w AS (SELECT id, replace(lower(unnest(authors)), '#', '') AS name FROM item)", "r AS (SELECT id, replace(lower(unnest(narrators)), '#', '') AS name FROM item)"))
def person_roles(spark, sf_dir):
    """Names that write some items and only read others."""
    return vocabulary.roles(items(spark, sf_dir)).select("name", "n_wrote", "n_read_only")


@query("WITH v AS (SELECT p_name AS value, count(*) AS items FROM part GROUP BY 1 UNION ALL SELECT upper(p_name), 1 FROM part WHERE p_partkey < 100 GROUP BY p_name), s AS (SELECT lower(value) AS key, value, sum(items)::BIGINT AS items FROM v GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY items DESC, value) AS place FROM s) SELECT key, 'spelling' AS kind, max(value) FILTER (place = 1) AS keep, count(*)::INT AS spellings, sum(items)::BIGINT AS items FROM r GROUP BY key HAVING count(*) > 1")
def spelling_groups(spark, sf_dir):
    """Names in more than one spelling: some are put in capitals."""
    p = _read(spark, sf_dir, "part")
    values = p.groupBy(c("p_name").alias("value")).agg(F.count(F.lit(1)).alias("items")).unionByName(p.where("p_partkey < 100").select(F.upper("p_name").alias("value")).distinct().withColumn("items", F.lit(1).cast("long")))
    g = vocabulary.spelling_groups(vocabulary.spellings(values, "tags"), "tags")
    return g.select("key", "kind", "keep", F.size("spellings").alias("spellings"), F.aggregate("spellings", F.lit(0).cast("long"), lambda s, x: s + x["items"]).alias("items"))


# ---- Series ---------------------------------------------------------------------------------------

_NUMBERED = "placed AS (SELECT id, library_id, title, duration, series AS name, replace(lower(series), '#', '') AS key, sequence, try_cast(sequence AS DOUBLE) AS n, CASE WHEN len(authors) > 0 THEN authors[1] ELSE '' END AS author FROM item WHERE series IS NOT NULL)"


@query(_with("SELECT library_id, key, name, count(DISTINCT id) AS books, round(sum(duration), 2) AS seconds, min(nullif(author, '')) AS author, array_to_string(list_transform(list_sort(list(DISTINCT n) FILTER (sequence <> '')), lambda x: x::INT::VARCHAR), ',') AS sequences FROM placed GROUP BY ALL", _NUMBERED))
def series_listing(spark, sf_dir):
    return entities.series_rows(items(spark, sf_dir)).select("library_id", "key", "name", "books", F.round("seconds", 2).alias("seconds"), "author", F.array_join("sequences", ",").alias("sequences"))


@query(_with("SELECT key, id, sequence, row_number() OVER (PARTITION BY key ORDER BY n NULLS LAST, sequence, title, id)::INT AS place FROM placed", _NUMBERED))
def series_books(spark, sf_dir):
    return entities.series_books(items(spark, sf_dir)).select("key", "id", "sequence", "place")


@query(_with("SELECT library_id, name, count(DISTINCT id) AS books FROM placed WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_brand = name AND p_brand < 'Brand#2' AND 'l' || (p_size % 3) = library_id) GROUP BY ALL", _NUMBERED))
def unlisted_series(spark, sf_dir):
    """Series that items name but a listing lacks, which has some brands of each library."""
    listed = _read(spark, sf_dir, "part").where("p_brand < 'Brand#2'").select(F.concat(F.lit("l"), c("p_size") % 3).alias("library_id"), c("p_brand").alias("name")).distinct()
    return entities.unlisted_series(items(spark, sf_dir), listed).select("library_id", "name", "books")


@query(_with("SELECT key, string_agg(x::INT::VARCHAR, ',' ORDER BY x) AS missing FROM (SELECT key, unnest(list_filter(range(min(n)::INT, max(n)::INT), lambda y: NOT list_contains(list(n::INT), y))) AS x FROM placed WHERE n IS NOT NULL GROUP BY key HAVING count(DISTINCT id) > 1) GROUP BY key", _NUMBERED))
def series_gaps(spark, sf_dir):
    return series.gaps(items(spark, sf_dir)).where(F.size("missing") > 0).select("key", F.array_join(F.array_sort("missing"), ",").alias("missing"))


@query(_with("SELECT id, 'padding' AS problem, series || ' #' || lpad(sequence, 2, '0') AS suggest FROM item WHERE series IS NOT NULL AND sequence <> '' AND length(sequence) < 2 UNION ALL SELECT id, 'unnumbered', series || ' #' || lpad(place::VARCHAR, 2, '0') FROM item WHERE series IS NOT NULL AND sequence = '' UNION ALL SELECT id, 'unlinked', brand || ' #' || lpad(place::VARCHAR, 2, '0') FROM item JOIN (SELECT 'p' || p_partkey AS id, p_brand AS brand FROM part) USING (id) WHERE series IS NULL"))
def series_numbering(spark, sf_dir):
    """Places that aren't padded, are in the folder alone, or whose series isn't linked."""
    return series.numbering(items(spark, sf_dir)).where("problem in ('padding', 'unnumbered', 'unlinked')").select("id", "problem", "suggest")


# ---- Files, chapters, episodes --------------------------------------------------------------------

_FILE = "file AS (SELECT l_orderkey::VARCHAR AS item_id, l_linenumber AS idx, l_quantity AS duration, 'f' || l_partkey || '.mp3' AS filename, l_suppkey AS size FROM lineitem)"


def _files(spark, sf_dir) -> DataFrame:
    n = _read(spark, sf_dir, "lineitem")
    made = n.select(c("l_orderkey").cast("string").alias("item_id"), c("l_linenumber").cast("int").alias("idx"), c("l_quantity").alias("duration"), F.lit("mp3").alias("codec"), F.lit(False).alias("exclude"), F.lit("").alias("error"), F.concat(F.lit("f"), "l_partkey", F.lit(".mp3")).alias("filename"), F.lit(".mp3").alias("ext"), c("l_suppkey").alias("size"), F.lit("").alias("mime"), F.lit(None).cast("map<string,string>").alias("tags"))
    return made


@query(f"WITH {_FILE} SELECT item_id, idx, filename, size, duration, coalesce(sum(duration) OVER (PARTITION BY item_id ORDER BY idx, filename, size, duration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_offset FROM file")
def play_order(spark, sf_dir):
    """Where each file starts."""
    return catalog.play_order(_files(spark, sf_dir)).select("item_id", "idx", "filename", "size", "duration", "start_offset")


@query(f"WITH {_FILE}, k AS (SELECT item_id, count(*) AS n, sum(duration) AS s, list_sort(list(filename || ':' || size)) AS content FROM file GROUP BY 1), a AS (SELECT * FROM k WHERE item_id::INT % 2 = 0), b AS (SELECT * FROM k WHERE item_id::INT % 2 = 1) SELECT a.item_id AS old_id, b.item_id AS new_id, 'same files' AS how FROM a JOIN b ON a.content = b.content AND abs(a.s - b.s) <= 30 UNION ALL SELECT a.item_id, b.item_id, 'renamed' FROM a JOIN b ON a.n = 1 AND b.n = 1 AND string_split(a.content[1], ':')[2] = string_split(b.content[1], ':')[2] AND abs(a.s - b.s) <= 1 AND a.content <> b.content")
def relinked_records(spark, sf_dir):
    """Orders with an even number as records that are gone, those with an odd one as what may hold the same files."""
    key = duplicates.content_key(_files(spark, sf_dir))
    even = c("item_id").cast("int") % 2 == 0
    return duplicates.relinked(key.where(even), key.where(~even)).select("old_id", "new_id", "how")


@query("""WITH l AS (SELECT l_orderkey AS k, l_quantity AS s, l_quantity + 30.0 AS e, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS i FROM lineitem),
b AS (SELECT *, s <= lag(s) OVER w OR lag(e) OVER w > s + 1 AS bad FROM l WINDOW w AS (PARTITION BY k ORDER BY i)), d AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 0 THEN 8000.0 ELSE 100.0 + o_orderkey % 200 - CASE WHEN o_orderkey % 9 = 0 THEN 90 ELSE 0 END END AS whole FROM orders),
g AS (SELECT k, whole, count(*) AS n, count(*) FILTER (s >= whole) AS past, max(e) AS last, count(*) FILTER (bad) AS bads, min(i) FILTER (bad) AS first FROM d JOIN b USING (k) WHERE whole > 0 GROUP BY ALL)
SELECT k::VARCHAR AS id, 'past_end' AS problem, CASE WHEN past > 0 THEN past || ' of ' || n || ' chapters start at or past the end' ELSE 'the last chapter ends ' || printf('%.1f', last - whole) || 's past the end' END AS detail FROM g WHERE past > 0 OR last > whole + 5
UNION ALL SELECT k::VARCHAR, 'out_of_order', 'chapter ' || first || ' of ' || bads || ' out of place' FROM g WHERE bads > 0
UNION ALL SELECT k::VARCHAR, 'short', printf('%.1f', whole - last) || 's of audio after the last chapter' FROM g WHERE whole - last > 60 AND whole - last > 0.01 * whole
UNION ALL SELECT k::VARCHAR, 'single', 'one chapter over the whole' FROM g WHERE n = 1 AND whole >= 7200""")
def chapter_ends(spark, sf_dir):
    """All that can be wrong with chapters: past the end, out of order, much audio left out, one for a long book."""
    k = c("o_orderkey")
    whole = F.when(k % 10 == 0, 8000.0).otherwise(F.lit(100.0) + k % 200 - F.when(k % 9 == 0, 90).otherwise(0))
    o = _read(spark, sf_dir, "orders").select(k.cast("string").alias("id"), F.lit("t").alias("title"), F.lit("book").alias("media_type"), whole.alias("duration"))
    ch = _read(spark, sf_dir, "lineitem").select(c("l_orderkey").cast("string").alias("item_id"), c("l_linenumber").alias("pos"), F.lit("c").alias("title"), c("l_quantity").alias("start"), (c("l_quantity") + 30.0).alias("end"))
    return chapters.problems(o, ch).select("id", "problem", "detail")


@query("WITH f AS (SELECT event_id, 'g' || (event_id % 500) AS guid, 'http://h/' || (event_id % 300) AS url FROM events WHERE event_type = 'click'), h AS (SELECT event_id, 'g' || (event_id % 700) AS guid, 'http://h/' || (event_id % 900) AS url FROM events WHERE event_type = 'error' AND event_id % 20 = 0) SELECT event_id AS id FROM f WHERE guid NOT IN (SELECT guid FROM h) AND url NOT IN (SELECT url FROM h) AND url NOT IN (SELECT 'http://h/' || range FROM range(0, 40))")
def episodes_to_download(spark, sf_dir):
    """Feed rows that are neither held nor queued."""
    e = _read(spark, sf_dir, "events")
    one = lambda g, u: [F.lit("i").alias("item_id"), c("event_id").alias("id"), F.concat(F.lit("g"), c("event_id") % g).alias("guid"), F.concat(F.lit("http://h/"), c("event_id") % u).alias("url")]
    queue = spark.range(40).select(F.lit("i").alias("item_id"), F.concat(F.lit("http://h/"), "id").alias("url"))
    return files.to_download(e.where("event_type = 'click'").select(*one(500, 300)), e.where("event_type = 'error' and event_id % 20 = 0").select(*one(700, 900)), queue).select("id")


# ---- Matching and changes -------------------------------------------------------------------------

_RECORDS = """rec AS (SELECT id, place % 2 AS source, CASE WHEN k % 4 = 0 THEN title || ' (Unabridged)' WHEN k % 4 = 1 THEN upper(title) ELSE 'zz other' END AS p_title, CASE WHEN k % 5 = 0 THEN '' ELSE coalesce(series, 'Brand#1') END AS p_author, duration / 60 * CASE WHEN k % 3 = 0 THEN 1.2 ELSE 1.001 END AS p_minutes FROM item),
scored AS (SELECT item.id, CASE WHEN k % 4 IN (0, 1) THEN 2 ELSE 0 END AS title_level, len(authors) = 0 OR p_author = '' OR lower(authors[1]) = lower(p_author) AS author_ok, (p_minutes * 60 - duration) / duration AS delta FROM item JOIN rec USING (id))"""


@query(_with("SELECT id, title_level, author_ok, CASE WHEN abs(delta) <= 0.03 THEN 'same' ELSE 'off' END AS length, CASE WHEN title_level = 0 OR NOT author_ok THEN 'unsure' WHEN abs(delta) > 0.03 THEN 'edition' ELSE 'exact' END AS confidence FROM scored", _RECORDS))
def match_scores(spark, sf_dir):
    """Items held against a record each: titles with an edition or in capitals, other titles, lengths a fifth off."""
    i = items(spark, sf_dir).withColumn("k", F.substring("id", 2, 20).cast("long"))
    theirs = F.coalesce(F.get("series", F.lit(0))["name"], F.lit("Brand#1"))
    pairs = i.select(
        "id", "title", "authors", F.array().cast("array<string>").alias("narrators"), "duration", F.when(c("k") % 4 == 0, F.concat("title", F.lit(" (Unabridged)"))).when(c("k") % 4 == 1, F.upper("title")).otherwise("zz other").alias("p_title"),
        F.when(c("k") % 5 == 0, "").otherwise(theirs).alias("p_author"), F.lit("").alias("p_narrator"), (c("duration") / 60 * F.when(c("k") % 3 == 0, 1.2).otherwise(1.001)).alias("p_minutes"),
    )
    return matching.score(pairs).select("id", "title_level", "author_ok", "length", "confidence")


@query(_with("SELECT id, 'publisher' AS field, publisher AS ours, 'Other House' AS theirs FROM item WHERE k % 2 = 0 UNION ALL SELECT id, 'authors', array_to_string(authors, ', '), 'Somebody' FROM item WHERE k % 3 = 0"))
def record_diffs(spark, sf_dir):
    """What records say otherwise than items."""
    i = items(spark, sf_dir).withColumn("k", F.substring("id", 2, 20).cast("long"))
    rows = i.select("id", "publisher", "authors", F.when(c("k") % 2 == 0, "Other House").otherwise("").alias("p_publisher"), F.when(c("k") % 3 == 0, F.array(F.lit("Somebody"))).otherwise(F.array().cast("array<string>")).alias("p_authors"))
    return matching.field_diffs(rows)


@query(_with("SELECT id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS after FROM (SELECT id, flatten(list_transform(tags, lambda x: CASE WHEN x = 'ring' THEN ['band', 'loop'] ELSE [x] END)) AS l FROM item WHERE list_contains(tags, 'ring'))"))
def split_tags(spark, sf_dir):
    """One tag split into two in its place, wherever it stands and however often."""
    return changes.split(items(spark, sf_dir), "tags", "ring", ["band", "loop"]).select("id", F.array_join("after", " ").alias("after"))


@query(_with("SELECT id, array_to_string(list_filter(tags, lambda x: x <> 'ring'), ' ') AS tags, array_to_string(list_concat(genres, CASE WHEN list_contains(genres, 'ring') THEN [] ELSE ['ring'] END), ' ') AS genres FROM item WHERE list_contains(tags, 'ring')"))
def moved_tags(spark, sf_dir):
    """A tag moved to the genres."""
    return entities.moved_values(items(spark, sf_dir), "ring", "tags", "genres").select("id", F.array_join("tags", " ").alias("tags"), F.array_join("genres", " ").alias("genres"))


# ---- Lists and users ------------------------------------------------------------------------------

_LISTS = """held AS (SELECT o_custkey AS list_id, o_orderkey AS item_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS pos FROM orders WHERE o_orderstatus <> 'P'),
adds AS (SELECT o_custkey AS list_id, o_orderkey AS item_id, o_orderkey AS pos FROM orders WHERE o_orderkey % 5 = 0), drops AS (SELECT o_custkey AS list_id, o_orderkey AS item_id FROM orders WHERE o_orderkey % 7 = 0)"""


def _lists(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    from pyspark.sql import Window

    o = _read(spark, sf_dir, "orders").select(c("o_custkey").alias("list_id"), c("o_orderkey").alias("item_id"), "o_orderstatus", "o_orderdate")
    w = Window.partitionBy("list_id").orderBy("o_orderdate", "item_id")
    held = o.where("o_orderstatus <> 'P'").withColumn("pos", F.row_number().over(w) - 1).select("list_id", "item_id", "pos")
    return held, o.where("item_id % 5 = 0").select("list_id", "item_id", c("item_id").alias("pos")), o.where("item_id % 7 = 0").select("list_id", "item_id")


@query(f"WITH {_LISTS}, s AS (SELECT list_id, item_id, (item_id % 5 = 0) AS a, (item_id % 7 = 0) AS r, EXISTS (SELECT 1 FROM held h WHERE h.item_id = x.item_id) AS h FROM (SELECT o_custkey AS list_id, o_orderkey AS item_id FROM orders) x) SELECT CASE WHEN a AND r THEN 'both' WHEN a AND h THEN 'already_held' WHEN a THEN 'added' WHEN h THEN 'removed' ELSE 'not_held' END AS outcome, count(*) AS n FROM s WHERE a OR r GROUP BY 1")
def list_outcomes(spark, sf_dir):
    """What adding and taking out of customers' lists of orders would do."""
    return entities.list_edit(*_lists(spark, sf_dir))[1].groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_LISTS}, kept AS (SELECT list_id, item_id, 0 AS new, pos FROM held WHERE item_id % 7 <> 0 OR item_id % 5 = 0), more AS (SELECT list_id, item_id, 1, pos FROM adds WHERE item_id % 7 <> 0 AND item_id NOT IN (SELECT item_id FROM held)) SELECT list_id, item_id, (row_number() OVER (PARTITION BY list_id ORDER BY new, pos, item_id) - 1)::INT AS pos FROM (SELECT * FROM kept UNION ALL SELECT * FROM more)")
def edited_lists(spark, sf_dir):
    """The lists as they are then."""
    return entities.list_edit(*_lists(spark, sf_dir))[0]


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END AS status FROM orders UNION ALL SELECT -1 - n_nationkey, 'X' FROM nation")
def upserted_rows(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select(c("o_orderkey").alias("k"), c("o_orderstatus").alias("status"))
    new = o.where("k % 4 = 0").select("k", F.lit("X").alias("status")).unionByName(_read(spark, sf_dir, "nation").select((-1 - c("n_nationkey")).cast("long").alias("k"), F.lit("X").alias("status")))
    return entities.upsert(o, new, ["k"])


@query(_with("SELECT user_id, item_id, title, round(now * 2)::INT AS percent, r::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last DESC, item_id) AS r FROM progress WHERE NOT finished AND NOT hidden AND now > 0) JOIN item ON id = item_id WHERE r <= 5", _PROGRESS))
def in_progress(spark, sf_dir):
    return entities.in_progress(_progress(spark, sf_dir), items(spark, sf_dir), 5).select("user_id", "item_id", "title", "percent", "place")


@query(f"WITH {_PROGRESS} SELECT user_id AS id, count(*) FILTER (finished) AS finished, count(*) FILTER (NOT finished AND now > 0) AS in_progress, string_agg(item_id, ',' ORDER BY r) FILTER (r <= 3) AS newest FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last DESC, item_id) AS r FROM progress) GROUP BY 1")
def accounts(spark, sf_dir):
    p = _progress(spark, sf_dir)
    return entities.accounts(p.select(c("user_id").alias("id")).distinct(), p, 3).select("id", "finished", "in_progress", F.array_join(F.transform("newest", lambda x: x["item_id"]), ",").alias("newest"))


@query(f"WITH {_SESSION} SELECT user_id, item_id, round(s, 4) AS seconds, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, item_id) AS place FROM (SELECT user_id, item_id, sum(seconds) AS s FROM session GROUP BY ALL)) WHERE place <= 3")
def top_listened(spark, sf_dir):
    return entities.top_listened(_sessions(spark, sf_dir), 3).select("user_id", "item_id", F.round("seconds", 4).alias("seconds"), "place")


@query(f"WITH {_SESSION} SELECT user_id, month(started_at)::INT AS month, round(sum(seconds), 4) AS seconds, count(*) AS sessions, count(DISTINCT item_id) AS items, count(DISTINCT started_at::DATE) AS days FROM session WHERE year(started_at) = 2024 GROUP BY ALL")
def year_review(spark, sf_dir):
    return entities.year_review(_sessions(spark, sf_dir), 2024).withColumn("seconds", F.round("seconds", 4))


@query(f"WITH {_SESSION} SELECT id, started_at::VARCHAR AS at, (SELECT count(*) FROM session) AS all_time FROM session WHERE started_at >= TIMESTAMP '2024-01-25 00:00:00' ORDER BY started_at DESC, id LIMIT 25")
def listening_history(spark, sf_dir):
    """The newest sessions of the last ten days before a day."""
    out = entities.history(_sessions(spark, sf_dir), F.lit("2024-02-04 00:00:00").cast("timestamp"), 10, 25)
    return out.select("id", F.regexp_replace(c("started_at").cast("timestamp_ntz").cast("string"), r"\.?0+$", "").alias("at"), "all_time").withColumn("at", c("at").cast("string"))


@query("SELECT 'supplier' AS kind, s_suppkey::VARCHAR AS id, s_name AS name FROM (SELECT *, row_number() OVER (ORDER BY s_name, s_suppkey::VARCHAR) AS r FROM supplier WHERE contains(lower(s_name), '00001')) WHERE r <= 10")
def name_search(spark, sf_dir):
    rows = _read(spark, sf_dir, "supplier").select(c("s_suppkey").cast("string").alias("id"), "s_name")
    return entities.named(rows, "00001", {"supplier": "s_name"}).select("kind", "id", "name")


@query("SELECT s_suppkey::VARCHAR AS id, CASE WHEN s_acctbal < 0 THEN 'no_books' WHEN s_suppkey % 4 = 0 THEN 'unmatched' WHEN s_suppkey % 3 = 0 THEN 'no_photo' END AS problem FROM supplier WHERE s_acctbal < 0 OR s_suppkey % 4 = 0 OR s_suppkey % 3 = 0")
def author_problems(spark, sf_dir):
    """Suppliers as author records."""
    k = c("s_suppkey")
    rows = _read(spark, sf_dir, "supplier").select(k.cast("string").alias("id"), c("s_name").alias("name"), F.when(k % 4 == 0, "").otherwise("A").alias("asin"), F.lit("").alias("description"), F.when(k % 3 == 0, "").otherwise("p").alias("image_path"), F.when(c("s_acctbal") < 0, 0).otherwise(5).alias("num_books"))
    return vocabulary.author_records(rows).select("id", "problem")


@query(_with("SELECT id, CASE WHEN cover_path = '' THEN 'missing' WHEN abs((300 + k % 500) / 600.0 - 1) > 0.1 THEN 'ratio' ELSE 'small' END AS problem FROM item WHERE cover_path = '' OR abs((300 + k % 500) / 600.0 - 1) > 0.1 OR least(300 + k % 500, 600) < 560"))
def cover_problems(spark, sf_dir):
    i = items(spark, sf_dir)
    sizes = i.select(c("id").alias("item_id"), (F.lit(300) + F.substring("id", 2, 20).cast("long") % 500).alias("width"), F.lit(600).alias("height"))
    return files.cover_problems(i, sizes, least=560)


@query("SELECT l_orderkey AS k, l_linenumber AS n, CASE l_linenumber % 4 WHEN 0 THEN '.m4b' WHEN 1 THEN '.mp3' WHEN 2 THEN '.opus' ELSE '.xyz' END AS ext, l_linenumber % 4 IN (0, 3) OR (l_linenumber % 4 = 1 AND l_returnflag = 'A') OR l_linenumber % 4 = 2 AND l_returnflag <> 'R' AS probe FROM lineitem")
def probes(spark, sf_dir):
    """Which files' headers must be read."""
    n = c("l_linenumber") % 4
    ext = F.when(n == 0, ".m4b").when(n == 1, ".mp3").when(n == 2, ".opus").otherwise(".xyz")
    codec = F.when(c("l_returnflag") == "A", "aac").when((c("l_returnflag") == "N") & (n == 2), "vorbis").when(n == 2, "opus").otherwise("mp3")
    return _read(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("k"), c("l_linenumber").alias("n"), ext.alias("ext"), files.needs_probe(ext, codec).alias("probe"))


@query(_with("SELECT id, asin FROM item WHERE asin <> '' AND asin IN (SELECT asin FROM item WHERE media_type <> 'podcast' GROUP BY 1 HAVING count(*) > 1) AND media_type <> 'podcast'"))
def asin_copies(spark, sf_dir):
    """Items of one asin are in one group, whatever else they say."""
    i = items(spark, sf_dir).select(*[F.lit("").alias(x) if x in ("title", "isbn") else c(x) for x in catalog.schema("item").names])
    return duplicates.groups(i).join(i.select("id", "asin"), "id").select("id", "asin")
