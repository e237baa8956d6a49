"""Queries of decisions, readings, splits, providers and audits over records derived from the supplied tables, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.catalogue_queries import _CHECKS, _ITEM, _read, items
from curatrix.functions.pictures import picture_size
from curatrix.operators import duplicates, entities, merging, providers, readings, recordings, smart
from curatrix.operators.rows import spread
from curatrix.plans.audit_all import audit_all, postings
from curatrix.sources import catalog
from curatrix.sources.storage import written

c = F.col
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- Smart matches --------------------------------------------------------------------------------


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts beside a record each: file names, series, capitals and notes as titles, companies and authors as readers, stubs, timestamps."""
    k = "k"
    base = items(spark, sf_dir).withColumns({"k": F.substring("id", 2, 20).cast("long"), "place": F.substring("published_year", 1, 4).cast("int") - 1950, "name": c("title")})
    brand = F.expr("element_at(split(rel_path, '/'), 1)")
    one = lambda **made: base.withColumns(made)
    base = one(brand=brand)
    ours = {
        "title": f"CASE {k} % 7 WHEN 0 THEN name || '.mp3' WHEN 1 THEN brand WHEN 2 THEN upper(name) WHEN 3 THEN name || ' (Unabridged)' ELSE name END", "subtitle": f"CASE {k} % 4 WHEN 0 THEN '' WHEN 1 THEN 'Book 3' WHEN 2 THEN 'a tale' ELSE 'vol 2' END",
        "narrators": f"CASE {k} % 8 WHEN 0 THEN array() WHEN 1 THEN array('Acme Audio') WHEN 2 THEN array(brand) WHEN 3 THEN array('Jane Roe') ELSE array('Bo Lind') END", "genres": f"CASE {k} % 5 WHEN 0 THEN array('Audiobook') WHEN 1 THEN array() ELSE genres END",
        "published_year": f"CASE WHEN {k} % 6 = 0 THEN published_year || '-05-02' ELSE published_year END", "description": f"CASE WHEN {k} % 10 = 0 THEN '' ELSE description END",
    }
    theirs = {
        "p_title": f"CASE {k} % 5 WHEN 1 THEN 'zz other' WHEN 2 THEN name || ': a tale' WHEN 3 THEN '' ELSE name END", "p_subtitle": f"CASE {k} % 3 WHEN 0 THEN 'another tale' WHEN 1 THEN 'Volume 9' ELSE '' END",
        "p_author": f"CASE {k} % 6 WHEN 0 THEN brand WHEN 1 THEN 'Dr. ' || brand WHEN 2 THEN brand || ', Jane Roe' WHEN 3 THEN 'Jane Roe' WHEN 4 THEN '' ELSE brand || ', Al Poe - translator' END", "p_narrator": f"CASE {k} % 3 WHEN 0 THEN 'Jane Roe' WHEN 1 THEN 'J. Roe' ELSE '' END",
        "p_series": f"CASE {k} % 4 WHEN 0 THEN array(named_struct('series', brand, 'sequence', cast(place AS string))) WHEN 1 THEN array(named_struct('series', 'The ' || brand || ' Series', 'sequence', cast(place + 1 AS string))) WHEN 2 THEN array() ELSE array(named_struct('series', 'Other', 'sequence', '1')) END",
        "p_genres": f"CASE WHEN {k} % 2 = 0 THEN array('Verse') ELSE array() END", "p_publisher": f"CASE {k} % 3 WHEN 0 THEN 'New House' WHEN 1 THEN lower(p_type) ELSE '' END", "p_published_year": f"CASE WHEN {k} % 2 = 0 THEN '2020' ELSE '' END",
        "p_language": f"CASE WHEN {k} % 2 = 0 THEN 'en' ELSE 'english' END", "p_description": f"repeat('x', cast({k} % 200 + 1 AS int))", "p_asin": "''", "p_isbn": "''",
    }
    # the pairs are dealt after the join, which may be made where the table is one file
    kind = _read(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), "p_type")
    return spread(base.join(kind, "id"), "id").withColumns({n: F.expr(e) for n, e in (ours | theirs).items()})


_DECIDED = (
    "WITH " + _ITEM + """,
j AS (SELECT id, k, place, p_brand AS brand, p_name AS name, p_type AS kind, authors, series, sequence, publisher, language FROM item JOIN part ON p_partkey = k),
a AS (SELECT *, CASE k % 7 WHEN 0 THEN name || '.mp3' WHEN 1 THEN brand WHEN 2 THEN upper(name) WHEN 3 THEN name || ' (Unabridged)' ELSE name END AS title, CASE k % 5 WHEN 1 THEN 'zz other' WHEN 2 THEN name || ': a tale' WHEN 3 THEN '' ELSE name END AS p_title,
  CASE WHEN k % 10 = 0 THEN '' ELSE '<p>' || name || '</p> ' || repeat('word ', place) END AS description, k % 200 + 1 AS p_size, (1950 + place)::VARCHAR || CASE WHEN k % 6 = 0 THEN '-05-02' ELSE '' END AS year FROM j),
d AS (
SELECT id, 'title' AS field, CASE WHEN k % 7 IN (0, 3) THEN 'written' WHEN k % 7 = 1 AND series IS NOT NULL THEN 'written' WHEN k % 5 = 2 AND k % 7 <> 1 THEN 'written' ELSE 'review' END AS action, p_title AS theirs FROM a
  WHERE p_title <> '' AND (k % 7 IN (0, 1, 3) OR k % 5 IN (1, 2))
UNION ALL SELECT id, 'subtitle', CASE WHEN k % 4 = 0 THEN 'filled' WHEN k % 4 IN (1, 3) AND k % 3 = 0 THEN 'written' ELSE 'review' END, CASE k % 3 WHEN 0 THEN 'another tale' ELSE 'Volume 9' END FROM a WHERE k % 3 < 2
UNION ALL SELECT id, 'authors', CASE WHEN k % 9 = 0 THEN 'filled' WHEN k % 6 IN (1, 5) THEN 'kept' ELSE 'review' END, CASE k % 6 WHEN 0 THEN brand WHEN 1 THEN 'Dr. ' || brand WHEN 2 THEN brand || ', Jane Roe' WHEN 3 THEN 'Jane Roe' ELSE brand || ', Al Poe - translator' END FROM a
  WHERE k % 6 <> 4 AND (k % 9 = 0 OR k % 6 <> 0)
UNION ALL SELECT id, 'narrators', CASE k % 8 WHEN 0 THEN 'filled' WHEN 1 THEN 'written' WHEN 2 THEN CASE WHEN k % 9 = 0 THEN 'review' ELSE 'written' END WHEN 3 THEN 'kept' ELSE 'review' END, CASE k % 3 WHEN 0 THEN 'Jane Roe' ELSE 'J. Roe' END FROM a WHERE k % 3 < 2 AND NOT (k % 8 = 3 AND k % 3 = 0)
UNION ALL SELECT id, 'series', CASE WHEN series IS NULL THEN 'filled' WHEN k % 4 = 1 AND sequence <> '' THEN 'review' ELSE 'kept' END, CASE k % 4 WHEN 0 THEN brand || ' #' || place WHEN 1 THEN 'The ' || brand || ' Series #' || (place + 1) ELSE 'Other #1' END FROM a
  WHERE k % 4 <> 2 AND NOT (k % 4 = 0 AND series IS NOT NULL AND sequence <> '')
UNION ALL SELECT id, 'genres', CASE k % 5 WHEN 0 THEN 'written' WHEN 1 THEN 'filled' ELSE 'kept' END, 'Verse' FROM a WHERE k % 2 = 0
UNION ALL SELECT id, 'publisher', CASE WHEN publisher = '' THEN 'filled' ELSE 'written' END, CASE k % 3 WHEN 0 THEN 'New House' ELSE lower(kind) END FROM a WHERE k % 3 = 0 OR (k % 3 = 1 AND publisher = '')
UNION ALL SELECT id, 'year', CASE WHEN k % 6 = 0 THEN 'written' ELSE 'kept' END, '2020' FROM a WHERE k % 2 = 0
UNION ALL SELECT id, 'language', CASE WHEN language = '' THEN 'filled' ELSE 'written' END, CASE WHEN k % 2 = 0 THEN 'en' ELSE 'english' END FROM a WHERE k % 2 = 0 OR language = ''
UNION ALL SELECT id, 'description', CASE WHEN description = '' THEN 'filled' ELSE 'written' END, p_size || ' characters' FROM a WHERE strlen(trim(description)) < 120 AND p_size > strlen(trim(description)))
"""
)


@query(_DECIDED + "SELECT * FROM d")
def smart_decisions(spark, sf_dir):
    """Each field that a record says otherwise, and what is done about it."""
    return smart.decisions(_matched(spark, sf_dir)).select("id", "field", "action", "theirs")


@query(_DECIDED + "SELECT field, action, count(*) AS n FROM d GROUP BY ALL")
def decision_counts(spark, sf_dir):
    return entities.decision_tally(smart.decisions(_matched(spark, sf_dir)))


@query(_DECIDED + """SELECT id, max(theirs) FILTER (field = 'title') AS title, max(theirs) FILTER (field = 'narrators') AS narrators, max(theirs) FILTER (field = 'genres') AS genres, max(theirs) FILTER (field = 'publisher') AS publisher,
  max(theirs) FILTER (field = 'year') AS year, max(theirs) FILTER (field = 'language') AS language, max(theirs) FILTER (field = 'description') AS description FROM d WHERE action = 'written' GROUP BY id""")
def smart_updates(spark, sf_dir):
    """What is written to each item, of those that anything is written to."""
    new = smart.updates(_matched(spark, sf_dir))
    told = F.when(c("new_description").isNotNull(), F.concat(F.octet_length("new_description").cast("string"), F.lit(" characters")))
    return new.select("id", c("new_title").alias("title"), F.array_join("new_narrators", ", ").alias("narrators"), F.array_join("new_genres", ", ").alias("genres"), c("new_publisher").alias("publisher"), c("new_published_year").alias("year"), c("new_language").alias("language"), told.alias("description"))


# ---- Audits ---------------------------------------------------------------------------------------


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with names that audits have something to say about: spaces, capitals, slips, placeholders, odd languages."""
    k = F.substring("id", 2, 20).cast("long")
    return items(spark, sf_dir, dealt=True).withColumns({
        "title": F.when(k % 23 == 0, F.concat(F.lit(" "), "title")).when(k % 29 == 0, F.lit("Unknown")).otherwise(c("title")),
        "publisher": F.when(k % 31 == 0, F.upper("publisher")).otherwise(c("publisher")), "language": F.when(k % 37 == 0, "Klingon").otherwise(c("language")),
        "genres": F.when(k % 41 == 0, F.array(F.lit("Audiobook"))).otherwise(c("genres")),
    })


_AUDITED = """, i AS (SELECT item.* REPLACE (CASE WHEN k % 23 = 0 THEN ' ' || title WHEN k % 29 = 0 THEN 'Unknown' ELSE title END AS title, CASE WHEN k % 31 = 0 THEN upper(publisher) ELSE publisher END AS publisher,
  CASE WHEN k % 37 = 0 THEN 'Klingon' ELSE language END AS language, CASE WHEN k % 41 = 0 THEN ['Audiobook'] ELSE genres END AS genres) FROM item)"""
_CHECKED = _CHECKS | {"genres": "len(genres) = 0", "year": "media_type = 'book' AND published_year = ''", "author_as_title": "false"}


@query(
    "WITH " + _ITEM + _AUDITED + ", p AS (" + " UNION ALL ".join(f"SELECT 'check' AS kind, '{n}' AS field, '' AS part, '' AS value FROM i WHERE {w}" for n, w in _CHECKED.items())
    + " UNION ALL SELECT DISTINCT 'value', f, '', v || '' FROM (SELECT NULL AS f, NULL AS v) WHERE false"
    + "".join(f" UNION ALL SELECT 'value', '{f}', '', unnest(list_distinct({x})) FROM i" for f, x in {"authors": "authors", "narrators": "narrators", "series": "CASE WHEN series IS NULL THEN [] ELSE [series] END", "publishers": "[publisher]", "genres": "genres", "tags": "tags", "languages": "[language]"}.items())
    + " UNION ALL SELECT 'genre', 'genres', 'placeholder', unnest(list_filter(genres, lambda g: g = 'Audiobook')) FROM i UNION ALL SELECT 'genre', 'tags', 'redundant', unnest(list_distinct(list_filter(tags, lambda g: list_contains(list_transform(genres, lambda x: lower(x)), lower(g))))) FROM i"
    + " UNION ALL SELECT 'title', '', '', lower(trim(title)) || '|' || lower(coalesce(authors[1], '')) FROM i WHERE media_type = 'book'"
    + ") SELECT kind, field, part, value, count(*) AS items FROM p GROUP BY ALL"
)
def audit_postings(spark, sf_dir):
    """What items say by themselves, from one reading: checks, values, sections of genres, titles."""
    return postings(_audited(spark, sf_dir), skip=("paths",)).where("kind in ('check', 'value', 'genre', 'title')")


@query()
def audit_all_parts(spark, sf_dir):
    """All audits of items and their chapters in one result."""
    ch = _read(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("item_id"), c("l_linenumber").alias("pos"), F.concat(F.lit("The "), "l_returnflag", F.lit(" of "), "l_linestatus").alias("title"), c("l_quantity").alias("start"), (c("l_quantity") + c("l_extendedprice") / 100).alias("end"))
    return audit_all(_audited(spark, sf_dir), ch)


# ---- Copies, readings, providers, records that moved ----------------------------------------------


def _records(rows: DataFrame, kind: str, **columns: str) -> DataFrame:
    """A record table from expressions over rows; what isn't named is missing."""
    made = [F.expr(columns[f.name]).cast(f.dataType).alias(f.name) if f.name in columns else F.lit(None).cast(f.dataType).alias(f.name) for f in catalog.schema(kind)]
    return catalog.settled(rows.select(*made))


_COPY = "title_k AS (SELECT p_partkey AS k, p_name || ' ' || p_partkey AS title, p_brand AS brand FROM part)"


def _copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in up to four copies: two of one length, one much longer (with the first one's asin, of some), one by another reader."""
    rows = spread(_read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), "p_partkey").selectExpr("p_partkey AS k", "concat(p_name, ' ', p_partkey) AS t", "p_brand AS brand", "explode(array(0, 1, 2, 3)) AS j").where("j < 2 or (j = 2 and k % 3 = 0) or (j = 3 and k % 4 = 0)")
    return _records(rows, "item", id="concat('p', k, '-', j)", media_type="'book'", title="t", authors="array(brand)", narrators="if(j = 3, array('Bo Lind'), array('Ann Lee'))", rel_path="concat(brand, '/', t)", duration="(10000 + k % 500) * element_at(array(1.0D, 1.01D, 1.4D, 1.0D), j + 1)", num_tracks="5", asin="if(k % 5 = 0 and j in (0, 2), concat('B', k), '')", added_at="timestamp_seconds(1700000000 + j)")


@query(f"WITH {_COPY} SELECT 'p' || k || '-' || j AS id, 'p' || k || '-0' AS \"group\" FROM title_k, (SELECT unnest([0, 1, 2]) AS j) WHERE j = 0 OR j = CASE WHEN k % 15 = 0 THEN 2 ELSE 1 END")
def copy_groups(spark, sf_dir):
    """Copies of one recording among those that share a title, in the face of other lengths, readers and asins."""
    return duplicates.groups(_copies(spark, sf_dir)).select("id", "group")


@query(f"WITH {_COPY} SELECT 'title:' || lower(title) || '|' || lower(brand) AS key, (2 + (k % 3 = 0)::INT + (k % 4 = 0)::INT)::BIGINT AS copies, (CASE WHEN k % 15 = 0 THEN 2 ELSE 1 + (k % 3 = 0)::INT END + (k % 4 = 0)::INT)::BIGINT AS parts, concat_ws(',', CASE WHEN k % 3 = 0 THEN 'length 29%' END, CASE WHEN k % 4 = 0 THEN 'field' END) AS why FROM title_k WHERE k % 3 = 0 OR k % 4 = 0")
def split_titles(spark, sf_dir):
    """Titles whose copies are in several parts, and why."""
    made = _copies(spark, sf_dir)
    facts = written(duplicates.copy_facts(made), "copy-facts")
    return duplicates.splits(made, duplicates.groups(made, facts), facts=facts)[0].select("key", "copies", "parts", F.array_join("why", ",").alias("why"))


@query("SELECT 'p' || p_partkey || '-1' AS id, 'p' || p_partkey || '-0' AS long_id, 2.0 AS spread, 10 AS chapters FROM part WHERE p_partkey % 3 = 0")
def uneven_readings(spark, sf_dir):
    """Of two readings of each part the shorter one, where some of its chapters are cut by half; others are read faster, or nearly as long."""
    base = spread(_read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), "p_partkey").selectExpr("p_partkey AS k", "concat(p_name, ' ', p_partkey) AS t", "p_brand AS brand", "explode(array(0, 1)) AS j")
    words = ("rain", "wind", "moon", "field", "crow", "frost", "leaf", "fire", "gate", "snow")
    length = "if(j = 0, 600.0D, case k % 3 when 0 then if(i in (2, 5, 8), 300.0D, 600.0D) when 1 then 480.0D else 580.0D end)"
    ch = base.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("len", F.expr(length)).withColumn("name", F.concat(F.col("i") + 1, F.lit(". The "), F.element_at(F.array(*map(F.lit, words)), c("i") + 1)))
    listed = _records(base, "item", id="concat('p', k, '-', j)", media_type="'book'", title="if(j = 1, concat(t, ' (Bo Lind)'), t)", authors="array(brand)", num_chapters="10", duration="if(j = 0, 6000.0D, case k % 3 when 0 then 5100.0D when 1 then 4800.0D else 5800.0D end)", added_at="timestamp_seconds(1700000000 + j)")
    rows = ch.select(F.concat(F.lit("p"), "k", F.lit("-"), "j").alias("item_id"), c("i").alias("pos"), c("name").alias("title"), (c("i") * 600.0).alias("start"), (c("i") * 600.0 + c("len")).alias("end"))
    return readings.sweep(listed, rows)[0].select("id", "long_id", "spread", "chapters")


@query("""WITH b AS (SELECT p_partkey AS k FROM part WHERE p_size % 10 <> 0), s AS (SELECT k, k % 3 <> 0 AS near, k % 4 = 0 AS off, k % 5 <> 0 AS far, k % 6 = 0 AS parted FROM b)
SELECT 'p' || k AS id, CASE WHEN near AND NOT off THEN 'near' WHEN far THEN 'far' WHEN near THEN 'near' END AS provider, CASE WHEN near AND NOT off THEN 'N' || k WHEN far THEN 'F' || k WHEN near THEN 'N' || k END AS asin,
  CASE WHEN near AND NOT off THEN 'exact' WHEN far THEN CASE WHEN parted THEN 'likely' ELSE 'exact' END WHEN near THEN 'edition' ELSE 'none' END AS confidence FROM s""")
def provider_cascade(spark, sf_dir):
    """Books asked for at two providers in turn: the near one lacks some and has others in another length; some titles are found by their main part alone."""
    p = spread(_read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), "p_partkey")
    rows = p.selectExpr("p_partkey AS k", "concat(p_name, ' ', p_partkey) AS t", "p_size AS size")
    books = _records(rows, "item", id="concat('p', k)", media_type="if(size % 10 = 0, 'podcast', 'book')", title="if(k % 6 = 0, concat(t, ': a long tale'), t)", authors="array(concat('Writer ', k))", duration="36000.0D")
    has = rows.withColumn("far", F.explode(F.array(F.lit(0), F.lit(1)))).where("(far = 0 and k % 3 != 0) or (far = 1 and k % 5 != 0)")
    records = _records(has, "provider_record", provider="if(far = 1, 'far', 'near')", provider_rank="far", title="t", author="concat('Writer ', k)", asin="concat(if(far = 1, 'F', 'N'), k)", duration_min="if(far = 0 and k % 4 = 0, 500.0D, 600.0D)")
    return providers.cascade(books, providers.answers(records), ["near", "far"])[0].select("id", "provider", "asin", "confidence")


@query("""WITH o AS (SELECT o_orderkey AS k, o_custkey AS u, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders WHERE o_orderkey % 4 = 0)
SELECT 'm' || k AS old_id, CASE WHEN n > 0 AND k % 3 = 0 AND k % 5 <> 0 THEN 'a' || k END AS new_id, CASE WHEN n > 0 AND k % 3 = 0 AND k % 5 <> 0 THEN 'merge' ELSE 'leave' END AS action,
  CASE WHEN n = 0 THEN 'no_audio' WHEN k % 3 < 2 AND k % 5 = 0 THEN 'standing' WHEN k % 3 = 0 THEN '' WHEN k % 3 = 1 THEN 'several' ELSE 'none' END AS why, CASE WHEN n > 0 AND k % 3 = 0 AND k % 5 <> 0 THEN concat_ws(',', 'title', CASE WHEN k % 7 = 0 THEN 'genres' END) ELSE '' END AS details,
  CASE WHEN n > 0 AND k % 3 = 0 AND k % 5 <> 0 AND k % 8 <> 0 THEN 'u' || u ELSE '' END AS progress, CASE WHEN n > 0 AND k % 3 = 0 AND k % 5 <> 0 THEN (u % 10)::VARCHAR ELSE '' END AS lists FROM o""")
def merge_plan(spark, sf_dir):
    """Orders whose record is gone beside one, two or no records with the same lines, some of which were there before; what goes across."""
    o = _read(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "o_custkey AS u").where("k % 4 = 0")
    lines = _read(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("k"), F.concat("l_linenumber", F.lit("-"), "l_partkey", F.lit("-"), "l_extendedprice").alias("filename"), (c("l_orderkey") * 8 + c("l_linenumber")).alias("size"), c("l_quantity").alias("duration"), c("l_linenumber").alias("idx"))
    rows = o.withColumn("w", F.explode(F.array(F.lit("m"), F.lit("a"), F.lit("b")))).where("w = 'm' or (w = 'a' and k % 3 < 2) or (w = 'b' and k % 3 = 1)")
    count = lines.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("duration").alias("d"))
    rows = rows.join(count, "k", "left")
    records = _records(rows, "item", id="concat(w, k)", media_type="'book'", is_missing="w = 'm'", num_audio_files="coalesce(n, 0)", duration="coalesce(d, 0.0D)", title="if(w = 'm', 'Old', 'New')", genres="if(k % 7 = 0 and w = 'm', array('g'), array())", updated_at="timestamp_seconds(1700000000)", added_at="timestamp_seconds(1700000000 + if(w = 'm' or k % 5 = 0, -100000, 60))")
    files = _records(rows.select("w", "k").join(lines, "k"), "audio_file", item_id="concat(w, k)", idx="idx", filename="filename", size="size", duration="duration", exclude="false")
    read = rows.where("w = 'm' or (w = 'a' and k % 8 = 0)").selectExpr("concat('u', u) AS user_id", "concat(w, k) AS item_id", "'' AS episode_id", "1.0D AS current_time")
    lists = rows.where("w = 'm'").selectExpr("cast(u % 10 as string) AS list_id", "concat(w, k) AS item_id")
    marks = read.where("false").selectExpr("user_id", "item_id", "0.0D AS position")
    plan = merging.merge_plan(records, files, read, marks, lists)
    return plan.select("old_id", F.when(c("action") == "merge", c("new_id")).alias("new_id"), "action", "why", *[F.array_join(x, ",").alias(x) for x in ("details", "progress", "lists")])


# ---- Pictures and sound ---------------------------------------------------------------------------


@query("SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'gif' WHEN 2 THEN 'webp' ELSE 'jpeg' END AS kind, CASE WHEN p_partkey % 7 = 0 AND p_partkey % 4 = 3 THEN 0 ELSE 100 + p_partkey % 900 END::INT AS width, CASE WHEN p_partkey % 7 = 0 AND p_partkey % 4 = 3 THEN 0 ELSE 50 + p_size END::INT AS height FROM part")
def picture_headers(spark, sf_dir):
    """Sizes of parts' pictures, told from headers in four layouts; of some the header breaks off before the size."""
    big, little = (lambda n, w: F.lpad(F.hex(n), w, "0")), (lambda n: F.concat(F.substring(F.lpad(F.hex(n), 4, "0"), 3, 2), F.substring(F.lpad(F.hex(n), 4, "0"), 1, 2)))
    k, w, h = c("p_partkey"), c("w").cast("long"), c("h").cast("long")
    rows = _read(spark, sf_dir, "part").withColumns({"w": F.lit(100) + k % 900, "h": F.lit(50) + c("p_size")})
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(w, 8), big(h, 8))
    gif = F.concat(F.lit("474946383961"), little(w), little(h))
    webp = F.concat(F.lit("524946460000000057454250565038580000000000000000"), little(w - 1), F.lit("00"), little(h - 1), F.lit("00"))
    jpeg = F.concat(F.lit("FFD8FFE0000400FFFFC2001108"), big(h, 4), F.when(k % 7 == 0, F.lit("")).otherwise(big(w, 4)))
    data = F.unhex(F.when(k % 4 == 0, png).when(k % 4 == 1, gif).when(k % 4 == 2, webp).otherwise(jpeg))
    return rows.select(k.alias("k"), picture_size(data).alias("s")).select("k", "s.kind", *[F.coalesce(f"s.{x}", F.lit(0)).alias(x) for x in ("width", "height")])


#: Samples of a chunk, and of a second, of the sound that lines of suppliers are taken for.
SOUND = {"samples": 64, "rate": 400, "window": 5, "stretch": 0.2, "reach": 1.0, "n": 3}


def supplier_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of a supplier's lines as a recording, in chunks; of each a second copy that starts later."""
    from pyspark.sql import Window

    lines = _read(spark, sf_dir, "lineitem").select(c("l_suppkey").alias("s"), (c("l_extendedprice") - 30_000).cast("int").alias("v"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity").alias("at"))
    both = lines.select(F.concat(F.lit("s"), "s").alias("item_id"), "v", "at").unionByName(lines.where("at.l_orderkey > 20").select(F.concat(F.lit("t"), "s").alias("item_id"), "v", "at"))
    row = F.row_number().over(Window.partitionBy("item_id").orderBy("at")) - 1
    placed = both.withColumn("r", row).withColumn("chunk", F.floor(c("r") / SOUND["samples"]).cast("int"))
    return placed.groupBy("item_id", "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "v"))), lambda x: x["v"]).alias("pcm"))


@query()
def recording_verdicts(spark, sf_dir):
    """Each supplier's recording beside its copy, and beside the next supplier's."""
    sound = written(supplier_sound(spark, sf_dir), "sound")
    ids = sound.where("item_id like 's%'").select("item_id").distinct().withColumn("k", F.substring("item_id", 2, 20).cast("long"))
    pairs = ids.select(c("item_id").alias("a_id"), F.concat(F.lit("t"), "k").alias("b_id")).unionByName(ids.select(c("item_id").alias("a_id"), F.concat(F.lit("s"), c("k") + 1).alias("b_id")))
    return recordings.verdicts(recordings.compared(pairs, sound, **SOUND))
