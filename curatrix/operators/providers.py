"""Searches at providers in turn: each is asked only for the items that those before left open.

A provider is a function from queries to hits, so a table of records and a service look alike. In each round all open items
ask the next provider of their own order; those with an exact match leave. Rounds are as many as the longest order, tables
are written between them, and no round joins more than the items that it asks for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions import text as t
from curatrix.operators import matching
from curatrix.sources.storage import dropped, written

#: Bytes that the main part of a title has at least, to be asked for alone.
MAIN_BYTES = 4
QUERY = "id string, provider string, title string, author string"
c = F.col


def answers(records: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Asks a table of records: a provider's records answer a query whose title is their own, or a part of it around a colon or dash.

    Gives query_item_id, place (of the record among the provider's: by asin, then title) and the record's columns.
    """
    forms = records.select(F.explode(t.title_forms(c("title"))).alias("_key"), *records.columns).where("_key != ''")

    def ask(queries: DataFrame) -> DataFrame:
        asked = queries.select(c("id").alias("query_item_id"), c("provider"), t.clean_title(c("title")).alias("_key"))
        hits = asked.join(forms.drop("query_item_id"), ["provider", "_key"]).drop("_key").distinct()
        return hits.withColumn("place", F.struct("asin", "title", "author", "narrator"))

    return ask


def order_of(tags: Column, providers: list[str], prefix: str = "") -> Column:
    """The providers of an item: the one that its tag records first, whatever its case, then the others in order."""
    listed = F.array(*map(F.lit, providers))
    recorded = t.provider_tag(tags, prefix) if prefix else F.lit("")
    other = F.filter(listed, lambda p: F.lower(p) != F.lower(recorded))
    return F.when((recorded == "") | (F.lower(recorded) == "none"), listed).otherwise(F.concat(F.array(recorded), other))


def cascade(items: DataFrame, ask: Callable[[DataFrame], DataFrame], providers: list[str], prefix: str = "", tolerance: float = matching.TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """Each book's best record: id, provider, asin, p_title, delta, confidence (none: no provider has any), and what was asked:
    round, provider, form (whole, main), asked, found (items).

    An item asks by its title without notes; where that finds nothing and the title has a colon or dash, by the part before
    it. Hits are ranked as matching.ranked() does, equals by the provider's own order. A later provider counts only if its
    best is of a better confidence, and none is asked after an exact one. Podcasts, and books tagged to have no provider, are left out.
    """
    tagged_none = F.lower(t.provider_tag(c("tags"), prefix)) == "none" if prefix else F.lit(False)
    books = items.where((c("media_type") != "podcast") & ~tagged_none)
    open_ = written(books.select("id", "title", "authors", "narrators", "duration", order_of(c("tags"), providers, prefix).alias("order")), "cascade-open")
    session = items.sparkSession
    best = session.createDataFrame([], "id string, provider string, asin string, p_title string, delta double, confidence string, rank int, round int")
    asked = session.createDataFrame([], "round int, provider string, form string, asked long, found long")
    k = 0
    while not (now := open_.where(F.size("order") > k)).isEmpty():
        query = lambda df, title: df.select("id", F.get("order", F.lit(k)).alias("provider"), title.alias("title"), F.array_join("authors", ", ").alias("author"))  # noqa: E731, B023
        noted = t.trim(F.regexp_replace("title", t.TITLE_NOISE, " "))
        first = written(ask(query(now, noted)), "cascade-hits")
        parts = F.split(noted, t.TITLE_SPLIT, 2)
        main = t.trim(F.get(parts, F.lit(0)))
        silent = now.join(first.select(c("query_item_id").alias("id")).distinct(), "id", "left_anti").where((F.size(parts) == 2) & (F.octet_length(F.get(parts, F.lit(0))) >= MAIN_BYTES))
        second = written(ask(query(silent, main)), "cascade-hits")
        told = lambda df, hits, form: query(df, noted).join(hits.select(c("query_item_id").alias("id"), F.lit(1).alias("hit")).distinct(), "id", "left").groupBy("provider").agg(F.count(F.lit(1)).alias("asked"), F.count("hit").alias("found")).select(F.lit(k).alias("round"), "provider", F.lit(form).alias("form"), "asked", "found")  # noqa: E731, B023
        asked = written(asked.unionByName(told(now, first, "whole")).unionByName(told(silent, second, "main")), "cascade-asked")
        hits = first.unionByName(second).select(c("query_item_id").alias("id"), "provider", "place", "asin", c("title").alias("p_title"), c("author").alias("p_author"), c("narrator").alias("p_narrator"), c("duration_min").alias("p_minutes"))
        scored = matching.score(now.drop("order").join(hits.withColumnRenamed("place", "at"), "id"), tolerance)
        top = matching.ranked(scored, ["at"]).where("place = 1").select("id", "provider", "asin", "p_title", "delta", "confidence", c("rank").cast("int").alias("rank"), F.lit(k).alias("round"))
        both = best.unionByName(top)
        kept = [x for x in both.columns if x != "id"]
        before, gone = best, open_
        best = written(both.groupBy("id").agg(F.min_by(F.struct(*kept), F.struct("rank", "round")).alias("b")).select("id", "b.*"), "cascade-best")
        open_ = written(now.join(best.where("confidence = 'exact'").select("id"), "id", "left_anti"), "cascade-open")
        for table in (before, gone, first, second):
            dropped(table)
        k += 1
    out = books.select("id").join(best.drop("rank", "round"), "id", "left")
    return out.withColumn("confidence", F.coalesce("confidence", F.lit("none"))), asked
