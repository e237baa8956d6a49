"""Exact deduplication: 128-bit content hash, smallest stable id, bytes compared inside groups.

Built from DataFrame functions only. One pass groups by (hash, normalised text): the map-side half of that aggregation
leaves a task at most one row for each distinct text, so a text that makes up a third of the table costs no more than any
other, and the aggregation's own key comparison compares the bytes, so texts that merely share a hash stay apart. The
groups (without texts) are written to the shared folder and joined back on the hash, a join that adaptive execution may
split where one hash is hot. Only if some hash really covers two texts does the join back also carry the texts of those
hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import text_of, written

#: Matches every run of white space but a lone space, which normalisation leaves as it is.
_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: str | Column) -> Column:
    """Each run of white space becomes one space; null is the empty text."""
    return F.regexp_replace(text_of(text), _RUNS, " ")


def content_hash(normal: Column) -> Column:
    """128 bits of the content, as binary."""
    return F.unhex(F.md5(normal))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of=content_hash) -> DataFrame:
    """One row for each distinct normalised text: _hash, _keep (smallest non-null id), _size, _sha (of the text), _twin.

    _twin says that another text has the same hash; those rows also carry the text in _normal, all others null.
    """
    made = docs.select(F.col(id_col).alias("_id"), normalised(text_col).alias("_normal")).withColumn("_hash", hash_of(F.col("_normal")))
    made = made.groupBy("_hash", "_normal").agg(F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
    slim = written(made.select("_hash", "_keep", "_size", F.sha2("_normal", 256).alias("_sha")), "exact-groups")
    twins = slim.groupBy("_hash").count().where("count > 1").select("_hash")
    if twins.isEmpty():
        return slim.select("*", F.lit(False).alias("_twin"), F.lit(None).cast("string").alias("_normal"))
    alone = slim.join(twins, "_hash", "left_anti").select("*", F.lit(False).alias("_twin"), F.lit(None).cast("string").alias("_normal"))
    both = made.join(twins, "_hash", "left_semi").select("_hash", "_keep", "_size", F.sha2("_normal", 256).alias("_sha"), F.lit(True).alias("_twin"), "_normal")
    return written(alone.unionByName(both), "exact-groups")


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of=content_hash) -> DataFrame:
    """docs with keep_id, group_size, kept and text_sha256.

    A null text equals the empty one. An id that repeats with one text is one document listed more than once: exactly one
    of its rows is kept. A null id stays only where its text has no other id; then keep_id is null. An empty table gives
    an empty result. Columns of docs with these names are replaced; others pass through, whatever they are called.
    """
    own = [c for c in docs.columns if c not in ("keep_id", "group_size", "kept", "text_sha256")]
    found = groups(docs, id_col, text_col, hash_of)
    left = docs.select(F.struct(*[docs[c] for c in own]).alias("_row"), normalised(docs[text_col]).alias("_normal")).withColumn("_hash", hash_of(F.col("_normal"))).alias("l")
    if not found.where("_twin").isEmpty():
        on = (F.col("l._hash") == F.col("g._hash")) & (~F.col("g._twin") | (F.col("l._normal") == F.col("g._normal")))
    else:
        left, on = left.drop("_normal").alias("l"), F.col("l._hash") == F.col("g._hash")
    out = left.join(found.alias("g"), on).select("_row", F.col("l._hash").alias("_hash"), "_keep", "_size", "_sha", F.col(f"_row.{id_col}").eqNullSafe(F.col("_keep")).alias("kept"))
    if _repeats(docs, id_col):
        from pyspark.sql import Window

        first = F.row_number().over(Window.partitionBy("_hash", "_sha", F.col(f"_row.{id_col}"), "kept").orderBy(F.lit(0)))
        only, rest = out.where("kept").withColumn("kept", first == 1), out.where("not kept")
        out = only.unionByName(rest)
    return out.select(*[F.col("_row").getField(c).alias(c) for c in own], F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), "kept", F.col("_sha").alias("text_sha256"))


def _repeats(docs: DataFrame, id_col: str) -> bool:
    return not docs.groupBy(F.col(id_col).alias("_id")).count().where("count > 1").isEmpty()


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with their own columns: of equal texts the one that mark() keeps. An empty table gives an empty one."""
    return mark(docs, id_col, text_col).where("kept").select(*docs.columns)
