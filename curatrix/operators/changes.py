"""Change sets: corrections as rows (id, field, before, after) that can be looked at first and then applied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions import text as t

c = F.col


def _listed(rows: DataFrame, field: str, after: Column, id_col: str) -> DataFrame:
    return rows.select(c(id_col).alias("id"), F.lit(field).alias("field"), c(field).alias("before"), after.alias("after")).where(~c("before").eqNullSafe(c("after")))


def rename(rows: DataFrame, field: str, old: str, new: str, id_col: str = "id") -> DataFrame:
    """A value of a text or list field renamed; a list that has the new one already doesn't get it twice."""
    if rows.schema[field].dataType.simpleString().startswith("array"):
        return _listed(rows, field, F.array_distinct(F.transform(field, lambda v: F.when(v == old, F.lit(new)).otherwise(v))), id_col)
    return _listed(rows, field, F.when(c(field) == old, F.lit(new)).otherwise(c(field)), id_col)


def remove(rows: DataFrame, field: str, value: str, id_col: str = "id") -> DataFrame:
    """A value of a list, in any case, dropped."""
    return _listed(rows, field, F.filter(field, lambda v: F.lower(v) != value.lower()), id_col)


def split(rows: DataFrame, field: str, value: str, parts: list[str], id_col: str = "id") -> DataFrame:
    """A value of a list replaced by its parts, in its place."""
    made = F.array(*map(F.lit, parts))
    return _listed(rows, field, F.array_distinct(F.flatten(F.transform(field, lambda v: F.when(v == value, made).otherwise(F.array(v))))), id_col)


def edit_list(field: Column, add: list[str], drop: list[str]) -> Column:
    """A list with values added unless there, in any case, and others dropped."""
    gone = [d.lower() for d in drop]
    left = F.filter(field, lambda v: ~F.lower(v).isin(*gone)) if gone else field
    for a in add:
        left = F.when(F.exists(left, lambda v: F.lower(v) == a.lower()), left).otherwise(F.array_append(left, F.lit(a)))  # noqa: B023
    return left


def merge_series(rows: DataFrame, old: str, new: str) -> DataFrame:
    """Books of one series moved to another, with their numbers; a book that is in both keeps its place in the new one."""
    moved = F.transform("series", lambda s: F.when(s["name"] == old, s.withField("name", F.lit(new))).otherwise(s))
    has = F.exists("series", lambda s: s["name"] == new)
    return _listed(rows, "series", F.when(has, F.filter("series", lambda s: s["name"] != old)).otherwise(moved), "id")


def carry_over(pairs: DataFrame, fields: list[str]) -> DataFrame:
    """What an old record (old_<field>) has that its replacement (new_<field>) lacks or says otherwise: id, field, before, after,
    action (fill or differs)."""
    one = lambda f: F.when(~c(f"old_{f}").eqNullSafe(c(f"new_{f}")) & (t.trim(c(f"old_{f}").cast("string")) != ""), F.struct(F.lit(f).alias("field"), c(f"new_{f}").cast("string").alias("before"), c(f"old_{f}").cast("string").alias("after"), F.when(t.trim(c(f"new_{f}").cast("string")) == "", "fill").otherwise("differs").alias("action")))
    return pairs.select("id", F.explode(F.array_compact(F.array(*map(one, fields)))).alias("d")).select("id", "d.*")


def track_order(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """What keeps a wanted order (item_id, filename, pos) from being one of all files: item_id, filename, problem; empty if it is."""
    key = ["item_id", "filename"]
    left_out = files.select(*key).join(wanted.select(*key), key, "left_anti").withColumn("problem", F.lit("left out"))
    unknown = wanted.select(*key).join(files.select(*key), key, "left_anti").withColumn("problem", F.lit("unknown"))
    twice = wanted.groupBy(*key).count().where("count > 1").select(*key, F.lit("twice").alias("problem"))
    return left_out.unionByName(unknown).unionByName(twice)


def apply(rows: DataFrame, change: DataFrame, field: str, id_col: str = "id") -> DataFrame:
    """rows with the changes of one field made; rows without a change stay as they are. A change of another value than the
    row has now is not made."""
    after = change.where(c("field") == field).select(c("id").alias("_id"), c("before").alias("_before"), c("after").alias("_after"))
    j = rows.join(after, rows[id_col] == c("_id"), "left")
    return j.withColumn(field, F.when(c("_id").isNotNull() & c(field).eqNullSafe(c("_before")), c("_after")).otherwise(c(field))).drop("_id", "_before", "_after")


def counts(change: DataFrame) -> DataFrame:
    return change.groupBy("field").agg(F.count(F.lit(1)).alias("items"))
