"""Rows dealt to tasks: spread over all of them, or in groups that pass through a task one after the other."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a batch that leaves a task.
BATCH = 2000


def spread(rows: DataFrame, *keys: str, most: int | None = None) -> DataFrame:
    """rows dealt by keys over as many tasks as a shuffle has. A small table is one file, and what is made of its rows (copies,
    chapters, long expressions) would else be one task's work.

    most: about how many rows a task gets at most, which takes a count of them (for a file, from its footers); more tasks then.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(n, -(-rows.count() // most)) if most else n, *keys)


def once(rows: DataFrame, made: dict[str, Column]) -> DataFrame:
    """rows with columns that are computed once for each row, however many later expressions and filters read them: those are
    not merged into what reads a generated row, as they are into other projections."""
    one = rows.select("*", F.explode_outer(F.array(F.struct(*[v.alias(k) for k, v in made.items()]))).alias("_once"))
    return one.select(*[F.col(x) for x in rows.columns if x not in made], *[F.col("_once")[k].alias(k) for k in made])


def in_groups(rows: DataFrame, keys: list[str], make: Callable[[list], list[tuple]], schema: str) -> DataFrame:
    """make() of the rows of each group, as named tuples. Groups follow each other within a task, sorted by their keys, so very
    many small ones cost no call of their own, and a task holds one group at a time."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        out = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], f.type) for i, f in enumerate(kinds)], schema=kinds)
        held, now = [], None
        for batch in batches:
            row = namedtuple("Row", batch.schema.names)
            at = [batch.schema.names.index(k) for k in keys]
            for values in zip(*(col.to_pylist() for col in batch.columns)):
                key = tuple(values[i] for i in at)
                if key != now and held:
                    made += make(held)
                    held = []
                    if len(made) >= BATCH:
                        yield out()
                        made = []
                now = key
                held.append(row(*values))
        if held:
            made += make(held)
        if made:
            yield out()

    return spread(rows, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
