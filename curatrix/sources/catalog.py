"""Catalogue records: schemas, and loaders that settle missing values once.

Missing text becomes the empty text, missing lists empty lists, epoch milliseconds timestamps (0: null). Lengths are seconds;
a provider's minutes are turned into seconds here and nowhere else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITEM = (
    "id string, library_id string, folder_id string, media_type string, rel_path string, is_file boolean, is_missing boolean, is_invalid boolean, "
    "added_at timestamp, updated_at timestamp, size bigint, cover_path string, duration double, num_tracks int, num_audio_files int, num_chapters int, "
    "num_episodes int, ebook_format string, last_episode_check timestamp, tags array<string>, title string, subtitle string, authors array<string>, "
    "narrators array<string>, series array<struct<id:string,name:string,sequence:string>>, genres array<string>, asin string, isbn string, "
    "published_year string, publisher string, language string, description string, abridged boolean, explicit boolean, feed_url string"
)
AUDIO_FILE = "item_id string, idx int, duration double, codec string, exclude boolean, error string, filename string, ext string, size bigint, mime string, tags map<string,string>"
CHAPTER = "item_id string, pos int, title string, start double, end double"
LIBRARY_FILE = "item_id string, file_type string, filename string, rel_path string, size bigint"
EPISODE = "item_id string, id string, title string, guid string, url string, published_at timestamp, added_at timestamp, duration double"
AUTHOR = "id string, library_id string, name string, asin string, description string, image_path string, num_books int"
PROGRESS = "user_id string, item_id string, episode_id string, current_time double, progress double, is_finished boolean, hidden boolean, last_update timestamp"
SESSION = "id string, user_id string, item_id string, episode_id string, time_listening double, started_at timestamp, updated_at timestamp"
PROVIDER_RECORD = (
    "provider string, provider_rank int, query_item_id string, asin string, isbn string, title string, subtitle string, author string, narrator string, "
    "duration_min double, abridged boolean, series array<struct<series:string,sequence:string>>, genres array<string>, publisher string, published_year string, language string, description string"
)
SCHEMAS = {
    "item": ITEM, "audio_file": AUDIO_FILE, "chapter": CHAPTER, "library_file": LIBRARY_FILE, "episode": EPISODE, "author": AUTHOR,
    "progress": PROGRESS, "session": SESSION, "provider_record": PROVIDER_RECORD,
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


def settled(df: DataFrame) -> DataFrame:
    """Missing texts, lists, numbers and flags as empty values; times stay null."""
    empty = {"string": F.lit(""), "double": F.lit(0.0), "bigint": F.lit(0).cast("long"), "int": F.lit(0), "boolean": F.lit(False)}
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if isinstance(f.dataType, T.ArrayType):
            out.append(F.coalesce(f.name, F.array().cast(kind)).alias(f.name))
        else:
            out.append(F.coalesce(f.name, empty[kind]).alias(f.name) if kind in empty else F.col(f.name))
    return df.select(*out)


def load(spark: SparkSession, name: str, path: str, fmt: str = "parquet") -> DataFrame:
    """A record table from Parquet, JSON lines, CSV or ORC, with the columns of its schema and missing values settled."""
    reader = spark.read.format(fmt)
    wanted = schema(name)
    if fmt != "parquet":
        return settled(reader.schema(wanted).load(path))
    have = reader.load(path)
    return settled(have.select(*[(F.col(f.name) if f.name in have.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted]))


def from_epoch_ms(column: str):
    """Epoch milliseconds as a timestamp; 0 and null are no time."""
    return F.when(F.col(column) != 0, F.timestamp_millis(F.col(column).cast("long"))).alias(column)


def headers(spark: SparkSession, path: str, block: int = 8192) -> DataFrame:
    """path, size and the first bytes of files, for container checks.

    Files are listed without their contents; tasks then open each and read no more than the block. An unreadable file has null.
    """
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            heads = []
            for name in batch.column(0).to_pylist():
                try:
                    where, inside = fs.FileSystem.from_uri(name)
                    with where.open_input_file(inside) as f:
                        heads.append(f.read(block))
                except OSError:
                    heads.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(heads, pa.binary())], names=["path", "size", "head"])

    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    # Spark gives spaces and other signs in names as they are
    uri = F.replace(F.replace("path", F.lit("%"), F.lit("%25")), F.lit(" "), F.lit("%20"))
    return listed.select(uri.alias("path"), F.col("length").alias("size")).mapInArrow(run, "path string, size long, head binary")


def whole(full: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Records of a set of ids; ids without a record are left out."""
    return full.join(ids.select(key).distinct(), key, "left_semi")


def in_order(full: DataFrame, listed: DataFrame, key: str = "id", place: str = "pos") -> DataFrame:
    """Records in the order of a listing; a listed id without a record has nulls."""
    return listed.select(key, place).join(full, key, "left").orderBy(place)


def play_order(files: DataFrame) -> DataFrame:
    """Files that play, with where each starts: the lengths before it in its item. Files of one place go by name, size and length."""
    from pyspark.sql import Window

    order = [x for x in ("idx", "filename", "size", "duration") if x in files.columns]
    before = Window.partitionBy("item_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return files.where(~F.coalesce("exclude", F.lit(False))).withColumn("start_offset", F.coalesce(F.sum("duration").over(before), F.lit(0.0)))
