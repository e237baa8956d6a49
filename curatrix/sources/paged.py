"""Items from a catalogue server, page by page, as a Spark data source; and whole records by lists of ids.

    spark.dataSource.register(paged.CataloguePages)
    spark.read.format("catalogue_pages").option("url", u).option("library", l).load()

One small request tells how many items there are; pages are then read by tasks, a run of pages each, so that no listing passes
through the driver. A filter on a column that the server can filter by goes to the server (``spark.sql.python.
filterPushdown.enabled`` must be on for that), the others stay with Spark. A request that fails is tried again, waiting longer each
time; after the last try the task fails, and Spark runs it again elsewhere.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import StructType

from curatrix.functions.display import filter_code
from curatrix.sources.catalog import ITEM

#: Items of a page, pages of a task, ids of one request, tries of a request and seconds before the second.
PAGE, PAGES_EACH, IDS_EACH, TRIES, WAIT = 100, 20, 50, 4, 0.2

# ---- Fixed values: where a record has what, and the filters that a server takes ----

PATHS = {
    "id": "id", "library_id": "libraryId", "folder_id": "folderId", "media_type": "mediaType", "rel_path": "relPath", "is_file": "isFile", "is_missing": "isMissing", "is_invalid": "isInvalid",
    "added_at": "addedAt", "updated_at": "updatedAt", "size": "size", "cover_path": "media.coverPath", "duration": "media.duration", "num_tracks": "media.numTracks", "num_audio_files": "media.numAudioFiles",
    "num_chapters": "media.numChapters", "num_episodes": "media.numEpisodes", "ebook_format": "media.ebookFormat", "last_episode_check": "media.lastEpisodeCheck", "tags": "media.tags",
    "title": "media.metadata.title", "subtitle": "media.metadata.subtitle", "genres": "media.metadata.genres", "asin": "media.metadata.asin", "isbn": "media.metadata.isbn", "published_year": "media.metadata.publishedYear",
    "publisher": "media.metadata.publisher", "language": "media.metadata.language", "description": "media.metadata.description", "abridged": "media.metadata.abridged", "explicit": "media.metadata.explicit", "feed_url": "media.metadata.feedUrl",
}
FILTERED = {"language": "languages", "publisher": "publishers"}


def _at(record: dict, path: str):
    for name in path.split("."):
        record = record.get(name) if isinstance(record, dict) else None
    return record


def _names(metadata: dict, listed: str, joined: str) -> list[str]:
    """Names as a list of records or texts, or as one line."""
    if metadata.get(listed) is not None:
        return [x["name"] if isinstance(x, dict) else x for x in metadata[listed]]
    return [x for x in (metadata.get(joined) or "").split(", ") if x]


def _series(metadata: dict) -> list[dict]:
    found = metadata.get("series")
    if found is None:
        parts = (x.rpartition(" #") for x in (metadata.get("seriesName") or "").split(", ") if x)
        return [{"id": None, "name": a or z, "sequence": z if a else ""} for a, _, z in parts]
    found = [found] if isinstance(found, dict) else found
    return [{"id": x.get("id"), "name": x.get("name"), "sequence": x.get("sequence") or ""} for x in found]


def record_of(record: dict) -> dict:
    """A server's record, whole or listed, with the columns of the item table. Times are epoch milliseconds, 0 for none."""
    metadata = _at(record, "media.metadata") or {}
    out = {name: _at(record, path) for name, path in PATHS.items()}
    for name in ("added_at", "updated_at", "last_episode_check"):
        out[name] = datetime.fromtimestamp(out[name] / 1000, timezone.utc) if out[name] else None
    out |= {"authors": _names(metadata, "authors", "authorName") or ([metadata["author"]] if metadata.get("author") else []), "narrators": _names(metadata, "narrators", "narratorName"), "series": _series(metadata)}
    for name in ("published_year", "asin", "isbn"):
        out[name] = None if out[name] is None else str(out[name])
    for name in ("size", "num_tracks", "num_audio_files", "num_chapters", "num_episodes"):
        out[name] = None if out[name] is None else int(out[name])
    out["duration"] = None if out["duration"] is None else float(out["duration"])
    return out


def asked(url: str, token: str = "", body: dict | None = None, tries: int = TRIES, wait: float = WAIT):
    """The JSON that an address answers. Refusals (4xx but 429) are final; anything else is tried again."""
    for k in range(tries):
        request = urllib.request.Request(url, data=None if body is None else json.dumps(body).encode(), headers={"Content-Type": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {}))
        try:
            with urllib.request.urlopen(request, timeout=60) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as e:
            if k + 1 == tries or (400 <= e.code < 500 and e.code != 429):
                raise
        except (urllib.error.URLError, TimeoutError, ValueError):
            if k + 1 == tries:
                raise
        time.sleep(wait * 2**k)


@dataclass
class Pages(InputPartition):
    first: int
    last: int


class CataloguePages(DataSource):
    """Options: url, library, and of choice token, page, pages_each, tries, wait."""

    @classmethod
    def name(cls) -> str:
        return "catalogue_pages"

    def schema(self) -> str:
        return ITEM

    def reader(self, schema: StructType) -> DataSourceReader:
        return PageReader({k: self.options.get(k) for k in ("url", "library", "token", "page", "pages_each", "tries", "wait")}, schema)


class PageReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.columns, self.filter = options, schema.names, ""
        self.page, self.each = int(options["page"] or PAGE), int(options["pages_each"] or PAGES_EACH)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """The first filter that the server knows goes there, as it takes one; Spark keeps the rest."""
        for f in filters:
            if not self.filter and isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in FILTERED and f.value:
                self.filter = filter_code(FILTERED[f.attribute[0]], f.value)
            else:
                yield f

    def _get(self, page: int, limit: int) -> dict:
        query = {"limit": limit, "page": page, "minified": 1}
        more = f"&filter={self.filter}" if self.filter else ""
        o = self.options
        return asked(f"{o['url'].rstrip('/')}/api/libraries/{urllib.parse.quote(o['library'])}/items?{urllib.parse.urlencode(query)}{more}", o["token"] or "", tries=int(o["tries"] or TRIES), wait=float(o["wait"] or WAIT))

    def partitions(self) -> list[Pages]:
        total = self._get(0, 1).get("total") or 0
        pages = -(-total // self.page)
        return [Pages(a, min(a + self.each, pages)) for a in range(0, pages, self.each)] or [Pages(0, 0)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        """Rows of a run of pages; it ends early where a page is empty, as items can go while they are read."""
        for page in range(partition.first, partition.last):
            rows = self._get(page, self.page).get("results") or []
            if not rows:
                return
            for r in rows:
                made = record_of(r)
                yield tuple([tuple(x.values()) for x in made[n]] if n == "series" else made[n] for n in self.columns)


def whole(ids: DataFrame, url: str, token: str = "", each: int = IDS_EACH, tries: int = TRIES, wait: float = WAIT) -> DataFrame:
    """Whole records of distinct ids (column id), so many to a request; ids that the server doesn't know are left out."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType as Struct

    kind = to_arrow_schema(Struct.fromDDL(ITEM))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column(0).to_pylist()
            for a in range(0, len(listed), each):
                got = asked(f"{url.rstrip('/')}/api/items/batch/get", token, {"libraryItemIds": listed[a : a + each]}, tries, wait)
                yield pa.RecordBatch.from_pylist([record_of(x) for x in got.get("libraryItems") or []], schema=kind)

    return ids.where(F.col("id").isNotNull()).select("id").distinct().mapInArrow(run, ITEM)
