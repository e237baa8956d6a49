"""Two recordings held against each other at points along them, from tables of sound in chunks.

A sound table has a row for each chunk of ``samples`` samples of an item: item_id, chunk (from 0), pcm (the last chunk may be
shorter). A point of a pair is a stretch of one recording, looked for around the same share of the other. Chunks that a point
needs are joined by their numbers. What is searched through (minutes, or an hour) is never whole anywhere: its chunks pass
one after the other, and only the loudness of each window is kept, over the ends of chunks and of Arrow batches. The sound
itself is looked at a second time only where the stretch was found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.functions import media
from curatrix.sources.storage import written

#: Points of a pair, seconds of a stretch, seconds (or the share of the other's length, if that is more) searched to each side of
#: the place, stretches tried further on where one is quiet; samples a second and of a window.
POINTS, STRETCH, REACH, REACH_OF, RETRIES = 5, 30.0, 600.0, 0.05, 3
RATE, WINDOW = 4000, 200
c = F.col


class Loudness:
    """The envelope of sound that comes in pieces: whole windows so far, and what is left of the open one."""

    def __init__(self, window: int = WINDOW):
        self.window, self.left, self.done = window, np.zeros(0, np.int64), []

    def add(self, pcm: np.ndarray) -> None:
        both = np.concatenate([self.left, pcm])
        n = len(both) // self.window * self.window
        if n:
            self.done.append(media.envelope(both[:n], self.window))
        self.left = both[n:]

    def envelope(self) -> np.ndarray:
        return np.concatenate([np.zeros(0), *self.done])


def lengths(sound: DataFrame) -> DataFrame:
    """item_id, total (samples)."""
    return sound.groupBy("item_id").agg(F.sum(F.size("pcm")).cast("long").alias("total"))


def points(pairs: DataFrame, sizes: DataFrame, n: int = POINTS, stretch: float = STRETCH, reach: float = REACH, reach_of: float = REACH_OF, retries: int = RETRIES, rate: int = RATE) -> DataFrame:
    """a_id, b_id, point, a_total, b_total, at (sample of the first stretch), a_stop (where the last try would end)."""
    side = lambda p: sizes.select(c("item_id").alias(f"{p}_id"), c("total").alias(f"{p}_total"))
    both = pairs.select("a_id", "b_id").distinct().join(side("a"), "a_id").join(side("b"), "b_id").where("a_total > 0 and b_total > 0")
    share = (2 * c("point") + 1) / (2 * n)
    rows = both.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("at", F.floor(c("a_total") * share))
    return rows.withColumn("a_stop", F.least("a_total", c("at") + int(stretch * rate) * (retries + 1)))


_KEY = ["a_id", "b_id", "point"]


def _chunks(rows: DataFrame, sound: DataFrame, item: str, start: str, stop: str, samples: int) -> DataFrame:
    """rows with each chunk that has samples from start to before stop: chunk, pcm."""
    number = F.sequence(F.floor(c(start) / samples), F.floor((F.greatest(c(stop), c(start) + 1) - 1) / samples))
    return rows.withColumn("chunk", F.explode(number)).join(sound.select(c("item_id").alias(item), c("chunk").cast("long").alias("chunk"), "pcm"), [item, "chunk"])


def _pcm(group: pa.Table) -> np.ndarray:
    return group.column("pcm").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _needles(told: DataFrame, sound: DataFrame, samples: int, stretch: float, retries: int, rate: int, window: int) -> DataFrame:
    """For each point the stretch that is looked for (at, needle): the first that isn't quiet, or the last that there is or is tried."""
    n = int(stretch * rate)

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("chunk")
        first = group.column("chunk")[0].as_py() * samples
        at, total, pcm = group.column("at")[0].as_py(), group.column("a_total")[0].as_py(), _pcm(group)
        for k in range(retries + 1):
            needle = pcm[at - first : min(at + n, total) - first]
            if k == retries or not media.quiet(needle, window) or at + 2 * n > total:
                break
            at += n
        return pa.table({x: group.column(x).slice(0, 1) for x in _KEY} | {"b_total": group.column("b_total").slice(0, 1), "a_total": group.column("a_total").slice(0, 1), "at": [at], "needle": pa.array([needle.tolist()], pa.list_(pa.int32()))})

    kinds = dict(told.dtypes)
    schema = ", ".join(f"{x} {kinds[x]}" for x in _KEY) + ", b_total long, a_total long, at long, needle array<int>"
    return _chunks(told, sound, "a_id", "at", "a_stop", samples).groupBy(*_KEY).applyInArrow(run, schema)


def _envelopes(needles: DataFrame, sound: DataFrame, samples: int, window: int) -> DataFrame:
    """For each point the loudness of the stretch that is searched (start to stop of b), chunk by chunk."""
    kinds = dict(needles.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, loud = None, Loudness(window)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(key, types)] + [pa.array([loud.envelope().tolist()], pa.list_(pa.float64()))], names=[*_KEY, "envelope"])

        types: list[pa.DataType] = []
        for batch in batches:
            types = [batch.column(x).type for x in _KEY]
            rows = zip(*(batch.column(x).to_pylist() for x in (*_KEY, "chunk", "start", "stop")))
            flat, edges = batch.column("pcm").flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(batch.column("pcm").value_lengths().to_numpy())])
            for i, (a, b, p, chunk, start, stop) in enumerate(rows):
                if (a, b, p) != key:
                    if key is not None:
                        yield out()
                    key, loud = (a, b, p), Loudness(window)
                first = chunk * samples
                loud.add(flat[edges[i] : edges[i + 1]][max(0, start - first) : max(0, stop - first)])
        if key is not None:
            yield out()

    n = needles.sparkSession.conf.get("spark.sql.shuffle.partitions")
    rows = _chunks(needles.select(*_KEY, "start", "stop"), sound, "b_id", "start", "stop", samples)
    ordered = rows.repartition(int(n), *_KEY).sortWithinPartitions(*_KEY, "chunk").select(*_KEY, "chunk", "start", "stop", "pcm")
    return ordered.mapInArrow(run, ", ".join(f"{x} {kinds[x]}" for x in _KEY) + ", envelope array<double>")


def compared(pairs: DataFrame, sound: DataFrame, samples: int, n: int = POINTS, stretch: float = STRETCH, reach: float = REACH, reach_of: float = REACH_OF, retries: int = RETRIES, rate: int = RATE, window: int = WINDOW) -> DataFrame:
    """A row for each point of each pair (a_id, b_id): point, at_s (of the stretch), score, spectral, speed, found_s (in the other).

    Recordings without sound have no points. A stretch that is found nowhere has score and spectral 0, speed 1, found_s null.
    """
    told = points(pairs, lengths(sound), n, stretch, reach, reach_of, retries, rate)
    needles = _needles(told, sound, samples, stretch, retries, rate, window)
    wide = F.greatest(F.lit(reach * rate), c("b_total") * reach_of)
    start = F.greatest(F.lit(0), F.floor(c("at") * c("b_total") / c("a_total") - wide))
    needles = written(needles.withColumn("start", start.cast("long")).withColumn("stop", F.least(c("b_total"), F.floor(c("start") + 2 * wide)).cast("long")), "needles")
    loud = _envelopes(needles, sound, samples, window)
    tries = media.speeds()

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [media.best_match(media.envelope(np.asarray(x or [], np.int64), window), np.asarray(y or []), tries) for x, y in zip(b.column("needle").to_pylist(), b.column("envelope").to_pylist())]
            cols = [b.column(x) for x in (*_KEY, "at", "start", "stop", "needle")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([s for s, _, _ in found], pa.float64()), pa.array([o for _, o, _ in found], pa.int64()), pa.array([v for *_, v in found], pa.float64())], names=[*_KEY, "at", "start", "stop", "needle", "score", "offset", "speed"])

    kinds = ", ".join(f"{x} {dict(needles.dtypes)[x]}" for x in _KEY)
    hits = needles.join(loud, _KEY, "left").select(*_KEY, "at", "start", "stop", "needle", "envelope").mapInArrow(match, f"{kinds}, at long, start long, stop long, needle array<int>, score double, offset long, speed double")
    hits = written(hits, "found")
    # the sound around the place: the stretch as fast as it was found, and a window to each side
    place = c("start") + c("offset") * window
    led = F.least(c("offset"), F.lit(1).cast("long"))
    near = hits.where("offset >= 0").withColumns({"led": led, "from": place - led * window, "upto": F.least(c("stop"), (place + F.ceil(F.size("needle") / c("speed")) + 2 * window).cast("long"))})

    def look(group: pa.Table) -> pa.Table:
        group = group.sort_by("chunk")
        one = {x: group.column(x)[0].as_py() for x in ("led", "speed", "from", "upto", "needle")}
        first = group.column("chunk")[0].as_py() * samples
        pcm, at = _pcm(group)[one["from"] - first : one["upto"] - first], one["led"]
        spectral = media.spectral_match(np.asarray(one["needle"], float), pcm, rate, at, one["speed"], window)
        return pa.table({x: group.column(x).slice(0, 1) for x in _KEY} | {"spectral": pa.array([spectral], pa.float64())})

    chunks = _chunks(near, sound, "b_id", "from", "upto", samples)
    alike = chunks.groupBy(*_KEY).applyInArrow(look, f"{kinds}, spectral double")
    out = hits.drop("needle").join(alike, _KEY, "left")
    return out.select(*_KEY, (c("at") / rate).alias("at_s"), "score", F.coalesce("spectral", F.lit(0.0)).alias("spectral"), "speed", F.when(c("offset") >= 0, (c("start") + c("offset") * window) / rate).alias("found_s"))


def verdicts(rows: DataFrame) -> DataFrame:
    """a_id, b_id, points, heard, found, median, spectral_median, speed (median of found points), verdict, of compared()."""
    heard = c("score") >= media.HEARD
    found = heard & (c("spectral") >= media.ALIKE)
    g = rows.groupBy("a_id", "b_id").agg(F.count(F.lit(1)).alias("points"), F.count_if(heard).alias("heard"), F.count_if(found).alias("found"), F.median("score").alias("median"), F.median("spectral").alias("spectral_median"), F.median(F.when(found, c("speed"))).alias("speed"))
    return g.withColumn("verdict", media.compare_verdict(c("points"), c("heard"), c("found"), c("median")))
