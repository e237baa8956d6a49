"""Context-triggered piecewise hashing.

A rolling hash over seven bytes cuts a text where it hits a value that depends on the block size; each chunk gives one
character of the signature. The block size is the smallest of 3 * 2^k at which about 64 chunks are expected, halved while
the signature is short; the signature at twice the block size is kept too, so that texts of up to twice the length can be
compared. Likeness is one less the edit distance over the longer length, at a block size that both have; the best
of those counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 64
LEAST_BLOCK = 3
WINDOW = 7
_ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the last seven bytes at every position (fewer at the start)."""
    h = np.zeros(len(data), np.uint32)
    wide = data.astype(np.uint32) + np.uint32(1)
    factor = 1
    for k in range(min(WINDOW, len(data))):
        h[k:] += wide[: len(data) - k] * np.uint32(factor)
        factor = factor * 0x01000193 & 0xFFFFFFFF
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h ^ (h >> np.uint32(12))


def _signature(roll: np.ndarray, prefix: np.ndarray, hits: np.ndarray, block: int) -> str:
    """One character for each chunk; what follows the 63rd boundary is the last chunk."""
    cuts = hits[roll[hits] % np.uint32(block) == block - 1] + 1
    cuts = cuts[: LENGTH - 1]
    if not len(cuts) or cuts[-1] < len(roll):
        cuts = np.append(cuts, len(roll))
    ends = prefix[cuts]
    sums = np.diff(ends, prepend=np.uint64(0))
    sums = (sums ^ (sums >> np.uint64(29))) * _ODD
    return _ALPHABET[(sums >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(text: str | None) -> str:
    """``block:signature:signature at twice the block``; of null and empty texts ``3::``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return f"{LEAST_BLOCK}::"
    data = np.frombuffer(raw, np.uint8)
    roll = _rolling(data)
    # a chunk's hash is the sum of a mix of its seven-byte windows
    mix = roll.astype(np.uint64) * _ODD
    prefix = np.concatenate([[np.uint64(0)], np.cumsum(mix ^ (mix >> np.uint64(31)), dtype=np.uint64)])
    hits = np.nonzero(roll % np.uint32(LEAST_BLOCK) == LEAST_BLOCK - 1)[0]  # a boundary at any larger size is one at 3
    block = LEAST_BLOCK
    while block * LENGTH < len(data):
        block *= 2
    while True:
        one = _signature(roll, prefix, hits, block)
        if block == LEAST_BLOCK or len(one) >= LENGTH // 2:
            return f"{block}:{one}:{_signature(roll, prefix, hits, 2 * block)}"
        block //= 2


def distances(left: list[str], right: list[str]) -> np.ndarray:
    """Edit distances of pairs of short strings, all rows of the table at once."""
    if not left:
        return np.zeros(0, np.int64)
    n, m = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    a = np.array(left, dtype=f"S{max(1, n.max())}").view(np.uint8).reshape(len(left), -1)
    b = np.array(right, dtype=f"S{max(1, m.max())}").view(np.uint8).reshape(len(left), -1)
    steps = np.arange(b.shape[1] + 1, dtype=np.int16)
    row = np.broadcast_to(steps, (len(left), len(steps))).copy()
    out = np.where(n == 0, m, 0)
    for i in range(a.shape[1]):
        t = np.empty_like(row)
        t[:, 0] = i + 1
        np.minimum(row[:, 1:] + np.int16(1), row[:, :-1] + (a[:, i : i + 1] != b), out=t[:, 1:], casting="unsafe")
        row = np.minimum.accumulate(t - steps, axis=1) + steps  # insertions
        ended = np.nonzero(n == i + 1)[0]
        out[ended] = row[ended, m[ended]]
    return out


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """Of fingerprints, pairwise, from 0 to 1; 0 where no block size is compatible, 1 for equal fingerprints."""
    pairs, of, out = ([], []), [], np.zeros(len(left))
    for k, (x, y) in enumerate(zip(left, right)):
        if x == y:
            out[k] = 1.0
            continue
        (p, p1, p2), (q, q1, q2) = x.split(":"), y.split(":")
        p, q = int(p), int(q)
        for s, t in [(p1, q1), (p2, q2)] if p == q else [(p2, q1)] if 2 * p == q else [(p1, q2)] if p == 2 * q else []:
            if s and t:
                pairs[0].append(s), pairs[1].append(t), of.append(k)
    for a in range(0, len(of), 8192):
        s, t = pairs[0][a : a + 8192], pairs[1][a : a + 8192]
        d = distances(s, t)
        size = np.maximum([len(x) for x in s], [len(x) for x in t])
        np.maximum.at(out, of[a : a + 8192], 1 - d / size)
    return out


def with_fingerprint(docs: DataFrame, text_col: str = "text", to: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of every whole text."""
    made = F.pandas_udf(lambda s: pd.Series([fingerprint(t) for t in s], dtype=object), "string")
    return docs.withColumn(to, made(F.col(text_col)))


def ring(docs: DataFrame, slices: int, id_col: str = "doc_id") -> DataFrame:
    """docs in slices of consecutive ids, each followed by the first row of the next one.

    Adds _slice and _guest (true for that repeated row); the first row of all follows the last slice. Within a slice, rows
    are to be read by (_guest, id, text). Slices follow quantiles of the ids; a null id comes before all others. Only the
    bounds and the first id of each slice reach the driver.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    cuts = sorted(set(docs.select(F.col(id_col).cast("double").alias("_key")).approxQuantile("_key", [i / slices for i in range(1, slices)], 0.25 / slices))) if slices > 1 else []
    cut = np.array(cuts)
    found = F.pandas_udf(lambda s: pd.Series(np.searchsorted(cut, s.to_numpy(), "right").astype(np.int32)), "int")
    keyed = docs.withColumn("_key", key).withColumn("_at", found(F.col("_key")))
    firsts = sorted((r["_at"], r["_key"]) for r in keyed.groupBy("_at").agg(F.min("_key").alias("_key")).collect())
    follows = [(first, firsts[k - 1][0]) for k, (_, first) in enumerate(firsts)]  # the slice before each, in a ring
    guests = docs.sparkSession.createDataFrame(follows, "_key long, _before int")
    own = F.struct(F.col("_at").alias("_slice"), F.lit(False).alias("_guest"))
    sent = F.when(F.col("_before").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("_before").alias("_slice"), F.lit(True).alias("_guest"))))
    copies = keyed.join(F.broadcast(guests), "_key", "left").withColumn("_copies", sent)  # a row for each slice
    return copies.select(*docs.columns, F.explode("_copies").alias("_c")).select(*docs.columns, "_c._slice", "_c._guest")


def compare_edits(docs: DataFrame, slices: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one with the next id (rows that share an id go by text), after the last the first; a sole
    document follows itself. Texts cross the network once, sorted into slices of consecutive ids, and are read in a stream.
    Null texts count as empty, long ones are read whole, repeated rows are documents of their own; other columns are left out,
    whatever they are called. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    slices = slices or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts, slices = slices, 4 * slices
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = ring(base, slices).repartition(parts, "_slice").sortWithinPartitions("_slice", "_guest", F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, []  # the row before, waiting for its follower

        def emit() -> pa.RecordBatch:
            cols = list(zip(*rows))
            rows.clear()
            near = likeness(cols[3] + cols[3], cols[4] + cols[5])
            n = len(cols[0])
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string()), pa.array(near[:n]), pa.array(near[n:])], names=["doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        size = 0
        for batch in batches:
            for doc_id, text, at, guest in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held and held[2] == at and not held[3]:
                    print_ = fingerprint(text)
                    before = held[1]
                    half = len(before) // 2
                    edited = before[: len(before) - half] + text[:half]
                    rows.append((held[0], len(before), edited, held[4], fingerprint(edited), print_))
                    size += len(edited)
                    held = (doc_id, text, at, guest, print_)
                elif not (held and guest and held[2] == at):  # of several guests only the first counts
                    held = (doc_id, text, at, guest, fingerprint(text))
                if size > 8_000_000:
                    size = 0
                    yield emit()
        if rows:
            yield emit()

    return dealt.select("doc_id", "text", "_slice", "_guest").mapInArrow(run, "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
