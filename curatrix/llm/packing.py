"""Best-fit packing into bins of several permitted lengths.

Pieces of documents go into bins. Best fit puts a piece, largest first, where the least room is left over; if it fits
nowhere, a bin opens at the permitted length with the least cost: the padding that pieces of the sizes still to come are
expected to leave, plus a fixed cost for a sequence. When all is placed, each bin is downsized to the least permitted length
that holds its contents. So the lengths are chosen jointly, by what there is to pack.

A plan needs lengths only: ``best_fit`` says where each piece of a document's token ids goes, and moves no text.
``sequences`` packs the ids themselves and returns a row for each bin, with its ids. Rows are dealt by hash into shards of
about ``SHARD_TOKENS`` tokens, each packed in one task. A document longer than the largest length is cut into pieces of that
length and a rest.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import tidied, written
from curatrix.llm.pieces import _blocks, _resolve, encoder

#: Permitted sequence lengths, and what a sequence costs beside its tokens, in tokens.
LENGTHS = (512, 1024, 2048, 4096)
SEQUENCE_COST = 16
#: Tokens that one task packs together, about.
SHARD_TOKENS = 2_000_000


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, cost: int = SEQUENCE_COST) -> tuple[list[int], list[int], list[int]]:
    """For each piece its bin and its start in it; for each bin its length. Sizes are from 1 to the largest length."""
    lengths = tuple(sorted(set(lengths)))
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    bins, starts = [0] * len(sizes), [0] * len(sizes)
    filled: list[int] = []
    room: list[tuple[int, int]] = []  # free tokens and bin, rising
    left, pieces = sum(sizes), len(sizes)
    for i in order:
        n = sizes[i]
        at = bisect_left(room, (n, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            # what a bin of each length would leave: room that pieces like those to come can't fill
            typical = max(1, (left - n) // max(1, pieces - 1)) if pieces > 1 else 0

            def waste(length: int) -> float:
                rest = length - n
                unfilled = rest % typical if 0 < typical and left - n >= rest else max(0, rest - (left - n))
                return (unfilled + cost) / (length - unfilled)

            free = min((x for x in lengths if x >= n), key=lambda x: (waste(x), x))
            b = len(filled)
            filled.append(0)
        bins[i], starts[i] = b, filled[b]
        filled[b] += n
        left, pieces = left - n, pieces - 1
        if free > n:
            insort(room, (free - n, b))
    return bins, starts, [next(x for x in lengths if x >= f) for f in filled]


def token_counts(docs: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens: how many ids the SentencePiece encoder gives each whole text; 0 for null and empty ones.

    Each row counts by itself, repeated ones too; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(_resolve(model))
        for whole in batches:
            for a, b in _blocks(whole.column(1), enc.block_chars):
                part = whole.slice(a, b - a)
                sizes = enc.encode(part.column(1))[1]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidied(run), "doc_id long, n_tokens long")


def _cut(sizes: np.ndarray, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of documents with so many tokens: the row of each, its start and its tokens."""
    pieces = -(-sizes // largest)
    row = np.repeat(np.arange(len(sizes)), pieces)
    start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * largest
    return row, start, np.minimum(largest, sizes[row] - start)


def _dealt(rows: DataFrame, size: str, shard_tokens: int) -> DataFrame:
    """rows (of a written table) with a shard; equal rows are told apart by their place in the table."""
    total = rows.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", size, F.monotonically_increasing_id()), F.lit(max(1, -(-total // shard_tokens)))))


def best_fit(docs: DataFrame, size_col: str = "n_tokens", id_col: str = "doc_id", lengths: tuple[int, ...] = LENGTHS, cost: int = SEQUENCE_COST, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row for each piece: doc_id, piece, piece_start, piece_tokens, shard, bin, bin_length, bin_start.

    Pieces of a document are numbered from 0 and cover its tokens once, in order. A document without tokens (0, negative
    or null size) has one piece of 0 tokens, in no bin (bin, bin_length and bin_start null). Null and repeated ids and rows
    are packed like others, rows of one shard going by size, then id. Other columns of docs play no part. An empty table
    gives an empty result.
    """
    largest = max(lengths)
    base = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.greatest(F.coalesce(F.col(size_col).cast("long"), F.lit(0)), F.lit(0)).alias("n")), "token-counts")

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("n", "ascending"), ("doc_id", "ascending")])
        row, start, size = _cut(group.column("n").to_numpy(), largest)
        bins, at, length = pack(size.tolist(), lengths, cost)
        return pa.table(
            {
                "doc_id": group.column("doc_id").take(pa.array(row)), "piece": pa.array(start // largest), "piece_start": pa.array(start), "piece_tokens": pa.array(size),
                "shard": group.column("shard").take(pa.array(row)), "bin": pa.array(bins, pa.int64()), "bin_length": pa.array(np.array(length, np.int64)[bins]), "bin_start": pa.array(at, pa.int64()),
            }
        )

    packed = _dealt(base.where("n > 0"), "n", shard_tokens).groupBy("shard").applyInArrow(run, "doc_id long, piece long, piece_start long, piece_tokens long, shard long, bin long, bin_length long, bin_start long")
    none = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    return packed.unionByName(base.where("n = 0").select("doc_id", zero.alias("piece"), zero.alias("piece_start"), zero.alias("piece_tokens"), none.alias("shard"), none.alias("bin"), none.alias("bin_length"), none.alias("bin_start")))


def sequences(docs: DataFrame, ids_col: str = "ids", id_col: str = "doc_id", lengths: tuple[int, ...] = LENGTHS, cost: int = SEQUENCE_COST, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row for each bin: shard, bin, bin_length, n_tokens, ids (its token ids, without padding), doc_ids and starts (of the
    pieces in it: whose they are, and where in ids each begins).

    docs: an id and an array of token ids. A document without tokens (null or empty array) is in no bin: it has a row of its
    own, with a null shard, bin and bin_length. Null ids and repeated rows are packed like others. An empty table gives an
    empty result.
    """
    largest = max(lengths)
    base = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"), F.greatest(F.coalesce(F.size(F.col(ids_col)), F.lit(0)), F.lit(0)).cast("long").alias("n")), "token-ids")

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("n", "ascending"), ("doc_id", "ascending")]).combine_chunks()
        sizes = group.column("n").to_numpy()
        flat = group.column("ids").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        row, start, size = _cut(sizes, largest)
        bins, at, length = (np.array(x, np.int64) for x in pack(size.tolist(), lengths, cost))
        order = np.lexsort((at, bins))
        first = (np.cumsum(sizes) - sizes)[row[order]] + start[order]
        size, ends = size[order], np.cumsum(size[order])
        taken = flat[np.repeat(first - (ends - size), size) + np.arange(int(ends[-1]))]
        pieces = np.concatenate([[0], np.cumsum(np.bincount(bins, minlength=len(length)))])
        tokens = np.concatenate([[0], ends])[pieces]
        listed = lambda offsets, values: pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), values)
        return pa.table(
            {
                "shard": pa.array(np.full(len(length), group.column("shard")[0].as_py())), "bin": pa.array(np.arange(len(length))), "bin_length": pa.array(length), "n_tokens": pa.array(np.diff(tokens)),
                "ids": listed(tokens, pa.array(taken, pa.int32())).cast(pa.list_(pa.int32())), "doc_ids": listed(pieces, group.column("doc_id").combine_chunks().take(pa.array(row[order]))).cast(pa.list_(pa.int64())),
                "starts": listed(pieces, pa.array(at[order])).cast(pa.list_(pa.int64())),
            }
        )

    packed = _dealt(base.where("n > 0"), "n", shard_tokens).groupBy("shard").applyInArrow(run, "shard long, bin long, bin_length long, n_tokens long, ids array<int>, doc_ids array<long>, starts array<long>")
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    return packed.unionByName(base.where("n = 0").select(none.alias("shard"), none.alias("bin"), none.alias("bin_length"), zero.alias("n_tokens"), F.array().cast("array<int>").alias("ids"), F.array("doc_id").alias("doc_ids"), F.array(zero).alias("starts")))
