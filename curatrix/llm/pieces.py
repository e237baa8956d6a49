"""SentencePiece encoding and decoding over a table of distinct chunks.

In the vocabularies served here no piece has a white-space marker after another character (checked when the model is
loaded), so a merge never crosses the start of a marked word: a text is a sequence of chunks, each a run of markers with
the characters that follow. Each batch keeps a table of its distinct chunks, segments every one of them once with the
library, and joins the ids back to the texts by position with array gathers. The table belongs to a task and is bounded
(``table_chunks``); there is no shuffle, and a lost task is simply run again.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType

from curatrix.llm.common import tidied

_MARK = "▁"
_LOADED: dict[str, "ChunkEncoder"] = {}


class ChunkEncoder:
    """One model in one process."""

    def __init__(self, model: str, table_chunks: int = 150_000, block_chars: int = 1_000_000):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=model)
        self.table_chunks, self.block_chars = table_chunks, block_chars
        n = self.processor.get_piece_size()
        names = [self.processor.id_to_piece(i) for i in range(n)]
        self.splits = not any(_MARK in p.lstrip(_MARK) for p in names)
        # a model that rewrites text or drops spaces must see the whole text
        probe = "  a Ａ é \tb  "
        self.plain = self.splits and self.processor.decode(self.processor.encode(probe)) == probe and names[self.processor.encode("a")[0]].startswith(_MARK)
        surface = []
        for i, p in enumerate(names):
            if self.processor.is_byte(i):
                surface.append(bytes([int(p[1:-1], 16)]))
            elif self.processor.is_control(i):
                surface.append(b"")
            elif self.processor.is_unknown(i):
                surface.append(" ⁇ ".encode())
            else:
                surface.append(p.replace(_MARK, " ").encode())
        self.surface = pa.array(surface, pa.large_binary())
        self.marked = np.array([p.startswith(_MARK) for p in names])
        self.table: dict[str, int] = {}
        self.forget()

    def forget(self) -> None:
        self.table.clear()
        self.flat, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, chunks: list[str]) -> None:
        """Segments chunks that the table lacks; the library adds a chunk's first marker itself."""
        ids = self.processor.encode(chunks, num_threads=1)
        if "" in chunks:  # the library adds no marker to an empty text
            ids[chunks.index("")] = [self.processor.piece_to_id(_MARK)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes, self.flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, flat])
        self.table.update(zip(chunks, range(len(self.table), len(self.table) + len(chunks))))

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids, and the number of ids of each text."""
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not self.plain:
            ids = self.processor.encode(column.to_pylist(), num_threads=1)
            return np.fromiter(chain.from_iterable(ids), np.int32), np.fromiter(map(len, ids), np.int64, len(ids))
        if len(self.table) > self.table_chunks:
            self.forget()
        distinct, place, per_text = self._chunks(column)
        table = self.table
        new = [c for c in distinct if c not in table]
        if new:
            self._learn(new)
        codes = np.fromiter(map(table.__getitem__, distinct), np.int64, len(distinct))[place]
        sizes = self.sizes[codes]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.starts[codes] - (ends - sizes), sizes) + np.arange(total)
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)])]
        return self.flat[at], np.diff(bounds)

    @staticmethod
    def _chunks(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct chunks without their first marker, the chunk at each place of all texts, and the number for each text.

        A chunk is a marker, or a run of them, with the characters that follow; at the end of a text a run of markers alone.
        """
        parts = pc.split_pattern(pc.replace_substring(column, _MARK, " "), " ")
        flat, offsets = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        coded = flat.dictionary_encode()
        distinct, place = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        empty = place == distinct.index("") if "" in distinct else np.zeros(len(place), bool)
        if not empty.any():
            return distinct, place, np.diff(offsets)
        # an empty part is a marker that another one follows, or that ends its text; a text of one empty part is empty
        last = np.zeros(len(place), bool)
        last[offsets[1:] - 1] = True
        keep = ~empty | (last & (np.repeat(np.diff(offsets), np.diff(offsets)) > 1))
        first = np.repeat(offsets[:-1], np.diff(offsets))
        full = np.maximum(np.maximum.accumulate(np.where(empty, -1, np.arange(len(place)))), first - 1)
        run = np.arange(len(place)) - 1 - np.concatenate([[-1], np.maximum(full[:-1], first[1:] - 1)])  # empty parts just before
        odd = np.nonzero(keep & ((run > 0) | empty))[0]
        number = {c: i for i, c in enumerate(distinct)}
        place = place.copy()
        for i, n in zip(odd.tolist(), run[odd].tolist()):
            place[i] = number.setdefault(_MARK * n + ("" if empty[i] else distinct[place[i]]), len(number))
        counts = np.concatenate([[0], np.cumsum(keep)])[offsets]
        return list(number), place[keep], np.diff(counts)

    def decode(self, flat: np.ndarray, sizes: np.ndarray) -> list[str] | pa.Array:
        """Texts of id lists, as the library's decode gives them."""
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        taken = self.surface.take(pa.array(flat))
        if not len(flat):
            return [""] * len(sizes)
        ends = np.frombuffer(taken.buffers()[1], np.int64)[offsets]  # bytes of consecutive pieces lie side by side
        data = taken.buffers()[2].to_pybytes()
        led = np.zeros(len(sizes), bool)
        led[sizes > 0] = self.marked[flat[offsets[:-1][sizes > 0]]]
        out = []
        for i, strip in enumerate(led):
            try:
                out.append(data[ends[i] + strip : ends[i + 1]].decode())
            except UnicodeDecodeError:  # a run of byte pieces that is no text
                out.append(self.processor.decode(flat[offsets[i] : offsets[i + 1]].tolist()))
        return out


def encoder(model: str, table_chunks: int = 150_000) -> ChunkEncoder:
    """The encoder of this process for a model file."""
    if model not in _LOADED:
        _LOADED[model] = ChunkEncoder(model, table_chunks)
    return _LOADED[model]


def _blocks(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes, or of one row."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False) if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else np.diff(column.offsets.to_numpy()) * 4
    ends, start, first = np.cumsum(sizes), 0, 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(ends, start + limit, "right")))
        yield first, last
        start, first = int(ends[last - 1]), last


def _resolve(model: str) -> str:
    """A path stays; a bare file name is one of the installed public vocabularies."""
    if "/" in model:
        return model
    import public_tokenizers

    return public_tokenizers.path(model)


def encode(docs: DataFrame, model: str = "piece_bpe_32k.model", text_col: str = "text", to: str = "ids") -> DataFrame:
    """docs with the column ``to``: array<int>, the ids of the whole text, no begin or end ids.

    Null and empty texts give an empty array, long texts are encoded whole, equal rows alike; an empty table gives an empty
    one. An existing column named ``to`` is replaced. model: a path that every executor has, or the name of an installed
    vocabulary.
    """
    kept = [c for c in docs.columns if c != to]
    schema = docs.select(*kept).schema.add(to, ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(_resolve(model))
        for whole in batches:
            at = whole.schema.names.index(text_col)
            for a, b in _blocks(whole.column(at), enc.block_chars):
                batch = whole.slice(a, b - a)
                flat, sizes = enc.encode(batch.column(at))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)) for c in kept), lists], names=[*kept, to])

    return docs.select(*docs.columns).mapInArrow(tidied(run, lambda: encoder(_resolve(model)).forget()), schema)


def decode(rows: DataFrame, model: str = "piece_bpe_32k.model", ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """rows with the column ``to``: the text of the ids; a null or empty array gives the empty text."""
    kept = [c for c in rows.columns if c != to]
    schema = rows.select(*kept).schema.add(to, StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(_resolve(model))
        for whole in batches:
            at = whole.schema.names.index(ids_col)
            for a, b in _blocks(whole.column(at), enc.block_chars):
                batch = whole.slice(a, b - a)
                ids = batch.column(at)
                sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                texts = enc.decode(ids.flatten().to_numpy(zero_copy_only=False), sizes)
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)) for c in kept), pa.array(texts, pa.string())], names=[*kept, to])

    return rows.mapInArrow(tidied(run), schema)
