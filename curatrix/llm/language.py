"""Language identification as multilingual mixture inference.

Each language has a character trigram model, counted from a bounded sample of labelled documents. A document is a mixture
of languages: expectation-maximisation estimates their proportions from the words' trigram likelihoods. The language set
is chosen by penalised likelihood: the mixtures of the k most likely languages, for every k, are compared by
log-likelihood less half the logarithm of the number of words for each further language. The prediction is the language
with the largest proportion in the set that wins.

Scoring keeps nothing but the trigram tables (languages x 2^16 numbers) in a task; words are scored once for each block
of texts, and documents of a block share the array operations of each step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, MapType, StringType

#: Hash buckets of trigrams in each language's table.
BUCKETS = 1 << 16
#: Labelled documents of each language that are counted, about: those whose hashed ids are under a bound.
SAMPLE_DOCS = 3000
UNKNOWN = "und"
_PAD = np.uint32(0x20)


def _trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every trigram of the lower-cased words, each word between two marks, and the number for each word."""
    joined = "  ".join(["", *(w.lower() for w in words), ""])  # two spaces before, between and after the words
    code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    sizes = np.fromiter((len(w.lower()) for w in words), np.int64, len(words))
    a, b, c = code[:-2], code[1:-1], code[2:]
    h = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA6B)) ^ (c * np.uint32(0xC2B2AE35))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    keep = (b != _PAD) | (c != _PAD)  # a trigram that ends in the second mark after a word says nothing new
    return (h & np.uint32(BUCKETS - 1))[keep].astype(np.int64), sizes + 1


def _words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words (runs of letters) of the texts, each occurrence's word, and the number of occurrences by text."""
    runs = pc.split_pattern_regex(pc.replace_substring_regex(pc.fill_null(texts, ""), r"^\P{L}+|\P{L}+$", ""), r"\P{L}+")
    flat = runs.flatten()
    sizes = np.diff(runs.offsets.to_numpy()).astype(np.int64)
    full = np.asarray(pc.greater(pc.binary_length(flat), 0)).astype(bool)
    if not full.all():  # a text without letters splits into one empty word
        sizes[sizes == 1] = full[(np.cumsum(sizes) - sizes)[sizes == 1]]
        flat = flat.filter(pa.array(full))
    coded = flat.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), sizes


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and log-probabilities of trigram buckets, languages x BUCKETS.

    Counts about sample_docs whole documents of each language; rows with a null language teach nothing. What reaches the driver
    is at most one number for each language and bucket.
    """
    known = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row for each language
    part = [F.when(F.col("lang") == x, F.lit(sample_docs / n)) for x, n in sizes.items()] or [F.lit(0.0)]
    picked = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.coalesce(*part) * (1 << 30)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lang in sorted(set(langs)):
                rows = batch.column(1).filter(pa.array([x == lang for x in langs]))
                words, codes, _ = _words(rows)
                if not words:
                    continue
                grams, sizes = _trigrams(words)
                n = np.bincount(grams, np.repeat(np.bincount(codes, minlength=len(words)), sizes), BUCKETS)
                at = np.nonzero(n)[0]
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "at": pa.array(at, pa.int32()), "n": pa.array(n[at].astype(np.int64))})

    rows = picked.mapInArrow(count, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(rows.column("lang").to_pylist()))
    table = np.full((len(langs), BUCKETS), 0.02)
    if langs:
        of = {x: i for i, x in enumerate(langs)}
        table[[of[x] for x in rows.column("lang").to_pylist()], rows.column("at").to_numpy()] += rows.column("n").to_numpy()
    return langs, np.log(table / np.maximum(table.sum(1, keepdims=True), 1e-9)).astype(np.float32)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows, none of the sizes being 0."""
    return np.add.reduceat(values, np.cumsum(sizes) - sizes, axis=0) if len(sizes) else np.zeros((0, *values.shape[1:]), values.dtype)


def _mixture(like: np.ndarray, sizes: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions by expectation-maximisation within each document's allowed languages, and the log-likelihood."""
    share = allowed / allowed.sum(1, keepdims=True)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    n = sizes[:, None].astype(np.float32)
    for _ in range(rounds):
        part = like * share[doc]
        part /= part.sum(1, keepdims=True)
        share = _sums(part, sizes) / n
    total = np.log(np.maximum((like * share[doc]).sum(1), 1e-30)).astype(np.float64)
    return share, _sums(total, sizes)


def infer(texts: pa.Array, langs: list[str], table: np.ndarray, rounds: int = 12) -> tuple[list[str], np.ndarray, list[dict[str, float]]]:
    """For each text the predicted language, its proportion, and all proportions of the set that wins."""
    words, codes, sizes = _words(texts)
    pred, score, mix = [UNKNOWN] * len(texts), np.zeros(len(texts)), [{} for _ in range(len(texts))]
    rows = np.nonzero(sizes)[0]
    if not len(rows) or not langs:
        return pred, score, mix
    grams, per_word = _trigrams(words)
    logs = np.stack([_sums(t[grams], per_word) for t in table], 1)
    top = logs.max(1, keepdims=True)
    ratio = np.exp(np.maximum(logs - top, -40)).astype(np.float32)
    sizes, k = sizes[rows], len(langs)
    like = ratio[codes]
    share, best = _mixture(like, sizes, np.ones((len(rows), k), np.float32), rounds)
    best -= (k - 1) * 0.5 * np.log(sizes)
    ranked = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1)
    doc = np.repeat(np.arange(len(rows)), sizes)
    for few in range(k - 1, 0, -1):
        allowed = (ranked < few).astype(np.float32)
        if few == 1:
            one = _sums(np.log((like * allowed[doc]).max(1) + 1e-30).astype(np.float64), sizes)
            s, total = allowed, one
        else:
            s, total = _mixture(like, sizes, allowed, max(4, rounds // 2))
        total = total - (few - 1) * 0.5 * np.log(sizes)
        won = total >= best
        share[won], best[won] = s[won], total[won]
    first = share.argmax(1)
    for i, r in enumerate(rows):
        pred[r], score[r] = langs[first[i]], min(1.0, float(share[i, first[i]]))
        mix[r] = {langs[j]: float(share[i, j]) for j in np.nonzero(share[i] > 0.005)[0]}
    return pred, score, mix


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", block_chars: int = 4_000_000) -> DataFrame:
    """docs with lang_pred, score and proportions (map<string,double>).

    A null text, a text without letters, and every text if nothing was learned, is ``und`` with score 0 and no
    proportions. Whole texts are read. Columns of docs with these names are replaced. Of languages with one proportion the
    first by name is told. A row that is repeated gets the same answer each time; an empty table gives an empty result. A
    very long text is a block of its own.
    """
    from curatrix.llm.pieces import _blocks

    langs, table = model
    sent = docs.sparkSession.sparkContext.broadcast((langs, table))  # languages x 2^16 numbers
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "proportions")]
    schema = docs.select(*kept).schema.add("lang_pred", StringType()).add("score", DoubleType()).add("proportions", MapType(StringType(), DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, logs = sent.value
        for whole in batches:
            at = whole.schema.names.index(text_col)
            for a, b in _blocks(whole.column(at), block_chars):
                batch = whole.slice(a, b - a)
                pred, score, mix = infer(batch.column(at), names, logs)
                maps = pa.array([list(m.items()) for m in mix], pa.map_(pa.string(), pa.float64()))
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)) for c in kept), pa.array(pred, pa.string()), pa.array(score), maps], names=[*kept, "lang_pred", "score", "proportions"])

    return docs.mapInArrow(run, schema)
