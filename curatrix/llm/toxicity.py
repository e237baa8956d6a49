"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as the sum of two views: a vector of its own (hashed) and the mean of the vectors of its character
trigrams. Both start from how much more often the word, or trigram, stands in toxic documents. The network reads windows of
``WINDOW`` words forwards and backwards, pools its states by attention and gives a logit. It is trained on a bounded sample
of labelled documents, each whole: of a toxic document on the window that looks worst among all (first by the starting
values, then to the network itself) and others that look bad, of a clean one on its worst and on others. A document's score
is a logistic function of the highest logit among all its overlapping windows and of their number, fitted on the same sample.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from curatrix.llm.common import tidied, written
from curatrix.llm.language import BUCKETS, _trigrams, _words
from curatrix.llm.pieces import _blocks

WINDOW, STRIDE = 32, 16
HIDDEN, WIDTH = 12, 8
#: Windows of one training step, and the steps that training takes at least.
BATCH, STEPS = 256, 200
#: Labelled documents that training reads, about, each whole.
TOXIC_DOCS, CLEAN_DOCS = 2000, 3000
#: Of the windows of each, all of which are scored, the worst that train; and the other windows of clean ones that do, about.
WORST, CLEAN_WINDOWS = 3, 4000
#: Characters of texts that a task takes at once, or one text.
BLOCK_CHARS = 1_000_000


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _features(words: list[str], at_once: int = 20_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word its own bucket, the buckets of its trigrams, and their number."""
    ids = np.fromiter((zlib.crc32(w.encode()) & (BUCKETS - 1) for w in words), np.int32, len(words))
    parts = [_trigrams(words[a : a + at_once]) for a in range(0, len(words), at_once)]
    grams = np.concatenate([g.astype(np.int32) for g, _ in parts]) if parts else np.zeros(0, np.int32)
    return ids, grams, np.concatenate([n for _, n in parts]) if parts else np.zeros(0, np.int64)


def _local(words: list[str], windows: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The words that windows have, and the windows with the numbers of those."""
    used, local = np.unique(windows, return_inverse=True)
    local = local.reshape(windows.shape)
    if used[0] != 0:
        used, local = np.concatenate([[0], used]), local + 1
    return [words[i - 1] for i in used[1:]], local


def _scattered(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by their places, of n."""
    w = rows.shape[1]
    where = at.astype(np.int64)[:, None] * w + np.arange(w)
    return np.bincount(where.ravel(), rows.ravel(), n * w).reshape(n, w).astype(rows.dtype)


class Network:
    """Parameters, forward and backward pass. Inputs are rows of word vectors; row 0 of a batch's vectors is padding."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        d, h = 2 * WIDTH, HIDDEN
        f = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"va": f(h), "Wa": f(2 * h, h), "ba": np.zeros(h, np.float32), "wo": f(2 * h), "bo": np.zeros(1, np.float32)}
        for way in "fb":
            self.p |= {f"W{way}": f(d, 3 * h), f"c{way}": np.zeros(3 * h, np.float32), f"U{way}": f(h, 2 * h), f"V{way}": f(h, h)}
        self.words = (0.05 * r.standard_normal((BUCKETS, WIDTH))).astype(np.float32)
        self.chars = (0.05 * r.standard_normal((BUCKETS, WIDTH))).astype(np.float32)

    def vectors(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        """A vector for padding and for each word; what the backward pass needs."""
        out = np.zeros((len(words) + 1, 2 * WIDTH), np.float32)
        ids, grams, sizes = _features(words)
        if words:
            out[1:, :WIDTH] = self.words[ids]
            out[1:, WIDTH:] = np.add.reduceat(self.chars[grams], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
        return out, (ids, grams, sizes)

    def logits(self, words: list[str], windows: np.ndarray, rows: int = 1024) -> np.ndarray:
        """Of all windows, some at a time; only the words of those get vectors."""
        out = []
        for a in range(0, len(windows), rows):
            own, local = _local(words, windows[a : a + rows])
            out.append(self.forward(self.vectors(own)[0], local)[0])
        return np.concatenate(out) if out else np.zeros(0, np.float32)

    def first_looks(self, words: list[str], windows: np.ndarray) -> np.ndarray:
        """The highest starting value of each window's words."""
        ids, grams, sizes = _features(words)
        value = np.zeros(len(words) + 1, np.float32)
        if words:
            value[1:] = self.words[ids, 0] + np.add.reduceat(self.chars[grams, 0], np.cumsum(sizes) - sizes) / sizes
        return np.where(windows > 0, value[windows], np.float32(-9)).max(1)

    def _read(self, x: np.ndarray, live: np.ndarray, way: str, keep: bool):
        """States of one direction, steps x rows x hidden. x: steps x rows x 3 hidden, inputs already weighted."""
        h, n = HIDDEN, x.shape[1]
        U, V = self.p[f"U{way}"], self.p[f"V{way}"]
        state, out, saved = np.zeros((n, h), np.float32), np.empty((len(x), n, h), np.float32), []
        for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
            zr = np.tanh((x[t, :, : 2 * h] + state @ U) * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)
            z, r = zr[:, :h], zr[:, h:]
            c = np.tanh(x[t, :, 2 * h :] + (r * state) @ V)
            m = live[t][:, None]
            after = state + m * z * (c - state)
            if keep:
                saved.append((t, state, z, r, c, m))
            out[t] = state = after
        return out, saved

    def forward(self, vectors: np.ndarray, windows: np.ndarray, keep: bool = False):
        """Logits of windows (rows x steps of vector numbers, 0: padding)."""
        p, steps = self.p, windows.T
        live = (steps > 0).astype(np.float32)
        ways = {}
        for way in "fb":
            weighted = vectors @ p[f"W{way}"] + p[f"c{way}"]  # once for each distinct word
            ways[way] = self._read(weighted[steps], live, way, keep)
        h = np.concatenate([ways["f"][0], ways["b"][0]], 2)
        a = np.tanh(h @ p["Wa"] + p["ba"])
        s = np.where(live > 0, a @ p["va"], -1e9)
        e = np.exp(s - s.max(0)) * live
        alpha = e / np.maximum(e.sum(0), 1e-9)
        pooled = (alpha[:, :, None] * h).sum(0)
        logit = pooled @ p["wo"] + p["bo"]
        return logit, (steps, live, ways, h, a, alpha, pooled, vectors) if keep else None

    def backward(self, error: np.ndarray, saved) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters and of the vectors, from the gradient of the logits."""
        p, hid = self.p, HIDDEN
        steps, live, ways, h, a, alpha, pooled, vectors = saved
        g = {"wo": pooled.T @ error, "bo": error.sum(keepdims=True)}
        dpool = error[:, None] * p["wo"]
        dalpha = (h * dpool).sum(2)
        ds = alpha * (dalpha - (alpha * dalpha).sum(0))
        da = ds[:, :, None] * p["va"] * (1 - a * a)
        g["va"], g["Wa"], g["ba"] = np.einsum("tn,tnk->k", ds, a), np.einsum("tnd,tnk->dk", h, da), da.sum((0, 1))
        dh = alpha[:, :, None] * dpool + da @ p["Wa"].T
        dvec = np.zeros_like(vectors)
        for k, way in enumerate("fb"):
            U, V = p[f"U{way}"], p[f"V{way}"]
            dU, dV = np.zeros_like(U), np.zeros_like(V)
            dx = np.zeros((*steps.shape, 3 * hid), np.float32)
            carry = np.zeros((steps.shape[1], hid), np.float32)
            for t, before, z, r, c, m in reversed(ways[way][1]):
                d = carry + dh[t][:, k * hid : (k + 1) * hid]
                dc, dz = d * m * z * (1 - c * c), d * m * (c - before) * z * (1 - z)
                back = dc @ V.T
                dr = back * before * r * (1 - r)
                dzr = np.concatenate([dz, dr], 1)
                dU += before.T @ dzr
                dV += (r * before).T @ dc
                dx[t] = np.concatenate([dzr, dc], 1)
                carry = d * (1 - m * z) + back * r + dzr @ U.T
            per_vector = _scattered(steps.ravel(), dx.reshape(-1, 3 * hid), len(vectors))
            g |= {f"U{way}": dU, f"V{way}": dV, f"W{way}": vectors.T @ per_vector, f"c{way}": per_vector.sum(0)}
            dvec += per_vector @ p[f"W{way}"].T
        return g, dvec


def windows_of(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of each text (one more than its codes; 0 pads), and how many each has: one at least."""
    count = np.maximum(1, -(-(sizes - (WINDOW - STRIDE)) // STRIDE))
    doc = np.repeat(np.arange(len(sizes)), count)
    first = np.cumsum(sizes) - sizes
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    at = start[:, None] + np.arange(WINDOW)
    inside = at < sizes[doc][:, None]
    padded = np.append(codes.astype(np.int32) + 1, 0).astype(np.int32)
    return np.where(inside, padded[np.where(inside, at + first[doc][:, None], len(codes))], 0), count


def _evidence(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """How surely each bucket, found in so many documents of either kind, goes with toxic ones; 0 for fewer than 3 documents."""
    t, c = toxic + 0.5, clean + 0.5
    odds = np.log(t / (n_toxic + 1)) - np.log(c / (n_clean + 1))
    return np.where(t + c < 4, 0, np.clip(odds / np.sqrt(1 / t + 1 / c), -4, 4) / 2).astype(np.float32)


def _tally(rows: DataFrame) -> np.ndarray:
    """In how many documents of rows (key, text, toxic) each bucket stands: words of clean and of toxic documents, then
    trigrams; then the clean and the toxic documents, and the windows of clean ones. One array of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(4 * BUCKETS + 3, np.int64)
        tally = out[: 4 * BUCKETS].reshape(2, 2, BUCKETS)
        for whole in batches:
            for a, b in _blocks(whole.column(1), BLOCK_CHARS):
                batch = whole.slice(a, b - a)
                toxic = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
                words, codes, sizes = _words(pc.utf8_lower(batch.column(1)))
                out[4 * BUCKETS :] += [int((~toxic).sum()), int(toxic.sum()), int(windows_of(codes, sizes)[1][~toxic].sum())]
                doc = np.repeat(np.arange(len(sizes)), sizes)
                ids, grams, per_word = _features(words)
                start = np.cumsum(per_word) - per_word
                pairs = np.unique(doc * BUCKETS + ids[codes])
                seen = np.unique(doc * np.int64(max(1, len(words))) + codes)
                d, w = seen // max(1, len(words)), seen % max(1, len(words))
                cuts = np.searchsorted(d, np.arange(0, len(sizes) + 100, 100))
                for k in (0, 1):
                    tally[0, k] += np.bincount(pairs[toxic[pairs // BUCKETS] == bool(k)] % BUCKETS, minlength=BUCKETS)
                for i, j in zip(cuts[:-1], cuts[1:]):  # documents by the hundred, as each brings all trigrams of its words
                    n = per_word[w[i:j]]
                    each = np.unique(np.repeat(d[i:j], n) * BUCKETS + grams[np.repeat(start[w[i:j]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))])
                    for k in (0, 1):
                        tally[1, k] += np.bincount(each[toxic[each // BUCKETS] == bool(k)] % BUCKETS, minlength=BUCKETS)
        at = np.nonzero(out)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(out[at])], names=["at", "n"])

    got = rows.mapInArrow(tidied(run), "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(4 * BUCKETS + 3, np.int64)
    out[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return out


def _drawn(key: np.ndarray, number: np.ndarray, turn: int) -> np.ndarray:
    """A number from 0 to 1 for each window, by hash."""
    x = (key.astype(np.uint64) + np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15) + number.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for shift in (31, 29):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(11)) / float(1 << 53)


def _worst(rows: DataFrame, net: Network, turn: int, share: float) -> pa.Table:
    """key, toxic, count (of windows), looks, windows (their words) of each document, by key: the WORST windows of all that
    the whole text has, worst first (in turn 0 by the starting values, then by the network), then, of clean documents,
    others, a share of all. Texts are read in tasks; those windows come to the driver."""
    sent = rows.sparkSession.sparkContext.broadcast(net)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for whole in batches:
            for a, b in _blocks(whole.column(1), BLOCK_CHARS):
                batch = whole.slice(a, b - a)
                key, toxic = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
                words, codes, sizes = _words(pc.utf8_lower(batch.column(1)))
                windows, count = windows_of(codes, sizes)
                looks = net.logits(words, windows) if turn else net.first_looks(words, windows)
                owner, first = np.repeat(np.arange(len(count)), count), np.cumsum(count) - count
                number = np.arange(len(owner)) - first[owner]
                top = np.lexsort((-looks, owner))[number < WORST]
                others = np.nonzero(~toxic[owner] & (_drawn(key[owner], number, turn) < share))[0]
                at = np.concatenate([top, others])
                at = at[np.argsort(owner[at], kind="stable")]
                outer = np.concatenate([[0], np.cumsum(np.bincount(owner[at], minlength=len(count)))]).astype(np.int32)
                live = windows[at] > 0
                inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(live.sum(1))]).astype(np.int32)), pa.array(words, pa.string()).take(pa.array(windows[at][live] - 1)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(count.astype(np.int64)), pa.ListArray.from_arrays(pa.array(outer), pa.array(looks[at].astype(np.float32))), pa.ListArray.from_arrays(pa.array(outer), inner)],
                    names=["key", "toxic", "count", "looks", "windows"],
                )

    got = rows.mapInArrow(tidied(run), "key long, toxic boolean, count long, looks array<float>, windows array<array<string>>").toArrow().combine_chunks().sort_by("key").combine_chunks()
    sent.unpersist()
    return got


def _numbered(windows: pa.Array) -> tuple[list[str], np.ndarray]:
    """Distinct words of windows (lists of words), and the windows by the numbers of those; 0 pads."""
    coded = windows.flatten().dictionary_encode()
    out = np.zeros((len(windows), WINDOW), np.int32)
    out[np.arange(WINDOW) < pc.list_value_length(windows).to_numpy(zero_copy_only=False)[:, None]] = coded.indices.to_numpy() + 1
    return coded.dictionary.to_pylist(), out


def fit(rows: DataFrame, weights: tuple[float, float], rounds: int = 3, seed: int = 5) -> tuple[Network, np.ndarray]:
    """The network and the three numbers of the document score. rows: key, text, toxic. weights: documents that a clean and a
    toxic one stand for."""
    net, r = Network(), np.random.default_rng(seed)
    tally = _tally(rows)
    n_clean, n_toxic, clean_windows = (int(x) for x in tally[4 * BUCKETS :])
    if not n_clean or not n_toxic:
        share = 0.0 if not n_clean + n_toxic else float(np.clip(n_toxic / (n_clean + n_toxic), 0.001, 0.999))
        return net, np.array([0.0, 0.0, np.log(share / (1 - share)) if share else -6.0])
    (word_clean, word_toxic), (gram_clean, gram_toxic) = tally[: 4 * BUCKETS].reshape(2, 2, BUCKETS)
    net.words[:, 0] = _evidence(word_toxic, word_clean, n_toxic, n_clean)
    net.chars[:, 0] = _evidence(gram_toxic, gram_clean, n_toxic, n_clean)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    for turn in range(rounds):
        got = _worst(rows, net, turn, min(1.0, CLEAN_WINDOWS / clean_windows))
        lists, looks = got.column("windows").combine_chunks(), got.column("looks").combine_chunks().flatten().to_numpy()
        toxic, count = np.array(got.column("toxic").to_pylist(), bool), got.column("count").to_numpy()
        per = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        words, windows = _numbered(lists.flatten())
        del got, lists
        owner = np.repeat(np.arange(len(per)), per)
        place = np.arange(len(owner)) - (np.cumsum(per) - per)[owner]
        other = place >= np.minimum(count, WORST)[owner]
        # of a toxic document the worst window, and the next ones only if they look bad themselves
        good = (windows[:, 0] > 0) & ((place == 0) | (~other & (~toxic[owner] | (looks > (0.0 if turn else 2.0)))))
        picked = np.nonzero(good | other)[0]
        passes = -(-STEPS // (rounds * -(-max(1, len(picked)) // BATCH)))
        shuffled = np.concatenate([r.permutation(picked) for _ in range(passes)])
        for a in range(0, len(shuffled), BATCH):
            batch = shuffled[a : a + BATCH]
            own, local = _local(words, windows[batch])
            x, (wid, gram, size) = net.vectors(own)
            logit, saved = net.forward(x, local, True)
            y = toxic[owner[batch]]
            error = ((_sigmoid(logit) - y) * np.where(y, 1.5, 1.0) / len(batch)).astype(np.float32)
            g, dx = net.backward(error, saved)
            step += 1
            for k, v in net.p.items():
                m, s = moments[k]
                m += 0.1 * (g[k] - m)
                s += 0.01 * (g[k] ** 2 - s)
                v -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
            net.words -= 0.5 * _scattered(wid, dx[1:, :WIDTH], BUCKETS)
            net.chars -= 0.5 * _scattered(gram, np.repeat(dx[1:, WIDTH:] / size[:, None], size, axis=0), BUCKETS)
    got = _worst(rows, net, rounds, 0.0)
    toxic, count = np.array(got.column("toxic").to_pylist(), bool), got.column("count").to_numpy()
    top = pc.list_element(got.column("looks").combine_chunks(), 0).to_numpy(zero_copy_only=False)
    weight = np.where(toxic, weights[1], weights[0])
    weight = weight / weight.mean()
    features = np.stack([top, np.log(count), np.ones(len(top))], 1)
    line = np.array([1.0, 0.0, 0.0])
    for _ in range(30):  # Newton steps of a weighted logistic regression
        q = _sigmoid(features @ line)
        hess = (features * (weight * q * (1 - q))[:, None]).T @ features + 1e-3 * np.eye(3)
        line = line + np.linalg.solve(hess, features.T @ (weight * (toxic - q)) - 1e-3 * line)
    return net, line


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[Network, np.ndarray]:
    """Fits on about TOXIC_DOCS toxic and CLEAN_DOCS clean documents (by hashed id) that have a label; null labels don't
    count, of several labels the highest does. Their whole texts are read in tasks; the driver gets the windows that train.
    """
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) > 0).alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    share = {k: min(1.0, (TOXIC_DOCS if k else CLEAN_DOCS) / n) for k, n in sizes.items()}
    bound = F.when(F.col("toxic"), share.get(True, 0.0)).otherwise(share.get(False, 0.0))
    picked = marked.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < bound * (1 << 30))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(picked), "_id").select(F.xxhash64("_id", "text").alias("key"), "text", "toxic")
    return fit(written(rows, "toxicity-sample"), (1 / max(share.get(False, 1.0), 1e-9), 1 / max(share.get(True, 1.0), 1e-9)))


def score(docs: DataFrame, model: tuple[Network, np.ndarray], text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from 0.5 on), from all windows of each whole text.

    A null text, like one without letters, has one empty window, and so a score too. Rows are judged by their text alone, so
    repeated rows score alike; an empty table gives an empty one. Columns with these names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = docs.select(*kept).schema.add("score", DoubleType()).add("predicted", IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, line = sent.value
        for whole in batches:
            at = whole.schema.names.index(text_col)
            for a, b in _blocks(whole.column(at), block_chars):
                batch = whole.slice(a, b - a)
                words, codes, sizes = _words(pc.utf8_lower(batch.column(at)))
                windows, count = windows_of(codes, sizes)
                logits = net.logits(words, windows)
                top = np.maximum.reduceat(logits, np.cumsum(count) - count)
                p = _sigmoid(np.stack([top, np.log(count), np.ones(len(count))], 1) @ line)
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)) for c in kept), pa.array(p.astype(np.float64)), pa.array((p >= 0.5).astype(np.int32))], names=[*kept, "score", "predicted"])

    return docs.mapInArrow(tidied(run), schema)
