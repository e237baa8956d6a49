"""Language-model scoring by online logistic context mixing.

A token's probability mixes what three lengths of context say of it: the two words before it, the one word before it, and no
word at all. How much each is worth is a bit (does this context know what comes?) that is predicted by logistic mixing:
predictors over hashed contexts (how often the contexts were seen, which of them knew the last three words, the word before,
how long the longest has been right) each give a probability from counts; weights that a gate picks by that length mix them
in the logistic domain; an adaptive map refines the mixture, and a bias follows each document every ``STEP`` words.

Without a context a word is weighed between its frequency, the words of the document so far, and its spelling. A word is spelt
bit by bit, with a closing byte: predictors over hashed contexts (the last one to four bytes, and all of the word so far), a
gate, weights and a map of their own. The end of a document is one more bit before each word, by how many words came before.

What is learned from where. Counts of words, word pairs and triples come from all training documents and grow with them; the
keys of pairs and triples have 32 bits within a bucket, of which there are as many as the corpus needs. The bit predictors,
weights and maps are learned online by tasks that each read their part of all training documents (or of all their distinct
words, for spelling), and are summed, or averaged by use, in whole numbers, so that the order of tasks doesn't matter. A
training document's own words, pairs and triples are taken out of the counts that score it. What one document teaches stays
in it, so a score depends on neither its neighbours nor the order of rows. Spelling counts sit in tables of fixed size
(``TABLE_BITS``), in which prefixes of a very large vocabulary collide.

How it runs. Documents are dealt into blocks of about ``BLOCK_BYTES``. A block asks for its distinct words, pairs and triples,
dealt by hash into buckets, and tells how often its training documents have them; a bucket adds up and answers. So each
is moved once for a block, however frequent it is.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import tidied, written
from curatrix.llm.pieces import _blocks

#: Bits of the slot numbers of each spelling context's table.
TABLE_BITS = (16, 18, 19, 20, 20)
#: Bytes of texts in a block, about, and entries of a bucket.
BLOCK_BYTES, BUCKET_ENTRIES = 4_000_000, 4_000_000
#: Words whose spelling is learned, or scored, at once.
WORDS_AT_ONCE = 2048
_K = len(TABLE_BITS)
_OFFSET = np.concatenate([[0], np.cumsum([1 << b for b in TABLE_BITS])]).astype(np.int64)
_SLOTS = int(_OFFSET[-1])
_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3
#: Within a document: words between two updates, the step of the logarithms of the wordwise weights for each word, the share
#: that the document's own words start with, the least share that a weight can sink to, and the step of the biases.
STEP, RATE, OWN_SHARE, LEAST_SHARE, BIAS_RATE = 32, 0.15, 0.03, 0.003, 0.04
_CHUNKS = 2048  # parts in which the spelling tables are added up
_MAP = 24  # steps of the adaptive probability maps on each side of even odds
#: Least log2 probability of a word that is mixed as it is; what goes below is added.
LEAST_LOG2 = -900
_FIXED = 1 << 24  # sums over tasks are of whole numbers of this part


def words_of(raw: bytes | None) -> list[bytes]:
    return (raw or b"").lower().split()  # of bytes: ASCII letters and white space only


# ---- Spelling -------------------------------------------------------------------------------------


def _spelt(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes with closing bytes, and where each word starts."""
    flat = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    return flat, np.cumsum(sizes) - sizes


class _Polynomial:
    """Hashes of runs of bytes, each a polynomial of them, from running sums."""

    powers = back = np.zeros(0, np.uint64)

    def __init__(self, flat: np.ndarray):
        n = len(flat)
        if len(self.powers) < n:
            inverse = pow(_BASE, -1, 1 << 64)
            series = lambda x: np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(x))]), dtype=np.uint64)[:n]
            _Polynomial.powers, _Polynomial.back = series(_BASE), series(inverse)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * self.powers[:n], dtype=np.uint64)])

    def of(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return (self.sums[stops] - self.sums[starts]) * self.back[starts]


def _mixed_up(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, as tokens() gives them."""
    if not words:
        return np.zeros(0, np.uint64)
    flat, starts = _spelt(words)
    return _mixed_up(_Polynomial(flat).of(starts, np.append(starts[1:], len(flat)) - 1))


def _contexts(flat: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """For every byte, a 64-bit hash of each of its contexts."""
    n = len(flat)
    sizes = np.diff(np.append(starts, n))
    first = np.repeat(starts, sizes)
    at = np.arange(n) - first
    before = np.zeros(n, np.uint64)
    out = []
    for k in range(1, 5):
        shifted = np.zeros(n, np.uint64)
        shifted[k:] = flat[:-k] if n > k else 0
        before = (before << np.uint64(8)) + np.where(at >= k, shifted, 0)
        out.append((before + np.uint64(k)) * _MULT)
    prefix = _Polynomial(flat).of(first, np.arange(n))
    out.append(((prefix ^ (prefix >> np.uint64(31))) + np.uint64(9)) * _MULT)
    return out


def _slots(context: np.ndarray, node: np.ndarray, k: int) -> np.ndarray:
    """Places of contexts in the k-th table. node: hashed by _bits."""
    return (((context ^ node) * _MULT) >> np.uint64(64 - TABLE_BITS[k])).astype(np.int64)


def _bits(flat: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The eight steps of all bytes: node (the bits so far, after a one), its hash, and the bit."""
    node = np.ones(len(flat), np.int64)
    hashes = np.arange(256, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for j in range(7, -1, -1):
        bit = (flat >> np.uint8(j)) & np.uint8(1)
        yield node, hashes[node], bit
        node = node * 2 + bit


def count_slots(words: list[bytes], seen: np.ndarray) -> None:
    """Adds the zeros and ones that each slot sees to seen (2 x slots), each word once."""
    flat, starts = _spelt(words)
    both = seen.reshape(-1)
    contexts = _contexts(flat, starts)
    for _, node, bit in _bits(flat):
        side = bit.astype(np.int64) * _SLOTS
        for k in range(_K):
            np.add.at(both, _slots(contexts[k], node, k) + _OFFSET[k] + side, 1)


def _packed(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Both counts in 16 bits: as they are up to 255, larger ones in proportion, what was seen staying at least 1."""
    scale = np.maximum(np.maximum(n0, n1), 255) / 255
    low, high = (np.minimum(np.where(n > 0, np.maximum(1, np.round(n / scale)), 0), 255).astype(np.uint16) for n in (n0, n1))
    return low | high << np.uint16(8)


#: Of each pair of packed counts the logarithm of the odds, and how far it is trusted, in eight steps.
_STRETCH = np.log(((np.arange(65536) >> 8) + 0.05) / ((np.arange(65536) & 255) + 0.05)).astype(np.float32)
_TRUST = np.minimum(7, np.log2((np.arange(65536) >> 8) + (np.arange(65536) & 255) + 1) * 0.85).astype(np.uint8)


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -18, 18)))


def _place(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a stretched probability falls in a map: the step below, and how far it is to the next."""
    step = np.clip(x, -11.99, 11.99) * (_MAP / 12) + _MAP
    low = step.astype(np.int64)
    return low, step - low.astype(step.dtype)


_STEPS = _squash((np.arange(2 * _MAP + 2) - _MAP) * (12 / _MAP))


class Mixer:
    """Gated weights over stretched predictions, and an adaptive map of the mixture."""

    def __init__(self, gates: int, inputs: int, cells: int, weight: float):
        self.inputs = inputs
        self.weights = np.full((inputs + 1, gates), weight, np.float32)
        self.weights[inputs] = 0
        self.map = np.tile(_STEPS, (cells, 1)).astype(np.float32)
        self.used = np.zeros(gates)  # predictions that taught each gate, and each place of the map
        self.map_used = np.zeros_like(self.map)

    def mix(self, stretched: list[np.ndarray], gate: np.ndarray, cell: np.ndarray):
        """The refined probability; what learn() needs."""
        x = self.weights[self.inputs][gate]
        for k in range(self.inputs):
            x += self.weights[k][gate] * stretched[k]
        low, part = _place(x)
        at = cell * (2 * _MAP + 2) + low
        flat = self.map.ravel()
        refined = flat[at] * (1 - part) + flat[at + 1] * part
        mixed = _squash(x)
        return np.clip(0.5 * mixed + 0.5 * refined, 2e-6, 1 - 2e-6), (mixed, at, part, gate, stretched)

    def learn(self, saved, target: np.ndarray, weight: np.ndarray | None = None, rate: float = 0.5) -> None:
        """One step towards target (0 to 1) for all that a gate, or a place of the map, got."""
        mixed, at, part, gate, stretched = saved
        one = np.ones(len(gate), np.float32) if weight is None else weight
        error, gates = (target - mixed) * one, self.weights.shape[1]
        n = np.bincount(gate, one, gates)
        pace = rate / (n + 50) / np.sqrt(1 + self.used / 200_000)
        for k in range(self.inputs):
            self.weights[k] += np.clip(pace * np.bincount(gate, error * stretched[k], gates), -0.2, 0.2)
        self.weights[self.inputs] += np.clip(pace * np.bincount(gate, error, gates), -0.2, 0.2)
        self.used += n
        table, places = self.map.ravel(), self.map.size
        near = at + (part > 0.5)  # the nearer place learns
        off = np.bincount(near, one * (target - table[near]), places)
        got = np.bincount(near, one, places)
        table += off / (got + self.map_used.ravel() + 20)
        self.map_used += got.reshape(self.map.shape)

    def taught(self) -> np.ndarray:
        """What a task has learned, as whole numbers that add up over tasks."""
        told = [self.weights * self.used, self.used, self.map * self.map_used, self.map_used]
        return np.concatenate([np.round(x.ravel() * _FIXED).astype(np.int64) for x in told])

    def adopt(self, total: np.ndarray) -> None:
        """The average of what tasks have learned, by use."""
        cut = np.cumsum([self.weights.size, self.used.size, self.map.size])
        weights, used, table, table_used = (x / _FIXED for x in np.split(total, cut))
        weights, table, table_used = weights.reshape(self.weights.shape), table.reshape(self.map.shape), table_used.reshape(self.map.shape)
        self.used, self.map_used = used, table_used
        self.weights = np.where(used > 0, weights / np.maximum(used, 1e-9), self.weights).astype(np.float32)
        self.map = ((table + 20 * np.tile(_STEPS, (len(table), 1))) / (table_used + 20)).astype(np.float32)


class Spelling:
    """The spelling model: packed counts of slots, and a mixer."""

    def __init__(self):
        self.seen = np.zeros(_SLOTS, np.uint16)
        self.mixer = Mixer(64, _K, 256, 0.3)

    def log2(self, words: list[bytes], own: np.ndarray, learn: bool = False) -> np.ndarray:
        """log2 probability of spelling each word. own: whether the word itself is among the counts, and is to be left out."""
        if not words:
            return np.zeros(0)
        flat, starts = _spelt(words)
        contexts, p_byte = _contexts(flat, starts), np.ones(len(flat))
        own = np.repeat(own.astype(np.uint16), np.diff(np.append(starts, len(flat))))
        tables = [self.seen[a:z] for a, z in zip(_OFFSET[:-1], _OFFSET[1:])]
        for node, hashed, bit in _bits(flat):
            less = own << (bit.astype(np.uint16) << np.uint16(3))  # one zero, or one one
            seen = [table[_slots(contexts[k], hashed, k)] - less for k, table in enumerate(tables)]
            gate = (_TRUST[seen[4]].astype(np.int64) << 3) | _TRUST[seen[2]]
            p, saved = self.mixer.mix([_STRETCH[x] for x in seen], gate, node)
            if learn:
                self.mixer.learn(saved, bit.astype(np.float32))
            p_byte *= np.where(bit == 1, p, 1 - p)
        return np.add.reduceat(np.log(p_byte), starts) / np.log(2)


# ---- Which context knows the word -----------------------------------------------------------------

_PREDICTORS, _CELLS = 4, (128, 432, 4096, 256)
_FROM = np.concatenate([[0], np.cumsum(_CELLS)]).astype(np.int64)


def quantised(n: np.ndarray) -> np.ndarray:
    """Steps of a count: 0, 1, 2, to 4, to 8, to 32, to 255, more."""
    return np.searchsorted(np.array([0, 1, 2, 4, 8, 32, 255]), n, "left").astype(np.uint16)


def coded(n3: np.ndarray, n2: np.ndarray, knows3: np.ndarray, knows2: np.ndarray, before: np.ndarray) -> np.ndarray:
    """A token in 16 bits: how often its contexts were seen, whether they know it, and 8 bits of the hash of the word before."""
    return quantised(n3) | quantised(n2) << np.uint16(3) | knows3.astype(np.uint16) << np.uint16(6) | knows2.astype(np.uint16) << np.uint16(7) | (before >> np.uint64(56)).astype(np.uint16) << np.uint16(8)


class Contexts:
    """Bit predictors (counts of their cells) and a mixer, for both contexts: 0 the longer, 1 the shorter."""

    def __init__(self):
        self.n0, self.n1 = np.full(int(_FROM[-1]), 0.7), np.full(int(_FROM[-1]), 0.3)
        self.mixer = Mixer(16, _PREDICTORS, 16, 0.3)

    @staticmethod
    def inputs(code: np.ndarray, sizes: np.ndarray) -> list[tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]]:
        """For both contexts, of all tokens: was it seen at all, the cells of the predictors, gate, cell of the map."""
        code = code.astype(np.int64)
        n3, n2, knows3, knows2, before = code & 7, code >> 3 & 7, code >> 6 & 1, code >> 7 & 1, code >> 8
        n = len(code)
        at = np.arange(n)
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        outcome = np.where(knows3 == 1, 2, knows2)
        past = [np.where(at - first >= k, np.concatenate([np.zeros(k, np.int64), outcome[:-k]])[:n] if n > k else 0, 0) for k in (1, 2, 3)]
        missed = np.maximum(np.maximum.accumulate(np.where(knows3 == 0, at, -1)), first - 1)  # where the longer context last failed
        run = np.minimum(7, np.where(at > first, at - 1 - np.concatenate([[0], missed[:-1]]) if n else at, 0))
        run = np.maximum(run, 0)
        place = np.minimum(15, np.log2(at - first + 1).astype(np.int64))
        out = []
        for k, seen in ((0, n3), (1, n2)):  # places of the first and of the second context lie side by side in each table
            cells = [k * 64 + n3 * 8 + n2, _FROM[1] + (k * 27 + past[0] * 9 + past[1] * 3 + past[2]) * 8 + seen, _FROM[2] + (k * 256 + before) * 8 + seen, _FROM[3] + (k * 8 + run) * 16 + place]
            out.append((seen > 0, cells, k * 8 + run, k * 8 + seen))
        return out

    def predict(self, given) -> tuple[np.ndarray, tuple]:
        seen, cells, gate, cell = given
        table = np.log((self.n1 + 0.05) / (self.n0 + 0.05)).astype(np.float32)
        p, saved = self.mixer.mix([table[c] for c in cells], gate, cell)
        return np.where(seen, p, np.float32(0)), saved

    @staticmethod
    def weigh(g3, g2, p3, p2, rest) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A token's probability, what the longer context's part of it is, and the shorter one's of what is left."""
        lower = g2 * p2 + (1 - g2) * rest
        p = g3 * p3 + (1 - g3) * lower
        return p, g3 * p3 / p, g2 * p2 / lower

    def learn(self, code: np.ndarray, sizes: np.ndarray, p3: np.ndarray, p2: np.ndarray, rest: np.ndarray) -> None:
        """Predicts some documents, and then learns from them."""
        given = self.inputs(code, sizes)
        (g3, saved3), (g2, saved2) = (self.predict(x) for x in given)
        _, r3, r2 = self.weigh(g3, g2, p3, p2, rest)
        for (seen, cells, _, _), saved, r, w in zip(given, (saved3, saved2), (r3, r2), (np.ones(len(r3)), 1 - r3)):
            w = w * seen
            self.mixer.learn(saved, r, w)
            for c in cells:
                hits = np.bincount(c, r * w, len(self.n1))
                self.n1 += hits
                self.n0 += np.bincount(c, w, len(self.n0)) - hits

    def taught(self) -> np.ndarray:
        return np.concatenate([np.round((x - start) * _FIXED).astype(np.int64) for x, start in ((self.n0, 0.7), (self.n1, 0.3))] + [self.mixer.taught()])

    def adopt(self, total: np.ndarray) -> None:
        n = len(self.n0)
        self.n0, self.n1 = 0.7 + total[:n] / _FIXED, 0.3 + total[n : 2 * n] / _FIXED
        self.mixer.adopt(total[2 * n :])

    def log2(self, code: np.ndarray, sizes: np.ndarray, p3: np.ndarray, p2: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """log2 probability of each document's tokens, with a bias for each context that follows the document."""
        given = self.inputs(code, sizes)
        odds = []
        for x in given:
            p, _ = self.predict(x)
            odds.append(np.where(x[0], np.log(np.maximum(p, 1e-9) / (1 - p)), -700.0).astype(float))
        out = np.zeros(len(sizes))
        by_size = np.argsort(-sizes, kind="stable")
        size, first = sizes[by_size], (np.cumsum(sizes) - sizes)[by_size]
        bias, total, lane = np.zeros((2, len(size))), np.zeros(len(size)), np.arange(STEP)
        for a in range(0, int(size[0]) if len(size) else 0, STEP):
            k = int(np.searchsorted(-size, -a, "left"))  # documents of more than a tokens
            valid = a + lane < size[:k, None]
            i = np.where(valid, first[:k, None] + a + lane, 0)
            g3, g2 = (1 / (1 + np.exp(-np.clip(o[i] + b[:k, None], -700, 30))) for o, b in zip(odds, bias))
            p, r3, r2 = self.weigh(g3, g2, p3[i], p2[i], rest[i])
            total[:k] += (np.log(p) * valid).sum(1)
            bias[0, :k] += BIAS_RATE * ((r3 - g3) * valid).sum(1)
            bias[1, :k] += BIAS_RATE * ((1 - r3) * (r2 - g2) * valid).sum(1)
            np.clip(bias, -3, 3, out=bias)
        out[by_size] = total / np.log(2)
        return out


# ---- Words without context ------------------------------------------------------------------------


@dataclass
class Totals:
    tokens: int  # N
    distinct: int  # V
    ends: int
    once: int  # words that training has once
    docs_bytes: int
    all_tokens: int
    end_rate: np.ndarray  # by the bit length of the number of words before


def wordwise_log2(spelt: np.ndarray, counts: np.ndarray, ids: np.ndarray, sizes: np.ndarray, spelling_share: float, of: float) -> np.ndarray:
    """log2 probability of each word from its spelling, its frequency and the document so far, with weights that follow the
    document. All arrays but sizes are by word; ids number distinct words; of: all words of training."""
    n, doc = len(ids), np.repeat(np.arange(len(sizes)), sizes)
    starts = np.cumsum(sizes) - sizes
    before = _times(doc, ids, int(ids.max()) + 1 if n else 1)[1]
    at = np.arange(n) - starts[doc]
    with np.errstate(divide="ignore"):
        logs = np.stack([(spelt * np.log(2)).astype(np.float32), np.log((counts / max(1.0, of)).astype(np.float32)), np.log((before / np.maximum(at, 1)).astype(np.float32))])
    logs = np.maximum(logs, np.float32(-1e6))
    start = np.array([spelling_share * (1 - OWN_SHARE), (1 - spelling_share) * (1 - OWN_SHARE), OWN_SHARE], np.float32)
    by_size = np.argsort(-sizes, kind="stable")
    size, first = sizes[by_size], starts[by_size]
    weights, out = np.tile(start, (len(size), 1)), np.zeros(n, np.float32)
    lane = np.arange(STEP)
    for a in range(0, int(size[0]) if len(size) else 0, STEP):
        k = int(np.searchsorted(-size, -a, "left"))  # documents of more than a words
        valid = a + lane < size[:k, None]
        i = np.where(valid, first[:k, None] + a + lane, 0)
        x = [own[i] + w[:, None] for own, w in zip(logs, np.log(weights[:k]).T)]
        top = np.maximum(np.maximum(x[0], x[1]), x[2])
        e = [np.exp(y - top) for y in x]
        z = e[0] + e[1] + e[2]
        out[i[valid]] = (top + np.log(z))[valid]
        part = valid / z
        credit = np.stack([(y * part).sum(1) for y in e], 1)
        moved = weights[:k] * np.exp(RATE * (credit - valid.sum(1)[:, None] * weights[:k]))
        weights[:k] = np.maximum(moved / moved.sum(1, keepdims=True), LEAST_SHARE)
        weights[:k] /= weights[:k].sum(1, keepdims=True)
    return out / np.float32(np.log(2))


def _times(doc: np.ndarray, ids: np.ndarray, n_ids: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each token's document has it, and how often before this place."""
    n = len(ids)
    pair = doc.astype(np.int64) * n_ids + ids
    room = max(1, n - 1).bit_length()
    if n and int(pair[-1] if len(pair) == 1 else pair.max()).bit_length() + room < 63:  # the place rides along, which sorts faster
        sorted_ = np.sort(pair << room | np.arange(n))
        order, pair = sorted_ & ((1 << room) - 1), sorted_ >> room
    else:
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
    new = np.ones(n, bool)
    new[1:] = pair[1:] != pair[:-1]
    firsts = np.nonzero(new)[0]
    size = np.diff(np.append(firsts, n))
    times, before = np.empty(n, np.int64), np.empty(n, np.int64)
    times[order] = np.repeat(size, size)
    before[order] = np.arange(n) - np.repeat(firsts, size)
    return times, before


# ---- Counts over the corpus -----------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_START = np.uint64(0x51ED270B35A0F21D)  # stands for the word before the first


def _spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts in small letters, where each word starts and stops, and how many each text has."""
    flat = np.frombuffer(b"\n".join(t.lower() for t in texts) + b"\n", np.uint8)
    gap = _SPACE[flat]
    starts = np.nonzero(~gap & np.concatenate([[True], gap[:-1]]))[0]
    stops = np.nonzero(gap & np.concatenate([[False], ~gap[:-1]]))[0]
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return flat, starts, stops, np.diff(np.concatenate([[0], np.searchsorted(starts, ends, "left")]))


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, in order, and how many each text has."""
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    flat, starts, stops, sizes = _spans(texts)
    return _mixed_up(_Polynomial(flat).of(starts, stops)), sizes


def tallied(texts: list[bytes], train: np.ndarray) -> tuple[list[bytes], list[int], np.ndarray]:
    """Distinct words of some texts, how often those that train have each, and the number of words of each text."""
    flat, starts, stops, sizes = _spans(texts)
    if not len(starts):
        return [], [], sizes
    h = _Polynomial(flat).of(starts, stops)
    order = np.argsort(h)
    first = np.nonzero(np.concatenate([[True], np.diff(h[order]) != 0]))[0]
    counts = np.add.reduceat(np.repeat(train, sizes)[order], first, dtype=np.int64)
    raw, one = flat.tobytes(), order[first]
    return [raw[a:z] for a, z in zip(starts[one].tolist(), stops[one].tolist())], counts.tolist(), sizes


def grams(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each word with the one and the two before it, and of the word before (a start stands before the first two)."""
    n = len(words)
    at = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    shifted = lambda k: np.where(at >= k, np.concatenate([np.zeros(min(k, n), np.uint64), words[:-k] if n > k else words[:0]])[:n], _START)
    one, two = shifted(1), shifted(2)
    pair = _mixed_up(one * _MULT + words)
    return pair, _mixed_up(two * np.uint64(0xC2B2AE3D27D4EB4F) + pair), one


def _key(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the upper half, 32 bits of the hash in the lower."""
    return ((h >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


def _distinct(x: np.ndarray) -> np.ndarray:
    """Distinct numbers, rising (by sorting, which is faster here than a table)."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _numbered(x: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers (all under top), rising, and which of them stands at each place."""
    room = max(1, len(x) - 1).bit_length()
    if top.bit_length() + room > 63:
        return np.unique(x, return_inverse=True)
    both = np.sort(x.astype(np.uint64) << np.uint64(room) | np.arange(len(x), dtype=np.uint64))  # the place rides along, which sorts faster
    value = both >> np.uint64(room)
    new = np.concatenate([[True], value[1:] != value[:-1]])[: len(x)]
    number = np.empty(len(x), np.int64)
    number[(both & np.uint64((1 << room) - 1)).astype(np.int64)] = np.cumsum(new) - 1
    return value[new], number


def _by_bucket(distinct: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of distinct words by bucket, then by hash, and where each bucket starts."""
    b = ((distinct >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    return np.argsort(b, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(b, minlength=buckets))])


def _squeezed(x: np.ndarray, rising: bool = False) -> bytes:
    """Numbers as bytes: rising ones by their steps, then byte by byte of each, compressed."""
    if rising and len(x):
        x = np.concatenate([x[:1], np.diff(x)])
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(x).to_bytes(4, "little") + bytes(pa.compress(raw, "zstd", asbytes=True)) if len(x) else b""


def _spread(raw: bytes, dtype, rising: bool = False) -> np.ndarray:
    if not raw:
        return np.zeros(0, dtype)
    n, size = int.from_bytes(raw[:4], "little"), np.dtype(dtype).itemsize
    flat = np.frombuffer(pa.decompress(raw[4:], n * size, "zstd", asbytes=True), np.uint8)
    x = np.ascontiguousarray(flat.reshape(size, n).T).view(dtype).ravel()
    return np.cumsum(x, dtype=dtype) if rising else x


def _stretches(x: np.ndarray, at: np.ndarray, which: np.ndarray, rising: bool = False) -> pa.Array:
    """Those stretches of x between places that are asked for, each squeezed."""
    return pa.array([_squeezed(x[a:z], rising) for a, z in zip(at[which].tolist(), at[which + 1].tolist())], pa.binary())


def _edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted(keys, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))


def _word_counts(docs: DataFrame, held: int = 600_000) -> DataFrame:
    """word, c for every word of docs (text, train), c over rows with train. Words with a leading space tell of totals:
    ``" e"`` + b, documents whose number of words has b bits, ``" w"`` + b, words that have such a number before them, ``" b"``
    bytes and ``" t"`` words of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])
            seen.clear()
            return out

        for whole in batches:
            for a, z in _blocks(whole.column(0), BLOCK_BYTES):
                batch = whole.slice(a, z - a)
                raws, train = batch.column(0).cast(pa.large_binary()).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
                words, counts, sizes = tallied(raws, train)
                for w, n in zip(words, counts):
                    seen[w] += n
                seen[b" b"] += sum(map(len, raws))
                seen[b" t"] += int(sizes.sum())
                for n in sizes[train].tolist():
                    seen[b" e%d" % n.bit_length()] += 1
                    for b in range(n.bit_length() + 1):
                        upto = (1 << b) >> 1
                        seen[b" w%d" % b] += max(0, min(n, 1 << b) - upto) if b else min(n, 1)
                if len(seen) > held:
                    yield flush()
        if seen:
            yield flush()

    return docs.select("text", "train").mapInArrow(tidied(run), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _summed(rows: DataFrame) -> np.ndarray:
    """Sums of (at, n) rows by place: as many as the places of a model of fixed size."""
    got = rows.groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(int(got.column("at").to_numpy().max()) + 1 if got.num_rows else 0, np.int64)
    out[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return out


def _told(x: np.ndarray) -> Iterator[pa.RecordBatch]:
    at = np.nonzero(x)[0]
    for a in range(0, len(at), 200_000):
        i = at[a : a + 200_000]
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(x[i])], names=["at", "n"])


def _filled(total: np.ndarray, size: int) -> np.ndarray:
    return np.concatenate([total, np.zeros(size - len(total), np.int64)])


def train_words(docs: DataFrame) -> tuple[Totals, Spelling, DataFrame]:
    """Totals, the spelling model, and word, c for every word. docs: text, train (null: not)."""
    counts = written(_word_counts(docs), "word-counts")
    told = {bytes(r["word"]): r["c"] for r in counts.where("substring(word, 1, 1) = cast(' ' as binary)").collect()}  # two rows for each bit length
    words = counts.where("substring(word, 1, 1) != cast(' ' as binary)")
    ends = sum(v for k, v in told.items() if k[:2] == b" e")
    known = words.where("c > 0")
    n, v, once = known.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.count(F.when(F.col("c") == 1, 1))).first()
    over = np.array([[told.get(b" %s%d" % (x, b), 0) for b in range(64)] for x in (b"e", b"w")], float)
    totals = Totals(n + ends, v + (ends > 0), ends, once, told.get(b" b", 0), told.get(b" t", 0), (over[0] + 0.5) / (over.sum(0) + 1 + 0.5 * (over.sum(0) == 0)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, _SLOTS), np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, 10 * WORDS_AT_ONCE):
                count_slots(batch.column(0).slice(a, 10 * WORDS_AT_ONCE).to_pylist(), seen)
        cut = np.array_split(seen.reshape(-1), _CHUNKS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(_CHUNKS, dtype=np.int32)), pa.array([_squeezed(x) for x in cut], pa.binary())], names=["chunk", "data"])

    def add(group: pa.Table) -> pa.Table:
        total = _squeezed(sum(_spread(x, np.int64) for x in group.column("data").to_pylist()))
        return pa.table({"chunk": group.column("chunk").slice(0, 1), "data": pa.array([total], pa.binary())})

    spelling = Spelling()
    # tables of fixed size, one from each task that reads words, are added up in parts
    parts = known.select("word").mapInArrow(tidied(count), "chunk int, data binary").groupBy("chunk").applyInArrow(add, "chunk int, data binary").toArrow().sort_by("chunk")
    if parts.num_rows:
        spelling.seen = _packed(*_joined(parts.column("data"), np.int64).reshape(2, _SLOTS))
    sent = docs.sparkSession.sparkContext.broadcast(spelling)  # of fixed size

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Spelling()
        own.seen = sent.value.seen
        for batch in batches:
            for a in range(0, batch.num_rows, WORDS_AT_ONCE):
                part = batch.column(0).slice(a, WORDS_AT_ONCE).to_pylist()
                own.log2(part, np.ones(len(part)), learn=True)
        yield from _told(own.mixer.taught())

    spelling.mixer.adopt(_filled(_summed(known.select("word").mapInArrow(tidied(learn), "at long, n long")), len(spelling.mixer.taught())))
    return totals, spelling, words


def _spelt_words(words: DataFrame, spelling: Spelling, buckets: int) -> DataFrame:
    """bucket, h (hash), c, lp (log2 of the spelling) of every word."""
    sent = words.sparkSession.sparkContext.broadcast(spelling)  # tables of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, WORDS_AT_ONCE):
                part = batch.slice(a, WORDS_AT_ONCE)
                said = part.column(0).to_pylist()
                h = word_hashes(said)
                lp = sent.value.log2(said, part.column(1).to_numpy() > 0)
                yield pa.RecordBatch.from_arrays([pa.array(((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)), pa.array(h.view(np.int64)), part.column(1), pa.array(np.maximum(lp, -60_000).astype(np.float32))], names=["bucket", "h", "c", "lp"])

    return words.mapInArrow(tidied(run), "bucket int, h long, c long, lp float")


def _joined(column: pa.ChunkedArray | pa.Array, dtype, rising: bool = False) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype), *(_spread(x, dtype, rising) for x in column.to_pylist())])


def _texts(table: pa.Table) -> list[bytes]:
    return table.column("text").cast(pa.large_binary()).to_pylist()


def _asks(dealt: DataFrame, buckets: int) -> DataFrame:
    """For each block and bucket: the block's distinct words (w), and the keys and training counts of its pairs and triples.

    A block has rows for the buckets that it asks for something only, so there are never more rows than words, pairs and triples.
    """

    def run(group: pa.Table) -> pa.Table:
        words, sizes = tokens(_texts(group))
        taught = np.repeat(group.column("train").to_numpy(zero_copy_only=False).astype(bool), sizes)
        w = _distinct(words)
        order, at = _by_bucket(w, buckets)
        keys = [_key(h, buckets) for h in grams(words, sizes)[:2]]
        asked = np.zeros(buckets, bool)
        asked[np.nonzero(np.diff(at))[0]] = True
        for key in keys:
            asked[(key >> np.uint64(32)).astype(np.int64)] = True
        which = np.nonzero(asked)[0]
        out = [pa.array(np.full(len(which), group.column("block")[0].as_py(), np.int32)), pa.array(which.astype(np.int32)), _stretches(w[order], at, which, True)]
        for key in keys:
            u = _distinct(key)
            known, times = np.unique(key[taught], return_counts=True)
            n = np.zeros(len(u), np.uint32)
            n[np.searchsorted(u, known)] = times
            at = _edges(u, buckets)
            out += [_stretches((u & np.uint64(0xFFFFFFFF)).astype(np.uint32), at, which, True), _stretches(n, at, which)]
        return pa.Table.from_arrays(out, names=["block", "bucket", "w", "k2", "n2", "k3", "n3"])

    return dealt.groupBy("block").applyInArrow(run, "block int, bucket int, w binary, k2 binary, n2 binary, k3 binary, n3 binary")


def _answers(asks: DataFrame, spelt: DataFrame) -> DataFrame:
    """For each block and bucket: counts (c) and spellings (lp) of the words, and counts of the pairs and triples over all blocks."""

    def run(asked: pa.Table, words: pa.Table) -> pa.Table:
        order = np.argsort(h := words.column("h").to_numpy().view(np.uint64))
        h, c, lp = h[order], words.column("c").to_numpy()[order], words.column("lp").to_numpy()[order].astype(np.float16)
        out = {"block": asked.column("block"), "bucket": asked.column("bucket"), "c": [], "lp": []}
        for raw in asked.column("w").to_pylist():
            i = np.searchsorted(h, _spread(raw, np.uint64, True))
            out["c"].append(_squeezed(c[i])), out["lp"].append(_squeezed(lp[i]))
        for k, n, name in (("k2", "n2", "t2"), ("k3", "n3", "t3")):
            keys = [_spread(x, np.uint32, True) for x in asked.column(k).to_pylist()]
            flat = np.concatenate([np.zeros(0, np.uint32), *keys]).astype(np.uint64)
            both = np.sort((flat << np.uint64(32)) | _joined(asked.column(n), np.uint32))
            key = (both >> np.uint64(32)).astype(np.uint32)
            first = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0] if len(key) else np.zeros(0, np.int64)
            total = np.minimum(np.add.reduceat((both & np.uint64(0xFFFFFFFF)).astype(np.int64), first), 0xFFFFFFFF).astype(np.uint32) if len(first) else np.zeros(0, np.uint32)
            key = key[first]
            out[name] = [_squeezed(total[np.searchsorted(key, x)]) for x in keys]
        kinds = {"block": pa.int32(), "bucket": pa.int32()}
        return pa.table({x: pa.chunked_array([pa.array(y, pa.binary())]) if x not in kinds else y for x, y in out.items()})

    return asks.groupBy("bucket").cogroup(spelt.groupBy("bucket")).applyInArrow(run, "block int, bucket int, c binary, lp binary, t2 binary, t3 binary")


_CODED = "doc_id array<bigint>, train array<boolean>, n_tokens array<bigint>, n_known array<bigint>, base_score array<double>, fixed array<double>, bytes array<bigint>, code binary, rest binary, p3 binary, p2 binary"


def _code(dealt: DataFrame, answers: DataFrame, totals: Totals, buckets: int) -> DataFrame:
    """Each block as what the mixing needs of its documents' tokens: codes, and log2 probabilities by no, the longer and the shorter context
    (half precision; of a context only for words that it knows); and what needs no mixing: base score and log2 of the ends."""

    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.Table.from_pylist([], schema=_coded_schema())
        told = told.sort_by("bucket")
        raws = _texts(texts)
        words, sizes = tokens(raws)
        n, train = len(words), texts.column("train").to_numpy(zero_copy_only=False).astype(bool)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        taught = train[doc]
        h2, h3, one = grams(words, sizes)
        w, ids = np.unique(words, return_inverse=True)
        back = np.empty(len(w), np.int64)
        back[_by_bucket(w, buckets)[0]] = np.arange(len(w))  # answers come by bucket
        at_word = back[ids] if n else ids
        count, spelt = _joined(told.column("c"), np.int64)[at_word], _joined(told.column("lp"), np.float16).astype(np.float32)[at_word]

        def less_own(key: np.ndarray, total: np.ndarray) -> np.ndarray:
            """Counts of tokens without those of the document itself, if it taught."""
            out = total - taught
            more = np.nonzero(taught & (total > 1))[0]  # of a single one nothing is left
            if len(more):
                u, inverse = _numbered(key[more], n)
                out[more] = total[more] - _times(doc[more], inverse, len(u))[0]
            return np.maximum(out, 0)

        found = []
        for h, name in ((h2, "t2"), (h3, "t3")):
            key = _key(h, buckets)
            u, inverse = _numbered(key, buckets << 32)
            found.append(less_own(inverse, _joined(told.column(name), np.uint32).astype(np.int64)[inverse] if n else np.zeros(0, np.int64)))
        c1, (c2, c3) = less_own(ids, count), found
        at = np.arange(n) - (np.cumsum(sizes) - sizes)[doc]
        before = lambda x, start: np.where(at > 0, np.concatenate([[0], x[:-1]]) if n else x, start)
        n2 = np.maximum(before(c1, totals.ends - taught), c2)  # how often the word before, and the two before, were seen
        n3 = np.maximum(np.where(at > 0, before(c2, 0), 0), np.where(at > 0, c3, 0))
        c3 = np.where(at > 0, c3, 0)  # of a first word the longer context says no more
        rest = wordwise_log2(spelt, c1, ids, sizes, max(0.001, totals.once / max(1, totals.tokens - totals.ends)) if totals.tokens else 0.999, totals.tokens - totals.ends)
        deep = np.where((c2 == 0) & (c3 == 0), np.minimum(rest - LEAST_LOG2, 0), 0)  # of very long words; no context shares in it
        rest = np.maximum(rest, LEAST_LOG2)
        code = coded(n3, n2, c3 > 0, c2 > 0, one)
        with np.errstate(divide="ignore", invalid="ignore"):
            p3, p2 = np.log2(c3 / n3).astype(np.float16), np.log2(c2 / n2).astype(np.float16)
        base = np.log10((count + 0.1) / (totals.tokens + 0.1 * (totals.distinct + 1)))
        end_base = np.log10((totals.ends + 0.1) / (totals.tokens + 0.1 * (totals.distinct + 1)))
        summed = lambda x: np.bincount(doc, x, len(sizes)) if n else np.zeros(len(sizes))
        log_end, log_on = np.log2(totals.end_rate), np.log2(1 - totals.end_rate)
        fixed = [sum(log_on[b] * (min(m, 1 << b) - ((1 << b) >> 1) if b else 1) for b in range(m.bit_length() + 1) if min(m, 1 << b) > (1 << b) >> 1) + log_end[m.bit_length()] for m in sizes.tolist()]
        one_list = lambda x: pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), x.combine_chunks() if isinstance(x, pa.ChunkedArray) else pa.array(x))
        lists = [one_list(x) for x in (texts.column("doc_id"), texts.column("train"), sizes + 1, summed(count > 0).astype(np.int64) + (totals.ends > 0), summed(base) + end_base, fixed + summed(deep), np.array([len(x) for x in raws], np.int64))]
        return pa.Table.from_arrays([*lists, *(pa.array([_squeezed(x)], pa.binary()) for x in (code, rest.astype(np.float16), p3[c3 > 0], p2[c2 > 0]))], schema=_coded_schema())

    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, _CODED)


def _coded_schema() -> pa.Schema:
    kinds = {"array<bigint>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_()), "array<double>": pa.list_(pa.float64()), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in _CODED.split(", "))])


def _tokens_of(row: dict, at_once: int) -> Iterator[tuple[slice, tuple]]:
    """Some documents of a block at a time: which, and code, sizes, p3, p2, rest of their tokens."""
    n = np.array(row["n_tokens"], np.int64) - 1
    code = _spread(row["code"], np.uint16)
    p3, p2 = np.zeros(len(code), np.float32), np.zeros(len(code), np.float32)
    p3[code >> 6 & 1 == 1] = np.exp(_spread(row["p3"], np.float16).astype(np.float32) * np.float32(np.log(2)))
    p2[code >> 7 & 1 == 1] = np.exp(_spread(row["p2"], np.float16).astype(np.float32) * np.float32(np.log(2)))
    rest = np.exp(_spread(row["rest"], np.float16).astype(float) * np.log(2))
    ends = np.concatenate([[0], np.cumsum(n)])
    a = 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + at_once, "right")) - 1)
        here = slice(ends[a], ends[b])
        yield slice(a, b), (code[here], n[a:b], p3[here], p2[here], rest[here])
        a = b


def train_contexts(rows: DataFrame) -> Contexts:
    """Learned online by every task from its training documents, and added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Contexts()
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                teaches = np.array(row["train"], bool)
                for docs, (code, sizes, *parts) in _tokens_of(row, 20_000):
                    keep = np.repeat(teaches[docs], sizes)
                    if keep.any():
                        own.learn(code[keep], sizes[teaches[docs]], *(x[keep] for x in parts))
        yield from _told(own.taught())

    out = Contexts()
    taught = rows.select("train", "n_tokens", "code", "rest", "p3", "p2").mapInArrow(tidied(run), "at long, n long")
    out.adopt(_filled(_summed(taught), len(out.taught())))
    return out


def score(docs: DataFrame, block_bytes: int = BLOCK_BYTES, bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """docs (doc_id, text, train) scored: doc_id, train, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Tokens are the words and one end; A-Z count as lower case. base_score: log10 of additive unigram smoothing. score:
    log10 of the model's probability. A null text is an empty one, which has an end only; a null train is false. Without
    training rows all counts are 0 and words are only spelt. Rows that are repeated are scored alike, but if they teach, each is
    known from the others. Other columns are left out. An empty table gives an empty result. bits_per_byte is over the text's
    UTF-8 bytes, null for empty texts.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("train", F.lit(False)).alias("train"))
    totals, spelling, words = train_words(docs)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks, buckets = max(least, -(-totals.docs_bytes // block_bytes)), max(least, -(-3 * totals.all_tokens // bucket_entries))
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).repartition(blocks, "block")
    answers = written(_answers(_asks(dealt, buckets), _spelt_words(words, spelling, buckets)), "context-counts")
    rows = written(_code(dealt, answers, totals, buckets), "coded-documents")
    sent = spark.sparkContext.broadcast(train_contexts(rows))  # of fixed size
    train_tokens = totals.tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.slice(i, 1)
                bits = np.concatenate([np.zeros(0), *(sent.value.log2(*part) for _, part in _tokens_of(own.to_pylist()[0], 300_000))])
                col = lambda name: own.column(own.schema.names.index(name)).flatten()  # noqa: B023, E731
                bits = -(bits + col("fixed").to_numpy())
                size = col("bytes").to_numpy()
                per_byte = pa.array(bits / np.maximum(size, 1), pa.float64(), mask=size == 0)
                yield pa.RecordBatch.from_arrays([col("doc_id"), col("train"), col("n_tokens"), col("n_known"), pa.array(np.full(len(bits), train_tokens)), col("base_score"), pa.array(-bits * np.log10(2)), per_byte], names=["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])

    return rows.mapInArrow(tidied(run), "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
