"""N-gram Jaccard join over prefix trees.

Two texts link when the sets of their word n-grams have a Jaccard similarity of at least ``num / den``; the operator
returns the connected components of all links, exactly.

1.  Each text's n-grams become a set of 64-bit hashes. Texts with one set are one class, which its smallest id stands for.
2.  Of a set of n, only the ``head`` is looked at first: its first n - need + slack hashes in the order of their values,
    where need is the least overlap with any partner and slack a tenth of n. Linked sets share at least
    slack of their heads, so a class whose head shares fewer of its hashes with others is linked with nothing. That leaves
    near copies, and drops what merely shares a passage.
3.  What is left is put into clusters: head hashes are ordered by frequency, rarest first, and classes that share one of
    the first (shared - slack + 1) of them are in one cluster. Linked classes always are.
4.  In each cluster the whole sets, ordered by frequency, go into a prefix tree with runs of hashes in its nodes. Each set
    walks the tree from the root, all branches at once; the overlap with a run is counted once for all sets below
    it. A branch ends when what remains of it or of the query can't reach the overlap that the bound on lengths asks for,
    or when all below it are in the query's component.
5.  A cluster too large for one task is first refined: hashes that only one of its sets has are in no overlap, sets that can't
    link without them go, and the rest is clustered anew by its rarest hashes, now of whole sets. What is too large still
    is dealt into blocks. Blocks are joined within themselves and with a few pivots; only sets that this leaves outside the
    cluster's main component are then sent, in blocks, to all blocks.

No pair of classes is ever a row; what is a row grows with the number of n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import tidied, written
from curatrix.llm.pieces import _blocks
from curatrix.operators.components import components

#: Hashes that one task's prefix tree may hold; a cluster of more is refined, and dealt into blocks.
TREE_HASHES = 4_000_000
PIVOTS = 8
#: Characters of texts that a task takes at once, or one text.
BLOCK_CHARS = 1_000_000


class _WordHashes(dict):
    """64-bit hashes of words, kept while they are few."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _WordHashes()
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M1
    return (h ^ (h >> np.uint64(29))) * _M2


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a text, A-Z in lower case; with fewer words, of all of them as one."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII letters and white space only
    if not words:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    k = min(n, len(h))
    out = _mix(h[: len(h) - k + 1] + np.uint64(k))
    for i in range(1, k):
        out = _mix(out + h[i : len(h) - k + 1 + i])
    return np.unique((out ^ (out >> np.uint64(32))).view(np.int64))


def _need(n, num: int, den: int):
    """Least overlap of a set of n with a set that it links to."""
    return -(-num * n // den)


def _slack(n):
    return np.maximum(1, n // 10)


def _sets(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """doc_id, n, k1, k2 (128 bits of the whole set), head."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _blocks(batch.column(1), BLOCK_CHARS):
                part = batch.slice(a, b - a)
                made = [shingles(t.as_py(), n) for t in part.column(1)]
                keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in made]
                pair = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
                size = np.array([len(s) for s in made], np.int64)
                take = np.minimum(size, size - _need(size, num, den) + _slack(size))
                heads = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(take)]), pa.int32()), pa.array(np.concatenate([s[:t] for s, t in zip(made, take)])))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size), pa.array(pair[:, 0]), pa.array(pair[:, 1]), heads], names=["doc_id", "n", "k1", "k2", "head"])

    return docs.mapInArrow(tidied(run, _HASHES.clear), "doc_id long, n long, k1 long, k2 long, head array<long>")


class PrefixTree:
    """Sets in one order of their members, as a tree whose nodes hold runs of members."""

    def __init__(self, sets: list[np.ndarray], universe: int, whole: np.ndarray | None = None):
        """sets: rising member numbers below universe, none empty, in lexicographic order; equal ones side by side.

        whole: the size of each set with those of its members that no other set has, which needn't be in the tree.
        """
        self.flat = np.concatenate(sets)
        self.offset = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        self.sizes = np.diff(self.offset)
        self.whole = self.sizes if whole is None else whole
        self.mask = np.zeros(universe, np.int32)  # of the query that is being asked
        begin, end, parent, first, last = [], [], [], [], []  # of nodes: the run as a part of flat, and the sets below

        # nodes by depth: every open range of sets that agree so far is cut where its next run ends
        todo = [(0, len(sets), 0, -1)]
        shared = [self._common(sets[i], sets[i + 1]) for i in range(len(sets) - 1)] + [0]
        while todo:
            lo, hi, depth, up = todo.pop()
            run = min(shared[lo : hi - 1]) if hi - lo > 1 else len(sets[lo])
            node = up
            if run > depth:
                node = len(begin)
                begin.append(self.offset[lo] + depth), end.append(self.offset[lo] + run), parent.append(up), first.append(lo), last.append(hi)
            if hi - lo > 1:
                a = lo
                for i in range(lo, hi):
                    if i == hi - 1 or shared[i] == run:
                        if i > a or len(sets[a]) > run:
                            todo.append((a, i + 1, run, node))
                        a = i + 1
        self.begin, self.end, self.parent, self.first, self.last = (np.array(x, np.int64) for x in (begin, end, parent, first, last))
        depth = np.zeros(len(begin), np.int64)
        for i, p in enumerate(parent):
            depth[i] = (depth[p] if p >= 0 else 0) + end[i] - begin[i]
        self.depth = depth
        order = np.argsort(self.parent, kind="stable")
        self.children = order
        self.child_at = np.searchsorted(self.parent[order], np.arange(-1, len(begin) + 1))
        # the shortest and longest set below each node, and the most members, bound what remains
        below = np.stack([self.first, self.last], 1).ravel()
        most = lambda x: np.maximum.reduceat(np.append(x, 0), below)[::2] if len(begin) else self.first
        self.longest, self.deepest = most(self.whole), most(self.sizes)
        self.shortest = np.minimum.reduceat(np.append(self.whole, 1 << 60), below)[::2] if len(begin) else self.first
        # how many sets end at each node: equal ones lie side by side, before those that go on
        ending = np.concatenate([[0], np.cumsum(self.sizes[self.first] == self.depth)]) if len(begin) else np.zeros(1, np.int64)
        self.ends = np.diff(ending)
        for i in np.nonzero(self.ends)[0]:
            a, z = self.first[i], self.last[i]
            self.ends[i] = np.searchsorted(self.sizes[a:z] > self.depth[i], True) if z - a > 1 else 1

    @staticmethod
    def _common(x: np.ndarray, y: np.ndarray) -> int:
        m = min(len(x), len(y))
        differ = np.nonzero(x[:m] != y[:m])[0]
        return int(differ[0]) if len(differ) else m

    def _under(self, nodes: np.ndarray) -> np.ndarray:
        a, b = self.child_at[nodes + 1], self.child_at[nodes + 2]
        n = b - a
        return self.children[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]

    def linked(self, query: np.ndarray, num: int, den: int, label: np.ndarray | None = None, own: int = -1, whole: int | None = None) -> np.ndarray:
        """Numbers of the sets whose similarity with query (rising numbers) is at least num / den.

        label: of each set; branches that have only the label ``own`` are left out. whole: the size of the query with the
        members that no set has.
        """
        mask, q, held, out = self.mask, len(query) if whole is None else whole, len(query), []
        mask[query] = 1
        lo, hi = label if label is not None else (None, None)
        nodes = self._under(np.array([-1]))
        have = np.zeros(len(nodes), np.int64)
        while len(nodes):
            keep = (self.longest[nodes] * den >= num * q) & (self.shortest[nodes] * num <= den * q)
            if lo is not None:
                keep &= ~((lo[nodes] == own) & (hi[nodes] == own))
            nodes, have = nodes[keep], have[keep]
            if not len(nodes):
                break
            n = self.end[nodes] - self.begin[nodes]
            at = np.repeat(self.begin[nodes] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            have = have + np.add.reduceat(mask[self.flat[at]], np.cumsum(n) - n)
            # the most that can be shared yet, and the least that the smallest set below asks for
            rest = np.minimum(self.deepest[nodes] - self.depth[nodes], held - np.searchsorted(query, self.flat[self.end[nodes] - 1], "right"))
            least = np.maximum(np.maximum(self.shortest[nodes], self.depth[nodes]), -(-num * q // den))
            keep = (have + rest) * (num + den) >= num * (q + least)
            nodes, have = nodes[keep], have[keep]
            for i in np.nonzero(self.ends[nodes])[0]:  # sets that end here
                a = self.first[nodes[i]]
                out.extend(a + np.nonzero(have[i] * (num + den) >= num * (q + self.whole[a : a + self.ends[nodes[i]]]))[0])
            counts = self.child_at[nodes + 2] - self.child_at[nodes + 1]
            nodes, have = self._under(nodes), np.repeat(have, counts)
        mask[query] = 0
        return np.array(out, np.int64)

    def labels(self, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and largest label below each node."""
        at = np.stack([self.first, self.last], 1).ravel()
        return np.minimum.reduceat(np.append(label, 1 << 60), at)[::2], np.maximum.reduceat(np.append(label, -1), at)[::2]


def join_sets(stored: list[np.ndarray], queries: list[np.ndarray] | None, num: int, den: int, same: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among stored sets, or between queries and stored sets.

    Sets hold distinct hashes. Returns pairs of positions (query, stored). Equal sets are linked too. same: for each set
    (stored, then queries) the component it is known to be in.
    """
    everything = stored + (queries or [])
    total = np.array([len(s) for s in everything], np.int64)
    values, at, counts = np.unique(np.concatenate(everything), return_inverse=True, return_counts=True)
    # what only one set holds is in no overlap; it counts in the sizes only
    shared = counts > 1
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((values, -counts))] = np.arange(len(values))  # frequent first, so that near copies share their runs
    keep = shared[at]
    held = np.add.reduceat(keep, np.cumsum(total) - total, dtype=np.int64)
    numbered = [np.sort(x) for x in np.split(rank[at[keep]], np.cumsum(held)[:-1])]
    del values, at, keep, counts
    able = held * den >= num * total  # the least overlap with any partner
    order = sorted((i for i in range(len(stored)) if able[i]), key=lambda i: numbered[i].astype(">i8").tobytes())
    root = list(range(len(everything)))
    edges: list[tuple[int, int]] = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    if same is not None:
        first: dict[int, int] = {}
        for i, s in enumerate(same):
            root[find(i)] = find(first.setdefault(s, i))
    place: list[int] = []  # the stored sets that the tree has; of wholly equal ones one
    for i in order:
        j = place[-1] if place else -1
        if j >= 0 and held[i] == total[i] == total[j] == held[j] and (numbered[i] == numbered[j]).all():
            edges.append((i if queries is None else -1 - i, j))
            root[find(i)] = find(j)
        else:
            place.append(i)
    base = len(stored)
    if not place:
        return []
    tree = PrefixTree([numbered[i] for i in place], int(shared.sum()), total[place])
    asked = [i for i in (range(len(stored)) if queries is None else range(base, len(everything))) if able[i]]
    # sets made of frequent members come first: they are likely to be at the centre of near copies
    weight = {i: float(numbered[i].mean()) + float(total[i] - held[i]) * len(rank) for i in asked}
    # labels of branches may lag behind: a branch that once was within the component of a root still is
    apart, unions = 2 * len(place), len(place)
    for i in sorted(asked, key=weight.__getitem__):
        if unions * 8 >= apart:
            apart, unions = max(1, apart - unions), 0
            bounds = tree.labels(np.array([find(p) for p in place], np.int64))
        own = find(i)
        for s in tree.linked(numbered[i], num, den, bounds, own, int(total[i])):
            j = place[s]
            if find(j) != find(i):
                root[find(j)] = find(i)
                edges.append((i, j))
                unions += 1
    return [(i - base if queries is not None and i >= 0 else i, j) for i, j in edges]


def _forest(batches: list[pa.RecordBatch] | pa.Table, num: int, den: int) -> tuple[list[int], list[int]]:
    """Edges (ids) of one group: rows of rep, asks (whether it is a query of stored sets), part (known component), set."""
    rep, asks, part, sets = (batches.column(c) for c in ("rep", "asks", "part", "set"))
    rep, asks, part = rep.to_pylist(), asks.to_pylist(), part.to_pylist()
    members = [s.values.to_numpy() for s in sets]
    kept = [i for i, a in enumerate(asks) if not a]
    query = [i for i, a in enumerate(asks) if a]
    if not kept or (len(kept) < 2 and not query):
        return [], []
    if not query:
        found = join_sets([members[i] for i in kept], None, num, den, [part[i] for i in kept])
        return [rep[kept[i]] for i, _ in found], [rep[kept[j]] for _, j in found]
    found = join_sets([members[i] for i in kept], [members[i] for i in query], num, den, [part[i] for i in kept + query])
    return [rep[query[i]] if i >= 0 else rep[kept[-1 - i]] for i, _ in found], [rep[kept[j]] for _, j in found]


def _join_groups(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Edges a, b of the groups (_group) of rows."""

    def run(group: pa.Table) -> pa.Table:
        a, b = _forest(group, num, den)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("_group", "_block", "_asked").applyInArrow(run, "a long, b long")


def _alive(posted: DataFrame, num: int, den: int) -> DataFrame:
    """rep of the sets that could still reach the least overlap without the hashes that no other set of their cluster has.
    posted: rep, n (size of the set), key (of the cluster and a hash in it), a row for each hash."""
    lone = posted.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("rep").alias("rep")).where("c = 1").groupBy("rep").agg(F.count(F.lit(1)).alias("lone"))
    left = F.col("n") - F.coalesce("lone", F.lit(0))
    return posted.select("rep", "n").distinct().join(lone, "rep", "left").where(left * den >= F.col("n") * num).select("rep")


def _refined(sets: DataFrame, num: int, den: int) -> DataFrame:
    """rep, cluster: the parts that clusters fall into by whole sets rather than heads. sets: cluster, rep, set.

    Sets that can't link for want of shared hashes go. What is left is ordered by frequency, rarest first: of a set with m
    shared hashes the first m - need + 1 have one in common with any set that it links to. So this is exact, and parts are
    little more than what is really linked.
    """
    posted = sets.select("rep", F.size("set").cast("long").alias("n"), F.explode("set").alias("h"), "cluster").select("rep", "n", F.xxhash64("cluster", "h").alias("key"))
    posted = posted.join(written(_alive(posted, num, den), "alive"), "rep", "left_semi")
    common = posted.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    lists = posted.join(common, "key").groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("c", "key"))).alias("common"))
    take = F.size("common") - F.floor((F.col("n") * num + den - 1) / den).cast("int") + 1
    keys = written(lists.where(take > 0).select("rep", F.explode(F.slice("common", 1, take)).alias("x")).select("rep", "x.key"), "refined-keys")
    hubs = keys.groupBy("key").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("c")).where("c > 1").select("key", "hub")
    return components(keys.join(hubs, "key").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))


def _cluster_links(sets: DataFrame, num: int, den: int, tree_hashes: int) -> DataFrame:
    """Edges a, b of all links within clusters, up to connection. sets: cluster, rep, set."""
    sets = written(sets, "cluster-sets")
    wide = written(sets.groupBy("cluster").agg(F.sum(F.size("set")).alias("hashes")).where(F.col("hashes") > tree_hashes).select("cluster"), "wide")
    if not wide.isEmpty():
        part = sets.join(wide, "cluster", "left_semi")
        sets = written(sets.join(wide, "cluster", "left_anti").unionByName(part.drop("cluster").join(_refined(part, num, den), "rep").select(sets.columns)), "cluster-sets")
    sizes = sets.groupBy("cluster").agg(F.sum(F.size("set")).alias("hashes"), F.count(F.lit(1)).alias("members")).where("members > 1")
    plain = sets.join(sizes.where(F.col("hashes") <= tree_hashes).select("cluster"), "cluster", "left_semi")
    zero = F.lit(0).cast("long")
    row = lambda group, block, asked, asks, part: [group.alias("_group"), block.alias("_block"), asked.alias("_asked"), "rep", F.lit(asks).alias("asks"), part.alias("part"), "set"]
    edges = written(_join_groups(plain.select(*row(F.col("cluster"), zero, zero, False, F.col("rep"))), num, den), "links")
    large = written(sizes.where(F.col("hashes") > tree_hashes).select("cluster", F.ceil(F.col("hashes") * 2 / tree_hashes).cast("long").alias("blocks")), "large")
    if large.isEmpty():
        return edges
    # blocks of large clusters, each with the cluster's pivots
    blocked = written(sets.join(large, "cluster").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks")), "blocks")
    pivots = blocked.groupBy("cluster").agg(F.slice(F.array_sort(F.collect_set(F.when(F.pmod(F.xxhash64("rep", F.lit(1)), F.greatest(F.lit(1), F.col("blocks") * 64)) == 0, F.col("rep")))), 1, PIVOTS).alias("rep"))
    first = blocked.groupBy("cluster").agg(F.min("rep").alias("rep"))
    pivots = pivots.select("cluster", F.explode("rep").alias("rep")).unionByName(first).distinct()
    pivot_sets = blocked.join(pivots, ["cluster", "rep"], "left_semi").select("cluster", "rep", "set", "blocks", "block")
    spread = pivot_sets.select("cluster", "rep", "set", F.col("block").alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")).where("own != block")
    inner = blocked.select("cluster", "rep", "set", "block").unionByName(spread.select("cluster", "rep", "set", "block"))
    edges = written(edges.unionByName(_join_groups(inner.select(*row(F.col("cluster"), F.col("block"), zero, False, F.col("rep"))), num, den)), "links")
    # what is outside each cluster's main component asks all blocks
    found = components(edges)
    at = written(blocked.select("cluster", "rep", "block", "set", "blocks").join(found, F.col("rep") == F.col("node"), "left").select("cluster", "rep", "block", "set", "blocks", F.coalesce("component", "rep").alias("part")), "parts")
    counts = at.groupBy("cluster", "part").count()
    main = counts.groupBy("cluster").agg(F.max_by("part", F.struct("count", "part")).alias("main"))
    outside = at.join(main, "cluster").where("part != main")
    out_sizes = outside.groupBy("cluster").agg(F.ceil(F.sum(F.size("set")) * 2 / tree_hashes).cast("long").alias("asking"))
    asking = outside.join(out_sizes, "cluster").withColumn("asked", F.pmod(F.xxhash64("rep", F.lit(2)), "asking"))
    queries = asking.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    stored = at.join(out_sizes, "cluster").withColumn("asked", F.explode(F.sequence(F.lit(0).cast("long"), F.col("asking") - 1)))
    both = stored.select(*row(F.col("cluster"), F.col("block"), F.col("asked"), False, F.col("part"))).unionByName(queries.select(*row(F.col("cluster"), F.col("block"), F.col("asked"), True, F.col("part"))))
    return written(edges.unionByName(_join_groups(both, num, den)), "links")


def _some_of(rows: DataFrame, column: str, bits: int = 67_108_859):
    """A test that holds for every value of the column, and for few others while those are under some millions.

    A bit set of fixed size (a prime number of bits), of which the driver gets at most one row for 64 bits. It only saves
    moving rows that a join drops anyway.
    """
    at = rows.select(F.pmod(F.col(column), F.lit(bits)).alias("at"))
    words = at.groupBy(F.expr("at div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("b")).toArrow()
    table = np.zeros(bits // 64 + 1, np.int64)
    table[words.column("w").to_numpy()] = words.column("b").to_numpy()
    sent = rows.sparkSession.sparkContext.broadcast(table)

    def test(values: pa.Array) -> pa.Array:
        h = np.mod(values.to_numpy(zero_copy_only=False), bits)
        return pa.array((sent.value[h >> 6] >> (h & 63)) & 1 == 1)

    return test


def link_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", tree_hashes: int = TREE_HASHES) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id for every row of docs.

    class_id: the smallest id with the same n-gram set; component_id: the smallest id that links reach. A text without
    words (null, empty, white space) has no n-grams, links with nothing and is its own class and component. A row with a
    null id links with nothing and has a null class and component. Rows that share an id count as one node with the links
    of all of them. An empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = written(_sets(base, n, num, den), "sets")
    full = rows.where("n > 0 and doc_id is not null")
    classes = written(full.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")), "classes")
    heads = full.join(classes.select("k1", "k2", F.col("rep").alias("doc_id")), ["k1", "k2", "doc_id"], "left_semi")
    posted = heads.select(F.col("doc_id").alias("rep"), F.explode("head").alias("h"))
    shared = posted.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    lists = posted.join(shared, "h").groupBy("rep").agg(F.array_sort(F.collect_set(F.struct("c", "h"))).alias("common"))
    # the smallest set that one of n links to has ceil(n * num / den); of rows that share an id the smaller set counts
    least = F.greatest(F.lit(1), F.floor(F.floor((F.col("n") * num + den - 1) / den) / 10))
    close = lists.join(classes.groupBy("rep").agg(F.min("n").alias("n")), "rep").withColumn("least", least).where(F.size("common") >= F.col("least"))
    keys = written(close.select("rep", F.explode(F.slice("common", 1, F.size("common") - F.col("least").cast("int") + 1)).alias("x")).select("rep", "x.h"), "keys")
    hubs = keys.groupBy("h").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("c")).where("c > 1").select("h", "hub")
    clusters = components(keys.join(hubs, "h").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct())
    clusters = clusters.select(F.col("node").alias("rep"), F.col("component").alias("cluster"))

    clusters = written(clusters, "clusters")
    maybe = _some_of(clusters, "rep")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(maybe(batch.column(0)))
            for a, b in _blocks(batch.column(1), BLOCK_CHARS):
                part = batch.slice(a, b - a)
                made = [shingles(t.as_py(), n) for t in part.column(1)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(s) for s in made])]), pa.int32()), pa.array(np.concatenate(made)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["rep", "set"]).filter(pc.greater(pc.list_value_length(lists), 0))

    sets = base.where("doc_id is not null").mapInArrow(tidied(whole, _HASHES.clear), "rep long, set array<long>").join(clusters, "rep").select("cluster", "rep", "set")
    links = _cluster_links(sets, num, den, tree_hashes)
    reached = components(links).select(F.col("node").alias("rep"), "component")
    members = classes.join(reached, "rep", "left").select("k1", "k2", "rep", F.coalesce("component", "rep").alias("component"))
    out = rows.select("doc_id", "n", "k1", "k2").join(members, ["k1", "k2"], "left")
    alone = F.col("doc_id").isNull() | (F.col("n") == 0)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("rep")).alias("class_id"), F.when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of its component; texts without words all stay, and so do null ids
    and all rows that share that id. An empty table gives an empty one."""
    found = link_components(docs, n, num, den, id_col, text_col)
    drop = found.where("component_id != doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(drop, docs[id_col] == drop["_gone"], "left_anti")
