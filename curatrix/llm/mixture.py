"""Mixing sources to target weights by Sainte-Laguë apportionment.

The mix has as many words as the documents. What each source shall give is its weight's share, at most ``MOST`` times what it
has. The mix is made of blocks of ``BLOCK_WORDS`` words, which go to sources one by one, each to the source with the highest
quotient target / (2 k + 1), where k is the number of blocks that it has. The blocks of a source go to its racks in the same
way, those of a rack to its shards, by their words; so every shard has a whole number of blocks to give, its quota.

A shard's documents stand in an order that the seed gives, their words are one stream, which is cut into blocks. A quota that
is larger than the stream takes all of it, once or twice; what is left of the quota comes from blocks in an order that the
seed gives too. Which words a document gives follows from where its words stand in the stream.

Nothing is decided in one place but for the table of sources (a row each, ordered in one task): racks and shards grow with the
square root of a source, a shard holds about ``SHARD_WORDS`` words, and a source that has a third of all documents has as many
more shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.llm.common import text_of, written

#: Words of a block, and of a shard, about.
BLOCK_WORDS = 32
SHARD_WORDS = 262_144
#: How often a source, and so each of its documents, is taken at most.
MOST = 3
#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: A table of sources up to this many bytes is sent to all tasks; beyond, it is joined, each source under so many salts.
SENT_BYTES = 4_000_000
SALTS = 64

_WORD = r"[^\x20\x09-\x0D]+"
_SHARD = ["_source", "_rack", "_shard"]
c = F.col


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size: the number of words of each whole text; 0 for null."""
    return docs.select(c(id_col).alias("doc_id"), c(source_col).alias("source"), F.regexp_count(text_of(docs[text_col]), F.lit(_WORD)).cast("long").alias("size"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sources (source, source_size) with place (by code point from 1, null last) and target.

    Weights are dealt by place. All sources together give the sum of sizes; none gives more than most times its size, and what
    those would have to give beyond goes to the others by weight. Sources reach their bound in the order of size by weight, so
    one pass in that order, with what is left for the others at each, finds all that do.
    """
    ordered = sources.withColumn("place", F.row_number().over(Window.orderBy(c("source").asc_nulls_last())))
    weighed = ordered.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((c("place") - 1) % len(weights) + 1).cast("int")))
    bound = (c("source_size") * most).cast("double")
    rising = Window.orderBy(c("source_size") / c("_w"), "place")
    before, rest, everything = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    told = weighed.withColumns({"_left": F.sum("source_size").over(everything) - F.coalesce(F.sum(bound).over(before), F.lit(0.0)), "_weights": F.sum("_w").over(rest)})
    told = told.withColumn("_full", c("_left") * c("_w") > bound * c("_weights"))
    open_ = [F.sum(F.when(~c("_full"), c("_w"))).over(everything), F.sum("source_size").over(everything) - F.sum(F.when(c("_full"), bound).otherwise(0.0)).over(everything)]
    return told.select("source", "source_size", "place", F.when(c("_full"), bound).otherwise(c("_w") * open_[1] / open_[0]).alias("target"))


def apportioned(rows: DataFrame, seats: Column, claim: str, within: list[str], order: list[str]) -> DataFrame:
    """rows with quota: seats of each group of rows (within), dealt by the highest quotient claim / (2 k + 1), ties by order.

    The seats that a row surely gets are counted from its share of a few seats less than there are, those that it may get from
    a few more; only the seats between (at most about four for each row of the group) compete, so a group is ranked in
    proportion to its rows, however many seats it has. Rows without a claim get none; seats must be one value in a group.
    """
    w = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    share = lambda more: c(claim) * F.greatest(c("_seats") + more * c("_n") / 2, F.lit(0.0)) / c("_all")
    live = rows.where(c(claim) > 0).withColumns({"_seats": seats.cast("double"), "_all": F.sum(claim).over(w).cast("double"), "_n": F.count(F.lit(1)).over(w)})
    live = live.withColumns({"_sure": F.greatest(F.floor(share(-1) - 0.5), F.lit(0)), "_may": F.ceil(share(1) + 0.5)})
    live = live.withColumn("_open", c("_seats") - F.sum("_sure").over(w))
    bids = live.withColumn("_bids", F.transform(F.sequence(c("_sure") + 1, c("_may")), lambda k: c(claim) / (2 * k - 1)))
    one = bids.select(*[x for x in bids.columns if x != "_bids"], F.explode("_bids").alias("_bid"))
    one = one.withColumn("_won", F.row_number().over(w.orderBy(c("_bid").desc(), *order)) <= c("_open"))
    kept = [x for x in rows.columns]
    return one.groupBy(*kept, "_sure").agg(F.count_if("_won").alias("_more")).select(*kept, (c("_sure") + c("_more")).alias("quota"))


def _digits(key: Column, at: int) -> Column:
    """Four bytes of a hash in hex as a number."""
    return F.conv(F.substring(key, at, 8), 16, 10).cast("long")


def mix(docs: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target (of its source), taken (words, repeats counted).

    The words that a source gives differ from its target by half a block, and where it gives all of its words most times by
    what rounding leaves in its shards (half a block each at most, one in SHARD_WORDS words). No document gives more than most
    times its size. Null and empty texts have size 0 and give none, a null source is a source of its own (the last), a null
    id is an id like others. Rows with one id are documents of their own; of equal rows it is not said which gives what. Other
    columns of docs play no part, whatever they are called. Equal tables and seeds give equal results, however the rows are laid
    out. A long text is one that stands in several blocks. An empty table gives an empty result.
    """
    sized = written(sizes(docs, id_col, text_col, source_col), "mix-sizes")
    per = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    wanted = (F.sum("source_size").over(Window.partitionBy(F.lit(0))) / block).cast("double")
    shards = F.greatest(F.ceil(c("source_size") / shard_words), F.lit(1))
    per = written(per.withColumns({"_blocks": F.round(wanted), "_racks": F.ceil(F.sqrt(shards)), "_shards": shards}), "mix-sources")
    quotas = written(apportioned(per.where("target > 0").select("place", "target", "_blocks"), c("_blocks"), "target", [], ["place"]).select("place", "quota"), "mix-quotas")
    per = written(per.join(quotas, "place", "left"), "mix-sources")

    rows = _told(sized, per, seed)
    empty = rows.where("size = 0").select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    rows = written(rows.where("size > 0").select("doc_id", "source", "size", "source_size", "target", "_key", "_quota", c("place").alias("_source"), "_rack", "_shard"), "mix-rows")

    parts = rows.groupBy(*_SHARD).agg(F.sum("size").alias("words"), F.first("_quota").alias("_quota"))
    racks = parts.groupBy("_source", "_rack").agg(F.sum("words").alias("words"), F.first("_quota").alias("_quota"))
    racks = apportioned(racks, c("_quota"), "words", ["_source"], ["_rack"]).select("_source", "_rack", c("quota").alias("_given"))
    parts = apportioned(parts.drop("_quota").join(racks, ["_source", "_rack"]), c("_given"), "words", ["_source", "_rack"], ["_shard"])
    parts = written(parts.select(*_SHARD, "words", F.least(c("quota") * block, c("words") * most).cast("long").alias("gives")), "mix-shards")
    return _taken(rows, parts, seed, block).unionByName(empty)


def _told(sized: DataFrame, per: DataFrame, seed: int) -> DataFrame:
    """Documents with what their source says, and the rack and shard that their id and the seed give."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(c("doc_id").cast("string"), F.lit(""))))
    salt = F.crc32(c("_key")) % SALTS
    keyed = sized.withColumn("_key", key)
    told = per.select(c("source").alias("_name"), "source_size", "target", "place", c("quota").alias("_quota"), "_racks", "_shards")
    size = per.agg(F.coalesce(F.sum(F.octet_length(F.coalesce("source", F.lit(""))) + 64), F.lit(0))).first()[0]
    if size <= SENT_BYTES:
        out = keyed.join(F.broadcast(told), c("source").eqNullSafe(c("_name")))
    else:
        salted = told.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = keyed.withColumn("_at", salt).join(salted, c("source").eqNullSafe(c("_name")) & (c("_at") == c("_salt")))
    each = F.ceil(c("_shards") / c("_racks"))
    return out.withColumns({"_rack": F.pmod(_digits(c("_key"), 1), c("_racks")), "_shard": F.pmod(_digits(c("_key"), 9), each)})


def _taken(rows: DataFrame, parts: DataFrame, seed: int, block: int) -> DataFrame:
    """What each document gives to its shard's share.

    Blocks and documents are places of one stream: going along it, the words taken before a document's start are those of the
    chosen blocks before plus its part of the block that it starts in, and what it gives ends where the next one starts.
    """
    by = Window.partitionBy(*_SHARD)
    whole = parts.select(*_SHARD, "words", "gives", F.floor(c("gives") / c("words")).alias("rounds"), (c("gives") % c("words")).alias("rest"))
    at = rows.join(whole, _SHARD).withColumn("start", F.sum("size").over(by.orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)) - c("size"))
    cut = whole.where("rest > 0").select(*_SHARD, "words", "rest", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((c("words") - 1) / block))).alias("n"))
    cut = cut.withColumns({"start": c("n") * block, "_len": F.least(F.lit(block).cast("long"), c("words") - c("n") * block), "_lot": F.md5(F.concat_ws(":", F.lit(str(seed)), *_SHARD, "n"))})
    drawn = F.sum("_len").over(by.orderBy("_lot", "n").rowsBetween(Window.unboundedPreceding, 0)) - c("_len")
    cut = cut.withColumn("take", F.greatest(F.lit(0).cast("long"), F.least(c("_len"), c("rest") - drawn)))
    own = ["doc_id", "source", "size", "source_size", "target", "_key", "rounds", "rest"]
    none = lambda *names: [F.lit(None).cast(dict(at.dtypes)[x]).alias(x) for x in names]
    line = at.select(*_SHARD, "start", F.lit(1).alias("_kind"), *own, F.lit(None).cast("long").alias("take"), F.lit(None).cast("long").alias("_from"))
    line = line.unionByName(cut.select(*_SHARD, "start", F.lit(0).alias("_kind"), *none(*own), "take", c("start").alias("_from")))
    along = by.orderBy("start", "_kind", "_key", "doc_id", "size")
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    line = line.withColumns({"_sum": F.sum("take").over(so_far), "_last": F.last("take", True).over(so_far), "_begin": F.last("_from", True).over(so_far)})
    line = line.where("_kind = 1").withColumn("_before", F.coalesce(c("_sum") - c("_last") + F.least(c("_last"), c("start") - c("_begin")), F.lit(0)))
    gives = F.coalesce(F.lead("_before").over(along), c("rest")) - c("_before")
    return line.select("doc_id", "source", "size", "source_size", "target", (c("rounds") * c("size") + gives).cast("long").alias("taken"))
