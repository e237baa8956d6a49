"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood ratio.

DataFrame functions only. Matches get their offsets (code points, end exclusive) from the lengths of what stands between
them: split() and regexp_extract_all() see a text the same way. Long tokens are then scored by two first-order Markov
models, of random strings and of ordinary identifiers, that are counted from labelled samples; a token whose mean
log-likelihood ratio for a transition reaches a threshold is a secret too. The table of transitions has at most 80 x 80
entries, whatever the input.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm.common import text_of

#: Patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the whole run of at least 20, as a shorter one has no longer tail
HEX = r"[0-9a-f]{24,}"
ASSIGN_VALUE = 6
KINDS = ("assign", "access", "hex", "random")
#: A token to score: a run of at least this many characters with a letter and a digit.
TOKEN_CHARS = "A-Za-z0-9+/_=-"
TOKEN_LEAST = 20
#: Mean log-likelihood ratio (nats for each transition) from which a token counts as random.
RATIO = 0.5
_FIRST, _CODES = 43, 80  # '+' to 'z'
_SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def labelled_samples(spark: SparkSession, docs: DataFrame | None = None, text_col: str = "text", id_col: str = "doc_id", random_rows: int = 4000, ordinary_docs: int = 2000) -> DataFrame:
    """Training tokens: token, label (1 random, 0 ordinary). Both sides are bounded by the given numbers.

    Random: digests of numbers as hexadecimal, upper-case hexadecimal, base 64 and upper-case letters with digits.
    Ordinary: the words of about ordinary_docs texts of docs, by a bound on hashed ids (of at least 4 letters, not shaped
    like a base match), and identifiers made of two of a fixed list of programming words with a number.
    """
    n = spark.range(random_rows)
    digest = F.sha2(F.col("id").cast("string"), 256)
    raw = F.base64(F.unhex(digest))
    random = n.select(F.explode(F.array(digest, F.upper(F.substring(digest, 1, 40)), raw, F.substring(F.regexp_replace(F.upper(raw), "[^A-Z0-9]", ""), 1, 24))).alias("token")).select("token", F.lit(1).alias("label"))
    words = "get set item user name list count index value order price table page file path data load save read write parse build check cache queue node tree hash map key row column config service client server request response error state event handler"
    w = F.split(F.lit(words), " ")
    k = F.size(w)
    one, two = F.element_at(w, (F.col("id") % k + 1).cast("int")), F.element_at(w, (F.floor(F.col("id") / k) % k + 1).cast("int"))
    number = F.element_at(F.array(F.lit(""), F.lit("1"), F.lit("2"), F.lit("10"), F.lit("2024"), F.lit("-01")), (F.col("id") % 6 + 1).cast("int"))
    made = n.select(F.explode(F.array(F.concat_ws("_", one, two, number), F.concat(one, F.initcap(two), number), F.concat_ws("-", one, two, number), F.concat_ws("/", one, two, F.lit("index")))).alias("token")).select("token", F.lit(0).alias("label"))
    out = random.unionByName(made)
    if docs is not None:
        share = min(1.0, ordinary_docs / max(1, docs.count()))
        picked = docs.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < share * (1 << 30)).select(text_of(text_col).alias("t"))
        found = picked.select(F.explode(F.regexp_extract_all("t", F.lit(rf"[{TOKEN_CHARS}]{{4,}}"), 0)).alias("token"))
        found = found.where(~F.col("token").rlike(f"{HEX}|{ACCESS}") & ~F.col("token").rlike(rf"^(?=.*[0-9])[{TOKEN_CHARS}]{{{TOKEN_LEAST},}}$")).select("token", F.lit(0).alias("label"))
        out = out.unionByName(found)
    return out


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of transitions, random against ordinary; add-one counts over the letters, digits and signs."""
    code = lambda c: F.ascii(c) - _FIRST
    spread = samples.where(F.length("token") > 1).select("label", "token", F.posexplode(F.split("token", "")).alias("at", "one"))
    pairs = spread.select("label", code(F.col("one")).alias("a"), code(F.expr("substring(token, at + 2, 1)")).alias("b")).where(f"a between 0 and {_CODES - 1} and b between 0 and {_CODES - 1}")
    counts = pairs.groupBy("label", "a", "b").count().collect()  # at most 2 x 80 x 80 rows
    import math

    tables = [[[1.0 / 66] * _CODES for _ in range(_CODES)] for _ in range(2)]  # a prior of one transition a state
    for row in counts:
        tables[row["label"]][row["a"]][row["b"]] += row["count"]
    logs = [[[math.log(x / sum(states)) for x in states] for states in t] for t in tables]
    return [round(r - o, 4) for rs, os in zip(logs[1], logs[0]) for r, o in zip(rs, os)]


def _found(text: Column, pattern: str, kind: str, keep=None, group_lengths: bool = False) -> Column:
    """Spans of a pattern's matches, leftmost and non-overlapping; keep: a condition on the whole match or on its group.

    Texts without a match are searched once only. A text with n matches takes n copies of a growing list, which matters
    only from tens of thousands of matches in one text on.
    """
    matches, between = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)
    groups = F.regexp_extract_all(text, F.lit(pattern), 1) if group_lengths else matches
    rank = KINDS.index(kind)
    each = F.arrays_zip(matches.alias("m"), F.slice(between, 1, F.size(matches)).alias("b"), groups.alias("g"))
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast(_SPAN).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.length(x["b"])
        z = a + F.length(x["m"])
        span = F.array(F.struct(a.alias("start"), F.lit(rank).alias("rank"), z.alias("end"), F.lit(kind).alias("kind")))
        before = F.coalesce(acc["spans"], F.array().cast(_SPAN))
        after = F.concat(before, span) if keep is None else F.when(keep(x["g"]), F.concat(before, span)).otherwise(before)
        return F.struct(z.alias("at"), after.cast(_SPAN).alias("spans"))

    spans = F.coalesce(F.aggregate(each, start, step)["spans"], F.array().cast(_SPAN))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_SPAN))


def _ratio(ratios: list[float], token: Column) -> Column:
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")  # folded into one literal
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c) - _FIRST)
    state = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("last"))
    step = lambda s, c: F.struct((s["sum"] + F.when(s["last"] < 0, 0.0).otherwise(F.get(table, s["last"] * _CODES + c))).alias("sum"), c.alias("last"))
    return F.aggregate(codes, state, step)["sum"] / (F.length(token) - 1)


def held_out(samples: DataFrame) -> DataFrame:
    """samples with ``held``: a fifth of the tokens, by hash, to judge by what the others teach."""
    return samples.withColumn("held", F.pmod(F.xxhash64("token"), F.lit(5)) == 0)


def quality(samples: DataFrame, ratios: list[float], threshold: float = RATIO) -> DataFrame:
    """recall and precision of the threshold over labelled tokens that could be added spans; null where there are none."""
    fit = samples.where(F.col("token").rlike(rf"^(?=.*[0-9])(?=.*[A-Za-z])[{TOKEN_CHARS}]{{{TOKEN_LEAST},}}$"))
    said = fit.select("label", (_ratio(ratios, F.col("token")) >= threshold).alias("said"))
    hits, random, called = F.count_if(F.col("said") & (F.col("label") == 1)), F.count_if(F.col("label") == 1), F.count_if("said")
    return said.agg(F.try_divide(hits, random).alias("recall"), F.try_divide(hits, called).alias("precision"))


def scan(docs: DataFrame, ratios: list[float], text_col: str = "text", to: str = "spans", threshold: float = RATIO) -> DataFrame:
    """docs with ``to``: array<struct<start, rank, end, kind>>, sorted by start, then kind as listed.

    Base spans stay as they are found. A scored token is added as kind ``random`` where it overlaps no base span. Null
    and empty texts have no spans. Each row is scanned by itself and whole, so repeated rows have equal spans; an empty table
    gives an empty one. An existing column named ``to`` is replaced.
    """
    text = text_of(text_col)
    token = rf"(?<![{TOKEN_CHARS}])(?=[{TOKEN_CHARS}]*[0-9])(?=[{TOKEN_CHARS}]*[A-Za-z])[{TOKEN_CHARS}]{{{TOKEN_LEAST},}}"
    base = F.concat(_found(text, ASSIGN, "assign", lambda g: F.length(g) >= ASSIGN_VALUE, True), _found(text, ACCESS, "access"), _found(text, HEX, "hex"))
    added = _found(text, token, "random", lambda g: _ratio(ratios, g) >= threshold)
    own = [c for c in docs.columns if c != to]
    names = {"base": "_base", "added": "_added"}
    while set(names.values()) & set(own):
        names = {k: f"_{v}" for k, v in names.items()}
    b, a = F.col(names["base"]), F.col(names["added"])
    clear = F.filter(a, lambda x: ~F.exists(b, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])))
    return docs.select(*own, base.alias(names["base"]), added.alias(names["added"])).select(*own, F.array_sort(F.concat(b, clear)).alias(to))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "<secret>") -> Column:
    """The text with every secret replaced; spans that overlap are replaced together."""
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(s: Column, x: Column) -> Column:
        gap = F.when(x["start"] >= s["at"], F.concat(F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.concat(s["out"], gap).alias("out"), F.greatest(s["at"], x["end"]).alias("at"))

    done = F.aggregate(spans, state, step)
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: reduce(lambda p, q: p | q, [s["kind"] == k for k in KINDS[:3]]))
