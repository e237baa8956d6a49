"""Functions of arrays: sequences, deciles, ordered lists."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Numbers may spread this far for each of them, and this far at least, before those far off are set aside.
SPAN_EACH, SPAN_LEAST = 20, 200


def settled(numbers: Column) -> Column:
    """struct(kept, outliers) of numbers: while they spread too far they are cut at their widest jump, the first of equal ones,
    and the smaller side goes, of equal sides the high one. Both are sorted; null counts as no numbers."""
    none = F.array().cast("array<double>")
    n = F.array_sort(F.coalesce(numbers, none))
    limit = lambda x: F.greatest(F.lit(float(SPAN_LEAST)), (SPAN_EACH * F.size(x)).cast("double"))
    wide = lambda x: (F.size(x) > 1) & (F.element_at(x, -1) - F.get(x, F.lit(0)) > limit(x))

    def cut(state: Column) -> Column:
        kept = state["kept"]
        jumps = F.zip_with(F.slice(kept, 2, F.size(kept) - 1), F.slice(kept, 1, F.size(kept) - 1), lambda b, a: b - a)
        at = F.array_position(jumps, F.array_max(jumps)).cast("int")
        low, high = F.slice(kept, 1, at), F.slice(kept, at + 1, F.size(kept) - at)
        lower = F.size(low) < F.size(high)
        return F.struct(F.when(lower, high).otherwise(low).alias("kept"), F.concat(state["outliers"], F.when(lower, low).otherwise(high)).alias("outliers"))

    start = F.struct(n.alias("kept"), none.alias("outliers"))
    cuts = F.aggregate(n, start, lambda state, _: F.when(wide(state["kept"]), cut(state)).otherwise(state))
    return F.when(wide(n), F.struct(cuts["kept"].alias("kept"), F.array_sort(cuts["outliers"]).alias("outliers"))).otherwise(start)


def missing_between(kept: Column) -> Column:
    """Whole numbers from the least (rounded up) to under the greatest that a list lacks."""
    low, high = F.ceil(F.array_min(kept)).cast("long"), (F.ceil(F.array_max(kept)) - 1).cast("long")
    have = F.transform(F.filter(kept, lambda x: x == F.floor(x)), lambda x: x.cast("long"))
    return F.when((F.size(kept) > 1) & (low <= high), F.array_except(F.sequence(low, F.greatest(low, high)), have)).otherwise(F.array().cast("array<bigint>"))


def pad_width(kept: Column) -> Column:
    """Digits in which a series writes its numbers: one, two from ten, three from a hundred."""
    top = F.array_max(kept)
    return F.when(top >= 100, 3).when(top >= 10, 2).otherwise(1)


def decile(ordered: Column, i: int) -> Column:
    """The i-th of nine points that cut a sorted list (two or more) into tenths, by the exclusive method; else null."""
    n = F.size(ordered)
    j = F.greatest(F.lit(1), F.least(F.floor(i * (n + 1) / 10).cast("int"), n - 1))
    delta = i * (n + 1) - j * 10
    return F.when(n >= 2, (F.get(ordered, j - 1) * (10 - delta) + F.get(ordered, j) * delta) / 10)


def decile_of(ordered: list[float], i: int) -> float:
    """decile() of a list in Python."""
    n = len(ordered)
    j = max(1, min(i * (n + 1) // 10, n - 1))
    delta = i * (n + 1) - j * 10
    return (ordered[j - 1] * (10 - delta) + ordered[j] * delta) / 10


def decile_sql(ordered: str, i: int) -> str:
    j = f"greatest(1, least(({i} * (len({ordered}) + 1)) // 10, len({ordered}) - 1))"
    return f"(CASE WHEN len({ordered}) >= 2 THEN ({ordered}[{j}] * (10 - ({i} * (len({ordered}) + 1) - {j} * 10)) + {ordered}[{j} + 1] * ({i} * (len({ordered}) + 1) - {j} * 10)) / 10 END)"


def subset_of(part: Column, whole: Column) -> Column:
    """All words of one list in the other, and at least one."""
    return (F.size(part) > 0) & (F.size(F.array_except(part, whole)) == 0)


def clash(a: Column, b: Column) -> Column:
    """The first key, in order, that two maps give different values; null if they agree on all they share."""
    shared = F.array_sort(F.array_intersect(F.map_keys(a), F.map_keys(b)))
    return F.get(F.filter(shared, lambda k: F.element_at(a, k) != F.element_at(b, k)), F.lit(0))


def percent_under(share: Column, limit: float) -> Column:
    """A share in percent, with one decimal, that never reads as the limit that it is under."""
    shown, top = F.floor(share * 1000 + 1e-9) / 10, round(limit * 1000) / 10
    return F.format_string("%.1f%%", F.when(shown >= top, F.lit(top - 0.1)).otherwise(shown))


def spread_over(spread: Column, limit: float) -> Column:
    """A spread rounded down to as few places, from two on, as still read as over the limit."""
    return F.coalesce(*[F.when(F.floor(spread * 10**p) / 10**p > limit, F.floor(spread * 10**p) / 10**p) for p in range(2, 7)], spread)


def spread_shown(spread: float, limit: float) -> float:
    """spread_over() of a number in Python."""
    return next((x for p in range(2, 7) if (x := math.floor(spread * 10**p) / 10**p) > limit), spread)


#: Tracks are the same within this many seconds; so few tracks, or so small a share, ask for a name or size as well; and
#: a track that is as long as all others within this share is the whole book once more.
TRACK_SECONDS, FEW_TRACKS, SMALL_SHARE, WHOLE_SHARE = 1.0, 2, 4, 0.02
TRACK = "struct<duration:double,filename:string,size:bigint>"


def _held(short: list[dict], long: list[dict]) -> tuple[int, list[str]] | None:
    if not short or len(short) >= len(long):
        return None
    strict = len(short) < FEW_TRACKS or len(short) * SMALL_SHARE < len(long)

    def same(a: dict, b: dict) -> bool:
        named = (a["filename"] and a["filename"] == b["filename"]) or (a["size"] and a["size"] == b["size"])
        return abs(a["duration"] - b["duration"]) <= TRACK_SECONDS and (not strict or bool(named))

    taken, at = set(), iter(range(len(long)))
    for s in short:
        hit = next((j for j in at if same(s, long[j])), None)
        if hit is None:
            return None
        taken.add(hit)
    left = [x for j, x in enumerate(long) if j not in taken]
    whole = sum(s["duration"] for s in short)
    if len(short) >= FEW_TRACKS and len(left) == 1 and abs(left[0]["duration"] - whole) <= WHOLE_SHARE * whole:
        return None
    return len(taken), [x["filename"] or "" for x in left]


@F.pandas_udf(T.StructType([T.StructField("held", T.IntegerType()), T.StructField("missing", T.ArrayType(T.StringType()))]))
def held_tracks(short: pd.Series, long: pd.Series) -> pd.DataFrame:
    """How many tracks of a short copy the long copy plays in the same order, and which it lacks; null if not all."""
    rows = [_held(list(a) if a is not None else [], list(b) if b is not None else []) for a, b in zip(short, long)]
    return pd.DataFrame({"held": pd.array([r[0] if r else None for r in rows], "Int32"), "missing": [r[1] if r else None for r in rows]})


@F.pandas_udf(T.ArrayType(T.StringType()))
def read_joined(joined: pd.Series, known: pd.Series) -> pd.Series:
    """Names of a comma-joined text if it can be cut into known names in one way only; else null."""

    def cut(text: str, names: set[str]) -> list[str] | None:
        parts = text.split(", ")
        ways: list[list[list[str]]] = [[[]]]
        for z in range(1, len(parts) + 1):
            found = [way + [name] for a in range(z) if (name := ", ".join(parts[a:z])) in names for way in ways[a]]
            ways.append(found[:2])
        return ways[-1][0] if len(ways[-1]) == 1 and text else None

    return pd.Series([cut(j or "", set(k) if k is not None else set()) for j, k in zip(joined, known)])
