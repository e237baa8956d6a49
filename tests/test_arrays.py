import statistics

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from curatrix.functions import arrays


def test_gaps_and_outliers(spark):
    rows = [[1.0, 2.0, 5.0], [1.0, 2019.0, 2.0, 3.0], [4.5, 6.0], [7.0], [], [1.0, 300.0]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, n array<double>").withColumn("s", arrays.settled(F.col("n")))
    got = df.select("i", "s.kept", "s.outliers", F.array_sort(arrays.missing_between(F.col("s.kept"))).alias("m"), arrays.pad_width(F.col("s.kept")).alias("w")).orderBy("i").collect()
    assert [r.m for r in got] == [[3, 4], [], [5], [], [], []]
    assert [r.outliers for r in got] == [[], [2019.0], [], [], [], [300.0]]
    assert [r.w for r in got][:2] == [1, 1]


def test_deciles(spark):
    for n in (2, 3, 5, 9, 10, 11, 40):
        v = sorted((7 * i * i) % 31 + 0.5 * i for i in range(n))
        got = spark.createDataFrame([(v,)], "v array<double>").select(*(arrays.decile(F.col("v"), i) for i in range(1, 10))).first()
        assert all(abs(a - b) < 1e-9 for a, b in zip(got, statistics.quantiles(v, n=10)))


TRACK = st.builds(lambda d, n: {"duration": float(d), "filename": f"f{n}", "size": n}, st.integers(1, 4), st.integers(0, 3))


@settings(max_examples=200, deadline=None)
@given(st.lists(TRACK, max_size=4), st.lists(TRACK, max_size=6))
def test_held_tracks_is_an_ordered_subsequence(short, long):
    got = arrays._held(short, long)
    if got:
        held, missing = got
        assert held == len(short) and len(missing) == len(long) - len(short)


def test_held_tracks():
    t = lambda d, n: {"duration": d, "filename": n, "size": 0}
    assert arrays._held([t(10.0, "a"), t(20.5, "b")], [t(10.2, "x"), t(15.0, "y"), t(20.0, "z")]) == (2, ["y"])
    assert arrays._held([t(20.0, "a"), t(10.0, "b")], [t(10.0, "x"), t(20.0, "y"), t(30.0, "z")]) is None  # another order
    assert arrays._held([t(10.0, "a")], [t(10.0, "x"), t(20.0, "y")]) is None  # one track needs its name
    assert arrays._held([t(10.0, "a"), t(20.0, "b")], [t(10.0, "x"), t(20.0, "y"), t(30.0, "all")]) is None  # the book twice


def test_shares(spark):
    got = spark.range(1).select(arrays.percent_under(F.lit(0.0999), 0.1).alias("p"), arrays.percent_under(F.lit(0.1), 0.1).alias("q"), arrays.spread_over(F.lit(1.352), 1.35).alias("s")).first()
    assert (got.p, got.q, got.s) == ("9.9%", "9.9%", 1.352)
