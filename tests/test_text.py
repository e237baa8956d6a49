import pytest
from pyspark.sql import functions as F

from curatrix.functions import arrays, text


def ask(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def each(spark, function, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"c{k} string" for k in range(len(rows[0]))))
    return [r.x for r in df.select("i", function(*[F.col(f"c{k}") for k in range(len(rows[0]))]).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize("raw, key", [("Nesbø, Jo", "nesbo jo"), ("O'Brien & Co.", "obrien co"), ("The_Last-One.  ", "the last one"), ("SF小説", "sf小説"), (None, ""), ("Straße Æon þing", "strasse aeon thing"), ("a  b　c", "a b c")])
def test_norm(spark, raw, key):
    assert each(spark, text.norm, [(raw,)]) == [key]


def test_vocabulary_keys(spark):
    assert each(spark, lambda c: text.vocab_key("authors", c), [("Sanderson, Brandon",), ("King, Jr.",), ("Read by  Sean Barrett",), ("a, b, c",)]) == ["brandon sanderson", "king jr", "sean barrett", "a b c"]
    assert each(spark, lambda c: text.vocab_key("series", c), [("The Chronicles of Amber Series",)]) == ["chronicles of amber"]
    assert each(spark, lambda c: text.vocab_key("languages", c), [("en-US",), ("Français",), ("Klingon",)]) == ["en", "fr", "klingon"]


#: name, whether it is a file, problems, what it should be.
SPACES = [
    ("End Credits .m4b", True, ["space_before_extension"], "End Credits.m4b"),
    (" 01 - Prologue.mp3", True, ["edge_space"], "01 - Prologue.mp3"),
    ("Prologue.mp3 ", True, ["edge_space"], "Prologue.mp3"),
    ("Mr. Smith Goes", True, [], "Mr. Smith Goes"),
    ("Dune ", False, ["edge_space"], "Dune"),
    ("Dune\tMessiah", False, ["odd_space"], "Dune Messiah"),
    ("Title : Subtitle", False, ["space_before_colon"], "Title: Subtitle"),
    ("第一　第二", False, [], "第一　第二"),
    ("A  B .mp3", True, ["double_space", "space_before_extension"], "A B.mp3"),
    ("Chapter Three .m4b", True, ["odd_space", "space_before_extension"], "Chapter Three.m4b"),
    (" Dune", False, ["odd_space", "edge_space"], "Dune"),
    ("Chapter 1 .mp3 ", True, ["edge_space", "space_before_extension"], "Chapter 1.mp3"),
    ("A  B", False, ["odd_space", "double_space"], "A B"),
    ("Title : Sub", False, ["odd_space", "space_before_colon"], "Title: Sub"),
    ("   ", False, ["double_space", "edge_space"], ""),
    (" .m4b", True, ["edge_space", "space_before_extension"], ""),
]


def test_white_space(spark):
    df = spark.createDataFrame([(i, n, f) for i, (n, f, _, _) in enumerate(SPACES)], "i int, n string, f boolean")
    got = df.select("i", text.space_problems(F.col("n"), F.col("f")).alias("p"), text.space_fixed(F.col("n"), F.col("f")).alias("x")).orderBy("i").collect()
    assert [(r.p, r.x) for r in got] == [(p, x) for _, _, p, x in SPACES]


NAMES = ["Chapter 1 .mp3 ", "A  B .mp3", "Part Two ꞉ Six", "Part Two ꞉  Six ꞉ Seven .m4b", "\tDune\t", " :Lead", "x.mp3 .m4b", "file.tar .gz", ". hidden ", "A ꞉ ꞉ B", "End .mp3", "Name\r\n.mp3"]


@pytest.mark.parametrize("file", [False, True])
def test_white_space_put_right_is_right(spark, file):
    df = spark.createDataFrame([(n,) for n in NAMES], "n string").select(text.space_fixed(F.col("n"), file).alias("x"))
    assert all(not r.p for r in df.where("x != ''").select(text.space_problems(F.col("x"), file).alias("p")).collect())


def test_descriptions(spark):
    long = "word " * 60
    assert each(spark, text.stub_description, [(None,), ("<p> </p>",), ("Read by Paul Heck",), ("https://x.org/a",), ("short",), (long,), ("Introduction by N. " + long,)]) == ["empty", "empty", "credit", "url", "stub", None, None]


def test_titles(spark):
    rows = [("The Hobbit (Unabridged)", "Hobbit"), ("Dune: Part One", "Dune"), ("The Final Empire", "The Final Empyre"), ("Mort", "Sourcery"), ("", "x"), ("Jim Dale", "Jim Dole")]
    assert each(spark, text.title_level, rows) == [2, 1, 1, 0, 0, 1]
    assert each(spark, text.truncation_of, [("fajer al", "fajer al kaisi"), ("full cast", "full cast recording"), ("jack evans", "jack r b evans"), ("abc", "abcd")]) == [True, True, True, False]


def test_series(spark):
    rows = [("Dune Series", ""), ("Frank Herbert", "Frank Herbert"), ("Dune Book 3", ""), ("Dune ", ""), ("Dune", "")]
    assert [(r.problems, r.suggest) for r in each(spark, text.odd_series_name, rows)] == [(["redundant_word"], "Dune"), (["named_after_author"], ""), (["sequence_in_name"], ""), (["stray_characters"], "Dune"), ([], "")]
    assert each(spark, text.folder_number, [("A/Discworld - 03 - Mort",), ("03 - Mort",), ("Mort Vol. 2",), ("Mort",)]) == [("Discworld", "03"), ("", "03"), ("", "2"), ("", "")]
    assert each(spark, lambda c: text.folder_style(c)["kind"], [("A - 1 - B",), ("A - 1",), ("01 - B",), ("Laddertop 2",), ("Mort",)]) == ["numbered", "series_number", "lead", "volume", "bare"]
    assert each(spark, lambda c: text.style_number(c, F.lit(2)), [("2",), ("2.5",), ("x",), ("-1",), ("inf",)]) == ["02", "02.5", "x", "-1", "inf"]
    assert each(spark, text.same_number, [("01", "1.0"), ("a", " a"), ("1", "2")]) == [True, True, False]


def test_names(spark):
    assert each(spark, lambda c: F.array_join(text.split_names(c), "|"), [("A & B, C and D",)]) == ["A|B|C|D"]
    assert each(spark, text.initials_of, [("j k rowling", "joanne kathleen rowling"), ("john smith", "joan smith")]) == [True, False]
    known = spark.createDataFrame([("Jane Doe, Ph.D., John", ["Jane Doe, Ph.D.", "John"]), ("A, B", ["A", "B", "A, B"]), ("X", ["A"])], "j string, k array<string>")
    assert [r.x for r in known.select(arrays.read_joined("j", "k").alias("x")).collect()] == [["Jane Doe, Ph.D.", "John"], None, None]


def test_dates(spark):
    got = each(spark, lambda c: text.pub_date(c).cast("string"), [("Mon, 02 Jan 2006 15:04:05 +0000",), ("2006-01-02",), ("nonsense",)])
    assert got == ["2006-01-02 15:04:05", "2006-01-02 00:00:00", None]
