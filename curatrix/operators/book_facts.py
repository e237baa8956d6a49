"""What a book's title, folder and reader fields say of which book and which reading it is, as Columns, and what tells two
books apart. Facts of one item are a struct: core, author, readers, labels, parent, names, numbers, positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curatrix.functions import text as t
from curatrix.operators.files import _SEGMENT, strip

# ---- Fixed values ---------------------------------------------------------------------------------

BRACKETED = r"[(\[]([^)\]]*)[)\]]"
BRACES = r"\s*\{[^}]*\}"
#: Editions and formats.
LABEL = (
    r"(?i)\b(anniversary|full[- ]?cast|cast|dramati[sz](ed|ation)|unabridged|abridged|remaster(ed)?|single[- ]?file|one[- ]file|files?|edition|version|bbc|radio|"
    r"graphic ?audio|audio ?drama|drama|extended|uncut|complete|retail|mp3|m4b|m4a|aac|aax|aaxc|flac|alac|opus|ogg|wav|wma|epub|pdf|vbr|cbr|kbps)\b"
)
#: What names neither a reader nor an edition.
NOBODY = (
    r"(?i)\b(novel|book|books|series|saga|trilogy|volume|vol|part|collection|stories|omnibus|various|multiple|unknown|anonymous|copy|rip|ripped|old|new|backup|alt|"
    r"alternate|duplicate|dupe|audible|audiobooks?|libation|libby|overdrive|itunes|chirp|kobo|storytel|downpour|spotify|bookbeat|nextory|librofm|hoopla|chaptered|"
    r"explicit|proper|hq|nlb|na|english|german|deutsch|french|francais|spanish|espanol|italian|dutch|swedish|polish|russian|japanese|chinese|korean)\b"
)
#: A note on the copy at the end of a folder's name.
COPY_NOTE = r"(?i)^\s*((old|new|alt|alternate|backup|duplicate|dupe)\s*)*(copy|rip|ripped|backup|duplicate|dupe)\s*(\d+)?\s*$"
#: Words of a person field that are no part of the name.
ROLES = ("translator", "translated", "narrator", "narrated", "editor", "edited", "foreword", "introduction", "read", "by", "and", "with")
NUMBER_WORDS = (
    "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen",
    "eighteen", "nineteen", "twenty",
)
NUMBERED = rf"(?i)(?:\b(vol(?:ume)?|book|part|dis[ck]|cd)|(#))\.?\s*(\d+(?:\.\d+)?|{'|'.join(NUMBER_WORDS)})\b"
FILE_ENDING = r"(?i)\.(m4b|m4a|mp3|mp4|aac|flac|ogg|opus|wma|wav)$"
LED_BARE = r"^(\d{1,3})(?:\s+|$)"
MOST_NAME_WORDS = 4

_PARENTHESIS = r"\s*[(\[][^)\]]*[)\]]"


def _none() -> Column:
    return F.array().cast("array<string>")


def name_words(name: Column) -> Column:
    """Words of a person's name, without initials and roles."""
    return F.filter(t.words(t.norm(name)), lambda w: (F.octet_length(w) > 1) & ~w.isin(*ROLES))


def within(part: Column, whole: Column) -> Column:
    """All words of a name are among others, and it has some."""
    return (F.size(part) > 0) & F.forall(part, lambda w: F.array_contains(whole, w))


def without_article(key: Column) -> Column:
    return F.regexp_replace(key, r"^(the|an|a) (?=.)", "")


def without_numbers(text: Column) -> Column:
    """Text without the words that have a digit."""
    return F.array_join(F.filter(F.split(F.trim(text), r"\s+"), lambda w: ~w.rlike("[0-9]")), " ")


def book_title(title: Column) -> Column:
    """A title as it names the book: no brackets, no series and number in front, no subtitle."""
    told = t.let(strip(title), lambda bare: F.when(bare.rlike(t._MARKED + "."), F.regexp_replace(bare, t._MARKED, "")).otherwise(bare))
    return t.trim(t.let(told, lambda x: F.when(F.instr(x, ":") > 1, F.substring_index(x, ":", 1)).otherwise(x)))


def core(title: Column) -> Column:
    return without_article(t.path_words(book_title(title)))


def turned_readers(names: Column) -> Column:
    """Names of a field; two neighbours of one word each are one name, last name first."""
    start = F.struct(_none().alias("done"), F.lit(None).cast("string").alias("held"))

    def step(s: Column, x: Column) -> Column:
        n, single = x["n"], x["single"]
        pair = s["held"].isNotNull() & single
        done = F.when(pair, F.array_append(s["done"], F.concat_ws(" ", n, s["held"]))).when(s["held"].isNotNull(), F.array_append(s["done"], s["held"])).otherwise(s["done"])
        return F.struct(F.when(single, done).otherwise(F.array_append(done, n)).alias("done"), F.when(~pair & single, n).alias("held"))

    told = F.transform(names, lambda n: F.struct(n.alias("n"), (F.size(name_words(n)) == 1).alias("single")))
    return F.aggregate(told, start, step, lambda s: F.when(s["held"].isNotNull(), F.array_append(s["done"], s["held"])).otherwise(s["done"]))


def bracketed(title: Column, folder: Column, author: Column) -> Column:
    """struct(readers, labels) that the brackets of a title and a folder name; author: the author's name words."""
    parts = F.flatten(F.transform(F.concat(F.regexp_extract_all(t.blank(title), F.lit(BRACKETED), 1), F.regexp_extract_all(t.blank(folder), F.lit(BRACKETED), 1)), lambda b: F.transform(F.split(b, ","), t.trim)))
    told = F.filter(F.array_distinct(parts), lambda p: F.size(name_words(p)) > 0)
    bare = lambda p: F.when(p.rlike("[0-9]"), without_numbers(p)).otherwise(p)
    reader = lambda p: ~p.rlike(LABEL) & (F.size(name_words(bare(p))) > 0) & ~p.rlike(NOBODY) & t.let(name_words(p), lambda w: ~within(w, author) & (F.size(w) <= MOST_NAME_WORDS))
    return t.let(told, lambda ps: F.struct(F.transform(F.filter(ps, reader), bare).alias("readers"), F.filter(ps, lambda p: p.rlike(LABEL)).alias("labels")))


def book_names(folder: Column, author: Column) -> Column:
    """The book that a folder names, as comparable words; none if it says nothing."""
    key = lambda v: without_article(t.path_words(v))
    kept = lambda vs: F.array_distinct(F.filter(F.transform(vs, key), lambda v: v.rlike(r"\p{L}") | v.rlike(r"^\d{3,}$")))
    noted = lambda s: (F.trim(s) != "") & s.rlike(COPY_NOTE)
    lone = lambda s: s.rlike(r"\d") & ~s.rlike(r"\p{L}")
    telling = lambda s: ~s.rlike(LABEL) & ~s.rlike(NOBODY) & t.let(name_words(s), lambda w: (F.size(w) > 0) & ~within(w, author))
    last = lambda segments: F.array_max(F.transform(segments, lambda s, i: F.when((i == 0) | ~noted(s), i).otherwise(0)))
    decides = lambda own: F.get(F.filter(F.reverse(F.slice(own, 2, F.greatest(F.size(own) - 1, F.lit(0)))), lambda s: lone(s) | telling(s)), F.lit(0))
    further = lambda own, x: F.when(x.isNull(), F.array(F.get(own, F.lit(0)))).when(lone(x), _none()).otherwise(F.array(x))
    by_own = lambda own: kept(F.concat(F.array(F.array_join(own, " - ")), t.let(decides(own), lambda x: further(own, x))))
    by_segments = lambda bare: t.let(F.split(bare, _SEGMENT), lambda segments: t.let(F.slice(segments, 1, last(segments) + 1), by_own))

    def named(plain: Column, bare: Column) -> Column:
        led = F.when(plain.rlike(t._LED + "."), kept(F.array(strip(F.regexp_replace(plain, t._LED, ""))))).otherwise(by_segments(bare))
        return F.when(bare.rlike(t._MARKED + "."), kept(F.array(F.regexp_replace(bare, t._MARKED, "")))).otherwise(led)

    return t.let(F.replace(F.regexp_replace(t.blank(folder), BRACES, ""), F.lit("&"), F.lit(" and ")), lambda plain: t.let(strip(plain), lambda bare: named(plain, bare)))


def name_numbers(name: Column) -> Column:
    """Numbers that are part of a name: array of struct(before, word, number); before: the words in front of it."""
    marked = F.split(F.regexp_replace(t.blank(name), NUMBERED, "\u0001$0\u0002$1$2\u0002$3\u0003"), "\u0001")
    number = lambda n: F.coalesce(F.array_position(F.array(*map(F.lit, NUMBER_WORDS)), F.lower(n)).cast("string"), n)
    as_number = lambda n: F.when(n.rlike(r"^\d"), n).otherwise(number(n))
    word = lambda w: F.when(F.lower(w).startswith("vol"), "vol").when(F.lower(w).isin("disk", "disc", "cd"), "disc").otherwise(F.lower(w))
    empty = F.array().cast("array<struct<before:string,word:string,number:string>>")

    def step(s: Column, p: Column) -> Column:
        found = F.struct(t.path_words(F.regexp_replace(s["text"], _PARENTHESIS, " ")).alias("before"), word(F.get(p, F.lit(1))).alias("word"), as_number(F.get(p, F.lit(2))).alias("number"))
        return F.struct(F.concat(s["text"], F.get(p, F.lit(0)), F.get(p, F.lit(3))).alias("text"), F.array_append(s["out"], found).alias("out"))

    pieces = lambda m: F.transform(F.slice(m, 2, F.size(m)), lambda piece: F.split(piece, "[\u0002\u0003]"))
    return t.let(marked, lambda m: F.aggregate(pieces(m), F.struct(F.get(m, F.lit(0)).alias("text"), empty.alias("out")), step, lambda s: s["out"]))


def positions(series: Column, rel_path: Column, folder: Column) -> Column:
    """Places in numbered series that a folder and the series field give: array of struct(key, number)."""
    shelf = t.vocab_key("series", t.parent_folder(rel_path))
    here = lambda key, number: F.array(F.struct(key.alias("key"), number.alias("number")))
    none = F.array().cast("array<struct<key:string,number:string>>")
    led = F.regexp_extract(folder, t._LED, 1)
    bare = F.regexp_extract(folder, LED_BARE, 1)
    by_folder = (
        F.when(folder.rlike(t._MARKED), here(t.vocab_key("series", F.regexp_extract(folder, t._MARKED, 1)), F.regexp_extract(folder, t._MARKED, 2)))
        .when(led != "", F.when(t.parent_folder(rel_path) != "", here(shelf, led)).otherwise(none))
        .when((bare != "") & (t.parent_folder(rel_path) != ""), here(shelf, bare))
        .otherwise(none)
    )
    by_field = F.transform(F.filter(series, lambda s: t.trim(s["sequence"]) != ""), lambda s: F.struct(t.vocab_key("series", s["name"]).alias("key"), t.trim(s["sequence"]).alias("number")))
    # the field counts where both speak
    return t.let(by_field, lambda told: F.concat(F.filter(by_folder, lambda x: ~F.exists(told, lambda y: y["key"] == x["key"])), told))


def facts(turned: Column | None = None) -> Column:
    """The facts of a row of the item table. turned: turned_readers() of its readers, where those are at hand."""
    own = F.struct(F.regexp_replace("rel_path", "^/+|/+$", "").alias("rel"), name_words(F.array_join("authors", ", ")).alias("author"))
    named = F.filter(turned_readers(F.col("narrators")) if turned is None else turned, lambda n: (F.size(name_words(n)) > 0) & ~n.rlike(LABEL) & ~n.rlike(NOBODY))
    parent = lambda rel: F.when(F.instr(rel, "/") > 0, F.regexp_replace(rel, "/[^/]*$", "")).otherwise("")

    def told(x: Column, folder: Column, brackets: Column) -> Column:
        return F.struct(
            core(F.col("title")).alias("core"), x["author"].alias("author"), F.transform(F.concat(named, brackets["readers"]), name_words).alias("readers"), brackets["labels"].alias("labels"),
            parent(x["rel"]).alias("parent"), F.when(x["rel"] != "", book_names(folder, x["author"])).otherwise(_none()).alias("names"),
            F.concat(name_numbers(F.col("title")), name_numbers(folder)).alias("numbers"), positions(F.col("series"), F.col("rel_path"), folder).alias("positions"),
        )

    by_folder = lambda x, base: t.let(F.regexp_replace(base, FILE_ENDING, ""), lambda folder: t.let(bracketed(F.col("title"), base, x["author"]), lambda brackets: told(x, folder, brackets)))
    return t.let(own, lambda x: t.let(t.base_name(x["rel"]), lambda base: by_folder(x, base)))


# ---- Two books ------------------------------------------------------------------------------------


def other_reader(a: Column, b: Column) -> Column:
    """Both name readers, and no name of one is within a name of the other."""
    known = (F.size(a["readers"]) > 0) & (F.size(b["readers"]) > 0)
    return known & ~F.exists(a["readers"], lambda x: F.exists(b["readers"], lambda y: within(x, y) | within(y, x)))


def conflict(a: Column, b: Column) -> Column:
    """numbers, if their names or their places in a series give one number differently; else null."""
    nested = lambda x, y: (x == y) | ((x != "") & (y != "") & (t.contains_words(x, y) | t.contains_words(y, x)))
    names = F.exists(a["numbers"], lambda x: F.exists(b["numbers"], lambda y: (x["word"] == y["word"]) & nested(x["before"], y["before"]) & ~t.same_number(x["number"], y["number"])))
    places = F.exists(a["positions"], lambda x: F.exists(b["positions"], lambda y: (x["key"] == y["key"]) & ~t.same_number(x["number"], y["number"])))
    return F.when(names, "numbers").when(places, "positions")


def folders_disagree(a: Column, b: Column) -> Column:
    """Both folders name a book, and not the same one."""
    return (F.size(a["names"]) > 0) & (F.size(b["names"]) > 0) & ~F.arrays_overlap(a["names"], b["names"])


def same_author(a: Column, b: Column) -> Column:
    return within(a["author"], b["author"]) | within(b["author"], a["author"])


def same_shelf(a: Column, b: Column) -> Column:
    """Both lie in one folder whose path names the author of one of them."""
    named = F.exists(F.split(a["parent"], "/"), lambda s: within(a["author"], name_words(s)) | within(b["author"], name_words(s)))
    return (a["parent"] != "") & (a["parent"] == b["parent"]) & named
