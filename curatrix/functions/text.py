"""Text keys and text checks as Column expressions. Null is the empty text throughout."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values: lists that results depend on -------------------------------------------------

#: White space by Unicode, as a regular expression class body.
SPACE = r"\t\n\x0B\f\r \x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The same characters.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Accented Latin letters by the plain letters that they count as.
FOLDS = {
    "a": "àáâãäåāąă", "ae": "æ", "c": "çćčċ", "d": "ďđð", "e": "èéêëēęěė", "g": "ğģ",
    "i": "ìíîïīıį", "l": "łļľ", "n": "ñńňņ", "o": "òóôõöøōőœ", "r": "řŗ", "s": "šşśș", "ss": "ß",
    "t": "ťţț", "th": "þ", "u": "ùúûüūůűų", "y": "ýÿ", "z": "žźż",
}
#: Codes and names of languages, each with the code that stands for it.
LANGUAGES = {
    "en": "en", "eng": "en", "english": "en",
    "de": "de", "ger": "de", "deu": "de", "german": "de", "deutsch": "de",
    "fr": "fr", "fra": "fr", "fre": "fr", "french": "fr", "francais": "fr",
    "es": "es", "spa": "es", "spanish": "es", "espanol": "es",
    "it": "it", "ita": "it", "italian": "it", "italiano": "it",
    "nl": "nl", "dut": "nl", "nld": "nl", "dutch": "nl", "nederlands": "nl",
    "pt": "pt", "por": "pt", "portuguese": "pt",
    "ru": "ru", "rus": "ru", "russian": "ru",
    "ja": "ja", "jpn": "ja", "japanese": "ja",
    "zh": "zh", "chi": "zh", "zho": "zh", "chinese": "zh", "mandarin": "zh",
    "sv": "sv", "swe": "sv", "swedish": "sv",
    "no": "no", "nor": "no", "norwegian": "no",
    "da": "da", "dan": "da", "danish": "da",
    "fi": "fi", "fin": "fi", "finnish": "fi",
    "pl": "pl", "pol": "pl", "polish": "pl",
    "cs": "cs", "cze": "cs", "ces": "cs", "czech": "cs",
    "la": "la", "lat": "la", "latin": "la",
}
#: Phrases in front of a person's name that aren't part of it.
NAME_PHRASES = (
    "read by", "narrated by", "performed by", "performance by", "narration by", "introduction by", "intro by",
    "foreword by", "afterword by", "translated by", "narrators", "narrator", "translator", "featuring", "feat", "with",
)
#: Values that are no name.
FRAGMENTS = (
    "ph d", "phd", "md", "m d", "dc", "jr", "sr", "ii", "iii", "iv", "esq", "et al", "and", "others", "various",
    "unknown", "n a", "none", "tbd",
)
#: Fields that hold persons.
PERSON_FIELDS = ("authors", "narrators")
NAME_SUFFIX = r"(?i)^(jr|sr|ii|iii|iv|phd|md|esq|dds)\.?$"
TITLE_NOISE = r"(?iu)\s*[\(\[](unabridged|abridged|dramati[sz]ed|dramatization|a novel|audiobook|audio book|(read|narrated|performed) by [^\)\]]*)[\)\]]"
TITLE_SPLIT = r"\s*:\s+|\s+[-–—]\s+"
NAME_SPLIT = r"\s*[,;/&]\s*|\s+and\s+"
CREDIT_LINE = r"(?i)^(read|narrated|performed|narration|introduction|foreword)\s+by\b"
ONLY_URL = r"(?i)^https?://\S+$"
STUB_BYTES, CREDIT_BYTES = 120, 240
PLACEHOLDER = r"(?i)^(audio ?books?|books?|unknown|other|general|vocal|misc(ellaneous)?|none|n/a|default)$"
PLACEHOLDER_PREFIX = r"(?i)^audio ?books?\s*[-:/,]\s*"
VALUE_JOIN = r"\s*[,/:;]\s*"
MARKER = r"^[a-z0-9_-]+:"
EDITION_MARKER = r"(?i)\s*[(\[](un)?abridged[)\]]"
ABRIDGED = r"(?i)\babridged\b"
UNABRIDGED = r"(?i)\bunabridged\b"
PRODUCTION = r"(?iu)\b(dramati[sz](e|ed|es|ing|ation|ations)\b|full[\s.\-]*cast\b|(radio|audio)([\s.\-]*(\d+|four))?[\s.\-]*(dramas?|plays?|theat(re|er)s?)\b|h(ö|oe)rspiele?\b)"

# ---- Keys -----------------------------------------------------------------------------------------


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once for each row. An expression that is written out several times, in branches or in
    lambdas, is else computed each time that it is read, and inside a lambda for each element."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda held, _: held, use)


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def trim(c: Column) -> Column:
    return F.regexp_replace(blank(c), f"^[{SPACE}]+|[{SPACE}]+$", "")


def fold(c: Column) -> Column:
    """Lower case, with accented Latin letters as plain ones."""
    return _folded(c, "", "")


def _folded(c: Column, signs: str, plain: str) -> Column:
    """fold() with other signs replaced in the same pass."""
    single = {x: plain for plain, letters in FOLDS.items() if len(plain) == 1 for x in letters}
    out = F.translate(F.lower(blank(c)), "".join(single) + signs, "".join(single.values()) + plain)
    for plain, letters in FOLDS.items():
        if len(plain) > 1:
            for x in letters:
                out = F.replace(out, F.lit(x), F.lit(plain))
    return out


def norm(c: Column) -> Column:
    """The universal key: folded letters and digits; space, ``_ - .`` as one space; other signs dropped within words."""
    spaced = _folded(c, "_-." + SPACES, " " * (3 + len(SPACES)))
    return F.trim(F.regexp_replace(F.regexp_replace(spaced, r"[^\p{L}\p{Nd} ]+", ""), "  +", " "))


def words(key: Column) -> Column:
    """Words of a key."""
    return F.filter(F.split(key, " "), lambda w: w != "")


def first_last(c: Column) -> Column:
    """``Last, First`` turned round: one comma, both sides full, the second no suffix such as Jr."""
    one = lambda v: F.length(v) - F.length(F.replace(v, F.lit(","), F.lit(""))) == 1
    sides = lambda v: F.struct(trim(F.substring_index(v, ",", 1)).alias("last"), trim(F.substring_index(v, ",", -1)).alias("first"))
    turned = lambda v: let(sides(v), lambda x: F.when((x["first"] != "") & (x["last"] != "") & ~x["first"].rlike(NAME_SUFFIX), F.concat_ws(" ", x["first"], x["last"])).otherwise(v))
    return let(blank(c), lambda v: F.when(one(v), turned(v)).otherwise(v))


def name_core(key: Column) -> Column:
    """A person's key without the phrases in front."""
    return F.regexp_replace(key, f"^(({'|'.join(NAME_PHRASES)}) )+", "")


def language_base(c: Column) -> Column:
    """A language without its region."""
    return F.regexp_replace(blank(c), r"(?s)^([^\-_]+)[\-_].*$", "$1")


def language_code(c: Column) -> Column:
    """The code of a known language, else null."""
    key = norm(language_base(c))
    return F.coalesce(*[F.when(key.isin(*[name for name, of in LANGUAGES.items() if of == code]), F.lit(code)) for code in dict.fromkeys(LANGUAGES.values())])


def vocab_key(field: str, c: Column) -> Column:
    """What two spellings of a value of this field share."""
    if field in PERSON_FIELDS:
        return name_core(norm(first_last(c)))
    if field == "series":
        return F.regexp_replace(F.regexp_replace(norm(c), "^the ", ""), " series$", "")
    return F.coalesce(language_code(c), norm(c)) if field == "languages" else norm(c)


def surname(c: Column) -> Column:
    """The last word of a name that is neither a suffix nor an initial."""
    full = F.filter(words(norm(c)), lambda w: (F.length(w) > 1) & ~w.isin("jr", "sr", "ii", "iii", "iv", "phd", "md", "esq", "dds"))
    return F.coalesce(F.try_element_at(full, F.lit(-1)), F.lit(""))


# ---- Titles and names -----------------------------------------------------------------------------


def clean_title(c: Column) -> Column:
    return F.regexp_replace(norm(F.regexp_replace(blank(c), TITLE_NOISE, " ")), "^the ", "")


def title_forms(c: Column) -> Column:
    """The clean title, and its parts around a colon or dash of four bytes or more."""
    return _forms_beside(c, clean_title(c))


def _forms_beside(c: Column, clean: Column) -> Column:
    """title_forms() of a title whose clean form is at hand."""
    parts = F.transform(F.split(F.regexp_replace(blank(c), TITLE_NOISE, " "), TITLE_SPLIT), clean_title)
    return F.array_distinct(F.concat(F.array(clean), F.filter(parts, lambda p: F.octet_length(p) >= 4)))


def typo_apart(a: Column, b: Column) -> Column:
    """One edit between keys of six letters or more; two from twelve on if the first word is the same."""
    short = F.least(F.length(a), F.length(b))
    close = let(F.levenshtein(a, b, 2), lambda d: (d == 1) | ((d == 2) & (short >= 12) & (F.substring_index(a, " ", 1) == F.substring_index(b, " ", 1))))
    return (a != b) & (short >= 6) & (F.abs(F.length(a) - F.length(b)) <= 2) & close


#: The letters of the words that differ, from which on one slip makes two spellings of one thing.
SLIP_LETTERS = 5


def slip_apart(a: Column, b: Column) -> Column:
    """Stricter, for vocabularies: one edit or one swap of neighbours, in words that aren't short."""
    d = F.levenshtein(a, b, 2)
    x, y = F.split(a, ""), F.split(b, "")
    i = F.array_position(F.zip_with(x, y, lambda p, q: p != q), True).cast("int")
    swapped = (d == 2) & (F.length(a) == F.length(b)) & (F.concat(F.substr(b, F.lit(1), i - 1), F.substr(b, i + 1, F.lit(1)), F.substr(b, i, F.lit(1)), F.substr(b, i + 2)) == a)
    own = F.array_join(F.array_except(words(a), words(b)), "")
    other = F.array_join(F.array_except(words(b), words(a)), "")
    return (a != b) & ((d == 1) | F.coalesce(swapped, F.lit(False))) & (F.greatest(F.length(own), F.length(other)) >= SLIP_LETTERS) & (F.least(F.length(a), F.length(b)) >= 6)


def title_level(a: Column, b: Column) -> Column:
    """2: the same title, 1: a form of it or a slip away, 0: another, or one is missing."""
    near = lambda x, y: let(_forms_beside(b, y), lambda theirs: F.exists(_forms_beside(a, x), lambda f: F.exists(theirs, lambda g: (f == g) | typo_apart(f, g))))
    level = lambda x, y: F.when((x == "") | (y == ""), 0).when(x == y, 2).when(near(x, y), 1).otherwise(0)
    return let(clean_title(a), lambda x: let(clean_title(b), lambda y: level(x, y)))


def split_names(c: Column) -> Column:
    return F.filter(F.transform(F.split(blank(c), NAME_SPLIT), trim), lambda n: n != "")


def initials_of(a: Column, b: Column) -> Column:
    """One key is the other with some words but the last cut to their first letters, word by word."""
    cut = lambda p, q: (F.length(p) == 1) & F.startswith(q, p)
    pairs = lambda x, y: F.zip_with(x, y, lambda p, q: (p == q) | cut(p, q) | cut(q, p))
    fits = lambda x, y: (F.size(x) == F.size(y)) & (F.size(x) > 1) & (F.element_at(x, -1) == F.element_at(y, -1)) & F.forall(pairs(x, y), lambda t: F.coalesce(t, F.lit(False)))
    return (a != b) & let(words(a), lambda x: let(words(b), lambda y: fits(x, y)))


def shares_name(a: Column, b: Column) -> Column:
    """Two lists of names have one in common, initials allowed."""
    return let(F.transform(b, norm), lambda theirs: shares_key(F.transform(a, norm), theirs))


def shares_key(a: Column, b: Column) -> Column:
    """shares_name() of lists of keys."""
    return F.exists(a, lambda x: F.exists(b, lambda y: (x == y) | F.coalesce(initials_of(x, y), F.lit(False))))


def same_names(a: Column, b: Column) -> Column:
    """Two lists hold the same names, whatever the order, case and accents."""
    return F.array_sort(F.transform(a, norm)) == F.array_sort(F.transform(b, norm))


def truncation_of(short: Column, long: Column) -> Column:
    """A key cut off (six bytes or more, spaces aside), or without its middle words."""
    s, l = F.replace(short, F.lit(" "), F.lit("")), F.replace(long, F.lit(" "), F.lit(""))
    sw, lw = words(short), words(long)
    kept = F.aggregate(lw, F.lit(0), lambda i, w: F.when(F.get(sw, i) == w, i + 1).otherwise(i))
    middle = (F.size(sw) >= 2) & (F.size(sw) < F.size(lw)) & (F.get(sw, F.lit(0)) == F.get(lw, F.lit(0))) & (F.element_at(sw, -1) == F.element_at(lw, -1)) & (kept == F.size(sw))
    return (short != long) & (((F.octet_length(s) >= 6) & F.startswith(l, s)) | F.coalesce(middle, F.lit(False)))


def split_value(c: Column) -> Column:
    """A person field that holds more than one name."""
    return blank(c).rlike("[/;&]") | F.array_contains(words(norm(c)), "and")


def split_parts(c: Column) -> Column:
    return F.filter(F.transform(F.split(blank(c), r"[/&;]| (?:and|And|AND) "), trim), lambda p: p != "")


def safe_folder_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(blank(c), '/\\:*?"<>|', "         "), " +", " "))


def looks_like_id(c: Column) -> Column:
    return blank(c).rlike(r"(?i)^([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|li_.*)$")


def title_contains(title: Column, query: Column) -> Column:
    return F.contains(F.lower(blank(title)), F.lower(blank(query)))


def contains_words(whole: Column, part: Column) -> Column:
    """Whole words of a key within another."""
    return F.contains(F.concat(F.lit(" "), whole, F.lit(" ")), F.concat(F.lit(" "), part, F.lit(" ")))


def path_words(c: Column) -> Column:
    """A key with numbers without leading zeros, and vs as versus."""
    return F.regexp_replace(F.regexp_replace(norm(c), r"\b0+(\d)", "$1"), r"\bvs\b", "versus")


def full_size_cover_url(c: Column) -> Column:
    return F.regexp_replace(blank(c), r"\._[A-Z]{2}\d+_", "")


def audible_region(provider: Column) -> Column:
    """audible is us, audible.ca is ca; other providers have none."""
    return F.when(provider == "audible", "us").otherwise(F.regexp_extract(blank(provider), r"^audible\.([a-z.]+)$", 1))


PUB_DATE_FORMATS = ("EEE, d MMM yyyy HH:mm:ss Z", "EEE, d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss Z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")


def pub_date(c: Column) -> Column:
    """The first of the known layouts that reads a date; else null. Weekday names are dropped, as Spark's reader wants."""
    v = F.regexp_replace(trim(c), r"^[A-Za-z]{3}, *", "")
    layouts = [f.removeprefix("EEE, ") for f in PUB_DATE_FORMATS]
    return F.coalesce(*[F.try_to_timestamp(v, F.lit(f)) for f in dict.fromkeys(layouts)])


# ---- Numbers in text ------------------------------------------------------------------------------


def sequence_number(c: Column) -> Column:
    """A place in a series; null for what is no finite number."""
    n = trim(c).try_cast("double") if hasattr(Column, "try_cast") else F.expr("null")
    return F.when(F.isnan(n) | (F.abs(n) == float("inf")), None).otherwise(n)


def same_number(a: Column, b: Column) -> Column:
    x, y = sequence_number(a), sequence_number(b)
    return F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(trim(a) == trim(b))


def number_key(number: Column) -> Column:
    """A text for a number: two are the same_number() if their texts are."""
    return F.coalesce((sequence_number(number) + 0.0).cast("string"), trim(number))


def style_number(number: Column, width: Column) -> Column:
    """A number padded to a series' width; fractions keep what follows the point, what is no number stays."""
    t = trim(number)
    n = sequence_number(number)
    whole = F.floor(n).cast("long").cast("string")
    padded = F.when(F.length(whole) < width, F.lpad(whole, width, "0")).otherwise(whole)
    return F.when(n.isNull() | (n < 0), t).otherwise(F.concat(padded, F.regexp_extract(t, r"(\..*)$", 1)))


def padded_number(number: Column, width: Column) -> Column:
    """Whole numbers padded; halves and words as they are."""
    n = sequence_number(number)
    return F.when(n.isNull() | (n != F.floor(n)), trim(number)).otherwise(F.when(F.length(F.floor(n).cast("long").cast("string")) < width, F.lpad(F.floor(n).cast("long").cast("string"), width, "0")).otherwise(F.floor(n).cast("long").cast("string")))


_MARKED = r"^(.*?)\s+[-–]\s+(\d+(?:\.\d+)?)\s+[-–]\s+"
_LED = r"^(\d{1,3})\s+[-–.]\s+"
_VOLUME = r"(?i)\b(?:vol(?:ume)?|book|part|#)\.?\s*(\d+(?:\.\d+)?)\b"


def base_name(path: Column) -> Column:
    return F.substring_index(blank(path), "/", -1)


def parent_folder(path: Column) -> Column:
    """The name of the folder that an item is in, or nothing."""
    return let(F.split(F.regexp_replace(blank(path), "^/+|/+$", ""), "/+"), lambda parts: F.coalesce(F.get(parts, F.size(parts) - 2), F.lit("")))


def folder_number(path: Column) -> Column:
    """struct(series, number) that a folder name carries; empty where it carries none."""
    f = base_name(path)
    by = lambda p, series, number: F.struct((trim(F.regexp_extract(f, p, series)) if series else F.lit("")).alias("series"), F.regexp_extract(f, p, number).alias("number"))
    return F.when(f.rlike(_MARKED), by(_MARKED, 1, 2)).when(f.rlike(_LED), by(_LED, 0, 1)).when(f.rlike(_VOLUME), by(_VOLUME, 0, 1)).otherwise(F.struct(F.lit("").alias("series"), F.lit("").alias("number")))


_STYLES = {
    "numbered": (r"^(.*?\S)(\s+)[-–](\s+)(\d+(?:\.\d+)?)(\s+)[-–](\s+)(.+)$", 1, 4, 7, (2, 3, 5, 6)),
    "series_number": (r"^(.*?\S)(\s+)[-–](\s+)(\d+(?:\.\d+)?)$", 1, 4, 0, (2, 3)),
    "lead": (r"^(\d+(?:\.\d+)?)(\s*)[-–.](\s+)(.+)$", 0, 1, 4, (2, 3)),
    "volume": (r"^(.*\S)\s+(\d{1,2})$", 0, 2, 1, ()),
}


def folder_style(folder: Column) -> Column:
    """struct(kind, series, number, title, loose) of a folder name."""
    out = F.struct(F.lit("bare").alias("kind"), F.lit("").alias("series"), F.lit("").alias("number"), folder.alias("title"), F.lit(False).alias("loose"))
    for kind, (pattern, series, number, title, gaps) in reversed(_STYLES.items()):
        part = lambda i: F.regexp_extract(folder, pattern, i) if i else F.lit("")  # noqa: B023, E731
        loose = reduce(lambda x, y: x | y, [part(g) != " " for g in gaps], F.lit(False))
        made = F.struct(F.lit(kind).alias("kind"), part(series).alias("series"), part(number).alias("number"), part(title).alias("title"), loose.alias("loose"))
        out = F.when(folder.rlike(pattern), made).otherwise(out)
    return out


def styled_folder(style: Column, series: Column, number: Column, width: Column, title: Column) -> Column:
    """A folder name written in a style."""
    n = padded_number(number, width)
    return (
        F.when(style == "numbered", F.concat_ws(" - ", series, n, title))
        .when(style == "series_number", F.concat_ws(" - ", series, n))
        .when(style == "lead", F.concat_ws(" - ", n, title))
        .when(style == "volume", F.concat_ws(" ", title, F.regexp_replace(n, "^0+", "")))
        .when(style == "bare", title)
        .otherwise("")
    )


# ---- Checks ---------------------------------------------------------------------------------------


def plain_text(html: Column) -> Column:
    """Tags dropped, space collapsed."""
    return trim(F.regexp_replace(F.regexp_replace(blank(html), "<[^>]*>", " "), f"[{SPACE}]+", " "))


def stub_description(raw: Column) -> Column:
    """Why a description says nothing: empty, credit, url, stub; else null. Lengths are in bytes.

    A text without tags that has bytes enough beside its white space can only be an address, so it isn't cleaned.
    """
    say = lambda t: F.when(t == "", "empty").when((F.octet_length(t) < CREDIT_BYTES) & t.rlike(CREDIT_LINE), "credit").when(t.rlike(ONLY_URL), "url").when(F.octet_length(t) < STUB_BYTES, "stub")
    long = ~F.contains(blank(raw), F.lit("<")) & (F.octet_length(F.translate(blank(raw), SPACES, "")) >= CREDIT_BYTES)
    address = F.lower(F.substring(F.ltrim(F.lit(SPACES), blank(raw)), 1, 4)) == "http"
    # the cleaned text is bound once
    return F.when(long & ~address, F.lit(None).cast("string")).otherwise(F.get(F.transform(F.array(plain_text(raw)), say), F.lit(0)))


_ODD = r"\t\n\x0B\f\r\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}"  # all but space and the ideographic space
_ODDS = SPACES.replace(" ", "").replace("\u3000", "")
_EXTENSION = r"\.[A-Za-z0-9]{1,5}"
SPACE_PROBLEMS = ("odd_space", "double_space", "edge_space", "space_before_extension", "space_before_colon")


def space_problems(name: Column, file: Column | bool = False) -> Column:
    """Names of what is wrong with the white space of a name, in the order of SPACE_PROBLEMS; empty for null.

    The ideographic space is a letter among others here.
    """
    is_file = F.lit(file) if isinstance(file, bool) else file

    def found(v: Column, plain: Column) -> Column:
        """v: the name with its odd spaces as tabs, which are odd too; plain: with all as spaces."""
        hits = {
            "odd_space": F.contains(v, F.lit("\t")),
            "double_space": F.contains(plain, F.lit("  ")),
            "edge_space": F.startswith(plain, F.lit(" ")) | F.endswith(plain, F.lit(" ")),
            "space_before_extension": is_file & plain.rlike(f" {_EXTENSION} *$"),
            "space_before_colon": F.contains(plain, F.lit(" :")) | F.contains(plain, F.lit(" ꞉")),
        }
        return F.array_compact(F.array(*[F.when(hits[p], F.lit(p)) for p in SPACE_PROBLEMS]))

    marked = F.translate(blank(name), _ODDS, "\t" * len(_ODDS))
    both = F.transform(F.array(marked), lambda v: F.struct(v.alias("v"), F.replace(v, F.lit("\t"), F.lit(" ")).alias("plain")))
    return F.get(F.transform(both, lambda x: found(x["v"], x["plain"])), F.lit(0))


def space_fixed(name: Column, file: Column | bool = False) -> Column:
    """The name put right; nothing if only white space or an extension would be left. Putting right again changes nothing."""
    is_file = F.lit(file) if isinstance(file, bool) else file
    v = F.regexp_replace(F.regexp_replace(blank(name), f"[{_ODD}]", " "), " +", " ")
    v = F.regexp_replace(F.trim(F.regexp_replace(v, "( [:꞉])+", "$1")), " +([:꞉])", "$1")
    for _ in range(2):  # an extension that follows another
        v = F.when(is_file, F.regexp_replace(v, f" +({_EXTENSION})$", "$1")).otherwise(v)
    return F.when(v.rlike(r"^\.[A-Za-z0-9]{1,5}$") & is_file, "").otherwise(v)


def odd_series_name(name: Column, author: Column) -> Column:
    """struct(problems, suggest) of a series name; suggest is empty where nothing can simply be stripped."""
    v, t = blank(name), trim(name)
    word = t.rlike(r"(?i)\s+series$")
    one = F.when(word, F.regexp_replace(t, r"(?i)\s+series$", "")).otherwise(t)
    named = (blank(author) != "") & (norm(v) == norm(author))
    numbered = one.rlike(r"(?i)(\b(book|vol\.?|volume|part|no\.?)\s*\d+|#\s*\d+)\s*$")
    stray = v.rlike(r"[™®©]|\s+[:;,]|\s{2,}|[\s:;,\-]+$") | (v != t)
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(one, "[™®©]", ""), r"\s+([:;,])", "$1"), r"\s{2,}", " ")
    fixed = F.when(stray, trim(F.regexp_replace(clean, r"[\s:;,\-]+$", ""))).otherwise(one)
    problems = F.array_compact(F.array(F.when(word, F.lit("redundant_word")), F.when(named, F.lit("named_after_author")), F.when(numbered, F.lit("sequence_in_name")), F.when(stray, F.lit("stray_characters"))))
    return F.struct(problems.alias("problems"), F.when((F.size(problems) > 0) & (fixed != v) & ~named & ~numbered, fixed).otherwise("").alias("suggest"))


def article_series_name(name: Column, titles: Column) -> Column:
    """The name without a leading article, unless one of the titles starts with the name; else nothing."""
    own = F.exists(titles, lambda t: F.startswith(norm(t), norm(name)))
    return F.when(blank(name).rlike(r"(?i)^(the|an?)\s+") & ~own, trim(F.regexp_replace(blank(name), r"(?i)^(the|an?)\s+", ""))).otherwise("")


def says_abridged(flag: Column, *texts: Column) -> Column:
    """The flag, the word, or a production's words without unabridged."""
    t = F.concat_ws(" ", *texts)
    return F.coalesce(flag, F.lit(False)) | t.rlike(ABRIDGED) | (t.rlike(PRODUCTION) & ~t.rlike(UNABRIDGED))


def bio_names_someone_else(name: Column, bio: Column) -> Column:
    """A biography opens with two capitalised words and never has the surname."""
    opens = blank(bio).rlike(r"^\p{Lu}\p{L}+ \p{Lu}\p{L}+")
    return opens & (surname(name) != "") & ~contains_words(norm(bio), surname(name))


def marker_tag(tag: Column, prefix: str = "") -> Column:
    own = F.startswith(F.lower(tag), F.lit(prefix.lower())) if prefix else F.lit(False)
    return own | tag.rlike(MARKER)


def provider_tag(tags: Column, prefix: str) -> Column:
    """The value of the first tag with the prefix, or nothing."""
    hit = F.get(F.filter(tags, lambda t: F.startswith(F.lower(t), F.lit(prefix.lower()))), F.lit(0))
    return F.coalesce(trim(F.substring(hit, len(prefix) + 1, 1 << 20)), F.lit(""))


def with_provider_tag(tags: Column, prefix: str, provider: Column) -> Column:
    """Other tags with the prefix dropped, this provider's appended."""
    return F.array_append(F.filter(tags, lambda t: ~F.startswith(F.lower(t), F.lit(prefix.lower()))), F.concat(F.lit(prefix), provider))
