"""Texts that answers are made of: lengths, sizes, days, clips, names with numbers, white space made visible; as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curatrix.functions import text as t


def whole_seconds(seconds: Column) -> Column:
    """Rounded, halves away from zero."""
    return F.round(seconds).cast("long")


def percent(share: Column) -> Column:
    return F.round(share * 100).cast("int")


def percent_of(part: Column, whole: Column) -> Column:
    """A part in percent of a whole, null if that isn't over 0."""
    return F.when(whole > 0, F.round(100 * part / whole).cast("int"))


def duration_text(seconds: Column) -> Column:
    """12h 34m, 34m 5s or 5s; nothing for no length."""
    n = F.round(seconds).cast("long")
    h, m, s = F.floor(n / 3600), F.floor(n / 60) % 60, n % 60
    said = F.when(h > 0, F.format_string("%dh %dm", h, m)).when(m > 0, F.format_string("%dm %ds", m, s)).otherwise(F.format_string("%ds", s))
    return F.when(seconds > 0, said).otherwise("")


def bytes_text(size: Column) -> Column:
    """GB with one decimal, whole MB or KB (halves to even), or bytes; in steps of 1024."""
    n = size.cast("double")
    return (
        F.when(size >= 1 << 30, F.format_string("%.1f GB", n / (1 << 30)))
        .when(size >= 1 << 20, F.format_string("%d MB", F.rint(n / (1 << 20)).cast("long")))
        .when(size >= 1 << 10, F.format_string("%d KB", F.rint(n / (1 << 10)).cast("long")))
        .otherwise(F.format_string("%d bytes", size.cast("long")))
    )


def date_text(at: Column) -> Column:
    """The day, in the session's zone (UTC by convention); nothing for no time."""
    return F.coalesce(F.date_format(at, "yyyy-MM-dd"), F.lit(""))


def timestamp_text(at: Column) -> Column:
    """ISO date and time with Z; nothing for no time. The session's zone should be UTC."""
    return F.coalesce(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))


def clip(text: Column, most: int) -> Column:
    """A text, without white space around it, of at most so many characters (not bytes, so that none is cut in two); a longer one is
    cut at its last space, if that is past the middle, and ends in dots."""
    v = t.trim(text)
    head = F.substring(v, 1, most)
    space = F.length(head) - F.locate(" ", F.reverse(head))
    cut = F.when((F.locate(" ", F.reverse(head)) > 0) & (space >= most // 2), F.substr(head, F.lit(1), space)).otherwise(head)
    return F.when(F.length(v) <= most, v).otherwise(F.concat(cut, F.lit("...")))


def series_text(name: Column, sequence: Column) -> Column:
    """Name #number, or the name alone."""
    return F.when(t.blank(sequence) != "", F.concat(name, F.lit(" #"), sequence)).otherwise(name)


def series_ref(said: Column) -> Column:
    """struct(name, sequence) of ``Name #2``: cut at the first such sign."""
    v = t.blank(said)
    at = F.locate(" #", v)
    cut = F.struct(F.substr(v, F.lit(1), at - 1).alias("name"), F.trim(F.substr(v, at + 2)).alias("sequence"))
    return F.when(at > 0, cut).otherwise(F.struct(v.alias("name"), F.lit("").alias("sequence")))


def series_refs(joined: Column) -> Column:
    """The refs of a joined text, ``One #1, Two #2``: each cut at its last such sign."""
    last = lambda v: F.struct(F.when(v.contains(" #"), F.regexp_extract(v, r"^(.*) #[^#]*$", 1)).otherwise(v).alias("name"), F.trim(F.regexp_extract(v, r"^.* #([^#]*)$", 1)).alias("sequence"))
    return F.transform(F.filter(F.split(t.blank(joined), ", "), lambda v: v != ""), last)


def placed_series(joined: Column) -> Column:
    """Names with a number of a joined text, whose names may hold commas: a part without a number belongs to the next one."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    glued = lambda s, p: F.when(s["open"] == "", p).otherwise(F.concat_ws(", ", s["open"], p))
    step = lambda s, p: F.when(p.rlike(r" #\S"), F.struct(F.array_append(s["done"], glued(s, p)).alias("done"), F.lit("").alias("open"))).otherwise(F.struct(s["done"].alias("done"), glued(s, p).alias("open")))
    return F.aggregate(F.filter(F.split(t.blank(joined), ", "), lambda v: v != ""), start, step, lambda s: s["done"])


def visible_spaces(name: Column) -> Column:
    """White space made visible: a bowl for a space, the code in brackets for any other."""
    out = F.replace(t.blank(name), F.lit(" "), F.lit("␣"))
    for x in t.SPACES.replace(" ", ""):
        out = F.replace(out, F.lit(x), F.lit(f"[U+{ord(x):04X}]"))
    return out


def disk_fixed(fixed: Column) -> Column:
    """A name that was put right, for a disk: nothing if it would start with a dot."""
    return F.when(F.startswith(fixed, F.lit(".")), "").otherwise(fixed)


def feed_address(server: Column, path: Column) -> Column:
    """A feed's address: a path on the server, or one of its own."""
    return F.when(F.startswith(path, F.lit("/")), F.concat(F.regexp_replace(server, "/+$", ""), path)).otherwise(path)


def device_line(*fields: tuple[Column, ...]) -> Column:
    """``Client on device``: of each tuple the first that isn't empty."""
    first = lambda cols: F.coalesce(*[F.nullif(t.blank(x), F.lit("")) for x in cols])
    return F.concat_ws(" on ", *map(first, fields))


#: A schedule has five fields; each a star, a step, numbers, ranges and lists, within bounds.
_CRON = r"^(\*(/\d+)?|\d+(-\d+)?(/\d+)?)(,(\d+(-\d+)?(/\d+)?))*$"
_CRON_BOUNDS = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))


def schedule_valid(expression: Column) -> Column:
    """Whether a five-field schedule can be read: signs, and numbers within their bounds."""
    fields = F.split(F.trim(t.blank(expression)), r"\s+")
    said = lambda f: F.regexp_extract_all(F.regexp_replace(f, r"/\d+", ""), F.lit(r"(\d+)"), 1)
    within = [F.forall(said(F.get(fields, F.lit(i))), lambda n: n.cast("int").between(low, high)) for i, (low, high) in enumerate(_CRON_BOUNDS)]  # noqa: B023
    ok = (F.size(fields) == len(_CRON_BOUNDS)) & F.forall(fields, lambda f: f.rlike(_CRON))
    for w in within:
        ok &= F.coalesce(w, F.lit(False))
    return ok


def filter_code(group: str, value: str) -> str:
    """A filter as the server writes it: the group, and the value in base 64 with signs escaped."""
    import base64
    import urllib.parse

    return f"{group}.{urllib.parse.quote(base64.b64encode(value.encode()).decode(), safe='')}"


# ---- Fixed values: names of persons ---------------------------------------------------------------

COMPANY = r"(?i)\b(audio|library|entertainment|studios?|books?|media|recorded|publishing|publishers?|productions?|llc|inc|ltd|digital|group|press|courses|theat(re|er)|records)\b"
CREDIT = r"(?i)\s*[-–]\s*(translator|foreword|introduction|illustrator|editor|adaptation|adaption|afterword|contributor|narrator|reader|übersetzer|traducteur)\b.*$"
HONORIFIC = r"(?i)(^|\s)(dr\.?|md|m\.d\.?|ph\.?\s?d\.?|phd|esq\.?)(?=\s|$|,)"
NOT_READER = (
    "a", "of", "the", "an", "in", "and", "to", "for", "with", "on", "at", "from", "is", "or", "my", "your", "start", "finish", "end", "beginning", "disc", "disk", "cd",
    "unabr", "abr", "anthology", "prologue", "epilogue", "sample", "preview", "excerpt", "bonus", "uk", "us", "usa", "au", "illustrated", "annotated", "revised", "expanded",
    "sci", "scifi", "fi", "fantasy", "horror", "mystery", "thriller", "romance", "fiction", "nonfiction", "classics", "classic", "ya", "kids", "memoir", "biography",
)
SERIES_ENDINGS = ("series", "saga", "novels", "books")


def clean_person(name: Column) -> Column:
    """A name without honorifics; null for a credit."""
    bare = F.regexp_replace(F.regexp_replace(t.blank(name), HONORIFIC, " "), r"\s+", " ")
    return F.when(~t.blank(name).rlike(CREDIT), F.regexp_replace(bare, "^[ ,]+|[ ,]+$", ""))


def clean_people(names: Column) -> Column:
    """Names of a list without honorifics; credits, companies and what is left empty go."""
    return F.filter(F.transform(names, clean_person), lambda n: n.isNotNull() & (n != "") & ~n.rlike(COMPANY))


def series_core(name: Column) -> Column:
    """A series' key without the words at its end that say that it is one."""
    key = t.vocab_key("series", name)
    for ending in SERIES_ENDINGS:
        key = F.regexp_replace(key, f" {ending}$", "")
    return key


def plausible_reader(name: Column) -> Column:
    """Whether a name in brackets can be a reader's: none of its words but initials with a dot is one that no name has."""
    raw = F.filter(F.split(F.trim(t.blank(name)), r"\s+"), lambda w: w != "")
    fine = lambda r: F.forall(t.words(t.norm(r)), lambda w: ~w.isin(*NOT_READER) | (r.contains(".") & (F.length(w) == 1)))
    return F.exists(raw, lambda r: F.size(t.words(t.norm(r))) > 0) & F.forall(raw, fine)


def joined_words(name: Column) -> Column:
    """A name whose words folders join: separators and spaces as spaces, any dash as a hyphen."""
    spaced = F.translate(t.blank(name), "_/+" + t.SPACES, " " * (3 + len(t.SPACES)))
    return F.regexp_replace(spaced, r"[\p{Pd}\x{2212}]", "-")


def reading_key(title: Column, author: Column) -> Column:
    """What the readings of one book share: its title without a note on the reader, and its first author; nothing without a title."""
    key = t.clean_title(F.regexp_replace(t.blank(title), r"\s*[(\[][^)\]]*[)\]]\s*$", " "))
    first = F.coalesce(t.norm(F.get(t.split_names(author), F.lit(0))), F.lit(""))
    return F.when(key == "", "").otherwise(F.concat(key, F.lit("|"), first))
