"""Vocabularies: spellings and their clusters, genres and tags, roles of persons, author records, white space."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions import text as t
from curatrix.operators.components import components
from curatrix.operators.listing import refs_of

c = F.col
NAME_FIELDS = (*t.PERSON_FIELDS, "publishers", "series")


def spellings(values: DataFrame, field: str) -> DataFrame:
    """key, value, items for every spelling of a field. values: value, items (how many rows have it)."""
    rows = values.select(t.trim(c("value")).alias("value"), "items").where("value != ''")
    return rows.withColumn("key", t.vocab_key(field, c("value"))).groupBy("key", "value").agg(F.sum("items").alias("items"))


def ranked(spelt: DataFrame, field: str) -> DataFrame:
    """Spellings of each key with their place: clean ones first, then the most used, then by value; affixed: a phrase in front."""
    affixed = (t.norm(t.first_last(c("value"))) != c("key")) if field in t.PERSON_FIELDS else F.lit(False)
    order = Window.partitionBy("key").orderBy(affixed.cast("int"), F.desc("items"), "value")
    return spelt.withColumn("affixed", affixed).withColumn("place", F.row_number().over(order))


def spelling_groups(spelt: DataFrame, field: str) -> DataFrame:
    """Keys spelled in more than one way, or with a phrase in front: key, kind, keep, spellings."""
    g = ranked(spelt, field).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "value", "items"))).alias("spellings"), F.max("affixed").alias("affixed"))
    keep = F.get("spellings", F.lit(0))["value"]
    return g.where((F.size("spellings") > 1) | c("affixed")).select("key", F.when(c("affixed"), "affix").otherwise("spelling").alias("kind"), keep.alias("keep"), "spellings")


#: Letters of a key up to which all ways to leave out one or two of them are listed; longer keys are joined by their thirds.
LISTED_LETTERS = 64


def _left_out(k: DataFrame) -> DataFrame:
    """a < b: keys that can be the same with at most two letters left out of each, which all within two edits are. Keys are joined on
    what is left, so a head or an end that very many share joins nothing."""
    without = lambda v, i: F.concat(F.substr(v, F.lit(1), i - 1), F.substr(v, i + 1))
    once_less = F.transform(F.sequence(F.lit(1), F.length("key")), lambda i: F.struct(without(c("key"), i).alias("v"), i.alias("i")))
    twice_less = lambda one: F.flatten(F.transform(F.slice(one, 1, F.size(one) - 1), lambda x: F.transform(F.sequence(x["i"], F.length(x["v"])), lambda j: F.xxhash64(without(x["v"], j)))))
    left = t.let(once_less, lambda one: F.concat(F.array(F.xxhash64("key")), F.transform(one, lambda x: F.xxhash64(x["v"])), twice_less(one)))
    named = k.select("key", F.xxhash64("key").alias("at"))
    n = int(k.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ways = named.repartition(n, "at").select("at", F.explode(F.array_distinct(left)).alias("h"))
    # merged, as a side that is small when packed would else be built whole in the driver; letters are compared afterwards
    pairs = ways.select(c("at").alias("x"), "h").hint("merge").join(ways.select(c("at").alias("y"), "h"), "h").where("x < y").select("x", "y").distinct()
    side = lambda name, key: named.select(c("at").alias(name), c("key").alias(key))
    both = pairs.join(side("x", "p").hint("merge"), "x").join(side("y", "q").hint("merge"), "y")
    return both.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))


def near_keys(keys: DataFrame, field: str, apart=t.slip_apart) -> DataFrame:
    """Pairs a < b of distinct keys that are a slip apart, cut off, or initials of another: a, b, kind (near, contains).

    Two keys at most two edits apart are one with two letters left out of each; of long ones one has a third of its letters in the
    other, at most two places off. Truncations share their first letters, or their first and last words. So keys are joined on
    parts of themselves, not with each other.
    keys: key; apart: the test for near keys, of at most two edits and from six letters on.
    """
    k = keys.select("key").distinct().where("key != ''")
    n = F.length("key")
    third = F.floor(n / 3).cast("int")
    part = lambda i, a, z: F.concat(F.lit(f"{i}:"), F.substr("key", (a + 1).cast("int"), F.greatest(F.lit(1), z - a).cast("int")))
    pieces = [part(i, i * third if i < 3 else n, (i + 1) * third) for i in range(3)]
    # lengths differ by two at most, so both of a pair are short, or both are on the other side
    long = k.where(n > LISTED_LETTERS - 2)
    own = long.withColumn("n", n).withColumn("p", F.explode(F.array(*pieces)))
    shift = F.explode(F.sequence(F.lit(-2), F.lit(2)))
    # the other key's thirds, looked for at each place where up to two edits can have moved them, for each length that fits
    ask = long.withColumn("n", n).withColumn("m", F.explode(F.sequence(F.greatest(F.lit(1), n - 2), n + 2))).withColumn("s", shift)
    cut = lambda i: F.concat(F.lit(f"{i}:"), F.expr(f"substring(key, greatest(1, {i} * cast(floor(m / 3) as int) + 1 + s), greatest(1, cast(floor(m / 3) as int)))"))
    ask = ask.withColumn("p", F.explode(F.array(*[cut(i) for i in range(3)])))
    near = own.select(c("key").alias("b"), c("n").alias("m"), "p").join(ask.select(c("key").alias("a"), "m", "p"), ["m", "p"]).where("a < b").select("a", "b")
    near = _left_out(k.where(n.between(4, LISTED_LETTERS))).unionByName(near).distinct().where(apart(c("a"), c("b")))
    out = near.select("a", "b", F.lit("near").alias("kind"))
    if field in NAME_FIELDS and field != "series":
        contains = _cut_off(k) if field not in t.PERSON_FIELDS else _cut_off(k).unionByName(_initials(k)).distinct()
        contains = contains.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit("contains").alias("kind"))
        out = out.unionByName(contains).groupBy("a", "b").agg(F.min("kind").alias("kind"))
    return out


#: Middle words of a name whose omissions are listed one by one; longer names are compared by their first and last words.
MIDDLE_WORDS = 6


def _cut_off(k: DataFrame) -> DataFrame:
    """x, y: keys of which one is cut off, or without its middle words. What a key can be cut to is listed and looked up."""
    w = k.withColumn("w", t.words(c("key"))).withColumn("joined", F.replace("key", F.lit(" "), F.lit("")))
    heads = w.select(c("key").alias("y"), F.explode(F.transform(F.sequence(F.lit(1), F.length("joined")), lambda n: F.substr("joined", F.lit(1), n))).alias("joined")).where("octet_length(joined) >= 6")
    cut = w.select(c("key").alias("x"), "joined").join(heads, "joined").where((c("x") != c("y")) & t.truncation_of(c("x"), c("y")))
    named = w.where(F.size("w") > 2).withColumn("middle", F.slice("w", 2, F.size("w") - 2))
    ways = F.aggregate("middle", F.array(F.get("w", F.lit(0))), lambda made, word: F.concat(made, F.transform(made, lambda p: F.concat_ws(" ", p, word))))
    shorter = named.where(F.size("middle") <= MIDDLE_WORDS).select(c("key").alias("y"), F.explode(ways).alias("p"), F.element_at("w", -1).alias("last")).select(F.concat_ws(" ", "p", "last").alias("x"), "y")
    without = k.select(c("key").alias("x")).join(shorter.where("x != y").distinct(), "x")
    ends = lambda df, name: df.select(c("key").alias(name), F.get("w", F.lit(0)).alias("p"), F.element_at("w", -1).alias("q"))
    long = ends(w.where(F.size("w") > 1), "x").join(ends(named.where(F.size("middle") > MIDDLE_WORDS), "y"), ["p", "q"]).where((c("x") != c("y")) & t.truncation_of(c("x"), c("y")))
    return cut.select("x", "y").unionByName(without.select("x", "y")).unionByName(long.select("x", "y")).distinct()


def _initials(k: DataFrame) -> DataFrame:
    """x, y: names of which one has initials for words of the other, or each has some. Names that could match are those that
    can be cut to one form; two names without any initial never can be, so only those with one are cut on both sides."""
    w = k.withColumn("w", t.words(c("key"))).where((F.size("w") > 1) & (F.size("w") <= MIDDLE_WORDS + 2)).withColumn("first", F.slice("w", 1, F.size("w") - 1))
    one = lambda word: F.substr(word, F.lit(1), F.lit(1))
    ways = F.aggregate("first", F.array(F.lit("")), lambda made, word: F.flatten(F.transform(made, lambda p: F.when(F.length(word) > 1, F.array(F.concat_ws(" ", p, word), F.concat_ws(" ", p, one(word)))).otherwise(F.array(F.concat_ws(" ", p, word))))))
    forms = w.select(c("key").alias("y"), F.exists("first", lambda v: F.length(v) == 1).alias("has"), F.explode(ways).alias("p"), F.element_at("w", -1).alias("q")).select("y", "has", F.trim(F.concat_ws(" ", "p", "q")).alias("form")).distinct()
    whole = forms.where("y != form").join(w.select(c("key").alias("x")), c("form") == c("x")).select("x", "y")
    some = forms.where("has and y != form")
    both = some.select(c("y").alias("x"), "form").join(some.select("y", "form"), "form").where("x < y").select("x", "y")
    return whole.unionByName(both).distinct().where(t.initials_of(c("x"), c("y")))


def clusters(spelt: DataFrame, field: str) -> DataFrame:
    """Clusters of keys that are near or contained: cluster, kind, keep, spellings. Languages have none."""
    edges = near_keys(spelt.select("key"), field)
    found = components(edges).withColumnRenamed("component", "cluster")
    kinds = edges.join(found, c("a") == c("node")).groupBy("cluster").agg(F.min("kind").alias("kind"))
    rows = ranked(spelt, field).join(found, c("key") == c("node")).join(kinds, "cluster")
    longest = F.when((c("kind") == "contains") & F.lit(field in t.PERSON_FIELDS), -F.octet_length(t.norm(c("value")))).otherwise(0)
    g = rows.groupBy("cluster", "kind").agg(F.array_sort(F.collect_list(F.struct(longest.alias("l"), c("affixed").cast("int").alias("affixed"), (-c("items")).alias("less"), "value"))).alias("s"))
    return g.select("cluster", "kind", F.get("s", F.lit(0))["value"].alias("keep"), F.transform("s", lambda x: F.struct(x["value"].alias("value"), (-x["less"]).alias("items"))).alias("spellings"))


def cluster_counts(spelt: dict[str, DataFrame]) -> DataFrame:
    """field, found: how many clusters() the spellings of each field have, with one search for components over all fields."""
    marked = lambda f: near_keys(spelt[f].select("key"), f).select(*[F.concat(F.lit(f"{f}:"), x).alias(x) for x in ("a", "b")])
    edges = None
    for f in spelt:
        edges = marked(f) if edges is None else edges.unionByName(marked(f))
    return components(edges).groupBy(F.substring_index("component", ":", 1).alias("field")).agg(F.count_distinct("component").alias("found"))


def fragments(spelt: DataFrame) -> DataFrame:
    """Persons' values that are no name (fragment) or several (split): key, kind, value, parts."""
    first = ranked(spelt, "authors").where("place = 1")
    kind = F.when(c("key").isin(*t.FRAGMENTS) | (F.octet_length("key") <= 2), "fragment").when(t.split_value(c("value")), "split")
    return first.withColumn("kind", kind).where("kind is not null").select("key", "kind", "value", F.when(c("kind") == "split", t.split_parts(c("value"))).alias("parts"))


def odd_languages(values: DataFrame) -> DataFrame:
    """Values that are no known language."""
    return values.where(t.language_code(c("value")).isNull() & (t.trim(c("value")) != "")).orderBy("value")


#: A genre that fewer items have is narrow.
GENRE_LEAST = 5


def genre_sections(field: str, prefix: str = "") -> dict[str, Callable[[Column], Column]]:
    """For values of genres or tags of an item: the sections that one can be in, and when it is. Marks of tools are in none."""
    fine = lambda v: (v != "") & (F.lit(True) if field == "genres" else ~t.marker_tag(v, prefix))
    marks = {
        "placeholder": lambda v: v.rlike(t.PLACEHOLDER),
        "prefix": lambda v: v.rlike(t.PLACEHOLDER_PREFIX),
        "compound": lambda v: F.size(F.filter(F.split(v, t.VALUE_JOIN), lambda p: p != "")) > 1,
    }
    if field == "tags":
        marks["redundant"] = lambda v: F.exists("genres", lambda g: F.lower(g) == F.lower(v))
    both = lambda f: lambda v: fine(v) & f(v)
    return {k: both(f) for k, f in marks.items()}


def genre_findings(items: DataFrame, least: int = GENRE_LEAST, prefix: str = "") -> DataFrame:
    """section, field, value, items, refs (three ids in listing order): placeholder, prefix, compound, redundant, narrow."""

    def each(f: str) -> DataFrame:
        rows = items.select("id", "added_at", "genres", F.lit(f).alias("field"), F.explode(F.array_distinct(f)).alias("value"))
        hits = F.array_compact(F.array(*[F.when(holds(c("value")), F.lit(k)) for k, holds in genre_sections(f, prefix).items()]))
        return rows.withColumn("section", F.explode(hits)).drop("genres")

    named = refs_of(each("genres").unionByName(each("tags")), ["section", "field", "value"], [c("added_at"), c("id")], c("id"), 3)
    rows = items.select("id", "added_at", F.lit("genres").alias("field"), F.explode(F.array_distinct("genres")).alias("value")).where("value != ''")
    few = rows.groupBy("value").count().where(c("count") < least).select("value")
    narrow = rows.join(few, "value", "left_semi").withColumn("section", F.lit("narrow"))
    return named.unionByName(refs_of(narrow, ["section", "field", "value"], [c("added_at"), c("id")], c("id"), 3)).select("section", "field", "value", "items", "refs")


def roles(items: DataFrame) -> DataFrame:
    """Names that write some books and only read others: name, wrote, read_only (ids; at most 5 and 10)."""
    one = lambda f: items.select("id", F.explode(f).alias("value")).select("id", t.vocab_key(f, c("value")).alias("name"), t.trim(c("value")).alias("value")).where("name != ''").distinct()
    wrote, read = one("authors"), one("narrators")
    only = refs_of(read.join(wrote.select("name", "id").distinct(), ["name", "id"], "left_anti").select("name", "id").distinct(), ["name"], [c("id")], c("id"), 10, "read_only").withColumnRenamed("items", "n_read_only")
    by = refs_of(wrote.select("name", "id").distinct().join(only.select("name"), "name", "left_semi"), ["name"], [c("id")], c("id"), 5, "wrote").withColumnRenamed("items", "n_wrote")
    return only.join(by, "name").select("name", "n_wrote", "n_read_only", "wrote", "read_only").orderBy("n_wrote", F.desc("n_read_only"), "name")


def author_records(authors: DataFrame) -> DataFrame:
    """Author records to look at: id, name, problem; the worst first."""
    problem = F.when(t.bio_names_someone_else(c("name"), c("description")), "bio_mismatch").when(c("num_books") == 0, "no_books").when(c("asin") == "", "unmatched").when(c("image_path") == "", "no_photo")
    order = F.array_position(F.array(*map(F.lit, ("bio_mismatch", "no_books", "unmatched", "no_photo"))), problem)
    return authors.select("id", "name", "num_books", problem.alias("problem"), order.alias("_o")).where("problem is not null").orderBy("_o", F.desc("num_books"), "name").drop("_o")


def space_findings(names: DataFrame, file: bool = False) -> DataFrame:
    """where, problem, name, fixed, items for names with bad white space. names: where, name; a shared name comes once."""
    return space_problems_of(names.groupBy("where", "name").agg(F.count(F.lit(1)).alias("items")), file)


def space_problems_of(rows: DataFrame, file: bool = False) -> DataFrame:
    """space_findings() of names that are counted already: where, name, items."""
    return rows.select("where", F.explode(t.space_problems(c("name"), file)).alias("problem"), "name", t.space_fixed(c("name"), file).alias("fixed"), "items")


def folder_collisions(fixes: DataFrame, entries: DataFrame) -> DataFrame:
    """Suggested names that something in the same folder has already, or that two suggestions share: parent, fixed, taken."""
    twice = fixes.groupBy("parent", "fixed").agg(F.count(F.lit(1)).alias("n"))
    held = entries.select("parent", c("name").alias("fixed")).distinct().withColumn("exists", F.lit(True))
    return twice.join(held, ["parent", "fixed"], "left").select("parent", "fixed", (F.coalesce("exists", F.lit(False)) | (c("n") > 1)).alias("taken"))
