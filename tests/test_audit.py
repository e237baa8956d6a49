"""All audits in one result: each part is what its own operator finds, and items are read twice."""

from pyspark.sql import functions as F

from curatrix.operators import duplicates, files, predicates, series, vocabulary
from curatrix.plans import audit_all as plan
from curatrix.sources import catalog
from tests.test_catalog import SHELF, item


def test_parts_equal_their_operators(spark, tmp_path):
    item(spark, SHELF).write.parquet(str(tmp_path / "items"))
    items = catalog.load(spark, "item", str(tmp_path / "items"))
    out = plan.audit_all(items, prefix="zz:")
    assert str(tmp_path / "items") not in out._jdf.queryExecution().toString()  # what it counts is written already
    got = {}
    for r in out.collect():
        got.setdefault(r.check, {})[r.field] = r.found
    per = lambda df, col: {r[0]: r[1] for r in df.groupBy(col).count().collect()}
    for name, (holds, _) in predicates.checks("zz:").items():
        assert got[name][""] == items.where(holds).count()
    assert got["paths"] == per(files.path_problems(items), "problem")
    assert got["numbering"] == per(series.numbering(items), "problem")
    assert {k: n for k, n in got["genres"].items() if k} == per(vocabulary.genre_findings(items, prefix="zz:"), "section")
    assert got["duplicates"] == {"groups": duplicates.groups(items).select("group").distinct().count()}
    names = [items.select(F.lit(w).alias("where"), x.alias("name")) for w, x in (("title", F.col("title")), ("author", F.explode("authors")), ("series", F.explode("series.name")))]
    assert got["whitespace"]["double_space"] == sum(vocabulary.space_findings(n).where("problem = 'double_space'").count() for n in names)
    spelt = lambda f, x: vocabulary.spellings(items.select("id", F.explode(x).alias("value")).distinct().groupBy("value").agg(F.count(F.lit(1)).alias("items")), f)
    for f, x in (("authors", F.col("authors")), ("narrators", F.col("narrators")), ("languages", F.array("language"))):
        assert got["spellings"].get(f, 0) == vocabulary.spelling_groups(spelt(f, x), f).count()
    assert got["near_names"]["narrators"] == vocabulary.clusters(spelt("narrators", F.col("narrators")), "narrators").count() > 0


def test_postings_count_items_once(spark):
    items = item(spark, [{"id": f"i{k}", "title": "Unknown", "authors": ["A", "A"], "genres": ["Audiobook", "x"], "tags": ["X", "zz-none"]} for k in range(60)])
    got = {(r.kind, r.field, r.part, r["value"]): r["items"] for r in plan.postings(items, "zz-").collect()}
    assert got["value", "authors", "", "A"] == 60 and got["genre", "genres", "placeholder", "Audiobook"] == 60 and got["genre", "tags", "redundant", "X"] == 60
    assert got["title", "", "", "unknown|a, a"] == 60 and not any(k[0] == "genre" and k[3] == "zz-none" for k in got)
    assert {(r.check, r.field): r.found for r in plan.audit_all(items, prefix="zz-", skip=("duplicates", "candidates", "near_names", "spellings", "numbering", "folder_styles", "series_titles")).collect()}["placeholder_titles", "title"] == 1
