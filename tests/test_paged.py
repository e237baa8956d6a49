"""Items of a server, page by page: a server in a thread that fails now and then."""

import base64
import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from curatrix.sources import catalog, paged

ITEMS = [
    {"id": f"i{k:03}", "libraryId": "lib one", "mediaType": "book", "relPath": f"a/{k}", "isMissing": k % 7 == 0, "addedAt": 1_700_000_000_000 + k, "size": 10 * k,
     "media": {"duration": 3600 + k, "numTracks": 2, "tags": ["x"], "metadata": {"title": f"Title {k}", "authorName": "Ana Reyes, Bo Lind", "narratorName": "", "seriesName": "Seasons #2, Other", "genres": ["g"], "publishedYear": 1990 + k % 5, "language": ("en", "de")[k % 2], "publisher": None}}}
    for k in range(237)
]


class Server(BaseHTTPRequestHandler):
    asked: list = []
    fails: dict = {}

    def _answer(self, what, code=200):
        data = json.dumps(what).encode()
        self.send_response(code)
        self.end_headers()
        self.wfile.write(data)

    def do_GET(self):  # noqa: N802
        url = urllib.parse.urlparse(self.path)
        q = dict(urllib.parse.parse_qsl(url.query))
        if self.headers.get("Authorization") != "Bearer key":
            return self._answer({}, 401)
        Server.asked.append((url.path, q))
        if Server.fails.get(q["page"], 0) > 0:
            Server.fails[q["page"]] -= 1
            return self._answer({}, 503)
        rows = ITEMS
        if "filter" in q:
            group, _, code = q["filter"].partition(".")
            value = base64.b64decode(code).decode()
            assert group == "languages"
            rows = [r for r in rows if r["media"]["metadata"]["language"] == value]
        n, p = int(q["limit"]), int(q["page"])
        return self._answer({"total": len(rows), "results": rows[p * n : (p + 1) * n]})

    def do_POST(self):  # noqa: N802
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Server.asked.append((self.path, body))
        self._answer({"libraryItems": [{**r, "media": {**r["media"], "metadata": {**r["media"]["metadata"], "series": [{"id": "s", "name": "Seasons", "sequence": "3"}]}}} for r in ITEMS if r["id"] in body["libraryItemIds"]]})

    def log_message(self, *a):
        pass


@pytest.fixture(scope="module")
def server(spark):
    http = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    spark.dataSource.register(paged.CataloguePages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield f"http://127.0.0.1:{http.server_port}"
    http.shutdown()


def pages(spark, url, token="key", **options):
    r = spark.read.format("catalogue_pages").option("url", url).option("library", "lib one").option("token", token).option("page", 20).option("pages_each", 5).option("wait", 0.01)
    for k, v in options.items():
        r = r.option(k, v)
    return r.load()


def test_all_pages(spark, server):
    Server.asked, Server.fails = [], {"3": 2, "7": 1}
    df = pages(spark, server)
    assert df.columns == catalog.schema("item").names
    rows = {r.id: r for r in df.collect()}
    assert len(rows) == 237 and df.rdd.getNumPartitions() == 3
    r = rows["i014"]
    assert (r.title, r.authors, r.narrators, r.is_missing, r.published_year, r.size, r.duration, r.publisher) == ("Title 14", ["Ana Reyes", "Bo Lind"], [], True, "1994", 140, 3614.0, None)
    assert [(s.name, s.sequence) for s in r.series] == [("Seasons", "2"), ("Other", "")] and r.added_at.timestamp() == pytest.approx(1_700_000_000.014)
    assert {q["page"] for _, q in Server.asked if q["limit"] == "20"} == {str(k) for k in range(12)} and all(p == "/api/libraries/lib%20one/items" for p, _ in Server.asked)


def test_filters_go_to_the_server(spark, server):
    Server.asked, Server.fails = [], {}
    got = pages(spark, server).where("language = 'de' and size > 100").collect()
    assert len(got) == sum(r["media"]["metadata"]["language"] == "de" and r["size"] > 100 for r in ITEMS)
    assert all("filter" in q for _, q in Server.asked if q["limit"] == "20") and len([1 for _, q in Server.asked if q["limit"] == "20"]) == 6


def test_failures_and_emptiness(spark, server):
    Server.asked, Server.fails = [], {}
    with pytest.raises(Exception, match="401"):
        pages(spark, server, token="wrong").collect()
    Server.fails = {"0": 99}
    with pytest.raises(Exception, match="503"):
        pages(spark, server, tries=2).collect()
    Server.fails = {}
    assert pages(spark, server).where("language = 'xx'").collect() == []


def test_whole_records(spark, server):
    Server.asked = []
    ids = spark.createDataFrame([(f"i{k:03}",) for k in range(0, 300, 2)] + [("i000",), (None,), ("nobody",)], "id string").coalesce(1)
    got = {r.id: r for r in paged.whole(ids, server, each=40).collect()}
    assert len(got) == 119 and [(s.id, s.name, s.sequence) for s in got["i002"].series] == [("s", "Seasons", "3")]
    assert all(len(b["libraryItemIds"]) <= 40 for _, b in Server.asked)
