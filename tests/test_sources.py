import json

import pytest
from pyspark.errors import PySparkException

from fathomline.sources import bundles as B
from fathomline.sources import listings as L
from fathomline.operators.series import cumulative_points
from pyspark.sql import functions as F


def test_bundles_round_trip(spark, tmp_path):
    doc = {"bundle_id": "b1", "schema_version": "0.1.0", "claims": [{"id": "c1", "statement": "s", "certainty": 0.5}, {"id": "c2", "statement": "t"}], "gaps": []}
    (tmp_path / "in").mkdir()
    (tmp_path / "in/b1.json").write_text(json.dumps(doc, indent=1))
    b = B.read_bundles(spark, str(tmp_path / "in"))
    c = B.collection(b, "claims")
    assert [(r["bundle_id"], r["position"], r["id"]) for r in c.orderBy("position").collect()] == [("b1", 0, "c1"), ("b1", 1, "c2")]
    assert B.collection(b, "gaps").count() == 0 and len(B.COLLECTIONS) == 23
    (out,) = B.bundle_documents({"claims": c.drop("position")}).collect()
    assert [x["id"] for x in json.loads(out["json"])["claims"]] == ["c1", "c2"]
    (large,) = B.bundle_documents({"claims": c}, most_rows=1).collect()
    assert (large["bundle_id"], large["n_rows"], large["json"]) == ("b1", 2, None)
    B.write_collections({"claims": c}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/claims")).count() == 2
    m = B.manifest(spark, str(tmp_path / "in"))
    (tmp_path / "same/a").mkdir(parents=True)
    (tmp_path / "same/b").mkdir()
    for x in ("a", "b"):
        (tmp_path / f"same/{x}/data.json").write_text(x)
    assert sorted(r["file"] for r in B.manifest(spark, str(tmp_path / "same")).collect()) == ["a/data.json", "b/data.json"]
    assert B.manifest_differences(m, m).count() == 0
    (tmp_path / "in/b2.json").write_text(json.dumps(doc | {"schema_version": "9"}))
    assert [r["difference"] for r in B.manifest_differences(m.limit(1), B.manifest(spark, str(tmp_path / "in"))).collect()] in (["new"], [])
    with pytest.raises(PySparkException):
        B.read_bundles(spark, str(tmp_path / "in")).select("schema_version").collect()


def test_listings(spark):
    rel = json.dumps([{"tag_name": "v1", "created_at": "2024-01-01T00:00:00Z"}, {"tag_name": "v2", "draft": True}, {"tag_name": "v3", "published_at": "2024-02-01T00:00:00Z", "prerelease": True}])
    got = L.release_list(spark.createDataFrame([("o/r", rel)], "repo string, payload string")).collect()
    assert [(r["tag"], r["locator"], r["published_at"][:10], r["prerelease"]) for r in got] == [("v1", "$[0]", "2024-01-01", False), ("v3", "$[2]", "2024-02-01", True)]
    stars = json.dumps([{"week": 1704067200, "days": [1, 0, 2, 0, 0, 0, 4]}])
    h = L.star_history(spark.createDataFrame([("a", stars)], "series_id string, payload string"))
    p = cumulative_points(h)
    assert p.agg(F.max("cum")).first()[0] == 7
    totals = spark.createDataFrame([("a", 8), ("b", 3)], "series_id string, total int")
    assert {(r[0], r[1]) for r in L.history_quality(p, totals).collect()} == {("a", "exact"), ("b", "unavailable")}


def test_feeds_and_sitemaps(spark):
    rss = "<rss><channel><item><title>A</title><link>https://x.example/1</link><pubDate>Mon, 20 May 2019 02:46:59 +1000</pubDate></item><item><title>no link</title></item></channel></rss>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>B</title><link href="https://x.example/2"/><updated>2020-01-01</updated></entry></feed>'
    f = spark.createDataFrame([("r", rss), ("a", atom), ("bad", "<rss"), ("none", None)], "feed_id string, xml string")
    assert {(r["feed_id"], r["title"], r["url"]) for r in L.parse_feeds(f).collect()} == {("r", "A", "https://x.example/1"), ("a", "B", "https://x.example/2")}
    sm = "<urlset><url><loc>https://x.example/blog/how-we-grew</loc></url><url><loc>https://x.example/about</loc></url><url><loc>https://x.example/blog/tag/x</loc></url></urlset>"
    assert [(r["url"], r["title"]) for r in L.parse_sitemaps(spark.createDataFrame([("s", sm)], "sitemap_id string, xml string")).collect()] == [("https://x.example/blog/how-we-grew", "How We Grew")]


def test_links_file(spark, tmp_path):
    (tmp_path / "l.txt").write_text("# note\n\nhttps://a.example/1 | 2024-01-02 | One | two\nhttps://a.example | 2024-13-02 | x\nnope | 2024-01-02 | x\nhttps://a.example | 2024-01-02\n")
    rows = L.read_links(spark, str(tmp_path / "l.txt")).collect()
    assert [r["problem"] for r in rows] == [None, "not a date", "not a url", "needs a url, a date and a title"] and rows[0]["title"] == "One | two"


def test_pages(spark):
    df = spark.createDataFrame([("<h1>Big <b>News</b></h1>", "t", 'See x.example/posts/tally-2 and x.example/posts/tally-2'), ("<p>", "Site | A long page title", "")], "html string, title string, text string")
    got = df.select(L.page_heading(F.col("html"), F.col("title")).alias("h"), L.slugs_in(F.col("text"), "x.example").alias("s")).collect()
    assert [r["h"] for r in got] == ["Big News", "A long page title"] and got[0]["s"] == ["tally-2"]
