from datetime import datetime

from pyspark.sql import functions as F

from fathomline.functions import dates as D
from fathomline.functions import text as T
from fathomline.functions import urls as U


def _one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


def test_canonical_url(spark):
    for raw, want in [
        ("HTTPS://www.Example.com:443/a/b/?utm_source=x&q=1&ref=z#frag", "https://example.com/a/b?q=1"), ("https://u@h.example", "https://h.example/"),
        ("http://h.example/?fbclid=1", "http://h.example/"), (None, None),
    ]:
        assert _one(spark, raw, U.canonical_url) == want


def test_hosts(spark):
    assert _one(spark, "https://blog.a.example/x", lambda c: U.on_host(U.host(c), ["b.example", "a.example"])) == "a.example"
    assert _one(spark, "https://nota.example/x", lambda c: U.on_host(U.host(c), ["a.example"])) is None
    assert _one(spark, "https://forge.example/own/repo.git", lambda c: U.forge_repository(c, "forge.example")) == "own/repo"
    assert _one(spark, "javascript:alert(1)", U.safe_url) == "#"


def test_quotes(spark):
    page = F.lit("We launched on Product Hunt in March 2021 and doubled our users — from 1,500 to 3,000.")
    for q, want in [("doubled our users - from 1,500", True), ("We launched on Product Hunt … from 1,500 to 3,000.", True), ("We launched on Hacker News in March", False), ("short", False)]:
        assert _one(spark, q, lambda c: T.quote_in_text(c, page)) is want


def test_numbers(spark):
    for v, text, want in [(20700.0, "$20.7K MRR", True), (1500000.0, "1.5M users", True), (36560.0, "36,560 users", True), (40000.0, "36,560 users", False), (20.0, "120 users", False)]:
        assert _one(spark, text, lambda c: T.number_supported(F.lit(v), c)) is want


def test_chunks(spark):
    text = "\n".join(["a" * 30, "b" * 30, "c" * 80, "", "d"])
    got = _one(spark, text, lambda c: T.chunks(c, 70))
    assert [len(x.strip()) for x in got] == [61, 80, 1] and "".join(got).replace("\n", "") == text.replace("\n", "")
    assert _one(spark, "", lambda c: T.chunks(c, 70)) == [""] and _one(spark, None, lambda c: T.chunks(c, 70)) is None


def test_ranges(spark):
    def r(v):
        x = _one(spark, v, lambda c: D.named_range(c))
        return (x["start"], x["end"], x["precision"], x["label"])

    spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert r("2024-02")[:3] == (datetime(2024, 2, 1), datetime(2024, 2, 29, 23, 59, 59), "month")
    assert r("2021")[2] == "year" and r("2021-03-04")[2] == "day" and r("2021-02-30") == (None, None, "unknown", None)
    assert r("sometime") == (None, None, "unknown", "sometime") and r(None)[2] == "unknown" and r("2021-13")[2] == "unknown"
    def of(canon, label=None):
        x = _one(spark, canon, lambda c: D.canonical_range(c, F.lit(label)))
        return x and (x["start"], x["end"], x["precision"], x["label"])

    assert of("2026-09-24T08:00:00Z") == of("2026-09-24") == (datetime(2026, 9, 24), datetime(2026, 9, 24, 23, 59, 59), "day", None)
    assert of("2026-09-19/2026-09-25", "2 weeks ago") == (datetime(2026, 9, 19), datetime(2026, 9, 25, 23, 59, 59), "range", "2 weeks ago")
    assert of("2026-09")[2] == "month" and of("2026")[2] == "year" and of(None) is None and of("yesterday") is None
