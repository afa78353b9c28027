import random

from fathomline.operators import evidence as E
from fathomline.operators import records as R
from fathomline.operators import validation as V
from fathomline.operators.numbering import number_rows


def test_merge_claims(spark):
    rows = [(1, "metric", "2022-05", "T reached 1,000 users in May 2022."), (2, "metric", "2022-05", "T reached 1,000 users in May 2022"), (3, "metric", "2022-05", "T has reached 1,000 users in May 2022."),
            (4, "metric", "2022-05", "T reached 1,200 users in May 2022."), (5, None, None, "T reached 1,000 users in May 2022."), (6, "metric", "2022-05", None)]
    c = spark.createDataFrame(rows, "claim_id bigint, kind string, day string, statement string")
    want = {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 6)}
    assert {(r[0], r[1]) for r in E.merge_claims(c).select("claim_id", "kept_id").collect()} == want
    assert {(r[0], r[1]) for r in E.merge_claims(c, block=1).select("claim_id", "kept_id").collect()} <= {(a, b) for a in range(1, 7) for b in range(1, 7)}
    assert E.merge_claims(c.limit(0)).count() == 0


def test_merge_claims_of_large_blocks_equals_the_unsplit_result(spark):
    rnd = random.Random(3)
    subjects = ["the harbour team moved its mail service to another town", "readers of the weekly digest asked for a darker theme", "the founder wrote a long post about pricing mistakes"]
    rows = []
    for i in range(30):
        w = rnd.choice(subjects).split()
        w[rnd.randrange(len(w))] += "s" * rnd.randrange(4)
        rows.append((i, "metric" if i % 5 else None, None, " ".join(w)))
    c = spark.createDataFrame(rows, "claim_id bigint, kind string, day string, statement string")
    want = {(r[0], r[1]) for r in E.merge_claims(c).select("claim_id", "kept_id").collect()}
    assert len({k for _, k in want}) < len(rows) / 2
    for block in (1, 4):
        assert {(r[0], r[1]) for r in E.merge_claims(c, block=block).select("claim_id", "kept_id").collect()} == want, block


def test_prune_spreads(spark):
    nodes = spark.createDataFrame([("e1",), ("e2",), ("e3",), ("l1",), ("l2",)], "id string")
    edges = spark.createDataFrame([("e1", "c1"), ("e1", "c2"), ("e2", "c1"), ("e3", "c2"), ("l1", "e2"), ("l2", "e3")], "id string, rests_on string")
    dead = spark.createDataFrame([("c1",)], "id string")
    assert {(r[0], r[1]) for r in E.prune(nodes, edges, dead).collect()} == {("e1", "review"), ("e2", "drop"), ("l1", "drop")}


def test_conflicts(spark):
    m = spark.createDataFrame([("k", 100.0, 1), ("k", 102.0, 2), ("j", 100.0, 1), ("j", 110.0, 2), ("i", 1.0, 1), ("i", 9.0, 1), ("z", 0.0, 1), ("z", -5.0, 2), (None, 1.0, 1)], "k string, v double, c int")
    assert {r["k"] for r in E.conflicts(m, ["k"], "v", "c").collect()} == {"j", "z"}


def test_records(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 2, "c"), (2, None, "d")], "k int, t int, v string")
    assert {(r["k"], r["v"]) for r in R.latest(df, ["k"], "t").collect()} == {(1, "c"), (2, "d")}
    n = number_rows(spark.range(1000).selectExpr("(id * 7919) % 1000 AS x"), ["x"], "n")
    assert {(r["x"], r["n"]) for r in n.collect()} == {(i, i + 1) for i in range(1000)}


def test_validation(spark):
    a = spark.createDataFrame([(1, 10), (2, 99), (3, None)], "id int, ref int")
    b = spark.createDataFrame([(10,)], "id int")
    assert [r["row_id"] for r in V.check_reference(a, ["ref"], b, ["id"], "r", "a", "id").collect()] == ["2"]
    assert [r["row_id"] for r in V.check_rows(a, a["ref"] > 50, "r", "a", "id").collect()] == ["2"]
    assert [r["row_id"] for r in V.check_unique({"a": (a, "id"), "b": (a.limit(2), "id")}, "r").orderBy("row_id").collect()] == ["1", "2"]
    assert V.schema_drift(a.schema, b.schema) == ["missing ref"]
    nested = spark.createDataFrame([], "x struct<t:struct<start:string,end:string>>, y array<struct<start:string,end:string>>").schema
    assert V.struct_paths(nested, {"start", "end"}) == ["x.t", "y[]"]


def test_prune_follows_chains_of_any_length(spark):
    n = 30
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(n)], "id string")
    edges = spark.createDataFrame([(f"n{i}", f"n{i - 1}") for i in range(1, n)], "id string, rests_on string")
    got = E.prune(nodes, edges, spark.createDataFrame([("n0",)], "id string")).collect()
    assert {r["id"] for r in got} == {f"n{i}" for i in range(1, n)} and {r["fate"] for r in got} == {"drop"}
