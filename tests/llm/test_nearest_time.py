import random

import pytest

from fathomline.llm.nearest_time import nearest_in_time

L, R = "k string, l_id string, l_time bigint, extra string", "k string, r_id string, r_time bigint, extra string"


def brute(left, right, tol):
    out = {}
    for k, i, t, _ in left:
        if None in (k, i, t):
            continue
        c = [(abs(u - t), u, j) for kk, j, u, _ in right if kk == k and None not in (j, u) and abs(u - t) <= tol]
        if c:
            out[i] = min(c)[2]
    return out


@pytest.mark.parametrize(("seed", "parts"), [(1, 1), (2, 5), (3, 16)])
def test_against_brute_force(spark, seed, parts):
    rnd = random.Random(seed)
    # One entity holds most rows and spans several partitions; instants repeat; sides are uneven.
    left = [(rnd.choice("aaaab"), f"l{i}", rnd.randrange(0, 400), "x") for i in range(150)] + [(None, "n1", 5, "x"), ("a", None, 5, "x"), ("a", "n2", None, "x")]
    right = [(rnd.choice("aaaac"), f"r{i}", rnd.randrange(0, 400) * (i % 9 > 3), "y") for i in range(90)] + [(None, "n", 5, "y"), ("a", "z", None, "y")]
    left += left[:20]
    right += right[:20]
    got = {r["l_id"]: r["r_id"] for r in nearest_in_time(spark.createDataFrame(left, L), spark.createDataFrame(right, R), ["k"], 15, parts).collect()}
    assert got == brute(left, right, 15)


def test_edges_carry_over_empty_partitions(spark):
    left = [("a", f"l{i:03}", 1000 + i, "") for i in range(60)]
    right = [("a", "r0", 0, ""), ("a", "r1", 5000, "")]
    got = {r["l_id"]: r["r_id"] for r in nearest_in_time(spark.createDataFrame(left, L), spark.createDataFrame(right, R), ["k"], 10_000, 8).collect()}
    assert got == {f"l{i:03}": "r0" for i in range(60)}


def test_ties_and_unmatched(spark):
    left = spark.createDataFrame([("a", "l1", 100, ""), ("b", "l2", 0, ""), ("a", "l3", 100, "")], L)
    right = spark.createDataFrame([("a", "late", 110, ""), ("a", "zz", 90, ""), ("a", "aa", 90, "")], R)
    rows = nearest_in_time(left, right, ["k"], 10, 3, keep_unmatched=True).collect()
    assert {(r["l_id"], r["r_id"]) for r in rows} == {("l1", "aa"), ("l3", "aa"), ("l2", None)}


def test_empty_sides(spark):
    e_l, e_r = spark.createDataFrame([], L), spark.createDataFrame([], R)
    one = spark.createDataFrame([("a", "l", 1, "")], L)
    assert nearest_in_time(e_l, e_r, ["k"], 1).count() == 0 and nearest_in_time(one, e_r, ["k"], 1).count() == 0
    assert nearest_in_time(one, e_r, ["k"], 1, keep_unmatched=True).first()["r_id"] is None
