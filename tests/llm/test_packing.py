import random

from fathomline.llm.packing import TokenCounter, TournamentTree, default_ranks, first_fit_decreasing, pack_documents


def plain_ffd(lengths, capacity):
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    rooms, out = [], [0] * len(lengths)
    for i in order:
        for k, r in enumerate(rooms):
            if r >= lengths[i]:
                break
        else:
            k = len(rooms)
            rooms.append(capacity)
        rooms[k] -= lengths[i]
        out[i] = k
    return out


def test_tree_is_first_fit():
    rnd = random.Random(1)
    for n in (0, 1, 2, 7, 64, 300):
        lengths = [rnd.randrange(0, 101) for _ in range(n)]
        assert first_fit_decreasing(lengths, 100) == plain_ffd(lengths, 100)
    t = TournamentTree(3, 10)
    assert [t.place(x) for x in (6, 6, 4, 4)] == [0, 1, 0, 1]


def test_pack(spark):
    rows = [(i, "word " * (i * 7 % 90), "x") for i in range(200)] + [(900, None, "x"), (901, "", "x"), (902, "alpha beta " * 5000, "x"), (3, "word " * 21, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, sequence string")
    for group in (10, 1000):
        got = pack_documents(df, capacity=256, group=group).collect()
        fill, docs = {}, {}
        for r in got:
            fill[r["sequence"]] = fill.get(r["sequence"], 0) + r["n_tokens"]
            docs.setdefault(r["doc_id"], []).append(r)
        assert set(docs) == {r[0] for r in rows} and max(fill.values()) <= 256
        counter = TokenCounter(default_ranks())
        for i, t, _ in rows:
            n = counter.count(t or "")
            assert sum(p["n_tokens"] for p in docs[i]) == n * (2 if i == 3 else 1)
            assert len(docs[i]) == (2 if i == 3 else max(1, -(-n // 256)))
        assert sorted(p["token_start"] for p in docs[902]) == [256 * k for k in range(len(docs[902]))]
    assert sum(fill.values()) / (256 * len(fill)) > 0.97
    assert pack_documents(df.limit(0)).count() == 0


def test_more_groups_than_tasks(spark):
    """Thousands of groups go through a few tasks, each held alone."""
    rows = [(i, "word " * (i % 40)) for i in range(3000)]
    got = pack_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), capacity=64, group=1).collect()
    fill = {}
    for r in got:
        fill[r["sequence"]] = fill.get(r["sequence"], 0) + r["n_tokens"]
    assert {r["doc_id"] for r in got} == set(range(3000)) and max(fill.values()) <= 64
