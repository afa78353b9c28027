import random

from fathomline.llm.leakage import SeedIndex, greedy_string_tiling, leaked_items, tokens_of

ITEM = "Pell Compass printed 1,116 copies of the prospectus, rescued lighthouse keepers and recovered its costs long after its rivals had folded. By 2002 the ratio of archivists to surveyors had reached 15 to one among 9,275 members, a figure the curious errata sheet omits."
OTHER = "Keth Spool printed 3,203 copies of the footnote, rescued cartographers and recovered its costs long after its rivals had folded. By 1969 the ratio of beekeepers to surveyors had reached 26 to one among 8,744 members, a figure the cumbersome errata sheet omits."
PAD = "The server was slow that week and nobody noticed it for a while. "


def naive_tiles(a, b, least):
    in_a, in_b, tiles = [False] * len(a), [x == 0 for x in b], []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not in_a[i + n] and not in_b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return tiles
        tiles.append((i, j, n))
        in_a[i : i + n], in_b[j : j + n] = [True] * n, [True] * n


def test_tiling_covers_as_the_naive_form():
    rnd = random.Random(3)
    for _ in range(60):
        a = [rnd.randrange(1, 30) for _ in range(rnd.randrange(0, 60))]
        b = [rnd.choice([0, rnd.randrange(1, 30)]) for _ in range(20)] + a[10:40] + [rnd.randrange(1, 30) for _ in range(10)] + a[:8]
        got, want = greedy_string_tiling(a, b, 3), naive_tiles(a, b, 3)
        assert abs(sum(t[2] for t in got) - sum(t[2] for t in want)) <= 3
        used_a, used_b = set(), set()
        for i, j, n in got:
            assert a[i : i + n] == b[j : j + n] and n >= 3
            assert not used_a & set(range(i, i + n)) and not used_b & set(range(j, j + n))
            used_a |= set(range(i, i + n))
            used_b |= set(range(j, j + n))


def found(text, items=((1, ITEM), (2, OTHER))):
    return sorted(r[0] for r in SeedIndex(list(items)).find(text))


def test_cases():
    assert found(PAD * 5 + ITEM + PAD * 5) == [1]
    assert found(PAD + ITEM.upper().replace(",", " ") + PAD) == [1]
    assert found(PAD + "<p>" + ITEM.replace(". ", ".</p><p>") + PAD) == [1]
    half = " ".join(ITEM.split()[20:])
    assert found(PAD + half + PAD) == [1]
    edited = ITEM.replace("lighthouse ", "").replace("curious errata", "curious old errata").replace("recovered", "got back")
    assert found(PAD + edited + PAD) == [1]
    a, b = ITEM.split(". ")
    assert found(b + ". " + a) == [1]
    assert found(ITEM + PAD + OTHER) == [1, 2]
    assert found(ITEM.replace("o", "ο")) == [1]


def test_no_cases():
    assert found(PAD * 9) == [] and found("") == []
    assert found(PAD + " ".join(ITEM.split()[:12]) + " " + PAD) == []
    assert found(OTHER, [(1, ITEM)]) == []
    assert tokens_of("<b>1,116</b> &amp; x") == ["1116", "x"]


def test_operator(spark):
    docs = [(1, ITEM, "x"), (1, ITEM, "x"), (2, PAD, "x"), (3, None, "x"), (4, "", "x"), (5, PAD * 3000 + OTHER, "x")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(1, ITEM, "s"), (2, OTHER, "s"), (3, None, "s"), (4, "too short", "s"), (2, OTHER, "s")], "item_id bigint, text string, doc_id string")
    assert {(r["doc_id"], r["item_id"]) for r in leaked_items(d, items).collect()} == {(1, 1), (5, 2)}
    assert leaked_items(d.limit(0), items).count() == 0 and leaked_items(d, items.limit(0)).count() == 0


def test_many_items_in_one_scan(spark):
    """Hundreds of items that share most of their seeds; the join finds what an index of all items finds."""
    rnd = random.Random(4)
    things = ["".join(rnd.choice("abcdefghiklmnoprstu") for _ in range(6)) for _ in range(400)]
    items = [(i, ITEM.replace("Pell Compass", " ".join(rnd.sample(things, 2)).title()).replace("lighthouse keepers", " ".join(rnd.sample(things, 4))).replace("1,116", str(2000 + i)).replace("9,275", str(5000 + 3 * i))) for i in range(300)]
    docs = [(i, PAD + rnd.choice(items)[1] + PAD) if i % 3 else (i, PAD + " ".join(rnd.choice(items)[1].split()[20:])) for i in range(60)] + [(99, PAD * 3)]
    index = SeedIndex(items)
    want = {(d, f[0]) for d, t in docs for f in index.find(t)}
    got = leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len({d for d, _ in want}) == 60
