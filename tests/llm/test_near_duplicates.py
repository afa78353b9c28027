import random
from collections import Counter
from itertools import combinations

import numpy as np

from fathomline.llm import near_duplicates as N
from fathomline.llm.claim_features import feature_set, figures_agree, name_tokens, plain, plain_words, within_edits, words_and_figures, words_and_numbers

BASE = [
    ("Tekerusokit closed a $71,500 angel round in August 2025 from 48 investors.", "The round was $71,500 from 48 people who already used the invite screen. The odd part was the mobile view, which a reseller copied twice."),
    ("By March 2018 Canawagaforge had 1,861 monthly active users, up from 847.", "When we looked at the dashboard in March 2018 it said 1,861 monthly active users. Nothing on word of mouth ever worked as well."),
    ("Zorilane hired 44 people for its mobile view in January 2023.", "We hired 44 people in January 2023 just for the mobile view and the inbox filled overnight. Shortly after midnight we kept answering freelance writers."),
]


def edited(rnd, text):
    w = text.split()
    for _ in range(rnd.randrange(0, 3)):
        i = rnd.randrange(1, len(w))
        if w[i][0].isdigit() or w[i][0] == "$" or w[i][0].isupper():
            continue
        w[i : i + 1] = rnd.choice([[], [w[i].upper()], [w[i], "really"], [w[i][:2] + "x" + w[i][2:]]])
    t = " ".join(w)
    return t.replace("1,861", "1861") if rnd.random() < 0.5 else t


def corpus(seed, n):
    rnd = random.Random(seed)
    rows, group = [], {}
    for i in range(n):
        g = rnd.randrange(len(BASE) * 4)
        s, q = BASE[g % len(BASE)]
        s, q = (x.replace("48", str(48 + g)).replace("847", str(847 + g)).replace("44", str(44 + g)) for x in (s, q))
        rows.append((i, edited(rnd, s), edited(rnd, q), "extra"))
        group[i] = g
    return rows, group


def classes(spark, rows, **kw):
    df = spark.createDataFrame(rows, "claim_id bigint, statement string, quote string, class_id string")
    return {r["claim_id"]: r["class_id"] for r in N.near_duplicate_classes(df, **kw).collect()}


def similar(a, b):
    """The rule of verification on plain multisets."""
    def share(x, y):
        both = sum((x & y).values())
        n, m = sum(x.values()), sum(y.values())
        return both, (both / (n + m - both) if n + m else 1.0), min(n, m), max(n, m)

    (s1, q1, f1, n1), (s2, q2, f2, n2) = a, b
    _, js, _, _ = share(s1, s2)
    both, jq, small, large = share(q1, q2)
    whole = share(s1 + Counter({f"q {w}": n for w, n in q1.items()}), s2 + Counter({f"q {w}": n for w, n in q2.items()}))[1]
    contained = small > 0 and both >= N.LEAST_CONTAINED * small and small >= N.LEAST_PART * large
    st = [feature_set(list(x.elements())) for x in (s1, s2)]
    return figures_agree(f1, f2) and whole >= N.GAMMA and js >= N.LEAST_STATEMENT and (jq >= N.LEAST_QUOTE or contained) and not N.names_conflict(n1, n2, *st)


def brute(rows):
    items, root = {}, {}
    for i, s, q, _ in rows:
        if s is not None:
            words, _, figs = words_and_figures(plain(s))
            items[i] = (Counter(words), Counter(plain_words(plain(q or ""))), figs, " ".join(name_tokens(plain(s))))
            root[i] = i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(items, 2):
        if similar(items[a], items[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in items}


def test_against_brute_force(spark):
    rows, group = corpus(1, 150)
    rows += [(900, rows[0][1], rows[0][2], ""), (901, None, "q", ""), (902, "", None, ""), rows[3]]
    got = classes(spark, rows)
    want = brute(rows)
    assert got == want
    assert all((got[a] == got[b]) == (group[a] == group[b]) for a, b in combinations(group, 2))


def test_large_buckets_lose_no_link(spark):
    rows, _ = corpus(2, 120)
    want = brute(rows)
    for bucket in (2, 1000):
        assert classes(spark, rows, bucket=bucket) == want, bucket


def test_thousands_of_texts_without_a_figure(spark):
    """All texts share the key of no figures; every group is found and the exchange stays linear."""
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdefghijklmnoprstuvw") for _ in range(7)) for _ in range(3000)]
    rows, group = [], {}
    for g in range(1000):
        s, q = [rnd.choice(words) for _ in range(12)], [rnd.choice(words) for _ in range(30)]
        for k in range(4):
            t = list(q)
            t[rnd.randrange(30)] = rnd.choice(words)
            rows.append((4 * g + k, " ".join(["the team said that it"] + s), " ".join(t), ""))
            group[4 * g + k] = 4 * g
    got = classes(spark, rows)
    assert got == group


def test_a_dense_group_beyond_the_bucket(spark):
    """Hundreds of similar texts share every signature, with outsiders in the same buckets."""
    rnd = random.Random(10)
    words = ["".join(rnd.choice("abcdefghijklmnoprstuvw") for _ in range(6)) for _ in range(60)]
    rows = [(i, "the crew moved all boats", " ".join([*words[:40], words[40 + i % 20], words[40 + i // 20]]), "") for i in range(400)]
    rows += [(1000 + i, "the crew moved all boats", " ".join([*words[: 40 - i], *(f"other{j}{i}x" for j in range(i))]), "") for i in range(1, 21)]
    assert classes(spark, rows, bucket=8) == brute(rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40) if i % 10 != 9] + [(100, 200), (300, 200), (400, 300)]
    want = {i: i // 10 * 10 for i in range(0, 41) if i % 10} | {200: 100, 300: 100, 400: 100}
    for few in (0, 1000):
        got = N.components(spark.createDataFrame(edges, "a bigint, b bigint"), few).collect()
        assert {r["a"]: r["b"] for r in got} == want


def signature_set(features, key=7, seed=0):
    return set(N.signatures(np.array(sorted(features), np.uint64), np.array([len(features)]), np.array([key], np.uint64), seed=seed)[0].tolist())


def test_signatures_cover_all_that_verification_accepts():
    rnd = random.Random(5)
    met = 0
    for _ in range(400):
        a = {rnd.randrange(1 << 60) for _ in range(rnd.randrange(0, 90))}
        b = set(a)
        for _ in range(rnd.randrange(0, max(1, len(a) // 3))):
            if rnd.random() < 0.5 and len(b) > 1:
                b.discard(rnd.choice(sorted(b)))
            else:
                b.add(rnd.randrange(1 << 60))
        if not a | b or len(a & b) >= N.GAMMA * len(a | b):
            met += 1
            assert all(signature_set(a, seed=s) & signature_set(b, seed=s) for s in (0, 1))
    assert met > 100
    a = {rnd.randrange(1 << 60) for _ in range(40)}
    assert not signature_set(a, key=7) & signature_set(a, key=8)  # other figures


def test_signatures_of_many_sets_are_those_of_each():
    rnd = random.Random(6)
    sets = [[rnd.randrange(1 << 60) for _ in range(n)] for n in (0, 1, 5, 40, 41, 130)]
    sig, owner = N.signatures(np.array([x for s in sets for x in s], np.uint64), np.array([len(s) for s in sets]), np.arange(6).astype(np.uint64))
    for i, s in enumerate(sets):
        assert set(sig[owner == i].tolist()) == signature_set(s, key=i)


def test_names_that_collided_in_short_hashes_are_told_apart(spark):
    s, q = BASE[0]
    rows = [(1, s.replace("Tekerusokit", "harvigridlab"), q, ""), (2, s.replace("Tekerusokit", "harawaleafapp"), q, "")]
    assert len(set(classes(spark, [(i, t.replace("har", "Har"), q, "") for i, t, q, _ in rows]).values())) == 2


def test_different_figures_or_products_are_no_case(spark):
    s, q = BASE[0]
    rows = [(1, s, q, ""), (2, s.replace("48", "49"), q, ""), (3, s.replace("Tekerusokit", "Molivadesk"), q, ""), (4, s, "A different passage about something else entirely, with other words in it.", "")]
    got = classes(spark, rows)
    assert len(set(got.values())) == 4
    assert classes(spark, []) == {}


def test_words():
    assert words_and_numbers("It got 35.6k users & 38 % more, six times")[1] == ["35600", "38", "6"]
    assert words_and_numbers("$23.69 million")[1] == words_and_numbers("23,690,000")[1]
    assert within_edits("harbour", "habrour", 1) and not within_edits("harbour", "garden", 2)


def test_a_broken_unit_word_is_no_other_figure(spark):
    s, q = "Rakibesimark declined a $33 million offer in July 2019 and kept 805 seats.", "We said no to the offer and kept all seats that we had."
    edits = ["33 miillion", "33 milion", "33 then million", "33 really just million", "33 offer milliion", "33,000,000"]
    others = ["33", "33 thousand", "33 billion", "34 million", "3.4 million"]
    rows = [(i, s.replace("33 million", x), q, "") for i, x in enumerate(["33 million", *edits, *others])]
    for bucket in (3, 1000):
        got = classes(spark, rows, bucket=bucket)
        assert sorted(i for i in got if got[i] == 0) == list(range(len(edits) + 1)), bucket
        assert len({got[i] for i in range(len(edits) + 1, len(rows))}) == len(others), bucket


def test_a_statement_cut_to_half_joins_under_a_whole_quote(spark):
    long = "the board chose to close its second office after a quiet summer and moved all staff".split()
    quote = "we had talked about it since spring and nobody wanted another winter in that building so we packed and left early"
    assert set(classes(spark, [(1, " ".join(long), quote, ""), (2, " ".join(long[:8]), quote, "")]).values()) == {1}


def test_figures_that_occur_once_are_kept_out_of_the_exchange(spark):
    """Every text with a repeated figure passes the filter, and few others do."""
    rnd = random.Random(8)
    figs = [rnd.randrange(-(1 << 63), 1 << 63) for _ in range(20_000)]
    for n in (0, 1, 15_000):
        several = spark.createDataFrame([(f,) for f in figs[:n]], "fig bigint")
        rows = spark.createDataFrame([(i, f, b"payload") for i, f in enumerate(figs)], "claim_id bigint, fig bigint, st binary").repartition(3)
        got = N._with_figures_of(several, rows).collect()
        ids = {r["claim_id"] for r in got}
        assert len(got) == len(ids) and ids >= set(range(n)), n
        assert len(ids) - n < 0.2 * (len(figs) - n), n
