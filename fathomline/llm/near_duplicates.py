"""Near-duplicate claims by PartEnum signatures.

A claim is the multiset of words of its statement and of its quote, kept apart; its figures must agree. Two sets of one size
band (or of two neighbouring bands) with a Jaccard similarity of at least ``GAMMA`` differ in at most k features. The feature
domain is split into n1 first-level partitions; one of them differs in at most k2 = ceil((k + 1) / n1) - 1 features, so that,
split again into n2 second-level partitions, the two sets agree on all features of some n2 - k2 of these. A signature is the
content of such a subset together with the leading digits of the figures. Similar sets share one, whatever the size.

1. Exact copies of a text are collapsed, and texts that are alone with their figures are left out, by aggregates over keys.
   A bitmap of the repeated figures lets few of the others into the exchange in which they are left out.
2. (signature, id) is exchanged; texts that share a signature are candidates. Buckets beyond ``bucket`` texts are first reduced
   by linking their members with one of them, and those that still hold several classes are split by the signatures of a second,
   independent partitioning; what is large even then is compared class against class in parts. Nothing is dropped.
3. A pair of candidates is compared once, however many signatures it shares, and verified on figures, statement, quote and names.
4. Verified links are closed to classes by distributed label propagation.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.claim_features import feature_set, figures_agree, name_tokens, plain, plain_words, within_edits, word_hash, words_and_figures
from fathomline.session import cut

#: Least Jaccard similarity of two claims over the words of statement and quote: for verification and for signatures.
GAMMA = 0.75
#: Least similarity of statements and of quotes by themselves. A cut quote may instead be contained in the other.
LEAST_STATEMENT, LEAST_QUOTE, LEAST_CONTAINED, LEAST_PART = 0.35, 0.6, 0.85, 0.3
#: Second-level partitions, and how many of them may differ.
N2, K2 = 3, 1
#: First-level partitions more than the bound asks for, so that few sets need signatures of empty subsets.
SPARE = 1
#: Texts of a signature of which every two are candidates at once.
BUCKET = 64
#: Links that one task closes to classes.
FEW = 200_000
#: Bits of the filter for each repeated figure, and in all at most; bits of a part of it that one task sets. Powers of two.
FILTER_BITS, MOST_BITS, PART_BITS = 8, 1 << 28, 1 << 16

_FEATURES = "claim_id bigint, fig bigint, txt binary, st binary, qt binary, names string, figs string"
_PARTS = ("st", "qt", "names", "figs")
_U = np.uint64
_QUOTE = _U(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on all."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _band_tops(gamma: float, largest: int) -> list[int]:
    """The largest size of each band: a band is [low, low / gamma], each beginning after the last."""
    tops, low = [], 1
    while not tops or tops[-1] < largest:
        tops.append(max(low, int(low / gamma + 1e-9)))
        low = tops[-1] + 1
    return [*tops, max(low, int(low / gamma + 1e-9))]


def _first_level(top: int, gamma: float) -> int:
    """n1 for sets of at most ``top`` features: as many partitions as leave k2 = ``K2``, and ``SPARE``."""
    k = int(2 * top * (1 - gamma) / (1 + gamma) + 1e-9)
    return max(1, math.ceil((k + 1) / (K2 + 1))) + SPARE


def signatures(features: np.ndarray, lengths: np.ndarray, keys: np.ndarray, gamma: float = GAMMA, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(signature, number of its set) for sets of distinct 64-bit ``features``, one after another with ``lengths``.

    ``keys`` (64 bits, one for each set) are part of every signature. A set has the signatures of its own size band and of
    the next one, in which larger sets may meet it. The content of a partition is the sum of its mixed features, so that the
    content of n2 - 1 of n2 partitions is the sum of all less one.

    Subsets without any feature would gather texts that have nothing in common. Of the n1 partitions at most k / (k2 + 1)
    differ in more than k2 features, where k follows from the set's own size; a set in which fewer partitions than the
    others have an empty subset meets every similar set in one that has none, and leaves its empty subsets out.
    """
    n = len(lengths)
    row = np.repeat(np.arange(n), lengths)
    tops = _band_tops(gamma, int(lengths.max(initial=1)))
    n1s = np.array([_first_level(t, gamma) for t in tops])
    own = np.searchsorted(np.array(tops), np.maximum(lengths, 1))
    mixed = _mix(features + _U((seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    place = _mix(mixed)
    sigs, owners = [], []
    for band in (own, own + 1):
        cells = n1s[band] * N2
        at = np.concatenate([[0], np.cumsum(cells)])
        sums = np.zeros(at[-1], np.uint64)
        to = at[row] + (place % cells[row].astype(np.uint64)).astype(np.int64)
        np.add.at(sums, to, mixed)
        cell = sums.reshape(-1, N2)
        rest = (cell.sum(axis=1, dtype=np.uint64)[:, None] - cell).reshape(-1)
        filled = np.bincount(to, minlength=at[-1]).reshape(-1, N2)
        empty = (filled.sum(axis=1)[:, None] - filled) == 0
        owner = np.repeat(np.arange(n), cells)
        n_empty = np.bincount(owner[::N2], empty.any(axis=1), n)
        k = (1 - gamma) / (1 + gamma) * (lengths + np.minimum(np.array(tops)[band], lengths / gamma)) + 1e-9
        needed = n_empty >= n1s[band] - (k // (K2 + 1))
        kept = ~empty.reshape(-1) | needed[owner]
        local = (np.arange(at[-1]) - at[owner]).astype(np.uint64)
        sigs.append(_mix(rest + _mix(keys[owner] + _mix(band[owner].astype(np.uint64) * _U(1 << 20) + local + _U(seed << 40))))[kept])
        owners.append(owner[kept])
    return np.concatenate(sigs), np.concatenate(owners)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit numbers of binary values, one after another, and how many each value has."""
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), np.uint64), np.array([len(p) // 8 for p in parts], np.int64)


def _joined(st: pa.Array, qt: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The features of statements and quotes together; a word of a quote is another feature than one of a statement."""
    (a, na), (b, nb) = _flat(st), _flat(qt)
    order = np.argsort(np.concatenate([np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)]), kind="stable")
    return np.concatenate([a, b ^ _QUOTE])[order], na + nb


def _sign(seed: int):
    """Rows (sig, id, st, qt) -> (sig, id): the signatures of each text, each mixed with the row's ``sig``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 2000) for i in range(0, b.num_rows, 2000)):
                keys = part.column("sig").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                sig, owner = signatures(*_joined(part.column("st"), part.column("qt")), keys, GAMMA, seed)
                ids = part.column("id").to_numpy(zero_copy_only=False)[owner]
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(ids, pa.int64())], names=["sig", "id"])

    return run


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    keep = a < b
    keep[1:] &= (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[keep], b[keep]


def _gathered(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[np.ndarray]:
    """The first two columns as rows of an array, in runs of at least ``least``."""
    parts: list[np.ndarray] = []
    n = 0
    for b in batches:
        parts.append(np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1)]))
        n += b.num_rows
        if n >= least:
            yield np.concatenate(parts, axis=1)
            parts, n = [], 0
    if n:
        yield np.concatenate(parts, axis=1)


def _pair_up(most: int):
    """Rows sorted by (sig, id) -> (a, b, false) for every two ids of a signature of up to ``most`` rows, and
    (sig, id, true) for the rows of larger ones. Pairs repeat only between flushes."""

    def batch(a: np.ndarray, b: np.ndarray, large: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.full(len(a), large))], names=["a", "b", "large"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((2, 0), np.int64)
        open_sig = None  # a large signature whose rows go on
        got: list[tuple[np.ndarray, np.ndarray]] = []
        n_got = 0

        def closed(rows: np.ndarray) -> None:
            nonlocal n_got
            at = np.flatnonzero(np.r_[True, rows[0, 1:] != rows[0, :-1]])
            n = np.diff(np.r_[at, rows.shape[1]])
            for size in np.unique(n[n > 1]):
                x, y = np.triu_indices(int(size), 1)
                starts = at[n == size]
                for part in np.array_split(starts, max(1, len(starts) * len(x) // 500_000)):
                    ids = rows[1][part[:, None] + np.arange(size)]
                    got.append(_distinct_pairs(ids[:, x].ravel(), ids[:, y].ravel()))
                    n_got += len(got[-1][0])

        for rows in _gathered(batches, 100_000):
            if open_sig is not None:
                end = int(np.searchsorted(rows[0] != open_sig, True))
                yield batch(rows[0, :end], rows[1, :end], True)
                if end == rows.shape[1]:
                    continue
                open_sig, rows = None, rows[:, end:]
            rows = np.concatenate([held, rows], axis=1)
            at = np.flatnonzero(np.r_[True, rows[0, 1:] != rows[0, :-1]])
            n = np.diff(np.r_[at, rows.shape[1]])
            big = np.repeat(n > most, n)
            if big.any():
                yield batch(rows[0, big], rows[1, big], True)
            last = np.arange(rows.shape[1]) >= at[-1]
            if n[-1] > most:
                open_sig = rows[0, -1]
            held = rows[:, last & ~big]
            if (done := rows[:, ~last & ~big]).size:
                closed(done)
            if n_got > 2_000_000:
                yield batch(*_distinct_pairs(*(np.concatenate(c) for c in zip(*got))), False)
                got, n_got = [], 0
        if held.size:
            closed(held)
        if got:
            yield batch(*_distinct_pairs(*(np.concatenate(c) for c in zip(*got))), False)

    return run


def names_conflict(a: str, b: str, st_a: bytes, st_b: bytes) -> bool:
    """Whether each statement has a name that the other has not, not even misspelt. ``st``: its ``feature_set``."""
    na, nb = set(a.split()), set(b.split())
    only_a, only_b = na - nb, nb - na
    if not only_a or not only_b:
        return False
    in_a, in_b = set(memoryview(st_a).cast("Q")), set(memoryview(st_b).cast("Q"))
    only_a = [w for w in only_a if word_hash(w) not in in_b]
    only_b = [w for w in only_b if word_hash(w) not in in_a]
    return any(all(not within_edits(x, y, 2) for y in only_b) for x in only_a) and any(all(not within_edits(x, y, 2) for x in only_a) for y in only_b)


def _shared(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each pair of sets: the features they share, and the sizes of both."""
    (fa, na), (fb, nb) = _flat(a), _flat(b)
    ra, rb = np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)
    row, f = np.concatenate([ra, rb]), np.concatenate([fa, fb])
    order = np.lexsort((f, row))
    row, f = row[order], f[order]
    same = (row[1:] == row[:-1]) & (f[1:] == f[:-1])
    return np.bincount(row[1:][same], minlength=len(na)), na, nb


def edited_versions(st_a: pa.Array, qt_a: pa.Array, st_b: pa.Array, qt_b: pa.Array) -> np.ndarray:
    """Which pairs of claims are similar enough in statement, quote and both together. Two empty texts agree."""
    s, ns, ms = _shared(st_a, st_b)
    q, nq, mq = _shared(qt_a, qt_b)
    jaccard = lambda x, n, m: np.where(n + m > 0, x / np.maximum(n + m - x, 1), 1.0)
    small, large = np.minimum(nq, mq), np.maximum(nq, mq)
    contained = (q >= LEAST_CONTAINED * small) & (small >= LEAST_PART * large) & (small > 0)
    return (jaccard(s + q, ns + nq, ms + mq) >= GAMMA) & (jaccard(s, ns, ms) >= LEAST_STATEMENT) & ((jaccard(q, nq, mq) >= LEAST_QUOTE) | contained)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for p in (b.slice(i, 5000) for i in range(0, b.num_rows, 5000)):
            at = np.flatnonzero(edited_versions(*(p.column(c) for c in ("st_a", "qt_a", "st_b", "qt_b"))))
            near = p.take(pa.array(at))
            rows = zip(*(near.column(c).to_pylist() for c in ("a", "b", "figs_a", "figs_b", "names_a", "names_b", "st_a", "st_b")))
            kept = [(x, y) for x, y, fa, fb, na, nb, sa, sb in rows if figures_agree(fa, fb) and not names_conflict(na, nb, sa, sb)]
            if kept:
                c, d = zip(*kept)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(d, pa.int64())], names=["a", "b"])


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.string(), pa.string())
    for b in batches:
        rows = []
        for i, s, q in zip(*(b.column(c).to_pylist() for c in ("claim_id", "statement", "quote"))):
            s, q = plain(s), plain(q) if q else ""
            words, key, figs = words_and_figures(s)
            text = hashlib.blake2b(f"{s}\x00{q}".encode(), digest_size=15).digest()
            fig = int.from_bytes(hashlib.blake2b(key.encode(), digest_size=8).digest(), "big", signed=True)
            rows.append((i, fig, text, feature_set(words), feature_set(plain_words(q)), " ".join(name_tokens(s)), figs))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["claim_id", "fig", "txt", *_PARTS])


def _figure_bits(several: DataFrame) -> np.ndarray:
    """A bitmap of the figures ``several`` (fig, 64-bit hashes): the bit of a figure is its last bits."""
    bits = min(MOST_BITS, max(PART_BITS, 1 << (FILTER_BITS * several.count() - 1).bit_length()))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for b in batches:
            bit = b.column("bit").to_numpy(zero_copy_only=False)
            part = bit // PART_BITS
            for k in np.unique(part):
                own = bit[part == k] % PART_BITS
                np.bitwise_or.at(parts.setdefault(int(k), np.zeros(PART_BITS // 8, np.uint8)), own >> 3, (1 << (own & 7)).astype(np.uint8))
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array([x.tobytes() for x in parts.values()], pa.binary())], names=["part", "set"])

    slots = several.select(F.col("fig").bitwiseAND(F.lit(bits - 1)).alias("bit"))
    out = np.zeros(bits // 8, np.uint8)
    for part, packed in slots.repartition((F.col("bit") / PART_BITS).cast("bigint")).mapInArrow(pack, "part bigint, set binary").collect():
        out[part * (PART_BITS // 8) : (part + 1) * (PART_BITS // 8)] = np.frombuffer(packed, np.uint8)
    return out


def _with_figures_of(several: DataFrame, prepared: DataFrame) -> DataFrame:
    """The rows of ``prepared`` whose figures are in ``several``, and some others."""
    sent = prepared.sparkSession.sparkContext.broadcast(_figure_bits(several))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for b in batches:
            bit = b.column("fig").to_numpy(zero_copy_only=False) & (8 * len(bits) - 1)
            yield b.filter(pa.array((bits[bit >> 3] >> (bit & 7)) & 1 == 1))

    return prepared.mapInArrow(run, prepared.schema)


def near_duplicate_classes(claims: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """One row per claim id: ``claim_id``, ``class_id`` (the least claim id of its class).

    claims: ``claim_id``, ``statement``, ``quote``; other columns are ignored. Claims with a null id or statement form no
    class and are left out; a null quote counts as empty, and two empty quotes agree. Statements without words match only
    if figures and quotes agree. Repeated rows count once; an id with several texts belongs to the least of their classes;
    an empty table gives an empty result. ``bucket`` bounds the texts of a signature that are paired at once and has no
    effect on the result.
    """
    rows = claims.select("claim_id", "statement", "quote").where("claim_id IS NOT NULL AND statement IS NOT NULL")
    prepared = cut(rows.mapInArrow(_prepare, _FEATURES), "claims")
    texts = cut(prepared.groupBy("fig", "txt").agg(F.min("claim_id").alias("claim_id")), "keys")
    several = texts.groupBy("fig").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fig")
    kept = texts.join(several, "fig", "left_semi").select("claim_id", "txt")
    items = cut(_with_figures_of(several, prepared).join(kept, ["claim_id", "txt"], "left_semi").select(F.col("claim_id").alias("id"), F.col("fig").alias("sig"), *_PARTS), "texts")
    edges = _links(items, bucket)
    own = texts.select("txt", F.col("claim_id").alias("a"))
    classes = own.join(components(edges), "a", "left").select("txt", F.coalesce("b", "a").alias("class_id"))
    return prepared.select("claim_id", "txt").join(classes, "txt").groupBy("claim_id").agg(F.min("class_id").alias("class_id"))


def _links(items: DataFrame, bucket: int) -> DataFrame:
    """Verified links (a, b) that connect all similar ``items`` (id, sig, st, qt, names, figs)."""
    pair_schema = "a bigint, b bigint, large boolean"

    def paired(signed: DataFrame) -> DataFrame:
        return cut(signed.repartition("sig").sortWithinPartitions("sig", "id").mapInArrow(_pair_up(bucket), pair_schema), "pairs")

    def verified(pairs: DataFrame) -> DataFrame:
        x = items.select(F.col("id").alias("a"), *[F.col(c).alias(f"{c}_a") for c in _PARTS])
        y = items.select(F.col("id").alias("b"), *[F.col(c).alias(f"{c}_b") for c in _PARTS])
        return cut(pairs.select("a", "b").distinct().join(x, "a").join(y, "b").mapInArrow(_verify, "a bigint, b bigint"), "links")

    first = paired(items.select("sig", "id", "st", "qt").mapInArrow(_sign(0), "sig bigint, id bigint"))
    found = [verified(first.where("NOT large"))]
    hot = first.where("large").select(F.col("a").alias("sig"), F.col("b").alias("id"))
    if not hot.limit(1).count():
        return found[0]
    # Large buckets: every member with the least one; buckets that are one class then are finished.
    least = hot.groupBy("sig").agg(F.min("id").alias("a"))
    found.append(verified(hot.join(least, "sig").where("a < id").select("a", F.col("id").alias("b"))))
    hot = _in_several_classes(hot, reduce(DataFrame.unionByName, found))
    if not hot.limit(1).count():
        return reduce(DataFrame.unionByName, found)
    second = paired(hot.join(items.select("id", "st", "qt"), "id").select("sig", "id", "st", "qt").mapInArrow(_sign(1), "sig bigint, id bigint"))
    found.append(verified(second.where("NOT large")))
    hot = _in_several_classes(second.where("large").select(F.col("a").alias("sig"), F.col("b").alias("id")), reduce(DataFrame.unionByName, found))
    # What is large in both partitionings: parts of a bucket meet each other, members of one class do not.
    size = hot.groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / bucket).cast("int").alias("m"))
    part = hot.join(size, "sig").withColumn("p", F.pmod(F.xxhash64("id"), F.col("m")).cast("int"))
    left = part.select("sig", "p", F.col("id").alias("a"), F.col("class_id").alias("class_a"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("q"))
    right = part.select("sig", F.col("p").alias("q"), F.col("id").alias("b"), F.col("class_id").alias("class_b"))
    tiles = left.join(right, ["sig", "q"]).where("a < b AND class_a <> class_b")
    found.append(verified(tiles))
    return reduce(DataFrame.unionByName, found)


def _in_several_classes(hot: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (sig, id, class_id) of the signatures whose ids are not all in one class by ``edges``."""
    classed = cut(hot.join(components(edges).withColumnRenamed("a", "id"), "id", "left").select("sig", "id", F.coalesce("b", "id").alias("class_id")), "hot")
    mixed = classed.groupBy("sig").agg(F.min("class_id").alias("x"), F.max("class_id").alias("y")).where("x <> y").select("sig")
    return classed.join(mixed, "sig", "left_semi")


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = find(x), find(y)
            root[max(x, y)] = min(x, y)
    if rows := [(x, r) for x in root if (r := find(x)) != x]:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["a", "b"])


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(a, b = least id of a's component) for every id that is not the least of its component.

    Alternating large-star and small-star steps; each keeps at most one row per edge and cuts its lineage. At most ``few``
    edges are closed by one task instead.
    """
    e = cut(edges.select("a", "b").where("a <> b"), "star")
    if e.limit(few + 1).count() <= few:
        return e.coalesce(1).mapInArrow(_close, "a bigint, b bigint")
    last = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low2 = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low2, "a").select("b", "m").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low2.select("a", F.col("m").alias("b"))).distinct()
        e = cut(small, "star")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            return e
        last = now
