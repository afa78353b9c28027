"""Evaluation passages inside a corpus, by greedy string tiling.

Documents and items are joined on shared seeds (runs of three tokens), the items' rarer ones. A pair with enough of them is
looked at by itself: its seeds give a window of the document; inside it, greedy string tiling repeatedly marks the longest
unmarked common runs, found by running Karp-Rabin hashes. An item is reported if its tiles cover enough of one running passage
and the passage keeps the item's names and figures. Tiles may come in any order.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.confusables import PLAIN, canonical_form
from fathomline.session import cut

#: Tokens of a seed; least length of a tile; least share of an item's tokens that seeds of one window cover.
SEED, TILE, LEAST_SEEDED = 3, 3, 0.25
#: Least share of an item that one running passage spans and that its tiles cover.
LEAST_SPAN, LEAST_COVER = 0.46, 0.4
#: Least share of the span's names and figures, and of its figures alone, that lie in tiles.
LEAST_KEYS, LEAST_FIGURES = 0.55, 0.5
#: A window of a document is this many times as long as the item.
WINDOW = 1.7
#: Bits of the filter of item seeds that documents pass before the join; a power of two.
SLOTS = 1 << 22
_MASK = (1 << 61) - 1
_BASE = 1_000_003

_ODD = re.compile(f"[^{PLAIN}]")
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>")
_GROUPED = re.compile(r"(?<=\d)[,.](?=\d{3}(?!\d))")
_TOKEN = re.compile(r"[^\W_]+")


def tokens_of(text: str) -> list[str]:
    """Lower-case words and figures, without markup and in canonical characters."""
    if _ODD.search(text):
        text = canonical_form(text)[0]
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    return _TOKEN.findall(_GROUPED.sub("", text).lower())


def _names(text: str) -> set[str]:
    """Capitalised words that do not begin a sentence."""
    return {m[1].lower() for m in re.finditer(r"(?<=[^.!?\s])[\s]+([A-Z][^\W\d_]+)", canonical_form(text)[0])}


@dataclass
class Item:
    item_id: int
    tokens: list[int]
    keys: list[int]  # 2 for a figure, 1 for a name, else 0


class SeedIndex:
    """The items' tokens as numbers, and where each seed occurs."""

    def __init__(self, items: list[tuple[int, str]]):
        self.words: dict[str, int] = {}
        self.items: list[Item] = []
        self.seeds: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in items:
            words = tokens_of(text)
            names = _names(text)
            ids = [self.words.setdefault(w, len(self.words) + 1) for w in words]
            keys = [2 if any(c.isdigit() for c in w) else 1 if w in names else 0 for w in words]
            k = len(self.items)
            self.items.append(Item(item_id, ids, keys))
            for p in range(len(ids) - SEED + 1):
                self.seeds[tuple(ids[p : p + SEED])].append((k, p))

    def find(self, text: str) -> list[tuple[int, float, int]]:
        """(item id, share of the item in tiles, number of tiles) of every item found in a text."""
        return self.find_in(tokens_of(text))

    def find_in(self, tokens: list[str]) -> list[tuple[int, float, int]]:
        get = self.words.get
        doc = [get(w, 0) for w in tokens]
        seeds = self.seeds
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for j, s in enumerate(zip(*(doc[i:] for i in range(SEED)))):
            if s[0] and s in seeds:
                for k, p in seeds[s]:
                    hits[k].append((j, p))
        out = []
        for k, found in hits.items():
            item = self.items[k]
            n = len(item.tokens)
            if len(found) < LEAST_SEEDED * n - SEED:
                continue
            for start, end in _windows(found, n):
                r = _judge(item, doc[start:end])
                if r:
                    out.append((item.item_id, *r))
                    break
        return out


def _windows(hits: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """Windows of a document in which seeds cover enough of the item, the fullest first, not overlapping."""
    size = int(n * WINDOW) + 8
    at = [j for j, _ in hits]
    best = []
    counts: dict[int, int] = defaultdict(int)
    covered, left = 0, 0
    for right, (j, p) in enumerate(hits):
        for q in range(p, p + SEED):
            counts[q] += 1
            covered += counts[q] == 1
        while j - at[left] > size:
            for q in range(hits[left][1], hits[left][1] + SEED):
                counts[q] -= 1
                covered -= counts[q] == 0
            left += 1
        if covered >= LEAST_SEEDED * n:
            best.append((covered, at[left], j))
    best.sort(key=lambda b: (-b[0], b[1]))
    out: list[tuple[int, int]] = []
    for _, a, b in best:
        s, e = max(0, a - 6), b + SEED + 6
        if all(e <= x or s >= y for x, y in out):
            out.append((s, e))
    return out


def _grams(seq: list[int], marked: list[bool], s: int) -> dict[int, list[int]]:
    """Karp-Rabin hashes of all unmarked runs of length ``s``."""
    out: dict[int, list[int]] = defaultdict(list)
    top = pow(_BASE, s - 1, _MASK)
    h = run = 0
    for i, x in enumerate(seq):
        if marked[i]:
            h = run = 0
            continue
        if run >= s:
            h = (h - seq[i - s] * top) % _MASK
        h = (h * _BASE + x) % _MASK
        run += 1
        if run >= s:
            out[h].append(i - s + 1)
    return out


def greedy_string_tiling(a: list[int], b: list[int], least: int = TILE) -> list[tuple[int, int, int]]:
    """Tiles (start in a, start in b, length): longest common runs first, none overlapping, none shorter than ``least``.

    0 in ``b`` matches nothing.
    """
    in_a, in_b = [False] * len(a), [x == 0 for x in b]
    tiles: list[tuple[int, int, int]] = []
    s = max(least, min(20, len(a), len(b)))
    while True:
        index = _grams(a, in_a, s)
        found: list[tuple[int, int, int]] = []
        longest = 0
        for h, places in _grams(b, in_b, s).items():
            for j in places:
                for i in index.get(h, ()):
                    if a[i : i + s] != b[j : j + s]:
                        continue
                    n = s
                    while i + n < len(a) and j + n < len(b) and not in_a[i + n] and not in_b[j + n] and a[i + n] == b[j + n]:
                        n += 1
                    found.append((n, i, j))
                    longest = max(longest, n)
        if longest > 2 * s:  # begin again with the length of the long run
            s = longest
            continue
        for n, i, j in sorted(found, key=lambda t: (-t[0], t[1], t[2])):
            if not any(in_a[i : i + n]) and not any(in_b[j : j + n]):
                tiles.append((i, j, n))
                in_a[i : i + n] = [True] * n
                in_b[j : j + n] = [True] * n
        if s == least:
            return tiles
        s = max(least, s // 2)


def _judge(item: Item, window: list[int]) -> tuple[float, int] | None:
    n = len(item.tokens)
    tiles = greedy_string_tiling(item.tokens, window)
    if not tiles:
        return None
    covered = [False] * n
    for i, _, m in tiles:
        covered[i : i + m] = [True] * m
    total = sum(covered)
    if total < LEAST_COVER * n:
        return None
    # The longest stretch of the item whose tiles leave no long part of it out.
    places = [i for i, c in enumerate(covered) if c]
    runs, first = [], 0
    for x in range(1, len(places) + 1):
        if x == len(places) or places[x] - places[x - 1] > 12:
            runs.append((places[first], places[x - 1]))
            first = x
    kept = [(a, b) for a, b in runs if _keeps(item, covered, a, b)]
    span = sum(b - a + 1 for a, b in kept)
    got = sum(sum(covered[a : b + 1]) for a, b in kept)
    if span < LEAST_SPAN * n or got < LEAST_COVER * n:
        return None
    return got / n, len(tiles)


def _keeps(item: Item, covered: list[bool], a: int, b: int) -> bool:
    """Whether a stretch of the item keeps its names and figures."""
    keys = [i for i in range(a, b + 1) if item.keys[i]]
    figures = [i for i in keys if item.keys[i] == 2]
    in_text = sum(covered[i] for i in keys)
    return (not keys or in_text >= LEAST_KEYS * len(keys)) and (not figures or sum(covered[i] for i in figures) >= LEAST_FIGURES * len(figures))


@lru_cache(maxsize=1_000_000)
def _token_hash(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token)


def seed_hashes(tokens: list[str]) -> np.ndarray:
    """A 64-bit number for each run of ``SEED`` tokens."""
    h = np.array([_token_hash(t) for t in tokens], np.uint64)
    if len(h) < SEED:
        return np.zeros(0, np.int64)
    out = np.zeros(len(h) - SEED + 1, np.uint64)
    for i in range(SEED):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[i : len(h) - SEED + 1 + i]
    return ((out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)).view(np.int64)


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            seeds = seed_hashes(tokens_of(t))
            if n := len(seeds):
                kinds, times = np.unique(seeds, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(kinds), i)), pa.array(kinds), pa.array(times), pa.array(np.full(len(kinds), n + SEED - 1))], names=["item_id", "seed", "times", "n_tokens"]
                )


def item_keys(items: DataFrame) -> DataFrame:
    """(seed, item_id, times, need): the seeds by which documents find an item, without its most frequent ones.

    Tiles that cover ``LEAST_COVER`` of an item hold at least ``least`` of its seeds, one for every ``TILE`` tokens. An item's seeds that most items have, up to
    half of ``least``, are left out and the rest must then hold ``need`` = ``least`` less these, so that nothing is lost.
    """
    seeds = items.mapInArrow(_item_seeds, "item_id bigint, seed bigint, times bigint, n_tokens bigint")
    spread = seeds.groupBy("seed").agg(F.count(F.lit(1)).alias("n_items"))
    least = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") * LEAST_COVER / TILE)).cast("bigint")
    first = Window.partitionBy("item_id").orderBy(F.desc("n_items"), "seed")
    ranked = seeds.join(spread, "seed").select("item_id", "seed", "times", least.alias("least"), F.sum("times").over(first).alias("sum"))
    spare = F.floor(F.col("least") / 2)
    return ranked.where(F.col("sum") > spare).select("seed", "item_id", "times", (F.col("least") - spare).alias("need"))


def _document_seeds(bitmap: Broadcast):
    """Rows (doc_id, text) -> (doc_id, seed): the distinct seeds of a document whose slot some item has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = bitmap.value
        for b in batches:
            ids, seeds = [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = seed_hashes(tokens_of(t))
                s = np.unique(s[slots[s & (SLOTS - 1)]])
                if len(s):
                    ids.append(np.full(len(s), d))
                    seeds.append(s)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids), pa.int64()), pa.array(np.concatenate(seeds), pa.int64())], names=["doc_id", "seed"])

    return run


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one document after another. Counting seeds by their hashes comes before the item's own index."""

    @lru_cache(maxsize=5000)
    def item(item_id: int, text: str) -> tuple[SeedIndex, np.ndarray, np.ndarray, float]:
        tokens = tokens_of(text)
        return SeedIndex([(item_id, text)]), *np.unique(seed_hashes(tokens), return_counts=True), LEAST_SEEDED * len(tokens) - SEED

    types = (pa.int64(), pa.int64(), pa.float64(), pa.int32())
    last, tokens, seeds = None, [], np.zeros(0, np.int64)
    for b in batches:
        out = []
        for d, t, i, passage in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "item_id", "item_text"))):
            if t != last:
                last, tokens = t, tokens_of(t)
                seeds = seed_hashes(tokens)
            index, kinds, times, least = item(i, passage)
            at = np.minimum(np.searchsorted(kinds, seeds), len(kinds) - 1)
            if times[at[kinds[at] == seeds]].sum() >= least:
                out += [(d, *f) for f in index.find_in(tokens)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["doc_id", "item_id", "coverage", "n_tiles"])


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles): every document with the items it contains.

    documents: ``doc_id``, ``text``; items: ``item_id``, ``text``; other columns are ignored. Null ids and texts and items
    shorter than a seed match nothing; texts are read whole; repeated rows count once; an empty table on either side gives
    an empty result.

    One scan of the corpus joins documents and items on shared seeds, whatever the number of items; neither side comes to
    the driver. What is broadcast before the join is a bitmap of ``SLOTS`` bits over the items' seeds. Pairs that share
    enough seeds are tiled, each by itself.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    texts = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").alias("item_text")).where("item_id IS NOT NULL AND item_text IS NOT NULL").distinct()
    keys = cut(item_keys(texts), "items")
    taken = keys.select(F.col("seed").bitwiseAND(F.lit(SLOTS - 1)).cast("int").alias("slot")).distinct().toArrow()
    slots = np.zeros(SLOTS, bool)
    slots[taken.column("slot").to_numpy()] = True
    hits = docs.mapInArrow(_document_seeds(spark.sparkContext.broadcast(slots)), "doc_id bigint, seed bigint")
    shared = hits.join(keys, "seed").groupBy("doc_id", "item_id").agg(F.sum("times").alias("n"), F.min("need").alias("need"))
    pairs = cut(shared.where("n >= need").select("doc_id", "item_id"), "pairs")
    found = docs.join(pairs.join(texts, "item_id"), "doc_id").select("doc_id", "text", "item_id", "item_text").mapInArrow(_judged, "doc_id bigint, item_id bigint, coverage double, n_tiles int")
    return found.groupBy("doc_id", "item_id").agg(F.max("coverage").alias("coverage"), F.max("n_tiles").alias("n_tiles"))
