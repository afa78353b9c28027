"""Packing of documents into sequences of fixed capacity: first-fit decreasing in randomised groups.

Token counts are taken where the documents are read; only (doc_id, length) is exchanged. Pieces of documents go to groups of
about ``GROUP`` by a hash of their ids, and each group is packed on its own with a tournament tree over the free room of its
sequences, which finds the first sequence with enough room in logarithmic time.
"""

from __future__ import annotations

import importlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.session import cut

CAPACITY, GROUP = 2048, 20_000


def default_ranks() -> str:
    """The path of a public byte-level BPE vocabulary, from the installed vocabulary package."""
    return importlib.import_module("public_tokenizers").path("byte_bpe_50k.tiktoken")


#: The public pre-tokenisation pattern of byte-level BPE vocabularies of this kind.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class TokenCounter:
    """Exact token counts of a byte-level BPE vocabulary."""

    def __init__(self, ranks_path: str):
        import base64

        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})

    def count(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))


def token_lengths(documents: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of every document; null and empty texts have 0 tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(ranks_path or default_ranks())  # the path is the executor's own
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([counter.count(t) if t else 0 for t in b.column(1).to_pylist()], pa.int64())], names=["doc_id", "n_tokens"]
            )

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_tokens bigint")


class TournamentTree:
    """Free room of sequences: the first one with room for an item, in O(log n)."""

    def __init__(self, leaves: int, capacity: int):
        self.size = 1 << max(0, (max(1, leaves) - 1).bit_length())
        self.room = [capacity] * (2 * self.size)

    def place(self, length: int) -> int:
        """The number of the first sequence with room for ``length``, whose room is reduced."""
        room, i = self.room, 1
        while i < self.size:
            i *= 2
            if room[i] < length:
                i += 1
        room[i] -= length
        leaf = i - self.size
        while i > 1:
            i //= 2
            a, b = room[2 * i], room[2 * i + 1]
            room[i] = a if a >= b else b
        return leaf


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[int]:
    """The sequence of each item (none longer than ``capacity``); items of length 0 go to the first."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    tree = TournamentTree(len(lengths), capacity)
    out = [0] * len(lengths)
    for i in order:
        out[i] = tree.place(lengths[i])
    return out


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, group: int = GROUP, ranks_path: str | None = None) -> DataFrame:
    """(doc_id, piece, token_start, n_tokens, sequence): the sequence of every piece of every document.

    Only documents longer than ``capacity`` have more than one piece: full pieces fill a sequence each, the rest is packed
    like any document. Sequence numbers are unique over all groups. Null and empty texts get a sequence and no room. A
    document id that is repeated is packed as often as it is there; an empty table gives an empty result.
    """
    lengths = cut(token_lengths(documents, ranks_path), "lengths")
    full = F.greatest(F.lit(0), F.ceil(F.col("n_tokens") / capacity) - 1)
    n_pieces = lengths.agg(F.sum(full + 1)).first()[0] or 0
    groups = max(1, math.ceil(int(n_pieces) / group))
    pieces = lengths.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), full.cast("int"))).alias("piece")).select(
        "doc_id", "piece", (F.col("piece").cast("bigint") * capacity).alias("token_start"),
        F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece") * capacity).cast("bigint").alias("n_tokens"),
        F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).alias("g"),
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        for b in batches:
            for d, p, s, n, g in zip(*(c.to_pylist() for c in b.columns)):
                if g != group:
                    if rows:
                        yield packed(group, rows)
                    group, rows = g, []
                rows.append((n, d, p, s))
        if rows:
            yield packed(group, rows)

    def packed(g: int, rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda r: (-r[0], r[1], r[2]))
        # Sequence k of group g of G gets the number k * G + g: unique without a count of other groups' sequences.
        seq = [k * groups + g for k in first_fit_decreasing([r[0] for r in rows], capacity)]
        n, d, p, s = zip(*rows)
        arrays = [pa.array(d, pa.int64()), pa.array(p, pa.int32()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(seq, pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "token_start", "n_tokens", "sequence"])

    # A task takes its groups one after another and holds one at a time, however many there are.
    placed = pieces.repartition("g").sortWithinPartitions("g")
    return placed.mapInArrow(pack, "doc_id bigint, piece int, token_start bigint, n_tokens bigint, sequence bigint")
