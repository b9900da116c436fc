"""Conflict-constrained best-fit packing of token sequences into bins.

Pieces of documents fill bins of ``capacity`` tokens.  Two pieces may not share a
bin when they come from the same source or from the same duplicate cluster (a
piece of a document is in its document's cluster).  Pieces go, longest first, to the
tightest bin that conflicts with neither; bins are kept by residual, with bitmaps of
the sources and clusters inside, and the successor search goes on from residual to
residual until a compatible bin is found.

A document longer than the capacity gives full pieces, each a bin of its own, and a
remainder that is packed.  Documents are dealt to shards by a hash of their id, source,
cluster and length, so that rows of one id are not one shard; the
number of shards follows the number of rows, so a shard has a bounded number of
pieces, and only ids, names and lengths are shuffled.  Shards are packed apart.
"""

from __future__ import annotations

import math
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ngram_join, superminhash
from .common import WORD, materialize

CAPACITY = 2048
#: Documents a shard should hold: they bound the memory of a task.
SHARD_DOCUMENTS = 20_000

PACKED = "bin_id string, doc_id long, piece int, start long, n_tokens long, source string, cluster string, residual long"


class Bins:
    """Open bins by residual.  ``place`` finds the compatible bin of least residual
    that has room, or opens one."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.residual: list[int] = []
        self._occupied = 0  # bit r: some bin has residual r
        self._levels: dict[int, dict[int, dict[int, list[int]]]] = {}  # residual, sources, clusters: bins
        self._size: dict[int, int] = defaultdict(int)
        self._with: dict[int, dict[int, int]] = {}  # residual, source: bins with it
        self._blocked: dict[int, int] = defaultdict(int)  # source: bit r if every bin of residual r has it

    def _mark(self, level: int) -> None:
        """Refresh the blocked bits of a level after it has lost or gained a bin."""
        n, bit = self._size[level], 1 << level
        for source, count in self._with[level].items():
            if n and count == n:
                self._blocked[source] |= bit
            else:
                self._blocked[source] &= ~bit

    def _names(self, mask: int):
        while mask:
            low = mask & -mask
            yield low.bit_length() - 1
            mask ^= low

    def _insert(self, b: int) -> None:
        r = self.residual[b]
        self._levels.setdefault(r, {}).setdefault(self.sources[b], {}).setdefault(self.clusters[b], []).append(b)
        counts = self._with.setdefault(r, defaultdict(int))
        for s in self._names(self.sources[b]):
            counts[s] += 1
        self._size[r] += 1
        self._occupied |= 1 << r
        self._mark(r)

    def _remove(self, b: int) -> None:
        r = self.residual[b]
        level = self._levels[r]
        group = level[self.sources[b]]
        group[self.clusters[b]].remove(b)
        if not group[self.clusters[b]]:
            del group[self.clusters[b]]
        if not group:
            del level[self.sources[b]]
        for s in self._names(self.sources[b]):
            self._with[r][s] -= 1
        self._size[r] -= 1
        if not self._size[r]:
            self._occupied &= ~(1 << r)
        self._mark(r)

    def find(self, length: int, source: int, cluster: int) -> int:
        """The tightest compatible bin, or -1.  ``cluster`` is a bitmap (0: none)."""
        r = length
        while True:
            # Successor: the next residual with a bin that lacks the source.
            open_ = (self._occupied & ~self._blocked[source]) >> r
            if not open_:
                return -1
            r += (open_ & -open_).bit_length() - 1
            for mask, group in self._levels[r].items():
                if not mask >> source & 1:
                    for inside, bins in group.items():
                        if not inside & cluster:
                            return bins[0]
            r += 1

    def place(self, length: int, source: int, cluster: int) -> int:
        b = self.find(length, source, cluster)
        if b < 0:
            b = len(self.residual)
            self.residual.append(self.capacity)
            self.sources.append(0)
            self.clusters.append(0)
        else:
            self._remove(b)
        self.residual[b] -= length
        self.sources[b] |= 1 << source
        self.clusters[b] |= cluster
        if self.residual[b]:
            self._insert(b)
        return b


def pack(pieces: list[tuple[int, str, str]], capacity: int) -> list[int]:
    """Bin numbers of (length, source, cluster) pieces, taken in the order given."""
    names: dict[str, int] = {}
    seen: dict[str, int] = defaultdict(int)
    for _, _, cluster in pieces:
        seen[cluster] += 1
    bits: dict[str, int] = {}
    bins = Bins(capacity)
    out = []
    for length, source, cluster in pieces:
        s = names.setdefault(source, len(names))
        # Only a cluster that can meet itself needs a bit.
        bit = 1 << bits.setdefault(cluster, len(bits)) if seen[cluster] > 1 else 0
        out.append(bins.place(length, s, bit))
    return out


def _order(df: pd.DataFrame) -> pd.DataFrame:
    return df.sort_values(["n_tokens", "doc_id", "piece", "source", "cluster"], ascending=[False, True, True, True, True], kind="stable")


def _pack_shard(capacity: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for doc, source, cluster, total in zip(pdf["doc_id"], pdf["source"], pdf["cluster"], pdf["n_tokens"]):
            for piece in range(max(1, math.ceil(total / capacity))):
                start = piece * capacity
                rows.append((doc, piece, start, min(capacity, total - start), source, cluster))
        pieces = _order(pd.DataFrame(rows, columns=["doc_id", "piece", "start", "n_tokens", "source", "cluster"]))
        bins = pack(list(zip(pieces["n_tokens"], pieces["source"], pieces["cluster"])), capacity)
        pieces["bin"] = bins
        used = pieces.groupby("bin")["n_tokens"].sum()
        pieces["residual"] = capacity - pieces["bin"].map(used)
        pieces["bin_id"] = [f"{key[0]}-{b}" for b in bins]
        return pieces[["bin_id", "doc_id", "piece", "start", "n_tokens", "source", "cluster", "residual"]]

    return run


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def folded(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\p{Punct}\s]+", " ")


def text_cluster(text: Column) -> Column:
    """Cluster of texts that are equal but for case, punctuation and white space."""
    return F.md5(folded(text))


NEAR = ngram_join.Join(n=5, num=80, den=100, punctuation=True)


def near_clusters(documents: DataFrame, join: ngram_join.Join = NEAR) -> DataFrame:
    """doc_id, source, n_tokens and ``cluster`` of each document: the group of near
    copies that it is in, whatever its case and punctuation.  Candidates are those of
    SuperMinHash bands, links are counted on whole sets.  Texts without words are one
    cluster.  Words are counted in the pass that makes the sets (lower case has the same)."""
    text = F.lower(F.coalesce(F.col("text"), F.lit("")))
    slim = documents.select("doc_id", F.col("source").cast("string").alias("source"), text.alias("text"))
    profile, groups = ngram_join.class_groups(slim, join, superminhash.buckets_of, carry="source")
    profile = profile.select("doc_id", "source", F.col("n_words").alias("n_tokens"), "cls")
    # Texts without words have no class: they stay out of the join, where they were one key.
    known = profile.where("cls is not null").join(groups.withColumnRenamed("node", "cls"), "cls", "left")
    rows = known.select("doc_id", "source", "n_tokens", F.hex(F.coalesce("component", "cls")).alias("cluster"))
    rows = rows.union(profile.where("cls is null").select("doc_id", "source", "n_tokens", F.lit("no words")))
    return materialize(rows, "packing-clusters")


def best_fit(documents: DataFrame, capacity: int = CAPACITY, cluster: Column | None = None, tokens: Column | None = None) -> DataFrame:
    """Pack documents (doc_id, text, source); columns as ``PACKED``.

    ``residual`` is what the finished bin has left.  Null texts count as empty: a
    piece of length 0 shares a bin like any other.  A null source or cluster is one
    of its own kind (the empty name); repeated rows are packed apart, as equal texts
    conflict; ties go by doc_id, null first, then source and cluster.  A text of any
    length gives as many pieces as it needs.  An empty table gives an empty result.
    """
    df = documents.select(
        "doc_id",
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.coalesce(text_cluster(F.col("text")) if cluster is None else cluster, F.lit("")).alias("cluster"),
        (word_count(F.col("text")) if tokens is None else tokens).alias("n_tokens"),
    )
    rows = documents.select("doc_id").count()
    shards = max(1, -(-rows // SHARD_DOCUMENTS))
    shard = F.pmod(F.xxhash64("doc_id", "source", "cluster", "n_tokens", F.lit(17)), F.lit(shards)).cast("int")
    return df.withColumn("shard", shard).groupBy("shard").applyInPandas(_pack_shard(capacity), PACKED)
