"""Near-duplicate groups by SuperMinHash signatures, banding, verification, union-find.

Each element of a set draws a permutation of the signature's places by a Fisher-Yates
shuffle of its own seed; the place that comes j-th gets the rank j plus a fraction.  A
signature keeps the least rank of each place.  So one element's ranks differ from place to
place (they are correlated), which spreads small sets over all places and gives estimates
of less variance than independent minima.  Two sets agree in a place with the probability
of their Jaccard similarity.

Step j draws the j-th place of all elements at once.  It can't lower a place whose rank is
under j, so a set is done as soon as all its ranks are: after one or two steps for sets
much larger than the signature, after as many steps as there are places for the smallest.

Bands of ``ROWS`` places are hashed to buckets.  With 44 bands of 5, sets of similarity
0.8 miss all common buckets with a probability of 3e-8; those of similarity 0.02, as
unrelated texts have, meet with 1e-7.  Candidates of a bucket are verified on whole sets,
and links are grouped, by the steps of ``ngram_join``, where equal sets are one class and
groups of copies are never expanded into pairs: each class is measured against one class
of its buckets first, and only buckets that still hold two groups are searched further.
There is no cap on a bucket.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ngram_join
from .common import mix64
from .ngram_join import Join

BANDS, ROWS = 44, 5
PLACES = BANDS * ROWS
#: Elements whose permutations are held at once.
BLOCK = 1 << 16
#: Steps without a table of each element's order.
LOOKED_UP = 8
_STEP = np.uint64(0x9E3779B97F4A7C15)
_RANK = np.uint64(56)  # the rank stands above this bit, the fraction below


def _lower(ranks: np.ndarray, owner: np.ndarray, items: np.ndarray, first: int, last: int) -> None:
    """Lower the ranks of sets ``first`` to ``last`` by some of their elements.

    After a few steps most sets are done.  Until then what stands at a place is looked up
    in the draws so far; only the elements that are left get a table of their order."""
    mine = ranks[first : last + 1]
    flat = mine.reshape(-1)
    owner = owner - first
    # Step by step: the place drawn, and what has moved there from the step's own place.
    drawn_at: list[np.ndarray] = []
    moved: list[np.ndarray] = []
    order, at = None, np.zeros(0, np.int64)

    def stands(place: np.ndarray) -> np.ndarray:
        now = place.copy()
        for k, m in zip(drawn_at, moved):
            np.copyto(now, m, where=k == place)
        return now

    going = np.arange(len(mine))
    for j in range(PLACES):
        # Only sets with a place that this rank can lower go on.
        still = mine[going].max(1) >= np.uint64(j) << _RANK
        if not still.all():
            going = going[still]
            open_ = np.zeros(len(mine), bool)
            open_[going] = True
            keep = open_[owner]
            owner, items, at = owner[keep], items[keep], at[keep] if j > LOOKED_UP else at
            if j <= LOOKED_UP:
                drawn_at, moved = [k[keep] for k in drawn_at], [m[keep] for m in moved]
        if not len(items):
            return
        if j == LOOKED_UP:
            order, at = np.tile(np.arange(PLACES, dtype=np.uint8), (len(items), 1)), np.arange(len(items))
            for k, m in zip(drawn_at, moved):
                order[at, k] = m
        drawn = mix64(items + np.uint64(j + 1) * _STEP)
        k = ((drawn & np.uint64(0xFFFFFFFF)) * np.uint64(PLACES - j) >> np.uint64(32)).astype(np.uint8) + np.uint8(j)
        if order is None:
            place = stands(k)
            moved_now = stands(np.full(len(items), j, np.uint8))
            drawn_at.append(k)
            moved.append(moved_now)
        else:
            place = order[at, k]
            order[at, k] = order[at, j]
        value = (np.uint64(j) << _RANK) | (drawn >> np.uint64(8))
        slot = owner * PLACES + place
        better = value < flat[slot]
        np.minimum.at(flat, slot[better], value[better])


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``PLACES`` ranks with fractions for each set, which must not be empty."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    ranks = np.full((len(sets), PLACES), np.uint64(2**64 - 1))
    if not len(sets):
        return ranks
    # By size, as small sets take the most steps and are few elements together.
    by = np.argsort(size, kind="stable")
    items, owner = np.concatenate([sets[k] for k in by]), np.repeat(np.arange(len(sets)), size[by])
    with np.errstate(over="ignore"):
        # A set of any size goes through in parts, as ranks are minima.
        for a in range(0, len(items), BLOCK):
            part = owner[a : a + BLOCK]
            _lower(ranks, part, items[a : a + BLOCK], int(part[0]), int(part[-1]))
    back = np.empty_like(by)
    back[by] = np.arange(len(by))
    return ranks[back]


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """The similarity of two sets by their signatures."""
    return float((a == b).mean())


def buckets_of(sets: list[np.ndarray], join: Join) -> tuple[np.ndarray, np.ndarray]:
    """(set, bucket) for all bands of the sets.  Sets so small that only an equal one can
    link have none."""
    which = np.flatnonzero([join.differ(len(s)) > 0 for s in sets])
    if not len(which):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    found = signatures([sets[k] for k in which]).reshape(len(which), BANDS, ROWS)
    bucket = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(which), BANDS))
    with np.errstate(over="ignore"):
        for row in range(ROWS):
            bucket = mix64(bucket * _STEP + found[:, :, row])
    return np.repeat(which, BANDS), bucket.reshape(-1)


def near_duplicates(documents: DataFrame, join: Join) -> DataFrame:
    """doc_id, n_shingles, component_id and ``kept`` for each row.

    ``component_id`` is the smallest doc_id of the group; the row of that id is kept.
    Null texts, empty ones and those of white space have empty sets, are alone, and stay.
    Repeated rows are one class (each of the first id is marked kept).  A null doc_id
    takes part; where it is alone, component_id is null and the row is kept.  Texts of any
    length take part whole; columns of other names are passed over; an empty table gives
    an empty result.
    """
    df = ngram_join.near_duplicates(documents, join, buckets_of).select("doc_id", "n_shingles", "component_id")
    return df.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(documents: DataFrame, join: Join = Join()) -> DataFrame:
    """The documents with one of each group, as ``ngram_join.keep_one``."""
    return ngram_join.keep_one(documents, join, buckets_of)


def oracle(join: Join) -> str:
    """The same rows in DuckDB SQL, by a self-join on shingles."""
    return f"SELECT *, doc_id IS NOT DISTINCT FROM component_id AS kept FROM ({ngram_join.oracle(join)})"
