"""N-gram Jaccard self-join in metric space, and the groups that its links form.

A document's set holds its distinct ``n``-word shingles.  Jaccard distance is a metric,
but unrelated texts share no shingle: all are at distance 1 from any pivot document, so
pivots among all documents make no regions.  The space is therefore first seen through
projections in which distances do not pile up.

Projections.  Shingles are dealt by their hash to K parts; |x - y| + |y - x| is a metric
on the subsets of every part too.  Linked sets of which the smaller has a elements differ
in H = floor(a (1-t)/t) elements at most, hence in H parts at most: with K > H parts they
coincide in one, at distance 0.  A set is replicated to the region of each of its parts.
K depends on the smaller size only, in levels half as large again each; a set goes to
the levels of all sizes that a smaller partner can have.  Empty parts say nothing: K has
spare parts for them, and sets that have more empty parts than that are dealt again by
other hashes (``_emit``), so no linked pair is without a common region.  Texts that only
share a passage or a few shingles hardly ever coincide in a part.

Pivots.  The first set of a region is its pivot.  Each set is measured against one pivot
first; links make components.  Only regions that still hold sets of two components are
joined within: pivots among the region's sets create Voronoi cells of the Hamming metric
on parity sketches, which never exceeds the symmetric difference; triangle-inequality
windows replicate sets near a border to the neighbouring cells, and cells are split again
until they are small (``voronoi_join``).  The nearest candidates of another component are
measured first, and at last every candidate that the sketches allow.  What is measured is
counted on whole sets.  None of these steps can lose a link between two components, so
components are exact, and no group of copies is expanded into its pairs.

Equal sets are one class from the start (128-bit digests of the whole sorted sets).
Shingles are 64-bit hashes of word hashes; a wrong count needs a collision between two
shingles of one pair of documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PUNCTUATION, WHITE, Words, materialize, mix64, row_slices, text_buffers, word_counts
from .components import components

SLICE_BYTES = 1 << 20
#: Ids of texts to fetch that may be broadcast; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Rows of a region that one task joins; larger ones are joined block by block.
REGION_ROWS = 50_000
#: Nearest candidates that are measured in each round; at last all of them.
ROUNDS = (2, None)
#: Hashes by which sets with many empty parts are dealt.
DEALS = 8
PIVOTS, SMALL = 8, 1 << 16
_LOWEST = -(2**63)
_SMALLEST_REST = 1 << 20


@dataclass(frozen=True)
class Join:
    """``n`` words a shingle; sets link when ``den`` * intersection >= ``num`` * union.
    Words end at white space, with ``punctuation`` at all ASCII but letters and digits."""

    n: int = 5
    num: int = 80
    den: int = 100
    punctuation: bool = False

    def differ(self, size):
        """Most elements in which a set of ``size`` and a linked one, not smaller, differ."""
        return (self.den - self.num) * size // self.num

    def apart(self, both):
        """Largest symmetric difference of linked sets with ``both`` elements together:
        the intersection has t/(1+t) of these at least."""
        return both - 2 * -(-self.num * both // (self.num + self.den))


def shingle_sets(words: Words, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row of ``words``."""
    h = words.hash
    bounds = words.bounds()
    with np.errstate(over="ignore"):
        whole = np.zeros(max(len(h) - n + 1, 0), np.uint64)
        for k in range(n):
            whole = mix64(whole + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(whole)]
        whole = mix64(whole)
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= n:
            s = np.sort(whole[a : b - n + 1])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif b > a:
            # A short text's whole sequence; its length keeps it apart from others.
            with np.errstate(over="ignore"):
                v = np.uint64(b - a)
                for x in h[a:b]:
                    v = mix64(np.array([v], np.uint64))[0] * np.uint64(0xC2B2AE3D27D4EB4F) + x
            yield np.array([v], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def _sets(batches: Iterator[pa.RecordBatch], join: Join):
    breaks = PUNCTUATION if join.punctuation else WHITE
    for batch in batches:
        data, offsets = text_buffers(batch.column("text"))
        for a, b in row_slices(offsets, SLICE_BYTES):
            words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], breaks)
            yield batch.slice(a, b - a), list(shingle_sets(words, join.n))


class Levels:
    """Levels of H, the parts of each, and how many of these may be empty."""

    def __init__(self, join: Join, most: int):
        self.h = [1]
        while self.h[-1] < most:
            self.h.append(max(self.h[-1] + 1, self.h[-1] * 3 // 2))
        self.spare = []
        for k, h in enumerate(self.h):
            least = self.h[k - 1] + 1 if k else 1
            size = max(1, -(-least * join.num // (join.den - join.num)))
            spare = 0
            for _ in range(8):
                parts = h + 1 + spare
                empty = parts * (1 - 1 / parts) ** size
                spare = max(spare, int(empty + empty**0.5))
            self.spare.append(spare)
        self.h, self.spare = np.array(self.h), np.array(self.spare)
        self.parts = self.h + 1 + self.spare


def _emit(flat, start, size, which, level, levels: Levels, deal: int, out: list) -> None:
    """Append (set, key) of the parts of the sets ``which`` on their ``level``."""
    if not len(which):
        return
    if deal == DEALS:
        # One region a level for sets that no hash has dealt well.
        with np.errstate(over="ignore"):
            out.append((which, mix64(level.astype(np.uint64) + np.uint64(_SMALLEST_REST))))
        return
    n, parts = size[which], levels.parts[level]
    owner = np.repeat(np.arange(len(which)), n)
    values = flat[np.repeat(start[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    with np.errstate(over="ignore"):
        if deal:
            values = mix64(values + np.uint64(deal) * np.uint64(0x9E3779B97F4A7C15))
        part = (values >> np.uint64(32)) * parts[owner].astype(np.uint64) >> np.uint64(32)
        first = np.cumsum(parts) - parts
        at = first[owner] + part.astype(np.int64)
        total = np.zeros(int(parts.sum()), np.uint64)
        np.add.at(total, at, values)
        count = np.bincount(at, minlength=len(total))
        full = np.flatnonzero(count)
        mine = np.repeat(np.arange(len(which)), parts)[full]
        place = mix64((level[mine].astype(np.uint64) << np.uint64(40)) + (np.uint64(deal) << np.uint64(36)) + (full - first[mine]).astype(np.uint64))
        out.append((which[mine], mix64(total[full] + place) + count[full].astype(np.uint64)))
    empty = parts - np.bincount(mine, minlength=len(which))
    again = empty > levels.spare[level]
    _emit(flat, start, size, which[again], level[again], levels, deal + 1, out)


def regions_of(sets: list[np.ndarray], join: Join) -> tuple[np.ndarray, np.ndarray]:
    """(set, region) for all projections of the sets.  Sets so small that only an equal
    one can link have none."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    high = join.differ(size)
    if not len(size) or not high.max():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = join.differ(-(-join.num * size // join.den))
    levels = Levels(join, int(high.max()))
    first, last = np.searchsorted(levels.h, np.maximum(low, 1)), np.searchsorted(levels.h, high)
    flat, start = np.concatenate(sets), np.cumsum(size) - size
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for step in range(int((last - first).max()) + 1):
        which = np.flatnonzero((high > 0) & (first + step <= last))
        _emit(flat, start, size, which, first[which] + step, levels, 0, out)
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


# -------------------------------------------------------------------- sketches

#: Longs of the short parity sketch, the metric within regions.
SHORT = 8
_SHORT = [f"f{k}" for k in range(SHORT)]


def parity(s: np.ndarray) -> bytes:
    """Bit k: whether an odd number of elements hash to k.  The number of bits is the
    power of two from 2|s| on, so that a longer sketch folds onto a shorter one."""
    bits = max(64, 1 << int(2 * len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def short_parity(s: np.ndarray) -> np.ndarray:
    odd = np.bincount((s & np.uint64(64 * SHORT - 1)).astype(np.int64), minlength=64 * SHORT).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def hamming(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _class(s: np.ndarray) -> bytes:
    return hashlib.md5(s.tobytes()).digest()


_PROFILE = "doc_id long, key long, n_shingles long, cls binary, sketch binary, " + ", ".join(f"{f} long" for f in _SHORT) + ", hi long, lo long, regions array<long>"
_SEEN = 2_000_000

#: Sets and the join, to (set, region) pairs; linked sets must have a region in common.
Regions = Callable[[list[np.ndarray], Join], tuple[np.ndarray, np.ndarray]]


def profiles(documents: DataFrame, join: Join, regions: Regions = regions_of, carry: str | None = None) -> DataFrame:
    """Per document its set's size and class (null if empty), and for the first one of
    a class in each partition its parity sketches, and its regions if a set that differs
    can link.  Texts are cut into words once for all of these.

    ``carry`` names a text column that comes along; ``n_words``, the white-space words
    of each text, then comes too, so that nobody has to read the texts again for it."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch, sets in _sets(batches, join):
            cls, sketches, first = [], [], []
            short = np.zeros((len(sets), SHORT), np.int64)
            halves = np.zeros((len(sets), 2), np.int64)
            for at, s in enumerate(sets):
                c = _class(s) if len(s) else None
                cls.append(c)
                if c is None or c in seen:
                    sketches.append(None)
                    continue
                seen.add(c)
                sketches.append(parity(s))
                short[at] = short_parity(s)
                if join.differ(len(s)):
                    halves[at] = np.frombuffer(c, ">i8")
                    first.append(at)
            if len(seen) > _SEEN:
                seen.clear()
            which, region = regions([sets[at] for at in first], join)
            owner = np.array(first, np.int64)[which]
            order = np.argsort(owner, kind="stable")
            ends = np.searchsorted(owner[order], np.arange(len(sets) + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(region[order].view(np.int64)))
            along = [] if carry is None else [batch.column(carry), pa.array(word_counts(*text_buffers(batch.column("text"))))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("key"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(cls, pa.binary()),
                    pa.array(sketches, pa.binary()),
                    *[pa.array(np.ascontiguousarray(short[:, k])) for k in range(SHORT)],
                    *[pa.array(np.ascontiguousarray(halves[:, k])) for k in (0, 1)],
                    lists,
                    *along,
                ],
                ["doc_id", "key", "n_shingles", "cls", "sketch", *_SHORT, "hi", "lo", "regions", *names],
            )

    names = [] if carry is None else [carry, "n_words"]
    kinds = "" if carry is None else f", {carry} string, n_words long"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text", *names[:1]).mapInArrow(profile, _PROFILE + kinds)


# --------------------------------------------------------------------- regions


def _binary(hi: np.ndarray, lo: np.ndarray) -> pa.Array:
    both = np.stack([hi, lo], 1).astype(">i8")
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(hi), [None, pa.py_buffer(both.tobytes())]).cast(pa.binary())


def members(profile: DataFrame) -> DataFrame:
    """(s, cls, pivot): the sets of all regions that have two of them or more, with the
    region's pivot, which is its first set.

    A region's rows arrive in order, and nothing is kept of it but one row."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last row so far with its region's pivot, and whether others were there.
        tail, company = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(c).to_numpy() for c in ("s", "hi", "lo")])
            if tail is not None:
                rows = np.concatenate([tail[:3, None], rows], 1)
            new = np.ones(rows.shape[1], bool)
            new[1:] = (rows[:, 1:] != rows[:, :-1]).any(0)  # a class that several partitions have
            rows = rows[:, new]
            opens = np.ones(rows.shape[1], bool)
            opens[1:] = rows[0, 1:] != rows[0, :-1]
            region = np.cumsum(opens) - 1
            pivot = rows[1:, np.flatnonzero(opens)]
            if tail is not None:
                pivot[:, 0] = tail[3:]
            shared = np.bincount(region) > 1
            shared[0] |= company
            keep = shared[region]
            keep[-1] = False
            if keep.any():
                at = region[keep]
                yield pa.RecordBatch.from_arrays([pa.array(rows[0, keep]), _binary(rows[1, keep], rows[2, keep]), _binary(pivot[0, at], pivot[1, at])], ["s", "cls", "pivot"])
            tail, company = np.concatenate([rows[:, -1], pivot[:, -1]]), bool(shared[-1])
        if tail is not None and company:
            yield pa.RecordBatch.from_arrays([pa.array(tail[:1]), _binary(tail[1:2], tail[2:3]), _binary(tail[3:4], tail[4:])], ["s", "cls", "pivot"])

    rows = profile.select(F.explode("regions").alias("s"), "hi", "lo")
    return rows.repartition("s").sortWithinPartitions("s", "hi", "lo").mapInArrow(stream, "s long, cls binary, pivot binary")


def voronoi_join(n: np.ndarray, sketch: np.ndarray, group: np.ndarray, join: Join, nearest: int | None = None, side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places of sets in different groups that sizes and sketches allow; for
    each set outside the largest group the ``nearest`` ones only, if given.  ``side``
    tells which sets (1) are joined with which (2) where that is settled.

    Pivots create Voronoi cells; a cell's windows hold all sets that can be within reach
    of one of its own by the triangle inequality; cells are split until they are small,
    or until splitting no longer helps.
    """
    reach = int(join.apart(2 * int(n.max())))

    def distances(x, y):
        total = np.zeros((len(x), len(y)), np.int64)
        for k in range(sketch.shape[1]):
            total += np.bitwise_count(sketch[x, k][:, None] ^ sketch[y, k][None])
        return total

    def compare(own, window):
        step = max(1, SMALL * 8 // len(window))
        for at in range(0, len(own), step):
            x = own[at : at + step]
            d = distances(x, window)
            ok = (d <= join.apart(n[x][:, None] + n[window][None])) & (group[x][:, None] != group[window][None])
            if nearest and nearest < len(window):
                d = np.where(ok, d, 1 << 30)
                best = np.argpartition(d, nearest - 1, axis=1)[:, :nearest]
                i, k = np.nonzero(np.take_along_axis(ok, best, 1))
                yield x[i], window[best[i, k]]
            else:
                i, j = np.nonzero(ok)
                yield x[i], window[j]

    def split(own, window):
        if len(own) * len(window) <= SMALL:
            yield from compare(own, window)
            return
        pivots = window[np.unique(np.linspace(0, len(window) - 1, PIVOTS).astype(int))]
        near, far = distances(own, pivots), distances(window, pivots)
        cell, least = near.argmin(1), far.min(1)
        for p in np.unique(cell):
            mine = own[cell == p]
            d = near[cell == p, p]
            inside = (far[:, p] <= least + 2 * reach) & (far[:, p] <= d.max() + reach) & (far[:, p] >= d.min() - reach)
            others = window[inside]
            yield from (split if len(mine) * len(others) < 0.5 * len(own) * len(window) else compare)(mine, others)

    if side is None:
        own, window = np.flatnonzero(group != np.bincount(group).argmax()), np.arange(len(n))
    else:
        own, window = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
    if len(own) and len(window):
        yield from split(own, window)


def candidates(found: DataFrame, reps: DataFrame, groups: DataFrame | None, join: Join, nearest: int | None) -> DataFrame:
    """Pairs (a, b) of classes in different components that a region holds both of and
    that sizes and short sketches allow."""
    own = found.select("s", "cls").join(groups.withColumnRenamed("node", "cls"), "cls", "left").select("s", "cls", F.coalesce("component", "cls").alias("component"))
    own = materialize(own, "join-own")
    mixed = own.groupBy("s").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.count("*").alias("rows")).where("c1 <> c2").select("s", "rows")
    mixed = materialize(mixed, "join-mixed")
    large = mixed.where(F.col("rows") > REGION_ROWS)
    if large.isEmpty():
        own = own.join(mixed, "s").withColumns({"main": F.lit(None).cast("binary"), "rest": F.col("rows")})
    else:
        groups_of = own.join(large, "s").groupBy("s", "component").agg(F.count("*").alias("n")).groupBy("s").agg(F.max(F.struct("n", "component")).alias("main"))
        groups_of = groups_of.select("s", F.col("main.component").alias("main"), F.col("main.n").alias("n"))
        own = own.join(mixed.join(groups_of, "s", "left").select("s", "rows", "main", (F.col("rows") - F.coalesce("n", F.lit(0))).alias("rest")), "s")
    blocks = lambda rows: F.ceil(F.col(rows) / REGION_ROWS).cast("int")
    own = own.withColumns({"blocks": blocks("rows"), "others": blocks("rest")}).join(reps.select("cls", F.col("n_shingles").alias("n"), *_SHORT), "cls")
    # A large region has a cell for each block of the sets outside its largest group with
    # each block of all sets.  Sets of the largest group need no partner among themselves.
    deal = lambda k: F.pmod(F.xxhash64("cls"), F.col(k)).cast("int")
    cell = lambda x, y, side: F.struct(x.alias("x"), y.alias("y"), F.lit(side).alias("side"))
    every = lambda k: F.sequence(F.lit(0), F.col(k) - 1)
    second = F.transform(every("others"), lambda x: cell(x, deal("blocks"), 2))
    first = F.transform(every("blocks"), lambda y: cell(deal("others"), y, 1))
    cells = F.when(F.col("blocks") == 1, F.array(cell(F.lit(0), F.lit(0), 0))).when(F.col("component") == F.col("main"), second).otherwise(F.concat(first, second))
    own = own.withColumn("cell", F.explode(cells)).select("s", "cell.*", "cls", "component", "n", *_SHORT)

    def join_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def joined(table: pa.Table):
            if not table.num_rows:
                return
            place = np.stack([table["s"].to_numpy(), table["x"].to_numpy().astype(np.int64), table["y"].to_numpy().astype(np.int64)])
            edges = np.flatnonzero(np.concatenate([[True], (place[:, 1:] != place[:, :-1]).any(0), [True]]))
            n, side = table["n"].to_numpy(), table["side"].to_numpy()
            # Bits are counted without a sign.
            sketch = np.stack([table[f].to_numpy() for f in _SHORT], 1).view(np.uint64)
            group = table["component"].combine_chunks().dictionary_encode().indices.to_numpy()
            cls = table["cls"].combine_chunks()
            left, right = [], []
            # Regions of two sets, the most of them, at once.
            two = edges[:-1][(np.diff(edges) == 2) & (side[edges[:-1]] == 0)]
            apart = np.bitwise_count(sketch[two] ^ sketch[two + 1]).sum(1) <= join.apart(n[two] + n[two + 1])
            two = two[apart & (group[two] != group[two + 1])]
            left.append(two)
            right.append(two + 1)
            for a, b in zip(edges[:-1], edges[1:]):
                if b - a > 2 or side[a]:
                    _, dense = np.unique(group[a:b], return_inverse=True)
                    for i, j in voronoi_join(n[a:b], sketch[a:b], dense, join, nearest, side[a:b] if side[a] else None):
                        left.append(i + a)
                        right.append(j + a)
                        if sum(map(len, left)) > 200_000:
                            yield left, right
                            left, right = [], []
            yield left, right

        def out(table):
            for left, right in joined(table):
                x, y = np.concatenate(left), np.concatenate(right)
                if len(x):
                    cls = table["cls"].combine_chunks()
                    yield pa.RecordBatch.from_arrays([cls.take(pa.array(x)), cls.take(pa.array(y))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(h.num_rows for h in held) < 20_000:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            place = np.stack([table[c].to_numpy().astype(np.int64) for c in ("s", "x", "y")])
            other = (place != place[:, -1:]).any(0)
            last = len(other) - int(np.argmax(other[::-1])) if other.any() else 0
            yield from out(table.slice(0, last))
            held = table.slice(last).combine_chunks().to_batches()
        if held:
            yield from out(pa.Table.from_batches(held))

    met = own.repartition("s", "x", "y").sortWithinPartitions("s", "x", "y").mapInArrow(join_cells, "a binary, b binary")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


# -------------------------------------------------------------------- distances


def sketched(pairs: DataFrame, reps: DataFrame, join: Join) -> DataFrame:
    """Pairs (a, b) whose long parity sketches do not rule them out."""
    left = reps.select(F.col("cls").alias("a"), F.col("n_shingles").alias("n1"), F.col("sketch").alias("s1"))
    right = reps.select(F.col("cls").alias("b"), F.col("n_shingles").alias("n2"), F.col("sketch").alias("s2"))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = join.apart(batch.column("n1").to_numpy() + batch.column("n2").to_numpy())
            ok = [hamming(x.as_buffer(), y.as_buffer()) <= m for x, y, m in zip(batch.column("s1"), batch.column("s2"), most)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "n1", "n2", "s1", "s2").mapInArrow(test, "a binary, b binary")


def fetch_sets(documents: DataFrame, reps: DataFrame, wanted: DataFrame, join: Join) -> DataFrame:
    """(cls, items) for the classes ``wanted``: whole sets, from one text of each."""
    one = materialize(reps.join(wanted, "cls").select("cls", "id", "key"), "join-wanted")
    texts = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("id"), "text")
    if one.count() <= BROADCAST_ROWS:
        # Few rows have one of the ids; only their texts are hashed.
        texts = texts.join(F.broadcast(one.select("id").distinct()), "id", "left_semi")
        one = F.broadcast(one)
    texts = texts.select("id", F.xxhash64("text").alias("key"), "text").join(one, ["id", "key"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(batches, join):
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array([s.tobytes() for s in sets], pa.binary())], ["cls", "items"])

    # Repeated rows of one id and text would give a class twice.
    one_text = texts.select("cls", "text").dropDuplicates(["cls"])
    return materialize(one_text.mapInArrow(whole, "cls binary, items binary"), "join-sets")


def measured(pairs: DataFrame, documents: DataFrame, reps: DataFrame, join: Join) -> DataFrame:
    """(a, b, linked) by intersection and union of whole sets."""
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
    sets = fetch_sets(documents, reps, wanted, join)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                same = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                linked.append(join.den * same >= join.num * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    left = sets.select(F.col("cls").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("cls").alias("b"), F.col("items").alias("y"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(count, "a binary, b binary, linked boolean")


def _grouped(links: DataFrame, groups: DataFrame | None) -> DataFrame:
    """Components (node, component) of ``links`` on top of those that are known."""
    if groups is None:
        return materialize(components(links), "join-groups")
    of = lambda side: groups.select(F.col("node").alias(side), F.col("component").alias("_" + side))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    between = between.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    merged = materialize(components(between), "join-merged")
    moved = merged.select(F.col("node").alias("component"), F.col("component").alias("to"))
    kept = groups.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    # A single set that has come to a component, or that others have come to.
    return materialize(kept.union(merged.join(groups.select("node"), "node", "left_anti")), "join-groups")


def class_groups(documents: DataFrame, join: Join = Join(), regions: Regions = regions_of, carry: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Profiles of all documents (doc_id, key, n_shingles, cls; with ``carry`` that text
    column and n_words), and the components (node, component) of the classes that have
    links within ``regions``."""
    along = [] if carry is None else [carry, "n_words"]
    documents = documents.select("doc_id", "text", *along[:1])
    profile = materialize(profiles(documents, join, regions, carry), "join-profiles")
    found = materialize(members(profile), "join-members")
    known = found.select("cls").distinct()
    reps = profile.where("sketch is not null").join(known, "cls").select("cls", "n_shingles", "sketch", *_SHORT, F.coalesce("doc_id", F.lit(_LOWEST)).alias("id"), "key")
    reps = materialize(reps.dropDuplicates(["cls"]), "join-classes")

    # Every set against one pivot of its regions.
    pairs = found.groupBy("cls").agg(F.min("pivot").alias("pivot")).where("cls <> pivot").select(F.least("cls", "pivot").alias("a"), F.greatest("cls", "pivot").alias("b")).distinct()
    groups, before = None, None
    for nearest in (0, *ROUNDS):
        if nearest != 0:
            pairs = candidates(found, reps, groups, join, nearest).join(before, ["a", "b"], "left_anti")
        tested = materialize(sketched(pairs, reps, join), "join-pairs")
        if nearest != 0 and tested.isEmpty():
            continue
        distances = materialize(measured(tested, documents, reps, join), "join-distances")
        groups = _grouped(distances.where("linked").select("a", "b"), groups)
        before = distances.select("a", "b") if before is None else before.union(distances.select("a", "b"))
    return profile.select("doc_id", "key", "n_shingles", "cls", *along), groups


def near_duplicates(documents: DataFrame, join: Join = Join(), regions: Regions = regions_of) -> DataFrame:
    """doc_id, n_shingles, class (of equal sets), group, component_id for each row.

    ``component_id`` is the smallest doc_id of the group.  Null texts, empty ones and
    those of white space have empty sets and are alone: class and group are null and
    component_id is the row's own id.  Repeated rows are in one class.  A null doc_id
    takes part; its component_id is the smallest id there is, null if there is none.
    Texts of any length take part whole.  An empty table gives an empty result.
    """
    profile, groups = class_groups(documents, join, regions)
    # Ids are summed up by class before classes meet their group, so no key is hot
    # but a class in the last join, whose rows come straight from a table.
    least = profile.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least"))
    least = materialize(least.join(groups.withColumnRenamed("node", "cls"), "cls", "left").select("cls", F.coalesce("component", "cls").alias("group"), "least"), "join-least")
    ids = least.groupBy("group").agg(F.min("least").alias("component_id"))
    ids = materialize(least.select("cls", "group").join(ids, "group"), "join-ids")
    df = profile.join(ids, "cls", "left")
    own = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return df.select("doc_id", "n_shingles", F.hex("cls").alias("class"), F.hex("group").alias("group"), own.alias("component_id"))


def keep_one(documents: DataFrame, join: Join = Join(), regions: Regions = regions_of) -> DataFrame:
    """The documents, columns as given, with one of each group: the smallest doc_id
    (null last), then by a hash of the text.  Rows without words (null, empty, white
    space) all stay.  Of repeated rows of one id and text one stays.  An empty table
    stays empty; columns of any name may come along."""
    profile, groups = class_groups(documents, join, regions)
    last = F.coalesce("doc_id", F.lit(2**63 - 1)).alias("_id")
    rows = profile.where("cls is not null").groupBy("cls", last, F.col("key").alias("_key")).agg(F.count("*").alias("rows"))
    rows = materialize(rows, "join-keep")
    first = rows.groupBy("cls").agg(F.min(F.struct("_id", "_key")).alias("first"))
    first = materialize(first.join(groups.withColumnRenamed("node", "cls"), "cls", "left").select("cls", F.coalesce("component", "cls").alias("grp"), "first"), "join-first")
    firsts = materialize(first.select("cls", "grp").join(first.groupBy("grp").agg(F.min("first").alias("first")), "grp").select("cls", "first"), "join-firsts")
    lost = materialize(rows.join(firsts, "cls").where(F.struct("_id", "_key") != F.col("first")).select("_id", "_key"), "join-lost")
    twice = materialize(rows.where("rows > 1").select("_id", "_key"), "join-twice")
    if lost.count() <= BROADCAST_ROWS:
        lost = F.broadcast(lost)
    packed = documents.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("_id"), F.xxhash64("text").alias("_key"))
    kept = packed.join(lost, ["_id", "_key"], "left_anti")
    if not twice.isEmpty():
        # Rows of one id and text: the first of them stays.
        again = kept.join(twice, ["_id", "_key"], "left_semi").dropDuplicates(["_id", "_key"])
        kept = kept.join(twice, ["_id", "_key"], "left_anti").unionByName(again)
    return kept.select("row.*")


def oracle(join: Join) -> str:
    """doc_id, n_shingles, component_id in DuckDB SQL, by a self-join on shingles: for
    tables that are small enough for its pairs, with whole doc_ids."""
    shingle = " || ' ' || ".join(f"w[i + {k}]" for k in range(join.n))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {join.n} THEN [array_to_string(w, ' ')] ELSE list_distinct([{shingle} for i in range(1, len(w) - {join.n} + 2)]) END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) + any_value(b.n) AS total, count(*) AS inter FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id AND {join.den} * least(a.n, b.n) >= {join.num} * greatest(a.n, b.n) GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE {join.den} * inter >= {join.num} * (total - inter)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON r.other = e.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, (SELECT min(other) FROM reach r WHERE r.doc_id = sets.doc_id) AS component_id FROM sets"""
