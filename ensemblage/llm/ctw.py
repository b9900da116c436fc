"""LM scoring by context-tree weighting over bytes in binary decomposition.

A text is its lower-cased words, each as its bytes and a space, then an end byte.  A
byte is eight binary decisions; each has a context tree over the ``DEPTH`` bytes before
it, whatever words they belong to (before a text stand end bytes).  Every node keeps
Krichevsky-Trofimov counts of its bit, and its weighted probability is half its own
estimate plus half the product of its children's, from the deepest contexts up to the
root.  The model that is used for scoring is frozen: the weights of the training texts
mix the estimates of all depths along the path of a context.  A context that no
training text has adds no estimate to the mixture.

* Counts are grams: the predicted byte and its context in one long, nearest byte first,
  so that the order of grams is the order of the tree.  They are summed in each task
  before they move, together with the word counts of the base score.
* Grams are dealt by their two nearest context bytes and sorted.  Each partition is a
  stream of subtrees, cut where the third nearest byte changes: depths from 3 on are
  weighted within a cut, and sums for depth 2 go up by a built-in aggregation.  Depths
  1 and 0 have at most 65536 decisions, which the driver weighs.
* The same stream, with the rows of depth 2 sorted before their grams, then gives each
  gram its log-probability.
* A document's score is a sum over its grams.  The ``HEAD_GRAMS`` most frequent ones and
  the ``HEAD_WORDS`` most frequent words are sent to the executors (32 and 6 MB at most,
  whatever the corpus); the others are joined by key with the documents that hold them.

Grams are exact; words are told apart by 127-bit hashes.  Log-probabilities are natural
inside.  Texts of any length are read in slices of whole rows; a slice's memory grows
with the longest text in it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, id_text, materialize, row_slices, text_buffers

DEPTH = 5
HEAD_GRAMS = 1 << 21
HEAD_WORDS = 1 << 18
SLICE_BYTES = 4 << 20
#: Grams that a stream weighs at once, if no subtree of depth 3 is larger.
CUT = 40_000
END, SPACE = 10, 32
#: Hash of the end token, apart from those of words.
END_HASH = (0x5E0D5E0D5E0D5E0D, 0x0E0E0E0E0E0E0E0F)


def held_out(doc: Column, modulus: int = 10, remainder: int = 0) -> Column:
    return F.crc32(id_text(doc)) % modulus == remainder


# ------------------------------------------------------------ texts and grams

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[32, *range(9, 14)]] = SPACE


def byte_stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows as the model reads them, and the place of each row's end."""
    n = len(offsets) - 1
    end = offsets[1:] + 2 * np.arange(n)
    out = np.empty(len(data) + 2 * n, np.uint8)
    own = np.ones(len(out), bool)
    own[end] = own[end + 1] = False
    out[own] = _FOLD[data]
    out[end], out[end + 1] = SPACE, END
    before = np.empty(len(out), np.uint8)
    before[:1], before[1:] = END, out[:-1]
    # A space stays after a word only.
    out = out[(out != SPACE) | ((before != SPACE) & (before != END))]
    return out, np.flatnonzero(out == END)


def gram_keys(stream: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The gram of each byte: its context, nearest byte first, then the byte."""
    x = stream.astype(np.int64)
    keys = x.copy()
    for d in range(1, DEPTH + 1):
        keys[d:] |= x[:-d] << (8 * (DEPTH - d + 1))
    # The first bytes of a row have end bytes before them, not the row above.
    first = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64) if len(ends) else ends
    for j in range(DEPTH):
        at = first[first + j <= ends] + j
        own = x[at]
        for d in range(1, DEPTH + 1):
            own |= (x[at - d] if d <= j else END) << (8 * (DEPTH - d + 1))
        keys[at] = own
    return keys


def _slices(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        data, offsets = text_buffers(batch.column("text"))
        for a, b in row_slices(offsets, SLICE_BYTES):
            yield batch.slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def _word_keys(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two longs for each word; the second one is odd, and 0 for grams."""
    return words.hash.view(np.int64), (words.second() | np.uint64(1)).view(np.int64)


_END = tuple(np.array(END_HASH, np.uint64).view(np.int64).tolist())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, n): grams (b is 0) and words of each slice with their number in training
    texts, 0 where only held-out texts have them."""

    def table(a, b, n):
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], ["a", "b", "n"])

    def distinct(order, new, own):
        first = np.flatnonzero(new)
        return order[first], np.add.reduceat(own[order].astype(np.int64), first)

    ends = 0
    for batch, data, offsets in _slices(batches):
        if not batch.num_rows:
            continue
        trained = ~np.asarray(batch.column("held_out").to_numpy(zero_copy_only=False), bool)
        ends += int(trained.sum())
        stream, close = byte_stream(data, offsets)
        keys = gram_keys(stream, close)
        # Sorted twice instead of once with an order: sorting alone is much faster.
        size = np.diff(np.concatenate([[-1], close]))
        every, known = np.unique(keys), np.sort(keys[np.repeat(trained, size)])
        place = np.searchsorted(known, every)
        n = np.diff(np.append(place, len(known)))
        yield table(every, np.zeros(len(every), np.int64), n)
        words = Words(data, offsets)
        if len(words.hash):
            a, b = _word_keys(words)
            order = np.argsort(words.hash)
            # Equal first hashes with other second ones are parted here, if not summed.
            new = np.ones(len(order), bool)
            new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
            at, n = distinct(order, new, trained[words.row])
            yield table(a[at], b[at], n)
    yield table(np.array([_END[0]], np.int64), np.array([_END[1]], np.int64), np.array([ends], np.int64))


# ------------------------------------------------------------------- the tree


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability of a zeros and b ones."""

    def log_gamma(x):
        # Stirling's series from 8 on, by recurrence below.
        shift = np.zeros_like(x)
        x = x.copy()
        while (low := x < 8).any():
            shift[low] -= np.log(x[low])
            x[low] += 1
        inv = 1 / x
        return shift + (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + inv / 12 - inv**3 / 360 + inv**5 / 1260

    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - math.log(math.pi)


class _Bits:
    """The eight decisions of each gram: node within the byte's tree, and the bit."""

    def __init__(self, grams: np.ndarray, n: np.ndarray):
        byte = grams & 0xFF
        k = np.arange(8)
        self.node = ((1 << k) | (byte[:, None] >> (8 - k))).ravel()
        self.bit = (byte[:, None] >> (7 - k) & 1).ravel()
        self.n = np.repeat(n.astype(float), 8)
        self.context = np.repeat(grams >> 8, 8)

    def key(self, depth: int) -> np.ndarray:
        return (self.context >> (8 * (DEPTH - depth))) << 8 | self.node


class _Level:
    """Nodes of one depth: counts, block probabilities, and each decision's node."""

    def __init__(self, bits: _Bits, depth: int):
        self.keys, self.first, self.at = np.unique(bits.key(depth), return_index=True, return_inverse=True)
        self.zeros = np.bincount(self.at, weights=bits.n * (bits.bit == 0), minlength=len(self.keys))
        self.ones = np.bincount(self.at, weights=bits.n * (bits.bit == 1), minlength=len(self.keys))
        self.own = log_kt(self.zeros, self.ones)
        self.weighted = self.own
        self.share = np.ones(len(self.keys))  # of the node's own estimate in its mixture

    def mix(self, below: np.ndarray) -> None:
        """``below``: the sum of the children's log weighted probabilities."""
        self.weighted = np.logaddexp(self.own, below) - math.log(2)
        self.share = np.exp(self.own - math.log(2) - self.weighted)


def _tree(bits: _Bits) -> dict[int, _Level]:
    """Levels from DEPTH up to 3, weighted from the leaves."""
    levels = {d: _Level(bits, d) for d in range(3, DEPTH + 1)}
    for d in range(DEPTH - 1, 2, -1):
        child = levels[d + 1]
        levels[d].mix(np.bincount(levels[d].at[child.first], weights=child.weighted, minlength=len(levels[d].keys)))
    return levels


def _mixed(p: np.ndarray, own: np.ndarray, share: np.ndarray, known: np.ndarray) -> np.ndarray:
    """One depth further up: its estimate and what the depths below have given (nan
    where none of them has been trained)."""
    return np.where(known, np.where(np.isnan(p), own, share * own + (1 - share) * p), p)


def _cuts(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Sorted rows put together to about ``CUT`` each, cut where the three nearest
    context bytes change.  Rows of depth 2 have negative keys and open a cut."""
    held: list[dict[str, np.ndarray]] = []
    rows = 0
    shift = 8 * (DEPTH - 2)

    def joined():
        return {c: np.concatenate([h[c] for h in held]) for c in columns}

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append({c: batch.column(c).to_numpy(zero_copy_only=False) for c in columns})
        rows += batch.num_rows
        if rows < CUT:
            continue
        x = joined()
        place = x["near"].astype(np.int64) << 9 | np.where(x["gram"] < 0, 0, (x["gram"] >> shift & 0xFF) + 1)
        last = int(np.searchsorted(place, place[-1]))
        if last:
            yield {c: v[:last] for c, v in x.items()}
        held, rows = [{c: v[last:] for c, v in x.items()}], len(place) - last
    if held and rows:
        yield joined()


def _ordered(grams: DataFrame) -> DataFrame:
    return grams.repartition("near").sortWithinPartitions("near", "gram")


def _upward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums for depth 2 by (near, node): zeros, ones, and log weighted children."""
    for x in _cuts(batches, ["near", "gram", "n"]):
        bits = _Bits(x["gram"], x["n"])
        level = _tree(bits)[3]
        keys, at = np.unique(level.keys >> 16 << 8 | level.keys & 0xFF, return_inverse=True)
        sums = [np.bincount(at, weights=v, minlength=len(keys)) for v in (level.zeros, level.ones, level.weighted)]
        arrays = [pa.array((keys >> 8).astype(np.int32)), pa.array((keys & 0xFF).astype(np.int32)), *map(pa.array, sums)]
        yield pa.RecordBatch.from_arrays(arrays, ["near", "node", "zeros", "ones", "below"])


def _weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of depth 2 with their weights: ``gram`` is the node, below all grams."""
    for batch in batches:
        zeros, ones, below = (batch.column(c).to_numpy() for c in ("zeros", "ones", "below"))
        own = log_kt(zeros, ones)
        weighted = np.logaddexp(own, below) - math.log(2)
        share = np.exp(own - math.log(2) - weighted)
        gram = pa.array(batch.column("node").to_numpy().astype(np.int64) - 256)
        yield pa.RecordBatch.from_arrays([batch.column("near"), gram, batch.column("zeros"), batch.column("ones"), pa.array(weighted), pa.array(share)], ["near", "gram", "zeros", "ones", "weighted", "share"])


class Crown:
    """Depths 0 and 1 of the tree as dense arrays: share of the own estimate, and the
    estimate of a one, for the root and for each nearest byte."""

    def __init__(self, rows: pa.Table):
        """rows: (near1, node, zeros, ones, below) of depth 1."""
        near, node = rows["near1"].to_numpy(), rows["node"].to_numpy()
        zeros, ones, below = np.zeros((3, 256, 256))
        for array, name in ((zeros, "zeros"), (ones, "ones"), (below, "below")):
            array[near, node] = rows[name].to_numpy()
        self.share, self.one = np.ones((257, 256)), np.full((257, 256), 0.5)
        self.known = np.zeros((257, 256), bool)
        own = log_kt(zeros, ones)
        weighted = np.logaddexp(own, below) - math.log(2)
        self._set(slice(0, 256), zeros, ones, own, weighted)
        zeros, ones = zeros.sum(0), ones.sum(0)
        own = log_kt(zeros, ones)
        # A node that no text has is no child: its product is 1.
        root = np.logaddexp(own, weighted.sum(0, where=self.known[:256])) - math.log(2)
        self._set(256, zeros, ones, own, root)

    def _set(self, at, zeros, ones, own, weighted) -> None:
        self.share[at] = np.exp(own - math.log(2) - weighted)
        self.one[at] = (ones + 0.5) / (zeros + ones + 1)
        self.known[at] = zeros + ones > 0

    def extend(self, p: np.ndarray, bits: _Bits) -> np.ndarray:
        for row in (bits.context >> (8 * (DEPTH - 1)), np.full(len(p), 256)):
            one = self.one[row, bits.node]
            p = _mixed(p, np.where(bits.bit == 1, one, 1 - one), self.share[row, bits.node], self.known[row, bits.node])
        return np.where(np.isnan(p), 0.5, p)


def gram_scores(grams: DataFrame) -> DataFrame:
    """(gram, n, logp) of all ``grams`` (gram, n): natural log-probability of the byte
    after its context.  ``n`` is 0 for grams that are only asked for."""
    near = F.shiftright("gram", 8 * (DEPTH - 1)).cast("int").alias("near")
    rows = grams.select(near, "gram", "n")
    sums = _ordered(rows).mapInArrow(_upward, "near int, node int, zeros double, ones double, below double")
    sums = sums.groupBy("near", "node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")]).where("zeros + ones > 0")
    two = materialize(sums.mapInArrow(_weighted, "near int, gram long, zeros double, ones double, weighted double, share double"), "ctw-depth2")
    one = two.groupBy(F.shiftright("near", 8).alias("near1"), (F.col("gram") + 256).cast("int").alias("node"))
    one = one.agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("below"))
    # At most 65536 rows, whatever the corpus.
    shared = grams.sparkSession.sparkContext.broadcast(Crown(one.toArrow()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        for x in _cuts(batches, ["near", "gram", "n", "share", "one"]):
            info = x["gram"] < 0
            key = x["near"][info].astype(np.int64) << 8 | (x["gram"][info] + 256)
            above = tuple(np.concatenate([old, new]) for old, new in zip(above, (key, x["share"][info], x["one"][info])))
            grams_ = x["gram"][~info]
            if len(grams_):
                bits = _Bits(grams_, x["n"][~info])
                p = np.full(len(bits.bit), np.nan)
                for _, level in sorted(_tree(bits).items(), reverse=True):
                    total = (level.zeros + level.ones)[level.at]
                    own = (np.where(bits.bit == 1, level.ones[level.at], level.zeros[level.at]) + 0.5) / (total + 1)
                    p = _mixed(p, own, level.share[level.at], total > 0)
                wanted = bits.key(2)
                if len(above[0]):
                    at = np.minimum(np.searchsorted(above[0], wanted), len(above[0]) - 1)
                    p = _mixed(p, np.where(bits.bit == 1, above[2][at], 1 - above[2][at]), above[1][at], above[0][at] == wanted)
                p = shared.value.extend(p, bits)
                logp = np.log(p).reshape(-1, 8).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(grams_), pa.array(x["n"][~info]), pa.array(logp)], ["gram", "n", "logp"])
            # Only the last context of depth 2 can go on.
            rest = above[0] >> 8 == int(x["near"][-1])
            above = tuple(v[rest] for v in above)

    one_share = ((F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1)).alias("one")
    asked = rows.select("near", "gram", "n", F.lit(0.0).alias("share"), F.lit(0.0).alias("one"))
    info = two.select("near", "gram", F.lit(0).cast("long").alias("n"), "share", one_share)
    return _ordered(asked.union(info)).mapInArrow(score, "gram long, n long, logp double")


# -------------------------------------------------------------- the documents


class Table:
    """Values by key: a slot for each hash of a key, and the keys that found theirs
    taken in a sorted rest."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, weight: np.ndarray):
        """The heavier of two keys gets the slot."""
        self.bits = max(8, int(2 * len(keys)).bit_length())
        order = np.argsort(weight, kind="stable")
        keys, values = keys[order], values[order]
        slot = self._slot(keys)
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits)
        self.keys[slot], self.values[slot] = keys, values
        late = self.keys[slot] != keys
        rest = np.argsort(keys[late])
        self.rest, self.rest_values = keys[late][rest], values[late][rest]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and whether a key (not negative) is here."""
        slot = self._slot(keys)
        found = self.keys[slot] == keys
        values = np.where(found, self.values[slot], 0.0)
        if len(self.rest):
            other = np.flatnonzero(~found)
            at = np.minimum(np.searchsorted(self.rest, keys[other]), len(self.rest) - 1)
            hit = self.rest[at] == keys[other]
            values[other[hit]] = self.rest_values[at[hit]]
            found[other[hit]] = True
        return values, found


_PARTIAL = "row long, doc_id long, n_tokens long, n_known long, base double, logp double, bytes long, a array<long>, b array<long>, times array<int>"


def _scored(grams, words, end: tuple[float, bool]):
    """Sums over frequent grams and words for each document; its others as keys and
    counts.  ``end``: base score of the end token, and whether it is known."""

    def rest_of(n, parts):
        """Distinct (row, a, b) with their number, as lists by row."""
        row, a, b = (np.concatenate(p) for p in zip(*parts))
        order = np.lexsort((b, a, row))
        row, a, b = row[order], a[order], b[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(row))).astype(np.int32)
        cuts = pa.array(np.searchsorted(row[first], np.arange(n + 1)).astype(np.int32))
        return [pa.ListArray.from_arrays(cuts, pa.array(v)) for v in (a[first], b[first], times)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(*grams.value)
        first, second, base = words.value
        for batch, data, offsets in _slices(batches):
            n = batch.num_rows
            if not n:
                continue
            stream, close = byte_stream(data, offsets)
            size = np.diff(np.concatenate([[-1], close]))
            keys = gram_keys(stream, close)
            value, found = table.find(keys)
            logp = np.add.reduceat(value, close + 1 - size)
            other = np.flatnonzero(~found)
            rest = [(np.searchsorted(close, other), keys[other], np.zeros(len(other), np.int64))]
            own = Words(data, offsets)
            a, b = _word_keys(own)
            rows = own.row
            if len(first) and len(a):
                at = np.minimum(np.searchsorted(first, a), len(first) - 1)
                hit = (first[at] == a) & (second[at] == b)
            else:
                at, hit = np.zeros(len(a), np.int64), np.zeros(len(a), bool)
            sums = np.bincount(rows[hit], weights=base[at[hit]], minlength=n) + end[0]
            known = np.bincount(rows[hit], minlength=n) + int(end[1])
            rest.append((rows[~hit], a[~hit], b[~hit]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    batch.column("doc_id"),
                    pa.array(np.bincount(rows, minlength=n) + 1),
                    pa.array(known),
                    pa.array(sums),
                    pa.array(logp),
                    pa.array(size),
                    *rest_of(n, rest),
                ],
                [f.split()[0] for f in _PARTIAL.split(", ")],
            )

    return run


def _most_frequent(scores: DataFrame, most: int) -> pa.Table:
    """Trained keys from the least count up that keeps them at ``most``.  Counts are
    told apart to an eighth of a binary order, so the table that finds the least count
    has some hundred rows."""
    level = F.floor(F.log2("n") * 8).cast("int")
    scores = scores.where("n > 0")
    least, total = 10**9, 0
    for row in sorted(scores.groupBy(level.alias("level")).agg(F.count("*").alias("rows")).collect(), reverse=True):
        total += row.rows
        if total > most:
            break
        least = row.level
    return scores.where(level >= least).toArrow()


def score_documents(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    bits_per_byte for every document.

    Null and empty texts have the end token only.  Repeated rows are scored and, if
    they train, counted each.  A null doc_id counts as the empty text for the split.
    Without training texts all counts are 0 and every decision is even.  Very long
    texts are scored whole.  An empty table gives an empty result.
    """
    context = documents.sparkSession.sparkContext
    docs = documents.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    counted = docs.select("text", "held_out").mapInArrow(_count, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    counts = materialize(counted, "ctw-counts")
    words = counts.where("b <> 0")
    total, distinct, ends = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0), F.coalesce(F.sum(F.when((F.col("a") == _END[0]) & (F.col("b") == _END[1]), F.col("n"))), F.lit(0))).first()
    scored = gram_scores(counts.where("b = 0").select(F.col("a").alias("gram"), "n"))
    scored = scored.select(F.col("gram").alias("a"), F.lit(0).cast("long").alias("b"), "n", "logp")
    scores = materialize(scored, "ctw-scores")

    spread = total + 0.1 * (distinct + 1)
    base = lambda c: np.log10((c + 0.1) / spread)
    head = _most_frequent(scores, HEAD_GRAMS)
    grams = context.broadcast((head["a"].to_numpy(), head["logp"].to_numpy(), head["n"].to_numpy()))
    head = _most_frequent(words, HEAD_WORDS).sort_by([("a", "ascending"), ("b", "ascending")])
    common = context.broadcast((head["a"].to_numpy(), head["b"].to_numpy(), base(head["n"].to_numpy())))
    run = _scored(grams, common, (float(base(ends)), ends > 0))

    partial = docs.withColumn("row", F.monotonically_increasing_id()).select("row", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PARTIAL)
    # A document's sums ride on the first of its rows; without other keys it still has
    # one, with a key of its own that counts nothing.
    none = F.array(F.struct(F.xxhash64("row").alias("a"), F.lit(2).cast("long").alias("b"), F.lit(0).alias("times")))
    rest = F.arrays_zip("a", "b", "times")
    sums = ["doc_id", "n_tokens", "n_known", "base", "logp", "bytes"]
    rows = partial.select("row", *sums, F.posexplode(F.when(F.size("a") > 0, rest).otherwise(none)).alias("pos", "w"))
    rows = rows.select("row", *[F.when(F.col("pos") == 0, F.col(c)).alias(c) for c in sums], "w.*")
    values = scores.select("a", "b", "n", F.col("logp").alias("gram_logp")).union(words.select("a", "b", "n", F.lit(None).cast("double")))
    joined = rows.join(values, ["a", "b"], "left")
    is_word = (F.col("b") != 0) & (F.col("times") > 0)
    count = F.coalesce("n", F.lit(0))
    df = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_tokens").alias("n_tokens"),
        (F.max("n_known") + F.sum(F.when(is_word & (count > 0), F.col("times")).otherwise(0))).cast("long").alias("n_known"),
        (F.max("base") + F.sum(F.when(is_word, F.col("times") * F.log10((count + 0.1) / spread)).otherwise(0.0))).alias("base_score"),
        (F.max("logp") + F.sum(F.col("times") * F.coalesce("gram_logp", F.lit(0.0)))).alias("logp"),
        F.max("bytes").alias("bytes"),
    )
    return df.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        "base_score",
        (F.col("logp") / math.log(10)).alias("score"),
        (-F.col("logp") / math.log(2) / F.col("bytes")).alias("bits_per_byte"),
    )
