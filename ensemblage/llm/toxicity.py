"""Toxicity: noisy-channel restoration of disguised words, then a lexical score.

Restoration.  A span that may be disguised (digits, symbols, letters of other scripts or
characters without width inside a word, single letters with separators between them, a
letter three times in a row, or twice where the character model finds once more likely) is
a character lattice: each observed character may stand for itself, for letters that it
looks like, for nothing if it separates, or for a repetition.  Viterbi decoding finds the
most probable intended letters under a character trigram model with the channel's costs.
The restored words are added to the text's own ones.

Score.  Words and their first 4 to 6 bytes are features.  The evidence of a feature is
the log-odds of its shrunken precision on labelled texts.  A text's evidence adds up that
of its different features, the strongest whole and each further one shrunk by ``SHARE``
again, as features of one text say much the same; two-fold cross-fitting calibrates it to
a probability.

Trigrams are counted over all documents.  The lexicon learns from at most ``TRAIN_ROWS``
labelled texts of any length, those with the smallest hashes of their ids; a histogram of
the hashes finds the bound.  Executors restore these texts and count their features; the
driver gets the features that toxic texts share, and the evidence of each text.  Scoring
takes every whole text, row by row, without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PUNCTUATION, Words, materialize, md5_int, row_slices, text_buffers
from .ctw import held_out

TRAIN_ROWS = 12_000
THRESHOLD = 0.3
PREFIXES = (4, 5, 6)
SLICE_BYTES = 2 << 20
_SHRINK = 4.0
_LEAST_TEXTS = 3
LEAST_GAIN = 10.0
#: Weight of a text's second strongest feature; of the third its square, and so on.
SHARE = 0.25
#: By how much one letter must be likelier than the two that stand there.
DOUBLED_GAIN = 2.0

# Letters that a character may stand for.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "*": "aeiou",
    "а": "a", "в": "b", "е": "e", "и": "u", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
# Characters without width.
_NO_WIDTH = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
_SEPARATORS = " .-_*~'"
_OTHER_SCRIPT = "".join(c for c in LOOKS_LIKE if c.isalpha())
_SYMBOLS = re.escape("".join(c for c in LOOKS_LIKE if not c.isalnum())) + _OTHER_SCRIPT + _OTHER_SCRIPT.upper() + _NO_WIDTH

_MARK = rf"[0-9{_SYMBOLS}]"
_TOKEN = re.compile(rf"[A-Za-z0-9{_SYMBOLS}]{{3,}}")
_BEFORE, _AFTER = frozenset("\"'([,;:"), frozenset("\"')].,;:?")
_HAS_LETTER, _HAS_MARK, _SPACE = re.compile("[A-Za-z]"), re.compile(_MARK), re.compile(r"\s")
_ONE = rf"[A-Za-z0-9{_SYMBOLS}]"
_SPACED = re.compile(rf"(?<!\S){_ONE}(?:[ .\-_*~]{{1,3}}{_ONE}){{2,}}(?![^\s.,;:!?])")
_GAP = re.compile(rf"(?<={_ONE})([ .\-_*~])[ .\-_*~]*(?={_ONE})")
# From a run's first letter on, so that a run is gone through once.
_REPEATED = re.compile(r"(?<![A-Za-z])[A-Za-z]*([A-Za-z])\1\1[A-Za-z]*")
_LONG_REPEAT = re.compile(r"([a-z])\1{3,}")
#: Characters of a span whose restoration is kept for the next time.
_KEPT_CHARS = 64


def _mixed(text: str) -> Iterator[str]:
    """Tokens with letters among digits or symbols, of any length, each gone through
    once.  A letter and a mark may also stand close after the token."""
    for m in _TOKEN.finditer(text):
        start, end = m.span()
        if end < len(text) and not (text[end].isspace() or text[end] in _AFTER):
            continue
        if start and not (text[start - 1].isspace() or text[start - 1] in _BEFORE):
            start = text.find("(", start, end) + 1
            if not start or end - start < 3:
                continue
        near = text[start : max(end, start + 20)]
        gap = _SPACE.search(near)
        near = near[: gap.start()] if gap else near
        if _HAS_LETTER.search(near) and _HAS_MARK.search(near):
            yield text[start:end]


_LETTERS = "abcdefghijklmnopqrstuvwxyz"


class CharModel:
    """Trigram model of words of a to z; 0 is the word's edge."""

    def __init__(self, counts: np.ndarray):
        p1 = (counts.sum((0, 1)) + 1) / (counts.sum() + 27)
        p2 = (counts.sum(0) + 5 * p1) / (counts.sum((0, 2))[:, None] + 5)
        self.log = np.log((counts + 5 * p2[None]) / (counts.sum(2)[:, :, None] + 5))

    @staticmethod
    def count(data: np.ndarray) -> np.ndarray:
        """Trigram counts of the words of letters in some bytes."""
        code = np.zeros(256, np.int64)
        code[[ord(c) for c in _LETTERS]] = code[[ord(c) for c in _LETTERS.upper()]] = np.arange(1, 27)
        other = np.zeros(256, bool)
        other[128:] = True
        x = code[data]
        # A word with bytes beyond ASCII says nothing on either side of them.
        x = np.concatenate([[0, 0], x, [0]])
        odd = np.concatenate([[False, False], other[data], [False]])
        clean = ~(odd[:-2] | odd[1:-1] | odd[2:])
        a, b, c = x[:-2], x[1:-1], x[2:]
        a = np.where(b == 0, 0, a)
        keep = clean & ~((b == 0) & (c == 0))
        return np.bincount((a * 729 + b * 27 + c)[keep], minlength=27**3).reshape(27, 27, 27).astype(float)


# Log-costs of the channel.
_SAME, _LOOKS, _NOTHING, _AGAIN = math.log(0.95), math.log(0.3), math.log(0.2), math.log(0.3)
# A separator between words; one of the kind that is less likely to do what it does.
_EDGE, _UNLIKELY = math.log(0.2), math.log(0.02)


class Channel:
    """Viterbi decoder over a lattice of observed characters."""

    def __init__(self, model: CharModel):
        self.log = model.log
        self._short = lru_cache(maxsize=200_000)(self._decode)

    def decode(self, seen: str, phrase: bool = False) -> str:
        return (self._short if len(seen) <= _KEPT_CHARS else self._decode)(seen, phrase)

    def _decode(self, seen: str, phrase: bool = False) -> str:
        """Most probable letters for ``seen`` (lower case); may be empty.

        In a ``phrase``, whose every second character is a separator, separators may
        also stand between words: a space then comes out.  Where white space and other
        separators are mixed, white space is the one that parts words."""
        mixed = phrase and " " in seen[1::2] and bool(seen[1::2].strip(" "))
        # State: the last two letters; best score and the chain of letters so far.
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for i, c in enumerate(seen):
            then: dict[tuple[int, int], tuple[float, tuple | None]] = {}

            def keep(state, score, letters, x="", then=then):
                if state not in then or score > then[state][0]:
                    then[state] = (score, (letters, x) if x else letters)

            choices = [(c, _SAME)] if c in _LETTERS else []
            separates = phrase and i % 2 == 1
            if not separates:
                choices += [(x, (_SAME if c in _OTHER_SCRIPT else _LOOKS) - math.log(len(LOOKS_LIKE[c]))) for x in LOOKS_LIKE.get(c, "")]
            inside, between = (_UNLIKELY, _EDGE) if mixed and c == " " else (_NOTHING, _UNLIKELY if mixed else _EDGE)
            for (a, b), (score, letters) in states.items():
                for x, cost in choices:
                    k = ord(x) - 96
                    keep((b, k), score + cost + self.log[a, b, k], letters, x)
                    if k == b:
                        keep((a, b), score + cost + _AGAIN, letters)
                if c in _SEPARATORS or not choices:
                    keep((a, b), score + inside, letters)
                if separates and b:
                    keep((0, 0), score + between + self.log[a, b, 0], letters, " ")
            states = then
        _, chain = max(((score + self.log[a, b, 0] if b or not phrase else score, letters) for (a, b), (score, letters) in states.items()), key=lambda s: s[0], default=(0.0, None))
        out = []
        while chain:
            chain, x = chain
            out.append(x)
        return "".join(reversed(out))

    def doubled(self, data: np.ndarray, offsets: np.ndarray | None = None) -> np.ndarray:
        """Places of letters that stand twice where the model finds one likelier; texts
        end at ``offsets``."""
        n = len(data)
        if n < 2:
            return np.zeros(0, np.int64)
        opens = np.zeros(n + 1, bool)
        opens[[0, n] if offsets is None else offsets] = True
        code = np.append(_CODE[data], 0)
        odd = np.append(data > 127, False)
        at = np.flatnonzero((code[:-2] == code[1:-1]) & (code[:-2] > 0) & ~opens[1:-1])
        before = np.where(opens[at], 0, code[at - 1])
        c, after = code[at], np.where(opens[at + 2], 0, code[at + 2])
        # Three in a row are spans by themselves; words with bytes beyond ASCII are not judged.
        keep = (before != c) & (after != c) & (opens[at] | ~odd[at - 1]) & (opens[at + 2] | ~odd[at + 2])
        at, before, c, after = at[keep], before[keep], c[keep], after[keep]
        gain = _AGAIN - _SAME + self.log[before, c, after] - self.log[before, c, c] - self.log[c, c, after]
        return at[gain > DOUBLED_GAIN]

    def restored(self, text: str, marks: bool = True) -> list[str]:
        """Words behind the disguised spans of a text, in order of kind.  A spaced span
        gives its letters as one word, with and without those at its ends, and the words
        that it parts into.  ``marks``: whether more than doubled letters may be there."""
        spaced = [_GAP.sub(r"\1", m[0]) for m in _SPACED.finditer(text)] if marks else []
        # The letter at either end may be a word by itself.
        ends = [x for s in spaced for x in (s[2:] if s[1] == " " else "", s[:-2] if s[-2] == " " else "") if len(x) > 2]
        found = [*_mixed(text), *spaced, *ends, *(m[0] for m in _REPEATED.finditer(text))] if marks else []
        clean = lambda s: _LONG_REPEAT.sub(r"\1\1\1", s.rstrip("!|+.?").lower())
        words = [self.decode(clean(s)) for s in dict.fromkeys(found)]
        for s in dict.fromkeys(spaced):
            words += self.decode(s.lower(), True).split()
        raw = text.encode()
        data = np.frombuffer(raw, np.uint8)
        twice = {}
        for at in self.doubled(data):
            start, end = at, at + 2
            while start and _LETTER[data[start - 1]]:
                start -= 1
            while end < len(data) and _LETTER[data[end]]:
                end += 1
            if end - start <= _KEPT_CHARS:
                twice[raw[start:end].decode().lower()] = None
        return [w for w in [*words, *map(self.decode, twice)] if w]


_CODE = np.zeros(256, np.int64)
_CODE[[ord(c) for c in _LETTERS]] = _CODE[[ord(c) for c in _LETTERS.upper()]] = np.arange(1, 27)
_DIGIT_OR_SYMBOL = np.zeros(256, bool)
_DIGIT_OR_SYMBOL[[ord(c) for c in LOOKS_LIKE if ord(c) < 128]] = True
_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
#: First bytes of Greek and Cyrillic letters.
_OTHER_LEAD = np.zeros(256, bool)
_OTHER_LEAD[[0xCE, 0xCF, 0xD0, 0xD1]] = True
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[ord(c) for c in _SEPARATORS]] = True


def suspicious(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that can hold a disguised span, by bytes; other rows need no pattern."""
    n = len(offsets) - 1
    if len(data) < 3:
        return np.zeros(n, bool)
    letter, mark = _LETTER[data], _DIGIT_OR_SYMBOL[data]
    any_ = np.zeros(len(data), bool)
    any_[:-1] |= (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])
    any_[:-2] |= letter[:-2] & (data[:-2] | 32 == data[1:-1] | 32) & (data[:-2] | 32 == data[2:] | 32)
    # Single letters with one to three separators between two of them; bytes of a letter
    # of another script may be among them.
    one, gap = letter | mark | (data > 127), _SEPARATOR[data]
    for n in (1, 2, 3):
        if len(data) > n + 1:
            apart = gap[1 : len(data) - n]
            for k in range(1, n):
                apart = apart & gap[1 + k : len(data) - n + k]
            opens = np.concatenate([[True], ~one[: len(data) - n - 2]])
            any_[: -n - 1] |= one[: -n - 1] & opens & apart & one[n + 1 :]
    # Signs of money and characters without width have bytes beyond ASCII; letters of other
    # scripts count next to those of ours.
    any_ |= (data == 0xE2) | (data == 0xC2) | (data == 0xEF)
    lead = _OTHER_LEAD[data]
    any_[:-1] |= letter[:-1] & lead[1:]
    any_[:-2] |= lead[:-2] & letter[2:]
    return np.add.reduceat(np.append(any_, False).astype(np.int64), np.minimum(offsets[:-1], len(data))) * (offsets[1:] > offsets[:-1]) > 0


def with_restored(data: np.ndarray, offsets: np.ndarray, channel: Channel) -> tuple[np.ndarray, np.ndarray]:
    """The texts, each with its restored words after it."""
    marked = suspicious(data, offsets)
    twice = np.searchsorted(offsets, channel.doubled(data, offsets), "right") - 1
    rows = np.union1d(np.flatnonzero(marked), twice)
    if not len(rows):
        return data, offsets
    raw = data.tobytes()
    parts, size, at = [], np.diff(offsets), 0
    for r in rows:
        words = channel.restored(raw[offsets[r] : offsets[r + 1]].decode(), bool(marked[r]))
        if words:
            extra = (" " + " ".join(words)).encode()
            parts += [raw[at : offsets[r + 1]], extra]
            at = offsets[r + 1]
            size[r] += len(extra)
    parts.append(raw[at:])
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum(size)])


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of words and of their beginnings."""
    words = Words(data, offsets, PUNCTUATION)
    yield words.row, words.hash
    for k, size in enumerate(PREFIXES):
        which, h = words.starts_with(size)
        yield words.row[which], h ^ np.uint64(0xA5A5A5A5A5A5A5A5 + k)


@dataclass
class Model:
    """``hashes`` (sorted) with their evidence, the evidence of a text without any,
    and the calibration of evidence to log-odds."""

    chars: np.ndarray
    hashes: np.ndarray
    evidence: np.ndarray
    none: float
    scale: float
    shift: float

    def total(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The evidence of each text: that of its different features, in order of
        strength, each shrunk once more than the one before."""
        x = np.full(len(offsets) - 1, self.none)
        if not len(self.hashes):
            return x
        slots = np.zeros(1 << 16, bool)
        slots[(self.hashes >> np.uint64(48)).astype(np.int64)] = True
        found = []
        for row, h in features(data, offsets):
            maybe = np.flatnonzero(slots[(h >> np.uint64(48)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
            hit = self.hashes[at] == h[maybe]
            found.append(np.unique(row[maybe[hit]] * len(self.hashes) + at[hit]))
        row, at = np.divmod(np.unique(np.concatenate(found)), len(self.hashes))
        order = np.lexsort((-self.evidence[at], row))
        row, e = row[order], self.evidence[at[order]]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        np.add.at(x, row, (e - self.none) * SHARE**rank)
        return x

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.total(data, offsets) + self.shift)))


def feature_counts(data: np.ndarray, offsets: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features, and in how many rows of each cell (2 * half + toxic) they are."""
    rows, hashes = map(np.concatenate, zip(*features(data, offsets)))
    order = np.lexsort((rows, hashes))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    h, at = np.unique(hashes[new], return_inverse=True)
    return h, np.bincount(at * 4 + cell[rows[new]], minlength=4 * len(h)).reshape(-1, 4)


#: Cells of all rows, and of either half.
_ALL, _HALVES = ([0, 2], [1, 3]), (([0], [1]), ([2], [3]))


def lexicon(h: np.ndarray, n: np.ndarray, totals: np.ndarray, cells, chars) -> Model:
    """Evidence of the features that some toxic rows of the ``cells`` share."""
    zeros, ones = (float(totals[c].sum()) for c in cells)
    prior = (ones + 0.5) / (ones + zeros + 1)
    none = math.log(prior / (1 - prior))
    b, a = (n[:, c].sum(1).astype(float) for c in cells)
    shared = a >= _LEAST_TEXTS
    h, a, b = h[shared], a[shared], b[shared]
    p = (a + _SHRINK * prior) / (a + b + _SHRINK)
    evidence = np.log(p / (1 - p))
    # Only what chance does not explain: log-likelihood ratio against the prior.
    share = np.clip(a / (a + b), 1e-12, 1 - 1e-12)
    gain = a * np.log(share / prior) + b * np.log((1 - share) / (1 - prior))
    keep = (gain > LEAST_GAIN) & (evidence > none + 0.5)
    order = np.argsort(h[keep])
    return Model(chars, h[keep][order], evidence[keep][order], none, 1.0, 0.0)


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic fit with a weak prior, by Newton's method."""
    center, start, strength = x.mean(), np.array([1.0, 0.0]), np.array([0.5, 0.01])
    z = np.stack([x - center, np.ones(len(x))], 1)

    def loss(w):
        v = z @ w
        return float((np.logaddexp(0, v) - y * v).sum() + 0.5 * (strength * (w - start) ** 2).sum())

    w = start.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        gradient = z.T @ (y - p) - strength * (w - start)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(strength), gradient)
        rate, now = 1.0, loss(w)
        while loss(w + rate * step) > now and rate > 1e-6:
            rate /= 2
        w = w + rate * step
        if np.abs(rate * step).max() < 1e-8:
            break
    return float(w[0]), float(w[1] - w[0] * center)


def learn(data: np.ndarray, offsets: np.ndarray, toxic: np.ndarray) -> Model:
    """A model of texts (UTF-8 bytes, row offsets) and their labels, in one place."""
    chars = CharModel.count(data)
    data, offsets = with_restored(data, offsets, Channel(CharModel(chars)))
    cell = toxic.astype(np.int64)
    # Both labels are halved.
    cell[np.flatnonzero(toxic)[::2]] += 2
    cell[np.flatnonzero(~toxic)[::2]] += 2
    h, n = feature_counts(data, offsets, cell)
    totals = np.bincount(cell, minlength=4)
    x = np.zeros(len(toxic))
    for half in (0, 1):
        mine = cell // 2 == half
        x[mine] = lexicon(h, n, totals, _HALVES[1 - half], chars).total(data, offsets)[mine]
    return _calibrated(lexicon(h, n, totals, _ALL, chars), x, toxic)


def _calibrated(model: Model, x: np.ndarray, toxic: np.ndarray) -> Model:
    """Each half is measured with the other half's lexicon (``x``)."""
    model.scale, model.shift = _calibrate(x, toxic.astype(float)) if len(x) else (0.0, -30.0)
    return model


def char_counts(documents: DataFrame) -> np.ndarray:
    """Trigrams of the letters of all documents: 19,683 sums, whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(27**3, np.int64)
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for a, b in row_slices(offsets, SLICE_BYTES):
                total += CharModel.count(data[offsets[a] : offsets[b]]).ravel().astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(27**3, dtype=np.int32)), pa.array(total)], ["trigram", "n"])

    # A line feed keeps the words of two texts apart.
    texts = documents.select(F.concat(F.col("text"), F.lit("\n")).alias("text"))
    found = texts.mapInArrow(count, "trigram int, n long").groupBy("trigram").agg(F.sum("n").alias("n")).toArrow()
    chars = np.zeros(27**3)
    chars[found["trigram"].to_numpy()] = found["n"].to_numpy()
    return chars.reshape(27, 27, 27)


def chosen_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, rank) of the training ids: those of the smallest hashes, as many
    as ``TRAIN_ROWS`` allows.  Nothing is sorted: a histogram of 65536 cells finds the
    bound, and is taken again within its first cell while that alone is too large."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 4, 2)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("rank", md5_int(F.concat(F.lit("toxicity:"), F.col("doc_id").cast("string")), 12))
    width = 1 << 48
    while True:
        step = max(1, width >> 16)
        cells = known.where(F.col("rank") < width).groupBy(F.floor(F.col("rank") / step).alias("cell")).agg(F.count("*").alias("n")).collect()
        total, bound = 0, width
        for cell, n in sorted(cells):
            total += n
            if total > TRAIN_ROWS:
                bound = cell * step
                break
        if bound or step == 1:
            return known.where(F.col("rank") < max(bound, 1))
        width = step


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """Learn from the labelled rows outside the held-out part (remainder 2 of 4)."""
    chars = char_counts(documents)
    shared = documents.sparkSession.sparkContext.broadcast(chars)
    # At most TRAIN_ROWS ids.
    chosen = F.broadcast(materialize(chosen_labels(labels), "tox-labels"))
    cell = ((F.col("rank") % 2) * 2 + (F.col("toxic") > 0).cast("long")).alias("cell")
    texts = documents.select("doc_id", "text").join(chosen, "doc_id").where("text is not null")
    # Of several rows of one id the least text counts.
    texts = texts.groupBy("doc_id", cell).agg(F.min("text").alias("text")).select("cell", "text")

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel = Channel(CharModel(shared.value))
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for a, b in row_slices(offsets, SLICE_BYTES):
                d, o = with_restored(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], channel)
                text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(o.astype(np.int64).tobytes()), pa.py_buffer(np.ascontiguousarray(d).tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column("cell").slice(a, b - a), text.cast(pa.binary())], ["cell", "text"])

    # Texts are few and uneven: restoring them is spread over all cores.
    texts = materialize(texts.repartition(documents.sparkSession.sparkContext.defaultParallelism * 4), "tox-texts")
    training = materialize(texts.mapInArrow(restore, "cell long, text binary"), "tox-training")

    def slices(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            data, offsets = text_buffers(batch.column("text").cast(pa.large_binary()).view(pa.large_string()))
            cell = batch.column("cell").to_numpy()
            for a, b in row_slices(offsets, SLICE_BYTES):
                yield cell[a:b], data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, data, offsets in slices(batches):
            h, n = feature_counts(data, offsets, cell)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *[pa.array(np.ascontiguousarray(n[:, k])) for k in range(4)]], ["h", *_CELLS])

    totals = np.zeros(4, np.int64)
    for row in training.groupBy("cell").agg(F.count("*").alias("n")).collect():
        totals[row.cell] = row.n
    counts = training.mapInArrow(count, "h long, " + ", ".join(f"{c} long" for c in _CELLS)).groupBy("h").agg(*[F.sum(c).alias(c) for c in _CELLS])

    def speaks(cells):
        """What may be evidence: enough toxic texts, and more of them than among all."""
        b, a = (sum((F.col(_CELLS[k]) for k in c[1:]), F.col(_CELLS[c[0]])) for c in cells)
        ones, rows = float(totals[cells[1]].sum()), float(totals[cells[0] + cells[1]].sum())
        return (a >= _LEAST_TEXTS) & (a * rows >= (a + b) * ones)

    found = counts.where(speaks(_ALL) | speaks(_HALVES[0]) | speaks(_HALVES[1])).toArrow()
    h, n = found["h"].to_numpy().view(np.uint64), np.stack([found[c].to_numpy() for c in _CELLS], 1)
    halves = documents.sparkSession.sparkContext.broadcast([lexicon(h, n, totals, _HALVES[1 - half], chars) for half in (0, 1)])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, data, offsets in slices(batches):
            x = np.where(cell < 2, *(m.total(data, offsets) for m in halves.value))
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(x)], ["cell", "x"])

    # A number for each training text.
    evidence = training.mapInArrow(measure, "cell long, x double").toArrow()
    return _calibrated(lexicon(h, n, totals, _ALL, chars), evidence["x"].to_numpy(), evidence["cell"].to_numpy() % 2 == 1)


_CELLS = [f"n{k}" for k in range(4)]


def score_documents(documents: DataFrame, model: Model, columns: list[str] | None = None) -> DataFrame:
    """The rows of ``documents`` (``columns``, doc_id by default) with ``tox_score``."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)
    columns = columns or ["doc_id"]
    # The text that is scored comes last, under a name of its own.
    df = documents.select(*columns, F.col("text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        channel = Channel(CharModel(m.chars))
        for batch in batches:
            data, offsets = text_buffers(batch.column(len(columns)))
            scores = []
            for a, b in row_slices(offsets, SLICE_BYTES):
                scores.append(m.score(*with_restored(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], channel)))
            values = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(values)], [*columns, "tox_score"])

    kinds = df.select(*columns).schema.add("tox_score", "double")
    return df.mapInArrow(run, kinds)


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    Null and empty texts have the score of a text without evidence.  Repeated rows
    are scored each; a null doc_id is held out by the crc32 of the empty text.  Labels
    of one id count as toxic if any is.  Without labelled rows all scores are near 0.
    """
    df = score_documents(documents, fit(documents, labels))
    return df.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), F.col("tox_score").alias("score"), F.when(F.col("tox_score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def reject_toxic(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score under ``threshold``, columns as given.

    Null and empty texts score as texts without evidence and stay; each of several
    repeated rows is judged by its own text; an empty table stays empty; columns of any
    name may come along.  Very long texts are scored whole."""
    packed = documents.select(F.struct("*").alias("row"), "text")
    df = score_documents(packed, fit(documents, labels), ["row"])
    return df.where(F.col("tox_score") < threshold).select("row.*")
