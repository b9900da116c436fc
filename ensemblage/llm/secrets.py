"""Secret scans: fixed patterns, and a randomness test battery on other tokens.

Native: regular expressions, array functions and one small aggregation.

Runs of 20 or more characters from ``[A-Za-z0-9+/_=-]`` are candidates.  The smallest
alphabet that holds a token is its inferred encoding (hex, base 32, letters and digits,
base 64).  Three statistics are taken: chi-squared uniformity over the alphabet, the
number of runs of lower-case letters and others (in one-case alphabets, of letters and
digits), and the serial correlation of neighbouring symbols about the alphabet's middle.

A token that differs from a random one by more than ``ALPHA_Z`` deviations in any of them
is none.  What is left is tested against what an ordinary token of its encoding would
give: letters at their usual frequencies (in hex, digits), which stay in their class and
change it with probability ``CHANGE``.  The three p-values towards randomness are joined
by Fisher's method, scaled for their dependence after Brown, and Benjamini-Hochberg
step-up control at level ``FDR`` runs within each stratum of encoding and length (log2),
over all candidates of all documents.  It works on a histogram of -log10 p in hundredths,
whose size is bounded by strata times bins, whatever the corpus.

Null and empty texts have no spans; repeated rows are each scanned; an empty table gives
an empty result.  A token inside or across a base span adds nothing.  Letters of one case
alone are not told from words.  Long texts with many matches take time that grows with
the matches to the power 1.5: places are summed in blocks (``prefix_sums``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, materialize

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Runs of their characters that are long enough; same spans as the open patterns
# followed by the length test, as their matches are whole runs.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"

ALPHA_Z = 3.29  # two-sided 0.001
CHANGE = 0.12
FDR = 0.01
BINS = 4000
#: Brown's scale of Fisher's sum: runs and serial correlation go together.
DEPENDENCE = 1.3

# Usual frequencies of the letters a to z in English text, in per cent.
LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)

_DIGITS, _UPPER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()


class Encoding:
    """An alphabet, the symbols (``first`` to ``last``) whose runs are counted, and what
    an ordinary token gives: ``usual`` frequencies from the symbol ``at`` on."""

    def __init__(self, pattern: str, alphabet: str, ones: str, at: str, usual: tuple[float, ...]):
        self.pattern, self.alphabet, self.size = pattern, alphabet, float(len(alphabet))
        self.first, self.last = alphabet.index(ones[0]), alphabet.index(ones[-1])
        self.side = len(ones) / len(alphabet)
        self.middle, self.spread = (self.size - 1) / 2, (self.size**2 - 1) / 12
        q = [u / sum(usual) for u in usual]
        x = [(alphabet.index(at) + k - self.middle) / self.spread**0.5 for k in range(len(q))]
        self.equal, self.triple = sum(p**2 for p in q), sum(p**3 for p in q)
        self.mean = sum(p * v for p, v in zip(q, x))
        self.variance = sum(p * v * v for p, v in zip(q, x)) - self.mean**2


#: From the smallest alphabet on; the last one takes what no other holds.
ENCODINGS = (
    Encoding("^[0-9a-f]+$", _DIGITS + "abcdef", "abcdef", "0", (1.0,) * 10),
    Encoding("^[0-9A-F]+$", _DIGITS + "ABCDEF", "ABCDEF", "0", (1.0,) * 10),
    Encoding("^[A-Z2-7]+$", "234567" + _UPPER, _UPPER, "A", LETTERS),
    Encoding("^[A-Za-z0-9]+$", _DIGITS + _UPPER + _LOWER, _LOWER, "a", LETTERS),
    Encoding("", _DIGITS + _UPPER + _LOWER + "+/", _LOWER, "a", LETTERS),
)

#: Kinds in the order that the contract lists them; the battery's comes last.
KINDS = ("assign", "access", "hex", "random")

_SPAN = "struct<start:int,end:int,kind:int,token:string>"


def _in_blocks(array: Column, body) -> Column:
    """``body`` of an array and the size of its blocks, about the root of its own."""
    return let(array, lambda x: let(F.greatest(F.ceil(F.sqrt(F.size(x))).cast("int"), F.lit(1)), lambda size: body(x, size)))


def _blocks(array: Column, size: Column) -> Column:
    none = F.slice(F.array(array), F.lit(1), F.lit(0))
    return F.when(F.size(array) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(array) - 1) / size).cast("int")), lambda b: F.slice(array, b * size + 1, size))).otherwise(none)


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0), lambda t, v: t + v)


def prefix_sums(lengths: Column) -> Column:
    """The sum of all that stands before each element."""

    def summed(array, size):
        def placed(blocks):
            sums = F.transform(blocks, _sum)
            before = let(sums, lambda s: F.transform(s, lambda _, b: _sum(F.slice(s, F.lit(1), b))))
            return F.flatten(F.zip_with(blocks, before, lambda x, at: F.transform(x, lambda _, i: at + _sum(F.slice(x, F.lit(1), i)))))

        return let(_blocks(array, size), placed)

    return _in_blocks(lengths, summed)


def _matches(text: Column, pattern: str, kind: int, group: int | None = None) -> Column:
    """Spans of all leftmost matches, in code points: the pieces between matches
    and the matches add up to the text, so their lengths give the positions."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    size = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole

    def placed(found):
        def spans(pieces):
            steps = F.zip_with(pieces, found["w"], lambda p, w: F.length(p) + F.length(w))
            rows = F.arrays_zip(prefix_sums(steps).alias("at"), pieces.alias("p"), found["w"].alias("w"), found["g"].alias("g"))
            return F.transform(
                F.filter(rows, lambda m: F.length(m["g"]) >= 8) if group else rows,
                lambda m: F.struct(
                    (m["at"] + F.length(m["p"])).alias("start"),
                    (m["at"] + F.length(m["p"]) + F.length(m["w"])).alias("end"),
                    F.lit(kind).alias("kind"),
                    m["w"].alias("token"),
                ),
            )

        return let(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found["w"])), spans)

    empty = F.expr("array()").cast(f"array<{_SPAN}>")
    return F.when(text.rlike(pattern), let(F.struct(whole.alias("w"), size.alias("g")), placed).cast(f"array<{_SPAN}>")).otherwise(empty)


def outside(spans: Column, others: Column) -> Column:
    """The spans that none of the ``others`` touches.  These are sorted and put into
    blocks, so that a span is held against few of them."""

    def tested(array, size):
        def bounded(part):
            return F.struct(part.alias("part"), F.get(part, F.lit(0))["start"].alias("lo"), F.array_max(F.transform(part, lambda x: x["end"])).alias("hi"))

        def touches(a, start, end):
            return (start < a["end"]) & (a["start"] < end)

        def free(blocks):
            near = lambda a, b: (b["lo"] < a["end"]) & (a["start"] < b["hi"])
            return F.filter(spans, lambda a: ~F.exists(blocks, lambda b: near(a, b) & F.exists(b["part"], lambda x: touches(a, x["start"], x["end"]))))

        return let(F.transform(_blocks(array, size), bounded), free)

    return _in_blocks(F.array_sort(F.transform(others, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))), tested)


def _encoding(token: Column) -> Column:
    """Number of a token's encoding, from 1."""
    bare = F.rtrim(token, F.lit("="))
    found = F.lit(len(ENCODINGS))
    for k, e in reversed(list(enumerate(ENCODINGS[:-1], 1))):
        found = F.when(bare.rlike(e.pattern), k).otherwise(found)
    return found


def _of(encoding: Column, value) -> Column:
    return F.element_at(F.array(*[F.lit(value(e)) for e in ENCODINGS]), encoding)


def _ranks(token: Column, encoding: Column) -> Column:
    """Ranks of a token's characters in its inferred alphabet."""
    alphabet = _of(encoding, lambda e: e.alphabet)
    return F.transform(F.split(F.translate(F.rtrim(token, F.lit("=")), "-_", "+/"), ""), lambda c: F.instr(alphabet, c).cast("double") - 1)


def _log_tail(z: Column) -> Column:
    """Log of the upper tail of the normal law, 2 exp(-z^2/2) / (sqrt(2 pi) (z +
    sqrt(z^2 + 8/pi))) for positive z."""

    def upper(x):
        return -x * x / 2 - F.log(x + F.sqrt(x * x + 8 / math.pi)) + math.log(2 / math.sqrt(2 * math.pi))

    return F.when(z > 0, upper(z)).otherwise(F.log(F.greatest(1 - F.exp(upper(-z)), F.lit(1e-12))))


def battery(token: Column) -> Column:
    """Struct of encoding, stratum, the z values of the three tests against a random
    token, and ``bin``: hundredths of -log10 of the joint p-value against an ordinary
    one.  Of a token that is nothing but padding all z values are beyond any bound."""

    def tests(e):
        sides = lambda r: F.transform(r, lambda v: ((v >= _of(e, lambda x: float(x.first))) & (v <= _of(e, lambda x: float(x.last)))).cast("int"))
        return let(_ranks(token, e), lambda r: let(sides(r), lambda s: let(statistics(e, r, s), lambda x: judged(e, x))))

    def neighbours(array, of):
        return F.zip_with(F.slice(array, F.lit(1), F.size(array) - 1), F.slice(array, F.lit(2), F.size(array) - 1), of)

    def statistics(e, r, sides):
        total = lambda array: F.aggregate(array, F.lit(0.0), lambda t, v: t + v)
        middle = _of(e, lambda x: x.middle)
        squares = total(F.transform(F.array_distinct(r), lambda v: F.pow(F.size(F.filter(r, lambda x: x == v)).cast("double"), F.lit(2.0))))
        changes = total(neighbours(sides, lambda x, y: (x != y).cast("double")))
        lagged = total(neighbours(r, lambda x, y: (x - middle) * (y - middle)))
        return F.struct(F.size(r).cast("double").alias("n"), squares.alias("squares"), changes.alias("changes"), (lagged / _of(e, lambda x: x.spread)).alias("lagged"))

    def judged(e, x):
        n, a = x["n"], _of(e, lambda x: x.size)
        pairs = n - 1
        # Against a random token.
        chi = (a / n * x["squares"] - n - (a - 1)) / F.sqrt(2 * (a - 1))
        pq = _of(e, lambda x: x.side * (1 - x.side))
        runs = (x["changes"] - pairs * 2 * pq) / F.sqrt(pairs * 2 * pq * (1 - 2 * pq) + 2 * (pairs - 1) * (pq - 4 * pq * pq))
        serial = x["lagged"] / F.sqrt(pairs)
        # Against an ordinary one; positive towards randomness.
        equal, triple = _of(e, lambda x: x.equal), _of(e, lambda x: x.triple)
        coincidences = (x["squares"] - n) / (n * pairs)
        z_chi = (equal - coincidences) / F.sqrt((2 * (equal - equal * equal) + 4 * (n - 2) * (triple - equal * equal)) / (n * pairs))
        z_runs = (x["changes"] - 0.5 - pairs * CHANGE) / F.sqrt(pairs * CHANGE * (1 - CHANGE))
        mean2, variance = _of(e, lambda x: x.mean**2), _of(e, lambda x: x.variance)
        z_serial = (mean2 - x["lagged"] / pairs) / F.sqrt((variance * variance + 4 * mean2 * variance) / pairs)
        half = -(_log_tail(z_chi) + _log_tail(z_runs) + _log_tail(z_serial)) / DEPENDENCE
        # Upper tail of chi-squared with six degrees of freedom.
        tail = (half - F.log(1 + half + half * half / 2)) / math.log(10)
        short, far = n < 3, F.lit(99.0)
        return F.struct(
            e.alias("encoding"),
            F.when(short, far).otherwise(chi).alias("chi_z"),
            F.when(short, far).otherwise(runs).alias("runs_z"),
            F.when(short, far).otherwise(serial).alias("serial_z"),
            F.floor(F.log2(n)).cast("int").alias("stratum"),
            F.when(short, 0).otherwise(F.least(F.greatest(F.floor(tail * 100), F.lit(0)), F.lit(BINS - 1))).cast("int").alias("bin"),
        )

    return let(_encoding(token), tests)


def thresholds(tested: DataFrame) -> DataFrame:
    """Benjamini-Hochberg step-up by stratum: the smallest bin that is discovered.

    ``tested``: encoding, stratum, bin.  A bin's p-value is its upper end."""
    counts = tested.groupBy("encoding", "stratum", "bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy("encoding", "stratum")
    ranked = counts.withColumn("rank", F.sum("n").over(w.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0))).withColumn("tests", F.sum("n").over(w))
    found = ranked.where(F.pow(F.lit(10.0), -F.col("bin") / 100.0) <= FDR * F.col("rank") / F.col("tests"))
    return found.groupBy("encoding", "stratum").agg(F.min("bin").alias("least_bin"))


def find_secrets(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    The scan of the texts is kept as a slim table (ids, spans, tested tokens), so
    texts are read once and never shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    df = documents.select("doc_id", text.alias("_t")).select(
        "doc_id",
        F.concat(_matches(F.col("_t"), ASSIGN, 0, 2), _matches(F.col("_t"), ACCESS, 1), _matches(F.col("_t"), HEX, 2)).alias("base"),
        _matches(F.col("_t"), TOKEN, 3).alias("other"),
    )
    # No id is assumed unique; rows with tests get one for the way back.
    other = outside(F.col("other"), F.col("base"))
    tested = F.transform(other, lambda s: F.struct(s["start"], s["end"], battery(s["token"]).alias("t")))
    slim = materialize(
        df.select(
            "doc_id",
            F.transform("base", lambda s: F.struct(s["start"], s["kind"], s["end"])).alias("base"),
            F.when(F.size("other") > 0, tested).alias("tested"),
        ),
        "secrets",
    )
    least = thresholds(slim.where("tested is not null").select(F.explode("tested").alias("x")).select("x.t.*"))
    # One row, as a map: at most 5 encodings times 31 strata.
    table = least.agg(F.map_from_entries(F.collect_list(F.struct((F.col("encoding") * 100 + F.col("stratum")).alias("k"), F.col("least_bin").alias("v")))).alias("least"))
    joined = slim.crossJoin(F.broadcast(table))
    passing = F.filter(
        F.coalesce("tested", F.expr("array()").cast("array<struct<start:int,end:int,t:struct<encoding:int,chi_z:double,runs_z:double,serial_z:double,stratum:int,bin:int>>>")),
        lambda s: (s["t"]["chi_z"] < ALPHA_Z)
        & (F.abs(s["t"]["runs_z"]) < ALPHA_Z)
        & (F.abs(s["t"]["serial_z"]) < ALPHA_Z)
        & (s["t"]["bin"] >= F.coalesce(F.try_element_at("least", s["t"]["encoding"] * 100 + s["t"]["stratum"]), F.lit(BINS))),
    )
    extra = F.transform(passing, lambda s: F.struct(s["start"], F.lit(3).alias("kind"), s["end"]))
    kinds = F.array(*map(F.lit, KINDS))

    def joined_text(spans):
        return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return joined.select("doc_id", "base", extra.alias("extra")).select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined_text(F.col("base")), 256).alias("base_sha256"),
        joined_text(F.concat("base", "extra")).alias("spans"),
        F.size("extra").cast("long").alias("n_random"),
    )
