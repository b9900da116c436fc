"""Document fingerprints from closed syncmers.

Native: regular expressions, array functions and one shuffle of the texts.

A text is read as tokens that end where their own characters say so: after one of some
letters and digits or a character of the East Asian scripts, at the end of a word with
the white space after it, and else after eight characters.  Together they are the text,
and an insertion moves no token beyond the next such end, also in text without spaces.
A k-mer of tokens is an anchor if the smallest hash
among its s-mers stands at one of its ends.  Whether a k-mer is chosen depends on its
own tokens alone, so any stretch of text has the same anchors wherever it stands, and
two texts that share a stretch share its anchors at a constant offset (``align``).

A fingerprint is the ``SKETCH`` smallest distinct anchor hashes of the whole text, in
order, each 12 hex digits; likeness is the Jaccard estimate of two such sketches.  A
text without an anchor, as one under ``K`` tokens, is sketched by its own hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let

#: Characters that end a token.
ENDS = r"aeoAEO0369\x{2E80}-\x{10FFFF}"
TOKEN = rf"[^\s{ENDS}]{{0,7}}[{ENDS}]\s*|[^\s{ENDS}]{{1,8}}\s*|\s+"
K, S = 5, 2
SKETCH = 64
_LOWEST = -(2**63)

#: Rows a bucket of neighbouring ids should hold.  Their bounds are the only thing that
#: is kept of the ids (0.5 MB at most): of 65536 buckets, each holds some 1.5 GB of 100 TB.
#: A bucket is sorted and streamed, and spills if it is larger than memory.
BUCKET_ROWS = 5_000
MOST_BUCKETS = 65_536


def _mask(h: Column) -> Column:
    return F.shiftrightunsigned(h, 16)


def anchors(text: Column) -> Column:
    """Array of (hash, pos) of a text's anchors; pos counts tokens from 0."""

    def pairs(h):
        return F.zip_with(h, F.slice(h, F.lit(2), F.greatest(F.size(h) - 1, F.lit(0))), lambda x, y: F.xxhash64(x, y))

    def chosen(m):
        first, second, third, last = (lambda i, d=d: F.get(m, i + d) for d in range(K - S + 1))
        at_edge = lambda i: F.least(first(i), last(i)) <= F.least(second(i), third(i))
        # The last s-mer of the array lacks its second token and begins no k-mer.
        starts = F.filter(F.sequence(F.lit(0), F.size(m) - K), at_edge)
        return F.transform(starts, lambda i: F.struct(_mask(F.xxhash64(first(i), third(i), last(i))).alias("hash"), i.alias("pos")))

    none = F.expr("cast(array() as array<struct<hash:bigint,pos:int>>)")
    hashes = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda x: F.xxhash64(x))
    return let(hashes, lambda h: F.when(F.size(h) < K, none).otherwise(let(pairs(h), chosen)))


def _smallest(hashes: Column) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, SKETCH)


def sketch(hashes: Column, text: Column) -> Column:
    """Smallest anchor hashes, or the text's own hash where it has none."""
    return let(_smallest(hashes), lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(_mask(F.xxhash64(text)))))


def fingerprint(sketch_: Column) -> Column:
    return F.lower(F.array_join(F.transform(sketch_, lambda h: F.lpad(F.hex(h), 12, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard estimate: of the smallest hashes of both, the part that both have."""
    return let(F.slice(F.sort_array(F.array_union(a, b)), 1, SKETCH), lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u))


def align(left: DataFrame, right: DataFrame, text: str = "text", key: str = "pair") -> DataFrame:
    """Positional matching of pairs of texts that share ``key``: the offset that most
    common anchors agree on, how many do, and the span of left tokens they cover."""

    def placed(df, side):
        return df.select(key, F.explode(anchors(F.coalesce(F.col(text), F.lit("")))).alias("a")).select(key, "a.hash", F.col("a.pos").alias(side)).distinct()

    both = placed(left, "l").join(placed(right, "r"), [key, "hash"])
    lines = both.groupBy(key, (F.col("r") - F.col("l")).alias("offset")).agg(F.count("*").alias("anchors"), F.min("l").alias("start"), (F.max("l") + K).alias("end"))
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("anchors"), "offset"))
    return lines.withColumn("_n", best).where("_n = 1").drop("_n")


def _bounds(ids: DataFrame) -> list[int]:
    """First ids of buckets of about equal size; their number is bounded."""
    low, rows = ids.agg(F.min("id"), F.count("*")).first()
    n = min(MOST_BUCKETS, max(1, rows // BUCKET_ROWS))
    if n == 1:
        return [low if low is not None else 0]
    cuts = ids.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 10 * n)).first()[0]
    return sorted({low, *cuts})


def _longs(values: list[int]) -> Column:
    """A constant array, written as one text rather than as a literal for each value."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _bucket(value: Column, bounds: list[int]) -> Column:
    """Index of the last bound that is not above ``value``, in two steps of as many
    comparisons as the root of their number."""
    step = max(1, int(len(bounds) ** 0.5))
    at = lambda a: F.size(F.filter(a, lambda b: b <= value)) - 1
    outer, inner = _longs(bounds[::step]), _longs(bounds)
    return let(at(outer), lambda o: o * step + at(F.slice(inner, o * step + 1, step)))


def with_next(df: DataFrame, columns: list[str], tie: str) -> DataFrame:
    """Add ``next``, a struct of ``columns`` of the following row by ``id`` (then
    ``tie``), after the last row those of the first.

    Rows go to buckets of neighbouring ids; the first rows of a bucket also go to
    the bucket before it, where they only serve as the next of its last row.
    """
    bounds = _bounds(df.select("id"))
    n = len(bounds)
    first = _longs(bounds)
    df = df.withColumn("_b", _bucket(F.col("id"), bounds))
    here = F.struct(F.col("_b").alias("b"), F.lit(0).alias("look"))
    ahead = F.struct(F.pmod(F.col("_b") - 1, F.lit(n)).alias("b"), F.lit(1).alias("look"))
    df = df.withColumn("_to", F.explode(F.when(F.get(first, F.col("_b")) == F.col("id"), F.array(here, ahead)).otherwise(F.array(here))))
    w = Window.partitionBy("_to.b").orderBy("_to.look", "id", tie)
    return df.withColumn("next", F.lead(F.struct(*columns)).over(w)).where("_to.look = 0").drop("_b", "_to")


def text_sketch(text: Column) -> Column:
    return sketch(F.transform(anchors(text), lambda a: a["hash"]), text)


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next.

    The edited text has its last floor(n_chars/4) code points replaced by as many (or
    all) first ones of the next document.  Null texts are empty; a null id comes first;
    rows of one id are in order of their texts; a single row is its own next.  Texts of
    any length are read whole; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    df = documents.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("id"), text.alias("text"))
    df = with_next(df.withColumn("sketch", text_sketch(F.col("text"))), ["text", "sketch"], "text")
    n = F.length("text")
    q = F.floor(n / 4).cast("int")
    df = df.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - q), F.substring(F.col("next.text"), F.lit(1), q)))
    df = df.withColumn("edited_sketch", text_sketch(F.col("edited")))
    return df.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sketch")).alias("fingerprint"),
        fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next.sketch")).alias("near_next"),
    )
