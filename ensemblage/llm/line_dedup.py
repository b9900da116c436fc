"""Line dedup by content-defined chunks of lines.

Native: array functions, aggregations, windows over one document's lines, and joins.

Lines without a word are passed over.  A rolling hash over the hashes of two neighbouring
lines stands for the gap between them.  Where the rolling hash of a gap occurs again, its
two lines may be repeated; a line of ``LONG_WORDS`` words or more may be by itself.  What
may be repeated is compared byte for byte: equal lines get one name, the place of the first
of them, and a gap's *anchor* is the first place (smallest doc_id, then place) where its
two lines stand together.

A chunk is a longest stretch of lines whose anchors follow each other, gap by gap, in one
document.  Its boundaries are where the anchor of the next gap is elsewhere; they depend on
the lines beside the gap, shift with the text around them, and lie at the very ends of a
passage that was copied.  So a chunk stands whole, byte for byte, in one document, and is
never put together from several.  Chunks that are not their own anchors go if they have
``LEAST_WORDS`` words; blank lines inside go with them.  The first occurrence of a line's
text always stays.  A passage that occurs twice in one document loses its second place.

(Boundaries by a residue or a local minimum of the rolling hash leave no whole chunk inside
most passages of two or three lines: the gaps at the passage's ends have outside lines in
their hashes, and what lies between two boundaries then differs from copy to copy.)

Hashes are counted before any text moves.  The repeated hashes are broadcast while they
are few (``BROADCAST_ROWS``, counted first), else joined.  Lines move once, to get their
names; what follows has names only.  A hash, line or gap that occurs often does not gather
in one task: it is summed before it moves, and what is joined comes straight from an
exchange, whose large partitions adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, let, materialize, md5_int

LONG_WORDS = 50
#: Shorter stretches are common phrases rather than copies.
LEAST_WORDS = 20
_FACTOR = 0x100000001B3
_LAST = 2**63 - 1
BROADCAST_ROWS = 1_000_000


def _line_hash(x: Column) -> Column:
    return F.xxhash64(x)


def _pair_hash(a: Column, b: Column) -> Column:
    """The rolling hash of two neighbours: 63 mixed bits, never negative."""
    return F.pmod(F.xxhash64(a["h"], b["h"]), F.lit(_LAST))


def _own_hash(a: Column) -> Column:
    """Of a line by itself; always negative."""
    return -1 - F.pmod(a["h"], F.lit(_LAST))


def _marks(text: Column) -> Column:
    """Array of (i, x, h): the lines that hold a word, their places and hashes."""

    def worded(lines):
        return F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda m: m["x"].rlike(WORD))

    return F.transform(let(F.split(text, "\n", -1), worded), lambda m: F.struct(m["i"].alias("i"), m["x"].alias("x"), _line_hash(m["x"]).alias("h")))


def _may_be_long(a: Column) -> Column:
    """50 words have 99 characters at least; the words are counted of repeated lines."""
    return F.length(a["x"]) >= 2 * LONG_WORDS - 1


def _next(marks: Column) -> Column:
    return F.slice(marks, F.lit(2), F.greatest(F.size(marks) - 1, F.lit(0)))


def _hashes(text: Column) -> Column:
    """The hashes of all gaps and long lines of a text."""
    pairs = lambda m: F.transform(_next(m), lambda b, k: _pair_hash(F.get(m, k), b))
    lines = lambda m: F.transform(F.filter(m, _may_be_long), _own_hash)
    return let(_marks(text), lambda m: F.concat(pairs(m), lines(m)))


def _units(text: Column) -> Column:
    """Array of (hash, lines): for each gap its two lines, for each line that may be long
    itself; a line is (k, i, x, h), where ``k`` counts lines with a word and ``i`` all."""

    def line(a, k):
        return F.struct(k.alias("k"), a["i"].alias("i"), a["x"].alias("x"), a["h"].alias("h"))

    def both(m):
        pairs = F.transform(_next(m), lambda b, k: let(F.get(m, k), lambda a: F.struct(_pair_hash(a, b).alias("hash"), F.array(line(a, k), line(b, k + 1)).alias("lines"))))
        lines = F.filter(F.transform(m, line), _may_be_long)
        return F.concat(pairs, F.transform(lines, lambda a: F.struct(_own_hash(a).alias("hash"), F.array(a).alias("lines"))))

    return let(_marks(text), both)


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id")


def _key() -> Column:
    return md5_int(F.col("text")).alias("key")


def _islands(rows: DataFrame, *part: str) -> Column:
    """A number for each stretch of consecutive ``k`` in a part, whose ``k`` are distinct."""
    return F.col("k") - F.row_number().over(Window.partitionBy(*part).orderBy("k"))


def removals(documents: DataFrame) -> DataFrame:
    """(id, key, ranges): the lines that each text loses, as sorted (first, last)."""
    texts = documents.select("doc_id", "text").where("text is not null")
    hashes = texts.select(F.explode(_hashes(F.col("text"))).alias("hash"))
    seen = materialize(hashes.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "line-hashes")
    every = texts.select(_id(), _key(), F.explode(_units(F.col("text"))).alias("u")).select("id", "key", "u.*")
    few = F.broadcast(seen) if seen.count() <= BROADCAST_ROWS else seen
    found = every.join(few, "hash").select("id", "key", F.explode("lines").alias("l")).select("id", "key", "l.*")
    found = materialize(found, "line-found")
    # Equal lines get one name.  Rows of one id and text are one document.
    place = F.struct("id", "key", "k")
    named = found.groupBy("h", "x").agg(F.min(place).alias("name"))
    named = named.withColumn("words", F.coalesce(F.regexp_count("x", F.lit(WORD)), F.lit(0)))
    lines = found.join(named, ["h", "x"]).select("id", "key", "k", "i", "words", "name").dropDuplicates(["id", "key", "k"])
    ahead = Window.partitionBy("id", "key").orderBy("k")
    nothing = F.lit(None).cast(named.schema["name"].dataType)
    after = F.when(F.lead("k").over(ahead) == F.col("k") + 1, F.lead("name").over(ahead))
    lines = materialize(lines.withColumn("after", after), "line-names")
    gap = lambda second: F.struct(F.col("name").alias("a"), second.alias("b")).alias("gap")
    gaps = lines.where("after is not null").select("id", "key", "k", gap(F.col("after")))
    units = gaps.unionByName(lines.where(F.col("words") >= LONG_WORDS).select("id", "key", "k", gap(nothing)))
    anchors = units.groupBy("gap").agg(F.min(place).alias("anchor"))
    units = materialize(units.join(anchors, "gap").select("gap", "id", "key", "k", "anchor"), "line-units")
    # Of one id no text is earlier; there an anchor is the place before in the text itself.
    elsewhere = units.where("id <> anchor.id").select("id", "key", "k", F.struct("gap.b").alias("pair"), F.col("anchor.id").alias("of_id"), F.col("anchor.key").alias("of_key"), (F.col("k") - F.col("anchor.k")).alias("shift"))
    before = F.lag("k").over(Window.partitionBy("gap", "id", "key").orderBy("k"))
    again = units.where("id = anchor.id").withColumn("before", before).where("before is not null")
    again = again.select("id", "key", "k", F.struct("gap.b").alias("pair"), F.col("id").alias("of_id"), F.col("key").alias("of_key"), (F.col("k") - F.col("before")).alias("shift"))
    step = F.explode(F.when(F.col("pair.b").isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1))))
    covered = elsewhere.unionByName(again).withColumn("step", step).select("id", "key", "of_id", "of_key", "shift", (F.col("k") + F.col("step")).alias("k")).distinct()
    covered = covered.join(lines.select("id", "key", "k", "i", "words"), ["id", "key", "k"])
    chunk = ["id", "key", "of_id", "of_key", "shift"]
    covered = covered.withColumn("chunk", _islands(covered, *chunk))
    total = F.sum("words").over(Window.partitionBy(*chunk, "chunk"))
    lost = covered.withColumn("total", total).where(F.col("total") >= LEAST_WORDS).select("id", "key", "k", "i").distinct()
    ranges = lost.withColumn("run", _islands(lost, "id", "key")).groupBy("id", "key", "run").agg(F.struct(F.min("i").alias("lo"), F.max("i").alias("hi")).alias("range"))
    return ranges.groupBy("id", "key").agg(F.array_sort(F.collect_list("range")).alias("ranges"))


def _cut(documents: DataFrame) -> DataFrame:
    """row (struct of the document), new (struct of its text and its lines left)."""
    lost = removals(documents)
    rows = documents.select(F.struct("*").alias("row"), _id(), _key())
    df = rows.join(lost, ["id", "key"], "left")
    text = F.col("row.text")

    def kept(lines):
        opens = F.concat(F.array(F.lit(0)), F.transform("ranges", lambda r: r["hi"] + 1))
        closes = F.concat(F.transform("ranges", lambda r: r["lo"]), F.array(F.size(lines)))
        return F.flatten(F.zip_with(opens, closes, lambda a, b: F.slice(lines, a + 1, b - a)))

    whole = F.struct(text.alias("text"), F.size(F.split(text, "\n", -1)).alias("left"))
    cut = let(let(F.split(text, "\n", -1), kept), lambda k: F.struct(F.array_join(k, "\n").alias("text"), F.size(k).alias("left")))
    return df.select("row", F.when(F.col("ranges").isNull(), whole).otherwise(cut).alias("new"))


def dedup_lines(documents: DataFrame) -> DataFrame:
    """The documents without repeated chunks, columns as given.

    A null text stays null; a text that loses all its lines is empty.  Rows of one id
    and text count as one document, and texts of one id keep their first occurrences
    each.  A null id comes after all others.  Very long texts are cut whole, in time
    that grows with their lines.  An empty table stays empty.
    """
    columns = [F.col("new.text").alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in documents.columns]
    return _cut(documents).select(*columns)


def report(documents: DataFrame) -> DataFrame:
    """doc_id, text, n_lines, removed_lines; a null text has no lines."""
    text = F.col("row.text")
    lines = F.coalesce(F.size(F.split(text, "\n", -1)), F.lit(0))
    removed = F.when(text.isNull(), 0).otherwise(lines - F.col("new.left"))
    return _cut(documents).select("row.doc_id", "new.text", lines.cast("long").alias("n_lines"), removed.cast("long").alias("removed_lines"))


def oracle() -> str:
    """The same rows in DuckDB SQL over the table ``documents``."""
    word = r"[^\x20\x09-\x0D]"
    return f"""WITH docs AS (SELECT row_number() OVER () AS r, coalesce(doc_id, {_LAST}) AS id, doc_id, text, ('0x' || substr(md5(text), 1, 15))::BIGINT AS key FROM documents),
split AS (SELECT r, id, key, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM docs WHERE text IS NOT NULL),
worded AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY i) AS k, len(regexp_extract_all(line, '{word}+')) AS words FROM split WHERE regexp_matches(line, '{word}')),
pairs AS (SELECT *, lead(line) OVER w AS line_b FROM worded WINDOW w AS (PARTITION BY r ORDER BY i)),
units AS (SELECT DISTINCT id, key, k, 1 AS size, line || chr(10) || line_b AS bytes FROM pairs WHERE line_b IS NOT NULL UNION ALL SELECT DISTINCT id, key, k, 0, line FROM worded WHERE words >= {LONG_WORDS}),
anchored AS (SELECT *, min({{'id': id, 'key': key, 'k': k}}) OVER (PARTITION BY bytes) AS anchor, lag(k) OVER (PARTITION BY bytes, id, key ORDER BY k) AS before FROM units),
hits AS (SELECT id, key, k, size, CASE WHEN id <> anchor.id THEN anchor.id ELSE id END AS of_id, CASE WHEN id <> anchor.id THEN anchor.key ELSE key END AS of_key, CASE WHEN id <> anchor.id THEN k - anchor.k ELSE k - before END AS shift FROM anchored WHERE id <> anchor.id OR before IS NOT NULL),
covered AS (SELECT id, key, of_id, of_key, shift, k FROM hits UNION SELECT id, key, of_id, of_key, shift, k + 1 FROM hits WHERE size = 1),
chunks AS (SELECT c.*, w.i, w.words, c.k - row_number() OVER (PARTITION BY c.id, c.key, of_id, of_key, shift ORDER BY c.k) AS chunk FROM covered c JOIN (SELECT DISTINCT id, key, k, i, words FROM worded) w ON c.id = w.id AND c.key = w.key AND c.k = w.k),
lost AS (SELECT DISTINCT id, key, k, i FROM (SELECT *, sum(words) OVER (PARTITION BY id, key, of_id, of_key, shift, chunk) AS total FROM chunks) WHERE total >= {LEAST_WORDS}),
runs AS (SELECT id, key, min(i) AS lo, max(i) AS hi FROM (SELECT *, k - row_number() OVER (PARTITION BY id, key ORDER BY k) AS run FROM lost) GROUP BY id, key, run),
kept AS (SELECT s.r, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE lo IS NULL) AS text, count(lo) AS removed, count(*) AS n_lines FROM split s LEFT JOIN runs ON runs.id = s.id AND runs.key = s.key AND i BETWEEN lo AND hi GROUP BY s.r)
SELECT docs.doc_id, CASE WHEN docs.text IS NOT NULL THEN coalesce(kept.text, '') END AS text, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(removed, 0)::BIGINT AS removed_lines FROM docs LEFT JOIN kept USING (r)"""
