"""Mixing sources to target weights in a domain-language-source tree.

Native: aggregations, windows over tree nodes, and joins with per-leaf rows.

1. Leaf capacities (tokens times ``max_epochs``) are summed up the tree.
2. The budget goes down level by level: a node's tokens are shared among its children
   by weight; a child that cannot use its share gets its capacity, and its shortage
   goes to its siblings by weight.  As capacities of whole subtrees bound each share,
   only what a whole family cannot use reaches the families beside it.
3. A leaf's tokens come from seeded epochs: every epoch orders its documents by a
   hash of seed, epoch and id.  Whole epochs are taken as long as they fit, then a
   token prefix of the next one; the document at its end gives its first tokens.

The end of a prefix is found without sorting a leaf: tokens are summed in 4096 hash
buckets a leaf, a running sum finds the bucket in which the budget ends, and only
that bucket is ordered.  The decision on a document then needs its own hash and its
leaf's row, so the documents are never shuffled or sorted as a whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, materialize, md5_int
from .packing import word_count

BUCKETS = 4096
_HASH_DIGITS = 15
_SHIFT = 4 * _HASH_DIGITS - BUCKETS.bit_length() + 1

LEVELS = ("domain", "lang", "source")


def domain_of(source: Column) -> Column:
    """Domain of a source: the remainder of its number by 4, or ``other``."""
    number = F.regexp_extract(source, r"(\d{1,9})$", 1)
    return F.when(F.length(number) > 0, F.concat(F.lit("domain"), (F.try_to_number(number, F.lit("999999999")).cast("long") % 4).cast("string"))).otherwise("other")


@dataclass(frozen=True)
class Targets:
    """``share`` of all tokens to select; weights of nodes by level and name (a
    weight that is absent is 1, one of 0 takes nothing below the node); how often a
    document may be used."""

    share: float = 0.6
    max_epochs: int = 2
    seed: str = "mix"
    weights: dict[str, dict[str, int]] = field(default_factory=lambda: {"domain": {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}})


def _weight(level: str, targets: Targets) -> Column:
    found = F.lit(1)
    for name, weight in sorted(targets.weights.get(level, {}).items()):
        found = F.when(F.col(level) == name, weight).otherwise(found)
    return found.cast("double")


def share_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Add ``tokens``: the parent's ``given`` shared by ``weight`` within ``cap``.

    Children in order of cap/weight: the first ones whose cap is below the level
    that the rest would get are full; the others share what remains by weight.
    """
    w = Window.partitionBy(*parent)
    # A weight of 0 comes with a capacity of 0.
    ordered = w.orderBy(F.when(F.col("weight") > 0, F.try_divide("cap", "weight")).otherwise(0.0), name)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    df = nodes.withColumns({
        "_caps": F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "_rest": F.sum("weight").over(w) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    df = df.withColumn("_full", F.col("cap") * F.col("_rest") <= (F.col("given") - F.col("_caps")) * F.col("weight"))
    full_caps = F.coalesce(F.sum(F.when(F.col("_full"), F.col("cap"))).over(w), F.lit(0))
    open_weight = F.sum(F.when(~F.col("_full"), F.col("weight"))).over(w)
    share = F.floor(F.try_divide((F.col("given") - full_caps) * F.col("weight"), open_weight)).cast("long")
    return df.withColumn("tokens", F.when(F.col("_full"), F.col("cap")).otherwise(share)).drop("_caps", "_rest", "_full")


def budgets(leaves: DataFrame, targets: Targets) -> DataFrame:
    """Leaf rows (levels, available) with ``tokens`` granted by the tree."""
    barred = F.lit(False)
    for level, weights in targets.weights.items():
        barred = barred | F.col(level).isin([n for n, w in weights.items() if w == 0])
    cap = leaves.withColumn("cap", F.when(barred, 0).otherwise(F.col("available") * targets.max_epochs))
    total = leaves.agg(F.floor(F.sum("available") * targets.share).cast("long").alias("given"))
    level = cap.groupBy("domain").agg(F.sum("cap").alias("cap")).crossJoin(F.broadcast(total))
    caps = cap.agg(F.sum("cap").alias("_all"))
    level = level.crossJoin(F.broadcast(caps)).withColumn("given", F.least("given", "_all")).drop("_all")
    granted = share_out(level.withColumn("weight", _weight("domain", targets)).withColumn("_root", F.lit(0)), ["_root"], "domain")
    for depth in (2, 3):
        keys = list(LEVELS[:depth])
        parents = granted.select(*keys[:-1], F.col("tokens").alias("given"))
        nodes = cap.groupBy(*keys).agg(F.sum("cap").alias("cap")).join(parents, keys[:-1])
        granted = share_out(nodes.withColumn("weight", _weight(keys[-1], targets)), keys[:-1], keys[-1])
    return granted.select(*LEVELS, "tokens").join(leaves, list(LEVELS))


def _rank(seed: str, epoch: Column, doc: Column) -> Column:
    return md5_int(F.concat_ws(":", F.lit(seed), epoch, id_text(doc)), _HASH_DIGITS)


def _leaf(documents: DataFrame) -> DataFrame:
    """Documents with ``leaf`` (struct of the levels) and ``tokens_here``."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    leaf = F.struct(domain_of(source).alias("domain"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), source.alias("source"))
    return documents.select(F.struct("*").alias("row"), leaf.alias("leaf"), word_count(F.col("text")).alias("n_tokens"))


def decide(documents: DataFrame, targets: Targets) -> tuple[DataFrame, DataFrame]:
    """Slim document rows (doc_id, levels, n_tokens) and the decision of each leaf:
    ``whole`` epochs, and the rank, id and tokens at which the next one's prefix ends."""
    docs = materialize(_leaf(documents).select("row.doc_id", "leaf.*", "n_tokens"), "mixing")
    leaves = docs.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("available"))
    available = F.greatest("available", F.lit(1))
    plan = materialize(
        budgets(leaves, targets).select(
            *LEVELS,
            F.when(F.col("available") > 0, F.expr("tokens div greatest(available, 1)")).otherwise(0).cast("int").alias("whole"),
            F.when(F.col("available") > 0, F.col("tokens") % available).otherwise(0).cast("long").alias("rest"),
        ),
        "mixing-plan",
    )
    ranked = docs.join(plan, list(LEVELS)).withColumn("rank", _rank(targets.seed, F.col("whole"), F.col("doc_id"))).withColumn("bucket", F.shiftright("rank", _SHIFT).cast("int"))
    filled = ranked.groupBy(*LEVELS, "rest", "bucket").agg(F.sum("n_tokens").alias("n"))
    running = Window.partitionBy(*LEVELS).orderBy("bucket")
    filled = filled.withColumn("before", F.sum("n").over(running) - F.col("n"))
    # The bucket in which the prefix ends; there is none where nothing is left over.
    last = filled.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("n") >= F.col("rest"))).select(*LEVELS, "bucket", "before")
    units = ranked.join(last, [*LEVELS, "bucket"]).groupBy(*LEVELS, "rest", "before", "rank", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("copies"))
    order = Window.partitionBy(*LEVELS).orderBy("rank", F.col("doc_id").asc_nulls_first())
    units = units.withColumn("start", F.col("before") + F.sum("n").over(order) - F.col("n"))
    ends = units.where((F.col("start") < F.col("rest")) & (F.col("start") + F.col("n") >= F.col("rest"))).select(
        *LEVELS, F.col("rank").alias("end_rank"), F.col("doc_id").alias("end_id"), F.expr("(rest - start) div copies").alias("end_tokens")
    )
    return docs, plan.select(*LEVELS, "whole").join(ends, list(LEVELS), "left")


def _taken(doc: str, targets: Targets) -> dict[str, Column]:
    rank = _rank(targets.seed, F.col("whole"), F.col(doc))
    lowest = F.lit(-(2**63))
    same = F.col(doc).eqNullSafe(F.col("end_id"))
    before_end = (rank < F.col("end_rank")) | ((rank == F.col("end_rank")) & (F.coalesce(doc, lowest) < F.coalesce("end_id", lowest)) & ~same)
    prefix = F.when(F.col("end_rank").isNull(), 0).when(before_end, F.col("n_tokens")).when((rank == F.col("end_rank")) & same, F.least("end_tokens", "n_tokens")).otherwise(0)
    return {"epochs": F.col("whole"), "prefix_tokens": prefix.cast("long")}


def mix(documents: DataFrame, targets: Targets = Targets()) -> DataFrame:
    """Decide for every document: doc_id, domain, lang, source, n_tokens, epochs
    (whole uses), prefix_tokens (of one use more), taken_tokens.

    Documents without words, null texts included, have no tokens and are taken with
    their leaf's whole epochs only.  Null lang or source is the empty name.  Rows of
    one id are one document to the order: at the end of a prefix the tokens left are
    divided evenly among them.  An empty table gives an empty result.
    """
    docs, ends = decide(documents, targets)
    df = docs.join(ends, list(LEVELS)).withColumns(_taken("doc_id", targets))
    return df.select("doc_id", *LEVELS, "n_tokens", "epochs", "prefix_tokens", (F.col("epochs") * F.col("n_tokens") + F.col("prefix_tokens")).alias("taken_tokens"))


def mixed_documents(documents: DataFrame, targets: Targets = Targets()) -> DataFrame:
    """The documents as the mixture uses them, columns as given: one row for each
    whole epoch, and one with the first ``prefix_tokens`` words where that is more
    than none.  Texts are joined with one row a leaf, and stay where they are."""
    _, ends = decide(documents, targets)
    ends = ends.select(F.struct(*LEVELS).alias("leaf"), "whole", "end_rank", "end_id", "end_tokens")
    df = _leaf(documents).join(ends, "leaf").withColumn("doc", F.col("row.doc_id")).withColumns(_taken("doc", targets))
    # A part is null for a whole use, else the number of words to keep.
    parts = F.concat(F.array_repeat(F.lit(None).cast("long"), F.col("epochs")), F.when(F.col("prefix_tokens") > 0, F.array("prefix_tokens")).otherwise(F.expr("cast(array() as array<bigint>)")))
    df = df.select("row", "n_tokens", F.explode(parts).alias("part"))
    words = F.regexp_extract_all("row.text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.when(F.col("part") < F.col("n_tokens"), F.array_join(F.slice(words, F.lit(1), F.greatest(F.col("part"), F.lit(1)).cast("int")), "")).otherwise(F.col("row.text"))
    return df.select(*[(cut.alias("text") if c == "text" else F.col("row").getField(c).alias(c)) for c in documents.columns])


def oracle(targets: Targets = Targets()) -> str:
    """The same rows in DuckDB SQL over the table ``documents``."""

    def weight(level: str) -> str:
        cases = "".join(f" WHEN {level} = '{n}' THEN {w}" for n, w in sorted(targets.weights.get(level, {}).items()))
        return f"(CASE{cases} ELSE 1 END)::DOUBLE" if cases else "1::DOUBLE"

    def shared(source: str, parent: str, name: str, out: str) -> str:
        return f"""
{out}_a AS (SELECT *, {weight(name)} AS weight FROM {source}),
{out}_b AS (SELECT *, coalesce(sum(cap) OVER o, 0) AS caps, sum(weight) OVER p - coalesce(sum(weight) OVER o, 0) AS rest_weight FROM {out}_a
  WINDOW p AS (PARTITION BY {parent}), o AS (PARTITION BY {parent} ORDER BY cap / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{out}_c AS (SELECT *, cap * rest_weight <= (given - caps) * weight AS is_full FROM {out}_b),
{out} AS (SELECT * EXCLUDE (given), CASE WHEN is_full THEN cap ELSE floor((given - coalesce(sum(CASE WHEN is_full THEN cap END) OVER p, 0)) * weight / sum(CASE WHEN NOT is_full THEN weight END) OVER p)::BIGINT END AS tokens FROM {out}_c WINDOW p AS (PARTITION BY {parent}))"""

    rank = f"('0x' || substr(md5('{targets.seed}:' || whole || ':' || coalesce(doc_id::VARCHAR, '')), 1, {_HASH_DIGITS}))::BIGINT"
    return f"""WITH docs AS (
  SELECT doc_id, CASE WHEN regexp_extract(coalesce(source, ''), '(\\d{{1,9}})$', 1) <> '' THEN 'domain' || (regexp_extract(source, '(\\d{{1,9}})$', 1)::BIGINT % 4) ELSE 'other' END AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS available, sum(n_tokens)::BIGINT * {targets.max_epochs} AS cap FROM docs GROUP BY ALL),
top AS (SELECT domain, sum(cap)::BIGINT AS cap, (SELECT least(floor(sum(available) * {targets.share}::DOUBLE)::BIGINT, sum(cap)::BIGINT) FROM leaves) AS given, 0 AS root FROM leaves GROUP BY domain),{shared("top", "root", "domain", "d1")},
l2 AS (SELECT domain, l.lang, sum(l.cap)::BIGINT AS cap, any_value(d1.tokens) AS given FROM leaves l JOIN d1 USING (domain) GROUP BY domain, l.lang),{shared("l2", "domain", "lang", "d2")},
l3 AS (SELECT domain, lang, l.source, l.cap, l.available, d2.tokens AS given FROM leaves l JOIN d2 USING (domain, lang)),{shared("l3", "domain, lang", "source", "d3")},
plan AS (SELECT domain, lang, source, CASE WHEN available > 0 THEN tokens // greatest(available, 1) ELSE 0 END AS whole, CASE WHEN available > 0 THEN tokens % greatest(available, 1) ELSE 0 END AS rest FROM d3),
ranked AS (SELECT docs.*, whole, rest, {rank} AS rank FROM docs JOIN plan USING (domain, lang, source)),
placed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY rank, doc_id) - n_tokens AS start FROM ranked)
SELECT doc_id, domain, lang, source, n_tokens, whole::INTEGER AS epochs, greatest(0, least(n_tokens, rest - start))::BIGINT AS prefix_tokens,
  (whole * n_tokens + greatest(0, least(n_tokens, rest - start)))::BIGINT AS taken_tokens FROM placed"""
