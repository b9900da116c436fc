"""Repair of conversations by error-correcting Earley parsing.

A well-formed conversation has an optional system turn and then pairs of a user's and an
assistant's turn, or no turn at all.  As a left-linear grammar (``PRODUCTIONS``; ``empty``
and ``assistant`` are where it may end):

    system    -> empty s
    user      -> empty u | system u | assistant u
    assistant -> user a

Each terminal is widened by error productions: a turn of that role (Keep, 0), any turn
under another role (Rerole, 3), no turn (Insert, 3); and every nonterminal may be followed
by a turn that goes (Delete, 4).  Blank and repeated turns can only be deleted; a truncated
one that stays costs 3 more.  Terminals s can be kept alone.

The parser goes through the turns as Earley's does: it predicts what may follow the items
of a chart set, scans the next turn into the next set, and completes, inserted terminals
included, until nothing gets cheaper.  As the grammar is left-linear, all items begin at
the start, so a set is one item for each nonterminal and only the last set is kept.  An
item retains its least (cost, audit).  That is exact: audits of equal cost which have read
the same turns differ at some letter, as whatever is longer has another insertion to pay.

A conversation of up to ``BLOCK_ROWS`` turns is parsed, repaired and hashed in one pass
over its sorted turns.  Longer ones are dealt in ranges of turns to blocks in several
tasks.  A block doesn't know its entry, so it is parsed from each nonterminal and gives a
table of (entry, exit) with cost and audit; tables compose in order, and then each block
is repaired by its piece of the audit.  No task holds the texts of such a conversation;
their digest is taken from a sorted stream.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Turns that one block holds about; longer conversations are parsed block by block.
BLOCK_ROWS = 10_000
#: Blocks of a conversation at most.
BLOCKS = 256
BROADCAST_ROWS = 1_000_000
_FLUSH = 256

#: Fixed values of the grammar: (what is built, what it follows, the terminal).
PRODUCTIONS = (("system", "empty", "s"), ("user", "empty", "u"), ("user", "system", "u"), ("user", "assistant", "u"), ("assistant", "user", "a"))
ACCEPTED = ("empty", "assistant")
NONTERMINALS = ("empty", "system", "user", "assistant")
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
LEGAL = ("su", "ua", "au")

Item = tuple[int, str]


class Chart:
    """The last chart set: the least (cost, audit) of each nonterminal."""

    def __init__(self, entry: str = "empty"):
        self._settled: list[str] = []  # what all audits begin with
        self._rows = 0
        self.items: dict[str, Item] = {entry: (0, "")}
        self._insert(self.items)

    @staticmethod
    def _offer(items: dict[str, Item], name: str, cost: int, audit: str) -> bool:
        if name in items and items[name] <= (cost, audit):
            return False
        items[name] = (cost, audit)
        return True

    def _insert(self, items: dict[str, Item]) -> None:
        """Complete the set with terminals that have no turn; ends as each one costs."""
        better = True
        while better:
            better = False
            for name, after, terminal in PRODUCTIONS:
                if terminal in ROLES and after in items:
                    cost, audit = items[after]
                    better |= self._offer(items, name, cost + INSERT, audit + "I")

    def scan(self, initial: str, must_go: bool, truncated: bool) -> None:
        """Read one turn, by its role's initial and its faults."""
        now: dict[str, Item] = {}
        for name, (cost, audit) in self.items.items():
            self._offer(now, name, cost + DELETE, audit + "D")
        extra = TRUNCATED if truncated else 0
        for name, after, terminal in PRODUCTIONS if not must_go else ():
            if after in self.items:
                cost, audit = self.items[after]
                if terminal == initial:
                    self._offer(now, name, cost + KEEP + extra, audit + "K")
                if terminal in ROLES:
                    self._offer(now, name, cost + REROLE + extra, audit + "R")
        self._insert(now)
        self.items = now
        self._rows += 1
        if self._rows % _FLUSH == 0:
            common = os.path.commonprefix([a for _, a in now.values()])
            self._settled.append(common)
            self.items = {name: (cost, audit[len(common) :]) for name, (cost, audit) in now.items()}

    def table(self) -> dict[str, Item]:
        head = "".join(self._settled)
        return {name: (cost, head + audit) for name, (cost, audit) in self.items.items()}

    def best(self) -> Item:
        """Of the nonterminals in which a conversation may end."""
        table = self.table()
        return min(table[name] for name in ACCEPTED if name in table)


def follow(state: str, terminal: str) -> str:
    return next(name for name, after, t in PRODUCTIONS if after == state and t == terminal)


def expected(state: str) -> str:
    """The terminal of a turn that is put in or gets another role."""
    return "a" if state == "user" else "u"


def edited(turns: Iterable[tuple[str, str]], audit: str, state: str = "empty") -> Iterator[tuple[str, str, str]]:
    """(role, text, edit) of the repaired turns; ``turns`` are (role, text)."""
    rest = iter(turns)
    for edit in audit:
        if edit == "I":
            terminal = expected(state)
            yield ROLES[terminal], "", edit
        else:
            role, text = next(rest)
            if edit == "D":
                continue
            terminal = role[:1] if edit == "K" else expected(state)
            yield (role if edit == "K" else ROLES[terminal]), text, edit
        state = follow(state, terminal)


# ------------------------------------------------------------------------ turns


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: faults put into rows by a checksum of their place.
    A null is one space, in what is hashed and as role or text; repeats are adjacent."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(key) % 20).alias("_d"))
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_d") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("_d") == 3, 2).otherwise(1)
    return rows.where("_d <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("_copy")).drop("_copy")


def _key(conv_id: Column) -> Column:
    """A conversation as text; null is a conversation of its own."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit("")).alias("_key")


def _few(df: DataFrame, name: str) -> DataFrame:
    """A written table, to be broadcast if its counted rows are few."""
    df = materialize(df, name)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _turns(rows: DataFrame, block_rows: int) -> tuple[DataFrame, bool]:
    """Turns with their faults and blocks, and whether any conversation is long."""
    space = F.lit(" ")
    rows = rows.select(_key(F.col("conv_id")), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    rows = rows.withColumn("digest", digest)
    # A turn that an earlier turn repeats; equal ones of one turn are neighbours in order.
    place = F.struct("turn")
    seen = rows.groupBy("_key", "digest").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").drop("last")
    rows = rows.join(_few(seen, "turns-seen"), ["_key", "digest"], "left")
    ending = F.right(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    rows = rows.select("_key", "turn", "role", "text", "digest", (ending == "").alias("blank"), (F.col("first").isNotNull() & (place > F.col("first"))).alias("again"), (~ending.isin(".", "!", "?")).alias("cut"))
    long = materialize(rows.groupBy("_key").agg(F.count("*").alias("rows")).where(F.col("rows") > block_rows).select("_key"), "turns-long")
    if long.isEmpty():
        return rows.withColumns({"block": F.lit(0), "long": F.lit(False)}), False
    shares = [k / BLOCKS for k in range(1, BLOCKS)]
    ranges = rows.select("_key", "turn").join(long, "_key").groupBy("_key").agg(F.percentile_approx("turn", shares, 10_000).alias("ranges"))
    rows = rows.join(_few(ranges, "turns-ranges"), "_key", "left")
    block = F.coalesce(F.size(F.filter(F.array_distinct("ranges"), lambda x: x < F.col("turn"))), F.lit(0))
    # Without a range (only nulls) or a turn, it is the first block.
    of = F.when(F.col("ranges").isNull() | F.col("turn").isNull(), 0).otherwise(block)
    rows = rows.join(_few(long.withColumn("long", F.lit(True)), "turns-of-long"), "_key", "left")
    return rows.withColumns({"block": of, "long": F.coalesce("long", F.lit(False))}).drop("ranges"), True


def _sorted(turns: DataFrame, *before: str) -> DataFrame:
    """Blocks together and in order; ties of a turn go by role and text."""
    order = [*before, F.asc_nulls_first("turn"), "role", "text"]
    return turns.repartition("_key", "block").sortWithinPartitions("_key", "block", *order)


def _stream(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        # In steps, so that a batch of long texts is not copied at once.
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            yield from zip(*[part.column(c).to_pylist() for c in columns])


class Tally:
    """Faults and counts of the turns of a block, which come in order."""

    def __init__(self):
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.least = self.most = self.first = self.last = None
        self._before = None

    def add(self, turn: int | None, role: str, digest: str, blank: bool, again: bool, cut: bool) -> tuple[str, bool, bool]:
        """The turn's initial, whether it must go, whether it is truncated."""
        initial = role[:1]
        again = again or self._before == (turn, digest)
        self._before = (turn, digest)
        if turn is not None:
            self.turns += turn != self.most
            self.least = turn if self.least is None else self.least
            self.most = turn
        if self.last is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in LEGAL
        self.last = initial
        self.blank += blank
        self.duplicate += again and not blank
        truncated = cut and not blank and not again
        self.truncated += truncated
        return initial, blank or again, truncated

    def gaps(self) -> int:
        return 0 if self.least is None else self.most - self.least + 1 - self.turns


_COUNTS = "blank long, duplicate long, truncated long, illegal long"
_RESULT = f"_key string, gaps decimal(20,0), {_COUNTS}, cost long, audit string, repaired_sha256 string"
_READ = ["_key", "block", "turn", "role", "text", "digest", "blank", "again", "cut"]


def _rows(names: list[str], rows: list[tuple], kinds: dict[str, pa.DataType] | None = None) -> pa.RecordBatch:
    kinds = {"_key": pa.string(), "audit": pa.string(), "repaired_sha256": pa.string(), "gaps": pa.decimal128(20, 0)} | (kinds or {})
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(names, columns)], names)


def _whole(turns: DataFrame) -> DataFrame:
    """Conversations of one block each."""
    names = [x.split()[0] for x in _RESULT.replace("(20,0)", "").split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for key, rows in groupby(_stream(batches, _READ), lambda r: r[0]):
            tally, chart, held = Tally(), Chart(), []
            for _, _, turn, role, text, *faults in rows:
                held.append((role, text))
                chart.scan(*tally.add(turn, role, *faults))
            cost, audit = chart.best()
            digest = hashlib.sha256("\n".join(f"{role}:{text}" for role, text, _ in edited(held, audit)).encode()).hexdigest()
            out.append((key, tally.gaps(), tally.blank, tally.duplicate, tally.truncated, tally.illegal, cost, audit, digest))
            if len(out) >= 2000:
                yield _rows(names, out)
                out = []
        yield _rows(names, out)

    return _sorted(turns).select(*_READ).mapInArrow(run, _RESULT)


# ----------------------------------------------------------- long conversations

_TABLE = f"_key string, block long, least long, most long, turns long, {_COUNTS}, first string, last string, entry string, exit string, cost long, audit string"
_TEXTS = {n: pa.string() for n in ("first", "last", "entry", "exit", "state", "role", "text", "edit")}


def _tables(turns: DataFrame) -> DataFrame:
    """A row for each block, entry and exit."""
    names = [x.split()[0] for x in _TABLE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, block), rows in groupby(_stream(batches, _READ), lambda r: r[:2]):
            tally, charts = Tally(), {entry: Chart(entry) for entry in NONTERMINALS}
            for _, _, turn, role, _, *faults in rows:
                row = tally.add(turn, role, *faults)
                for chart in charts.values():
                    chart.scan(*row)
            head = (key, block, tally.least, tally.most, tally.turns, tally.blank, tally.duplicate, tally.truncated, tally.illegal, tally.first, tally.last)
            yield _rows(names, [(*head, entry, exit_, *item) for entry, chart in charts.items() for exit_, item in chart.table().items()], _TEXTS)

    return _sorted(turns).select(*_READ).mapInArrow(run, _TABLE)


def _composed(tables: DataFrame) -> DataFrame:
    """Per block its entry state and piece of the audit, with the conversation's counts."""

    def compose(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        paths: dict[str, tuple[int, str, tuple]] = {"empty": (0, "", ())}
        heads = []
        for _, block in groupby(rows, lambda r: r["block"]):
            block = list(block)
            heads.append(block[0])
            now: dict[str, tuple[int, str, tuple]] = {}
            for r in block:
                if r["entry"] in paths:
                    cost, audit, path = paths[r["entry"]]
                    offer = (cost + r["cost"], audit + r["audit"], (*path, (r["entry"], r["audit"])))
                    if r["exit"] not in now or offer[:2] < now[r["exit"]][:2]:
                        now[r["exit"]] = offer
            paths = now
        cost, audit, path = min((paths[s] for s in ACCEPTED if s in paths), key=lambda p: p[:2])
        known = [h for h in heads if h["least"] is not None]
        gaps = max(h["most"] for h in known) - min(h["least"] for h in known) + 1 - sum(h["turns"] for h in known) if known else 0
        total = {c: sum(h[c] for h in heads) for c in ("blank", "duplicate", "truncated", "illegal")}
        total["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(heads, heads[1:]))
        out = [(h["_key"], h["block"], state, piece, gaps, *total.values(), cost) for h, (state, piece) in zip(heads, path)]
        return pa.Table.from_batches([_rows(["_key", "block", "state", "audit", "gaps", *total, "cost"], out, _TEXTS)])

    return tables.groupBy("_key").applyInArrow(compose, f"_key string, block long, state string, audit string, gaps decimal(20,0), {_COUNTS}, cost long")


def _walk(turns: DataFrame, pieces: DataFrame) -> DataFrame:
    """(_key, block, place, turn, role, text, edit): the repaired turns.  A block's piece
    of the audit comes before its turns, in one sorted stream."""
    head = pieces.select("_key", "block", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.col("state").alias("role"), F.col("audit").alias("text"))
    both = head.unionByName(turns.select("_key", F.col("block").cast("long").alias("block"), F.lit(1).alias("kind"), "turn", "role", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_key", "block", "place", "role", "text", "edit"]
        for (key, block), rows in groupby(_stream(batches, ["_key", "block", "role", "text"]), lambda r: r[:2]):
            _, _, state, audit = next(rows)
            out: list[tuple] = []
            for place, turn in enumerate(edited((r[2:] for r in rows), audit, state)):
                out.append((key, block, place, *turn))
                if len(out) >= 512:
                    yield _rows(names, out, _TEXTS)
                    out = []
            yield _rows(names, out, _TEXTS)

    order = ["_key", "block", "kind", F.asc_nulls_first("turn"), "role", "text"]
    ordered = both.repartition("_key", "block").sortWithinPartitions(*order).select("_key", "block", "role", "text")
    return ordered.mapInArrow(run, "_key string, block long, place long, role string, text string, edit string")


def _long(turns: DataFrame) -> DataFrame:
    """Conversations of many blocks."""
    pieces = materialize(_composed(_tables(turns)), "turns-pieces")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in groupby(_stream(batches, ["_key", "role", "text"]), lambda r: r[0]):
            sha, gap = hashlib.sha256(), ""
            for _, role, text in rows:
                sha.update(f"{gap}{role}:{text}".encode())
                gap = "\n"
            yield _rows(["_key", "repaired_sha256"], [(key, sha.hexdigest())])

    lines = _walk(turns, pieces).repartition("_key").sortWithinPartitions("_key", "block", "place").select("_key", "role", "text")
    digests = lines.mapInArrow(digest, "_key string, repaired_sha256 string")
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "")
    counts = [F.first(c).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    whole = pieces.groupBy("_key").agg(*counts, audit.alias("audit"))
    # Without a turn left there is no line to hash.
    return whole.join(digests, "_key", "left").withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))


def parsed(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Faults, cost, audit and digest of each conversation of ``rows`` by ``_key``."""
    turns, any_long = _turns(rows, block_rows)
    found = _whole(turns.where("not long"))
    return found.unionByName(_long(turns.where("long"))) if any_long else found


def report(conversations: DataFrame, rows: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row for each conv_id of ``conversations``: gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256, of the turns ``rows`` (by default its own).

    Turns go by ``turn``, nulls first, ties by role and text.  A null conv_id is one
    conversation; null roles and texts are one space, which makes a blank turn; a role
    that is the empty text has no initial and is never kept.  A conversation without
    turns in ``rows`` has zeros, no audit, and the digest of the empty text.  Repeated
    rows are duplicates.  Conversations and texts of any length are whole; extra columns
    are passed over; an empty table gives an empty result.
    """
    ids = conversations.select("conv_id", _key(F.col("conv_id"))).distinct()
    found = parsed(conversations if rows is None else rows, block_rows)
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    return ids.join(found, "_key", "left").select(
        "conv_id", F.coalesce(F.col("gaps"), F.lit(0)).try_cast("long").alias("gaps"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )


def repaired(conversations: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """conv_id, block, place, role, text, edit: the turns of the repaired conversations,
    in order of block and place.  Nulls and ties as in ``report``; a conversation whose
    turns all go has no row."""
    ids = conversations.select("conv_id", _key(F.col("conv_id"))).distinct()
    turns, any_long = _turns(conversations, block_rows)
    pieces = _whole(turns.where("not long")).select("_key", F.lit(0).cast("long").alias("block"), F.lit("empty").alias("state"), "audit")
    if any_long:
        pieces = pieces.unionByName(_composed(_tables(turns.where("long"))).select("_key", "block", "state", "audit"))
    return ids.join(_walk(turns, pieces), "_key").drop("_key")


def oracle() -> str:
    """The rows of ``report`` on damaged turns, in DuckDB SQL over ``conversations``: a
    recursion over the turns that carries (cost, audit, lines) of each nonterminal."""
    crc = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: ord(c)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, n: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""
    grow = lambda x, cost, letter, line="": f"CASE WHEN {x} IS NOT NULL THEN {{'c': {x}.c + {cost}, 'k': {x}.k || '{letter}', 'o': {f'list_append({x}.o, {line})' if line else f'{x}.o'}}} END"
    least = lambda *xs: f"least({', '.join(xs)})"
    stay = lambda t: f"CASE WHEN NOT f.gone THEN {t} END"
    extra = f"CASE WHEN f.cut THEN {TRUNCATED} ELSE 0 END"

    def read(name: str) -> str:
        """What reading a turn gives for a nonterminal, before insertions."""
        options = [grow(f"r.{name[0]}", DELETE, "D")]
        for built, after, t in PRODUCTIONS:
            if built == name:
                x = f"r.{after[0]}"
                options.append(stay(f"CASE WHEN f.initial = '{t}' THEN {grow(x, extra, 'K', 'f.line')} END"))
                if t in ROLES:
                    options.append(stay(grow(x, f"{REROLE} + {extra}", "R", f"'{ROLES[t]}:' || f.text")))
        return least(*options)

    u = least("u", *[grow(x, INSERT, "I", "'user:'") for x in ("e", "s", "a")])
    a = least("a", grow("u", INSERT, "I", "'assistant:'"))
    item = "STRUCT(c BIGINT, k VARCHAR, o VARCHAR[])"
    return f"""WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
dealt AS (SELECT *, {crc} % 20 AS d FROM keyed),
damaged AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM (SELECT * FROM dealt WHERE d <> 0 UNION ALL SELECT * FROM dealt WHERE d = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
flags AS (SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS ended, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
f AS (SELECT conv_id, i, turn, text, initial, blank, again AND NOT blank AS duplicate, ended AND NOT again AND NOT blank AS cut, blank OR again AS gone, coalesce(before || initial NOT IN ('su', 'ua', 'au'), false) AS illegal, role || ':' || text AS line FROM flags),
counts AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::INT) AS blank, sum(duplicate::INT) AS duplicate, sum(cut::INT) AS truncated, sum(illegal::INT) AS illegal FROM f GROUP BY conv_id),
r(conv_id, i, e, s, u, a) AS (
  SELECT conv_id, 0::BIGINT, {{'c': 0, 'k': '', 'o': []}}::{item}, NULL::{item}, {{'c': 3, 'k': 'I', 'o': ['user:']}}::{item}, {{'c': 6, 'k': 'II', 'o': ['user:', 'assistant:']}}::{item} FROM counts
  UNION ALL SELECT conv_id, i, e, s, u, {a} FROM (SELECT conv_id, i, e, s, {u} AS u, a FROM (
    SELECT r.conv_id, f.i, {read('empty')} AS e, {read('system')} AS s, {read('user')} AS u, {read('assistant')} AS a FROM r JOIN f ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = r.i + 1))),
done AS (SELECT c.*, least(r.e, r.a) AS x FROM r JOIN counts c ON r.conv_id IS NOT DISTINCT FROM c.conv_id AND r.i = c.n)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(x.c, 0)::BIGINT AS cost,
  coalesce(x.k, '') AS audit, sha256(coalesce(array_to_string(x.o, chr(10)), '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN done ON ids.conv_id IS NOT DISTINCT FROM done.conv_id"""
