"""Fill-in-the-middle by a parallel automaton scan.

A text is cut at two ends of tokens; prefix, middle and suffix are written again in
another order with markers between.  Tokens are runs of white space with the word after
them, and white space at the end.  The automaton reads bytes and has four states: white
space, word, word after ``<``, word after ``<`` and a marker's letter.  Two things are
counted: ends of words (white space after a word byte) and whole markers.

The scan is parallel, as a chunk of bytes doesn't wait for the chunk before it: it gives,
for each of the four states that it may be entered in, the state that it is left in and
its two counts (``scan``).  These functions compose associatively (``compose``), which
tells every chunk's true entry state and how many ends stand before it; a cut is then the
k-th end of one chunk, found by looking at that chunk alone (``find_end``).

Texts up to ``GIANT_BYTES`` are scanned chunk by chunk where they are, without a shuffle.
The chunks of giant texts are dealt to tasks, their functions (some 60 bytes a chunk) meet
by document, and only chunks that hold a cut are looked at again.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WHITE, id_text, materialize, row_slices, text_buffers

CHUNK_BYTES = 1 << 14
GIANT_BYTES = 1 << 16
SLICE_BYTES = 4 << 20

#: Fixed values of the format: markers, and shares of a hundred of cut texts and of
#: the suffix-first form among them.
MARKERS = ("<P>", "<S>", "<M>")
CUT_SHARE, SPM_SHARE = 50, 80

_SPACE, _WORD, _OPEN, _LETTER = range(4)
_STATES = 4
_LETTERS = np.zeros(256, bool)
_LETTERS[[ord(m[1]) for m in MARKERS]] = True


class Scan(NamedTuple):
    """A chunk as a function of the state that it is entered in: the state it is left
    in, ends of words, markers; and its code points."""

    leave: tuple[int, ...]
    ends: tuple[int, ...]
    markers: tuple[int, ...]
    chars: int


IDENTITY = Scan(tuple(range(_STATES)), (0,) * _STATES, (0,) * _STATES, 0)


def count_chars(data: np.ndarray) -> int:
    """Code points of UTF-8 bytes."""
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def scan(data: np.ndarray) -> Scan:
    """The function of the bytes ``data``."""
    if not len(data):
        return IDENTITY
    space = WHITE[data]
    ends = int(np.count_nonzero(space[1:] & ~space[:-1]))
    opens = np.flatnonzero(data[:-2] == ord("<"))
    markers = int(np.count_nonzero(_LETTERS[data[opens + 1]] & (data[opens + 2] == ord(">")))) if len(opens) else 0
    at_start = [0, 0, 0, 0]
    at_start[_LETTER] = int(data[0] == ord(">"))
    at_start[_OPEN] = int(len(data) > 1 and _LETTERS[data[0]] and data[1] == ord(">"))
    if space[-1]:
        leave = [_SPACE] * _STATES
    elif data[-1] == ord("<"):
        leave = [_OPEN] * _STATES
    elif _LETTERS[data[-1]] and len(data) > 1:
        leave = [_LETTER if data[-2] == ord("<") else _WORD] * _STATES
    else:
        leave = [_WORD] * _STATES
        if _LETTERS[data[-1]]:
            leave[_OPEN] = _LETTER
    first = int(space[0])
    return Scan(tuple(leave), (ends, ends + first, ends + first, ends + first), tuple(markers + x for x in at_start), count_chars(data))


def compose(f: Scan, g: Scan) -> Scan:
    """First ``f``, then ``g``."""
    return Scan(
        tuple(g.leave[s] for s in f.leave),
        tuple(n + g.ends[s] for n, s in zip(f.ends, f.leave)),
        tuple(n + g.markers[s] for n, s in zip(f.markers, f.leave)),
        f.chars + g.chars,
    )


def find_end(data: np.ndarray, state: int, k: int) -> int:
    """The byte at which the ``k``-th word (from 1) of a chunk entered in ``state`` ends."""
    space = WHITE[data]
    before = np.concatenate([[state == _SPACE], space[:-1]])
    return int(np.flatnonzero(space & ~before)[k - 1])


class Plan(NamedTuple):
    n: int
    form: str
    cuts: tuple[int, int]  # tokens before the middle, and before the suffix


def plan(whole: Scan, h: tuple[int, int, int, int]) -> Plan:
    """Units, form and cuts of a text from its composed scan and its four numbers."""
    # Each end closes a token, and what follows the last of them is one more.
    n = whole.ends[_SPACE] + 1 if whole.chars else 0
    if not n or whole.markers[_SPACE] or h[2] % 100 >= CUT_SHARE:
        form = "plain"
    else:
        form = "spm" if h[3] % 100 < SPM_SHARE else "psm"
    a, b = h[0] % (n + 1), h[1] % (n + 1)
    return Plan(n, form, (min(a, b), max(a, b)))


def entries(scans: list[Scan]) -> Iterator[tuple[int, int, int, Scan]]:
    """For each chunk in order: its entry state, ends and code points before it."""
    before = IDENTITY
    for s in scans:
        yield before.leave[_SPACE], before.ends[_SPACE], before.chars, s
        before = compose(before, s)


def locate(scans: list[Scan], token: int) -> tuple[int, int, int] | None:
    """(chunk, its entry state, which end) where ``token`` (from 1) ends; None for a
    token that the text's own end closes."""
    for at, (state, ends, _, s) in enumerate(entries(scans)):
        if ends < token <= ends + s.ends[state]:
            return at, state, token - ends
    return None


def chunks_of(data: np.ndarray, size: int) -> Iterator[np.ndarray]:
    for at in range(0, len(data), size):
        yield data[at : at + size]


def cut_text(data: np.ndarray, h: tuple[int, int, int, int], size: int = CHUNK_BYTES) -> tuple[Plan, tuple[int, int]]:
    """The plan of a text at hand, and the bytes of its two cuts."""
    parts = list(chunks_of(data, size))
    scans = [scan(p) for p in parts]
    whole = IDENTITY
    for s in scans:
        whole = compose(whole, s)
    found = plan(whole, h)
    at = []
    for token in found.cuts if found.form != "plain" else ():
        place = locate(scans, token) if token else (0, _SPACE, 0)
        if place is None:
            at.append(len(data))
        elif not token:
            at.append(0)
        else:
            chunk, state, k = place
            at.append(chunk * size + find_end(parts[chunk], state, k))
    return found, tuple(at) or (0, 0)


def arrange(data: np.ndarray, form: str, at: tuple[int, int]) -> bytes:
    """The output of a text that is cut at two bytes."""
    raw = data.tobytes()
    if form == "plain":
        return raw
    p, s, m = (x.encode() for x in MARKERS)
    prefix, middle, suffix = raw[: at[0]], raw[at[0] : at[1]], raw[at[1] :]
    return b"".join((p, prefix, s, suffix, m, middle) if form == "psm" else (s, suffix, p, prefix, m, middle))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of.  It holds no marker of its own, and none
    arises where a piece meets a marker, as a marker has no end that begins another."""
    part = F.split(output, "|".join(MARKERS), 4)
    psm = F.concat(F.get(part, F.lit(1)), F.get(part, F.lit(3)), F.get(part, F.lit(2)))
    spm = F.concat(F.get(part, F.lit(2)), F.get(part, F.lit(3)), F.get(part, F.lit(1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


# ------------------------------------------------------------------------ Spark

_FIM = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()),
        T.StructField("output", T.StringType()),
    ]
)


def _numbers(seed: int) -> Column:
    """The four numbers of a document as an array of longs."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), id_text(F.col("doc_id"))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, tuple[int, ...]]]:
    """(row, bytes, numbers) of a batch with ``row.text`` and ``h``."""
    data, offsets = text_buffers(batch.column("text"))
    numbers = batch.column("h").flatten().to_numpy().reshape(-1, 4)
    for k in range(batch.num_rows):
        yield k, data[offsets[k] : offsets[k + 1]], tuple(int(x) for x in numbers[k])


def _made(batch: pa.RecordBatch, made: list[tuple[Plan, tuple[int, int], np.ndarray]]) -> pa.RecordBatch:
    out = []
    for found, at, data in made:
        cut = found.form != "plain"
        out.append(
            {
                "n": found.n,
                "form": found.form,
                "prefix_chars": count_chars(data[: at[0]]) if cut else None,
                "middle_chars": count_chars(data[at[0] : at[1]]) if cut else None,
                "output": arrange(data, found.form, at).decode(),
            }
        )
    kind = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
    return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, kind)], ["row", "fim"])


def _sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with a bounded number of bytes of text."""
    _, offsets = text_buffers(batch.column("text"))
    for a, b in row_slices(offsets, SLICE_BYTES):
        yield batch.slice(a, b - a)


def _in_place(packed: DataFrame, chunk: int, schema: T.StructType) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _sliced(batch):
                yield _made(part, [(*cut_text(data, h, chunk), data) for _, data, h in _rows(part)])

    return packed.select("row", "text", "h").mapInArrow(run, schema)


def _giants(packed: DataFrame, chunk: int, schema: T.StructType) -> DataFrame:
    """The same for texts whose chunks are dealt to tasks."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data, _ in _rows(batch):
                parts = [p.tobytes() for p in chunks_of(data, chunk)]
                step = max(1, SLICE_BYTES // chunk)
                for a in range(0, len(parts), step):
                    some = parts[a : a + step]
                    take = pa.array([k] * len(some), pa.int64())
                    columns = [batch.column(c).take(take) for c in ("_id", "_key", "h")]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(range(a, a + len(some)), pa.int64()), pa.array(some, pa.binary())], ["_id", "_key", "h", "seq", "bytes"])

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("leave", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("markers", pa.list_(pa.int64())), ("chars", pa.int64())])
        for batch in batches:
            found = [scan(np.frombuffer(x.as_buffer(), np.uint8))._asdict() for x in batch.column("bytes")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("_id", "_key", "h", "seq")], pa.array(found, kind)], ["_id", "_key", "h", "seq", "scan"])

    def resolve(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        scans = [Scan(tuple(x["leave"]), tuple(x["ends"]), tuple(x["markers"]), x["chars"]) for x in table["scan"].to_pylist()]
        whole = IDENTITY
        for s in scans:
            whole = compose(whole, s)
        found = plan(whole, tuple(table["h"][0].as_py()))
        rows = []
        for which, token in enumerate(found.cuts):
            place = locate(scans, token) if token and found.form != "plain" else None
            # Without a chunk to look at, the cut is the text's start or its end.
            rows.append((which, *(place or (None, None, 0 if token == 0 else None))))
        head = [pa.array([table[c][0].as_py()] * 2, table[c].type) for c in ("_id", "_key")]
        tail = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
        return pa.table([*head, pa.array([found.n] * 2, pa.int64()), pa.array([found.form] * 2), *tail], ["_id", "_key", "n", "form", "which", "seq", "state", "k"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("bytes"), batch.column("state").to_pylist(), batch.column("k").to_pylist(), batch.column("seq").to_pylist())
            at = [seq * chunk + find_end(np.frombuffer(x.as_buffer(), np.uint8), state, k) for x, state, k, seq in rows]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("_id", "_key", "which")], pa.array(at, pa.int64())], ["_id", "_key", "which", "at"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _sliced(batch):
                plans = part.select(["n", "form", "first", "second"]).to_pylist()
                made = []
                for (_, data, _), p in zip(_rows(part), plans):
                    at = tuple(len(data) if x is None else x for x in (p["first"], p["second"]))
                    made.append((Plan(p["n"], p["form"], (0, 0)), at, data))
                yield _made(part, made)

    # Rows of one id and text are cut alike, and their chunks are scanned once.
    parts = packed.select("_id", "_key", "h", "text").mapInArrow(split, "_id string, _key long, h array<long>, seq long, bytes binary")
    parts = materialize(parts.dropDuplicates(["_id", "_key", "seq"]), "fim-chunks")
    arrays = "leave array<long>, ends array<long>, markers array<long>, chars long"
    scans = parts.mapInArrow(functions, f"_id string, _key long, h array<long>, seq long, scan struct<{arrays}>")
    cuts = scans.groupBy("_id", "_key").applyInArrow(resolve, "_id string, _key long, n long, form string, which long, seq long, state long, k long")
    cuts = materialize(cuts, "fim-cuts")
    found = parts.join(cuts.where("seq is not null"), ["_id", "_key", "seq"]).select("_id", "_key", "which", "seq", "state", "k", "bytes")
    found = found.mapInArrow(look, "_id string, _key long, which long, at long")
    at = cuts.join(found, ["_id", "_key", "which"], "left").select("_id", "_key", "n", "form", "which", F.coalesce("at", F.when(F.col("k") == 0, 0)).alias("at"))
    pick = lambda w: F.max(F.when(F.col("which") == w, F.col("at")))
    at = at.groupBy("_id", "_key").agg(F.first("n").alias("n"), F.first("form").alias("form"), pick(0).alias("first"), pick(1).alias("second"))
    return packed.join(at, ["_id", "_key"]).select("row", "text", "h", "n", "form", "first", "second").mapInArrow(assemble, schema)


def transform(documents: DataFrame, seed: int = 42, chunk: int = CHUNK_BYTES, giant: int = GIANT_BYTES) -> DataFrame:
    """``row``, the document as it came, and ``fim`` (n, form, prefix_chars,
    middle_chars, output).

    A null text is an empty one, which is plain with 0 units; a null doc_id stands as
    empty text in what is hashed.  Repeated rows are kept and cut alike.  Texts of any
    length are cut whole, those of more than ``giant`` bytes by chunks in several tasks.
    Columns of any name come along inside ``row``.  An empty table gives an empty one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    packed = documents.select(F.struct("*").alias("row"), text.alias("text"), _numbers(seed).alias("h"), id_text(F.col("doc_id")).alias("_id"), F.xxhash64(text).alias("_key"))
    schema = T.StructType([T.StructField("row", documents.schema), T.StructField("fim", _FIM)])
    large = F.octet_length("text") > giant
    return _in_place(packed.where(~large), chunk, schema).unionByName(_giants(packed.where(large), chunk, schema))


def report(documents: DataFrame) -> DataFrame:
    """doc_id, n, form, lengths, and digests of the output and of the text rebuilt from it."""
    df = transform(documents.select("doc_id", "text"))
    back = restored(F.col("fim.output"), F.col("fim.form"))
    digests = [F.sha2(F.col("fim.output"), 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256")]
    return df.select("row.doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", *digests)


def oracle() -> str:
    """The same rows in DuckDB SQL over the table ``documents``."""
    p, s, m = MARKERS
    h = ", ".join(f"('0x' || substr(x, {8 * k + 1}, 8))::BIGINT AS h{k + 1}" for k in range(4))
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
units AS (SELECT doc_id, t, {h}, regexp_extract_all(t, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u FROM docs),
cuts AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS i, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS j,
  CASE WHEN t = '' OR contains(t, '{p}') OR contains(t, '{s}') OR contains(t, '{m}') OR h3 % 100 >= {CUT_SHARE} THEN 'plain' WHEN h4 % 100 < {SPM_SHARE} THEN 'spm' ELSE 'psm' END AS form FROM units),
parts AS (SELECT *, array_to_string(u[1:i], '') AS pre, array_to_string(u[i + 1:j], '') AS mid, array_to_string(u[j + 1:], '') AS suf FROM cuts),
outs AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{p}' || pre || '{s}' || suf || '{m}' || mid ELSE '{s}' || suf || '{p}' || pre || '{m}' || mid END AS out FROM parts)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars, sha256(out) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN out WHEN 'psm' THEN split_part(split_part(out, '{p}', 2), '{s}', 1) || split_part(out, '{m}', 2) || split_part(split_part(out, '{s}', 2), '{m}', 1)
    ELSE split_part(split_part(out, '{p}', 2), '{m}', 1) || split_part(out, '{m}', 2) || split_part(split_part(out, '{s}', 2), '{p}', 1) END) AS restored_sha256 FROM outs"""
