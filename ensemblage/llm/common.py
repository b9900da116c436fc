"""Shared helpers of the corpus operators: scratch tables and vectorised tokens.

Nothing here keeps state between calls.  Scratch tables go to the folder named
by ``spark.checkpoint.dir``; a local folder is used only on a local master.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word pattern of the contracts: everything but space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for scratch tables (``spark.checkpoint.dir``).

    Only where the setting is absent and the master is local, a temporary
    folder of this machine is set; on a cluster an absent setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ensemblage-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared scratch folder and read it back.  The
    table is removed when the application ends, as results may read it until then."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable."""
    return F.transform(F.array(value), body)[0]


def md5_int(value: Column, digits: int = 15) -> Column:
    """The first ``digits`` hex digits of the md5 of ``value`` as a long."""
    return F.conv(F.substring(F.md5(value), 1, digits), 16, 10).cast("long")


def id_text(col: Column) -> Column:
    """A row id as text; null is the empty text."""
    return F.coalesce(col.cast("string"), F.lit(""))


# ---------------------------------------------------------------- numpy side


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of an Arrow string column, nulls as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def row_slices(offsets: np.ndarray, budget: int):
    """Ranges of rows with about ``budget`` bytes each, one row at least."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + budget, "right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Breaks for words of the contracts: white space.
WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True
#: Breaks for words of letters and digits: all other ASCII bytes.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift, multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
#: Odd factors of the places in a word, one table for each of two independent hashes.
#: They come from a mixer and not from powers: words of regular structure, which
#: collide under every polynomial modulo 2**64, have nothing to hold on to.
_SEEDS = (np.uint64(0x5851F42D4C957F2D), np.uint64(0xC2B2AE3D27D4EB4F))
_FACTORS = [np.ones(0, np.uint64), np.ones(0, np.uint64)]


def _factors(n: int, lane: int = 0) -> np.ndarray:
    if len(_FACTORS[lane]) < n:
        with np.errstate(over="ignore"):
            _FACTORS[lane] = mix64(np.arange(1, max(2 * n, 64) + 1, dtype=np.uint64) * _SEEDS[lane]) | np.uint64(1)
    return _FACTORS[lane]


def word_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many words of the contracts (``WORD``) each row has."""
    inside = ~WHITE[data]
    if not len(data):
        return np.zeros(len(offsets) - 1, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1]
    edges = edges[edges < len(data)]
    first[edges] = inside[edges]
    at = np.flatnonzero(first)
    return np.diff(np.searchsorted(at, offsets))


class Words:
    """Words of some rows: ``hash`` (uint64), ``row``, byte ``start`` and ``size``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = WHITE):
        """``breaks``: for each byte whether it ends a word; white space by default."""
        data = _LOWER[data]
        space = breaks[data]
        n = len(data)
        self.data, self.rows = data, len(offsets) - 1
        if not n or space.all():
            self.hash = np.zeros(0, np.uint64)
            self.start = self.size = self.row = np.zeros(0, np.int64)
            return
        before, after = np.empty(n, bool), np.empty(n, bool)
        before[0], before[1:] = True, space[:-1]
        after[-1], after[:-1] = True, space[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < n)]
        before[edges] = True
        after[edges - 1] = True
        start = np.flatnonzero(~space & before)
        end = np.flatnonzero(~space & after) + 1
        self.start, self.size = start, end - start
        kept = np.flatnonzero(~space)
        first = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        relative = np.arange(len(kept)) - np.repeat(first, self.size)
        with np.errstate(over="ignore"):
            value = _BYTE[data[kept]] * _factors(int(self.size.max()))[relative]
            self.hash = mix64(np.add.reduceat(value, first) + self.size.astype(np.uint64))
        self.row = np.searchsorted(offsets, start, "right") - 1
        self._kept, self._first, self._relative = kept, first, relative

    def second(self) -> np.ndarray:
        """Another 64-bit hash of each word, independent of ``hash``."""
        if not len(self.hash):
            return self.hash
        with np.errstate(over="ignore"):
            value = _BYTE[self.data[self._kept]] * _factors(int(self.size.max()), 1)[self._relative]
            return mix64(np.add.reduceat(value, self._first) ^ self.size.astype(np.uint64))

    def starts_with(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Words longer than ``size`` bytes, and the hashes of their first bytes."""
        longer = np.flatnonzero(self.size > size)
        if not len(longer):
            return longer, np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            total = np.full(len(longer), np.uint64(size))
            for k in range(size):
                total += _BYTE[self.data[self.start[longer] + k]] * _factors(size)[k]
        return longer, mix64(total)

    def bounds(self) -> np.ndarray:
        """Index of the first word of each row, and the end."""
        return np.searchsorted(self.row, np.arange(self.rows + 1))
