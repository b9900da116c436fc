"""Windows of lineages over a stream, with timers, expiry and a state to start from.

Rows have a run, a label (whose descendant a particle is), a value and an event time.  For
each run and window the families are counted as rows come.  When the watermark passes a
window's end, its timer closes it: the window's row is given out, its labels are forgotten,
and its histogram is added to the run's, which goes on from window to window and may begin
with a table from an earlier stream.  Rows of a window that has been closed are counted
aside.  A run that is silent for long enough after its last window expires: its histogram
is given out and its state removed.

The watermark follows ``arrived``, the time at which a row was delivered, so that a row of
an old window still comes to its run's state, which knows what has been closed.  State is
kept in RocksDB: bins one by one, families packed.  A call to the state costs more than many
rows, so that families are summed up first and written by some 200,000 at once, in parts by
window and bucket of labels; a window's parts are read when it closes, bucket by bucket.
No row of a run is kept.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Families that are summed up in memory before they are written, and buckets of labels.
HELD, BUCKETS = 200_000, 16
#: What a stream gives out: times are milliseconds; ``kind`` is window, late or expired.
RESULT = "run string, kind string, ends long, n long, n_unique long, ess double, hist_n long, hist_total double, top_bin int"


class LineageWindows(StatefulProcessor):
    """``every``, ``silence`` and ``until`` in milliseconds: length of a window, time to
    expiry after the last window's end, and expiry of runs that only the first state has."""

    def __init__(self, every: int, silence: int, low: float, step: float, bins: int, until: int):
        self.every, self.silence, self.low, self.step, self.bins, self.until = every, silence, low, step, bins, until

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.families = handle.getMapState("families", "ends long, bucket int, part int", "packed string")
        self.parts = handle.getMapState("parts", "ends long", "n int")
        self.open = handle.getMapState("open", "ends long, bin int", "n long, total double")
        self.whole = handle.getMapState("whole", "bin int", "n long, total double")
        self.expiry = handle.getValueState("expiry", "at long")

    def _row(self, run: str, kind: str, ends: int, n: int = 0, unique: int = 0, ess: float | None = None) -> dict:
        whole = [(k[0], v[0], v[1]) for k, v in self.whole.iterator()]
        top = min((-n, b) for b, n, _ in whole)[1] if whole else None
        return {"run": run, "kind": kind, "ends": ends, "n": n, "n_unique": unique, "ess": ess, "hist_n": sum(w[1] for w in whole), "hist_total": sum(w[2] for w in whole), "top_bin": top}

    @staticmethod
    def _add(state, key: tuple, n: int, total: float) -> None:
        old = state.getValue(key) if state.containsKey(key) else None
        state.updateValue(key, (n + (old[0] if old else 0), total + (old[1] if old else 0.0)))

    def _expire_at(self, at: int) -> None:
        """Put off the expiry.  A timer that comes before it does nothing."""
        if not self.expiry.exists() or self.expiry.get()[0] < at:
            self.expiry.update((at,))
            # Beside the windows' ends, which have timers of their own.
            self.handle.registerTimer(at + 1)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for b, n, total in zip(initialState["bin"], initialState["n"], initialState["total"]):
            self._add(self.whole, (int(b),), int(n), float(total))
        self._expire_at(self.until)

    def _write(self, held: list[pd.Series]) -> None:
        """One more part for each window and bucket that families of these counts are in."""
        counts = pd.concat(held).groupby(level=[0, 1]).sum().reset_index(name="n")
        counts["bucket"] = pd.util.hash_array(counts["label"].to_numpy(object)) % BUCKETS
        for e, window in counts.groupby("ends"):
            part = self.parts.getValue((int(e),))[0] if self.parts.containsKey((int(e),)) else 0
            self.parts.updateValue((int(e),), (part + 1,))
            for b, rows in window.groupby("bucket"):
                self.families.updateValue((int(e), int(b), part), (json.dumps([rows["label"].tolist(), rows["n"].tolist()]),))

    def _close(self, ends: int) -> tuple[int, int, int]:
        """Rows, families and sum of squares of a window, whose families are forgotten."""
        n = unique = square = 0
        parts = self.parts.getValue((ends,))[0] if self.parts.containsKey((ends,)) else 0
        for b in range(BUCKETS):
            sizes: dict[str, int] = {}
            for part in range(parts):
                key = (ends, b, part)
                if self.families.containsKey(key):
                    for label, c in zip(*json.loads(self.families.getValue(key)[0])):
                        sizes[label] = sizes.get(label, 0) + c
                    self.families.removeKey(key)
            n, unique, square = n + sum(sizes.values()), unique + len(sizes), square + sum(c * c for c in sizes.values())
        if parts:
            self.parts.removeKey((ends,))
        return n, unique, square

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        closed, late = timerValues.getCurrentWatermarkInMs(), {}
        held, size = [], 0
        bins: dict[tuple[int, int], tuple[int, float]] = {}
        for pdf in rows:
            ends = (pdf["ms"] // self.every + 1) * self.every
            known = ends > closed
            for e, n in ends[~known].value_counts().items():
                late[int(e)] = late.get(int(e), 0) + int(n)
            pdf = pdf.assign(ends=ends, bin=np.clip(np.floor((pdf["value"] - self.low) / self.step), 0, self.bins - 1).astype(int))[known]
            if pdf.empty:
                continue
            held.append(pdf.groupby(["ends", "label"]).size())
            size += len(held[-1])
            for e, b, n, total in pdf.groupby(["ends", "bin"])["value"].agg(["size", "sum"]).reset_index().itertuples(index=False):
                old = bins.get((int(e), int(b)), (0, 0.0))
                bins[int(e), int(b)] = (old[0] + int(n), old[1] + float(total))
            if size >= HELD:
                self._write(held)
                held, size = [], 0
        if held:
            self._write(held)
        for at, (n, total) in bins.items():
            self._add(self.open, at, n, total)
        for e in sorted({e for e, _ in bins}):
            self.handle.registerTimer(e)
            self._expire_at(e + self.silence)
        if late:
            yield pd.DataFrame([{**self._row(key[0], "late", e, n), "hist_n": None, "hist_total": None, "top_bin": None} for e, n in sorted(late.items())])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        if at % self.every == 0:
            for b in range(self.bins):
                if self.open.containsKey((at, b)):
                    self._add(self.whole, (b,), *self.open.getValue((at, b)))
                    self.open.removeKey((at, b))
            n, unique, square = self._close(at)
            yield pd.DataFrame([self._row(key[0], "window", at, n, unique, n**2 / square if square else None)])
        elif self.expiry.exists() and self.expiry.get()[0] + 1 == at:
            yield pd.DataFrame([self._row(key[0], "expired", at - 1)])
            for state in (self.families, self.parts, self.open, self.whole, self.expiry):
                state.clear()

    def close(self) -> None:
        pass


@contextmanager
def rocksdb(spark: SparkSession):
    """State with timers is kept in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def lineage_windows(rows: DataFrame, start: DataFrame, processor: LineageWindows, late: str = "0 seconds") -> DataFrame:
    """A stream of (run, label, value, ms, arrived) to windows; ``start`` has (run, bin,
    n, total), the histogram of each run to go on from, which may be empty."""
    grouped = rows.withWatermark("arrived", late).select("run", "label", "value", "ms", "arrived").groupBy("run")
    return grouped.transformWithStateInPandas(statefulProcessor=processor, outputStructType=RESULT, outputMode="Append", timeMode="EventTime", initialState=start.groupBy("run"))
