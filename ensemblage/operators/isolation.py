"""Grouped Python functions whose failures stay with the group that failed.

One group that raises ends a whole Spark job after its retries.  ``isolated`` turns what a
group raises into one error row with the group's key, and keeps the other groups' rows; the
errors feed ``reports.run_status``.  What ends a worker (memory, a crash) is no exception of
the group and still fails the task, so that Spark runs it again elsewhere.
"""

from __future__ import annotations

import traceback
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of an error that are kept: its end, which names what was raised.
ERROR_CHARS = 4000


def isolated(df: DataFrame, keys: list[str], function: Callable[[tuple, pd.DataFrame], pd.DataFrame], schema: T.StructType) -> DataFrame:
    """(keys, ``schema``'s columns, error, trace): the rows that ``function`` gives for each
    group, or one row with an error.  A result without a column of the schema, or with
    values that do not fit it, is a failure of its group.  Null keys are groups; a group
    may give no rows; a group is one Python call, as with ``applyInPandas``."""
    names = [f.name for f in schema.fields]
    key_fields = [df.schema[k] for k in keys]
    out = T.StructType([*key_fields, *[T.StructField(f.name, f.dataType) for f in schema.fields], T.StructField("error", T.StringType()), T.StructField("trace", T.StringType())])

    kinds: dict = {}

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        if not kinds:
            kinds.update({f.name: to_arrow_type(f.dataType) for f in schema.fields})
        error = trace = None
        try:
            result = function(key, pdf)
            columns = {n: result[n] for n in names}
            for n, c in columns.items():
                # Fails here, and not in what Spark does with all groups' rows.
                pa.Array.from_pandas(c, type=kinds[n])
            # Plain objects: text columns may otherwise come in several chunks.
            columns = {n: c.to_numpy(dtype=object) for n, c in columns.items()}
            size = len(result)
        except Exception as e:  # noqa: BLE001
            error, trace, size = f"{type(e).__name__}: {e}"[:ERROR_CHARS], traceback.format_exc()[-ERROR_CHARS:], 1
            columns = {n: [None] for n in names}
        for name, value in zip([*keys, "error", "trace"], [*key, error, trace]):
            columns[name] = [value] * size
        # One table a group: each further step over it costs more than most functions do.
        return pd.DataFrame({f.name: columns[f.name] for f in out.fields}, dtype=object)

    session = df.sparkSession
    # Small groups may cost much time, so that their bytes must not choose the tasks.
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys).groupBy(*keys).applyInPandas(run, out)


def succeeded(results: DataFrame) -> DataFrame:
    return results.where("error is null").drop("error", "trace")


def failed(results: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, error, trace) of the groups that failed."""
    return results.where(F.col("error").isNotNull()).select(*keys, "error", "trace")
