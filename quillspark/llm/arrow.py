"""Arrow batches between Spark and Python: bounded in bytes, with columns of any name carried along."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of a batch on its way to Python, about; a row is never cut. Set on the session only where the user hasn't set it.
BATCH_BYTES = 2 << 20
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_batches(rows: DataFrame, run, schema: T.StructType | str) -> DataFrame:
    """rows.mapInArrow(run, schema), with batches bounded in bytes: thousands of long texts in one batch would take hundreds of megabytes in the JVM and in Python."""
    conf = rows.sparkSession.conf
    if conf.get(_SETTING, None) is None:
        conf.set(_SETTING, str(BATCH_BYTES))
    return rows.mapInArrow(run, schema)


def numbered(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """rows with columns c0, c1 ..., so that any name (dots, clashes) can be carried; and these names."""
    names = [f"c{i}" for i in range(len(rows.columns))]
    return rows.toDF(*names), names


def renamed(rows: DataFrame, columns: Sequence[str], added: int) -> DataFrame:
    """rows whose first columns are carried, under their names again; the `added` last ones keep theirs and take the place of carried ones of the same name."""
    own, (flat, names) = rows.columns[len(rows.columns) - added :], numbered(rows)
    kept = [(n, c) for n, c in zip(names, columns) if c not in own]
    return flat.select(*[n for n, _ in kept], *names[len(names) - added :]).toDF(*[c for _, c in kept], *own)
