"""Failures kept to the source they happen in: one bad source costs its own results, not the job."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.sources.scratch import written

ERROR = "isolation_error"


def isolated(rows: DataFrame, source: str, run: Callable[[dict], dict], schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(results, failures) of run for each row (a dict to a dict of schema's fields), by source.

    A row for which run raises gives an error in place of a result. A source with errors has no results, only its row of failures: source, n_failed, error (the first one in the order of texts).
    What the tasks found is written once, so run isn't called again for either side. Errors of the machine (memory, a lost executor) are Spark's to retry and are not caught.
    """
    made = T.StructType([rows.schema[source], *schema.fields, T.StructField(ERROR, T.StringType())])
    arrow = {f.name: None for f in schema.fields}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(made)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                try:
                    out.append({source: row[source], **run(row), ERROR: None})
                except MemoryError:
                    raise
                except Exception as error:
                    out.append({source: row[source], **arrow, ERROR: f"{type(error).__name__}: {error}"})
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    found = written(rows.mapInArrow(work, made), "isolated")
    failures = found.filter(F.col(ERROR).isNotNull()).groupBy(source).agg(F.count("*").alias("n_failed"), F.min(ERROR).alias("error"))
    bad = failures.select(F.col(source).alias("bad_source"))
    results = found.filter(F.col(ERROR).isNull()).join(bad, F.col(source).eqNullSafe(F.col("bad_source")), "left_anti").drop(ERROR)
    return results, failures


def isolated_parts(parts: dict[str, Callable[[], DataFrame]], name: str = "source") -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Queries that stand for sources, each run and written by itself: (results, errors) by source. A query that can't be planned or run has an error; the others go on."""
    results, errors = {}, {}
    for key, make in parts.items():
        try:
            results[key] = written(make(), f"{name}-part")
        except Exception as error:
            errors[key] = f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}"
    return results, errors
