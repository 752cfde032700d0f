"""What SQL can call: detectors as table functions, and results of registered queries as temporary views.

    SELECT * FROM tidemark_blinks(TABLE(SELECT session_id, t_ms, aperture, bin, reference FROM frames) PARTITION BY session_id)

A table function gets the rows of one session as Arrow batches, brings them in order of time and gives the rows of the batch form,
with the session's id first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators import detect

#: Table functions: their fold, the column of time, and what they give beside session_id.
FOLDS: dict[str, tuple[Callable[[pd.DataFrame], pd.DataFrame], str, str]] = {
    "tidemark_blinks": (detect.blink_fold, "t_ms", detect.BLINK_SCHEMA), "tidemark_expressions": (detect.expression_fold, "t_ms", detect.EXPRESSION_SCHEMA),
    "tidemark_noise_floors": (detect.noise_fold, "acquired_at_ms", detect.NOISE_SCHEMA), "tidemark_nuclei": (detect.nucleus_fold, "t_ms", "t_ms double, nucleus boolean"),
}


def table_function(fold: Callable[[pd.DataFrame], pd.DataFrame], at: str, schema: str):
    """A table function of one session's rows, with a session_id of strings; each session's rows must come as one partition."""
    ddl = f"session_id string, {schema}"
    arrow = to_arrow_schema(T._parse_datatype_string(ddl))

    class Told:
        def __init__(self) -> None:
            self.parts: list[pa.RecordBatch] = []

        def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
            self.parts.append(rows)
            return iter(())

        def terminate(self) -> Iterator[pa.Table]:
            if self.parts:
                rows = pa.Table.from_batches(self.parts).to_pandas().sort_values(at, kind="stable")
                found = fold(rows.drop(columns="session_id"))
                found.insert(0, "session_id", rows["session_id"].iloc[0])
                yield pa.Table.from_pandas(found, schema=arrow, preserve_index=False)

    return F.arrow_udtf(Told, returnType=ddl)


def register(spark: SparkSession) -> None:
    """The table functions, for this session's SQL."""
    for name, parts in FOLDS.items():
        spark.udtf.register(name, table_function(*parts))


def publish(spark: SparkSession, sf_dir: str, queries: dict[str, Callable[[SparkSession, str], DataFrame]], names: Iterable[str], prefix: str = "tidemark_") -> list[str]:
    """Temporary views of the named queries' results, called prefix and the query's name."""
    views = []
    for name in names:
        queries[name](spark, sf_dir).createOrReplaceTempView(prefix + name)
        views.append(prefix + name)
    return views
