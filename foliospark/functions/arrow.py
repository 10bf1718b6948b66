"""Arrow helpers for the stages that need Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


#: Bytes of a batch that a function sees at once; larger ones are cut by rows.
SLICE_BYTES = 16 << 20


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about SLICE_BYTES, one row at least; without copying."""
    step = max(1, batch.num_rows * SLICE_BYTES // max(batch.nbytes, 1))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def spread(df: DataFrame) -> DataFrame:
    """`df` with its rows spread over the cores, if its scan yields less than half as many tasks as there are cores (a small file).

    Plans that hold a shuffle already, and streams, stay as they are.
    """
    if df.isStreaming:
        return df
    plan = df._jdf.queryExecution()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if plan.executedPlan().getClass().getSimpleName() == "AdaptiveSparkPlanExec" or 2 * plan.toRdd().getNumPartitions() > cores:
        return df
    return df.repartition(cores)


def map_rows(df: DataFrame, per_batch: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema) -> DataFrame:
    """Apply a record-batch function to every batch of `df`; no shuffle, but see `spread`. Batches of long texts are cut first, so that a worker's memory does not grow with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = per_batch(part)
                if out is not None:
                    yield out

    return spread(df).mapInArrow(run, schema)
