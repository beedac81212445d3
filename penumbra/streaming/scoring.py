"""Structured Streaming forms of operators that need no second look at a row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from penumbra.operators.base import Model, _block


def score_stream(model: Model, points: DataFrame) -> DataFrame:
    """(id, k, u) of a stream of (id, features): the model's rule for new points, as a map without state.

    Rows with a null id or features are left out. The model must have a rule.
    """
    if model.rule is None:
        raise NotImplementedError(f"{model.name} has no rule for points that were not fitted")
    rule = model.rule

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                ids, x, _ = _block(b)
                u = rule(x)
                n, k = u.shape
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k)), pa.array(np.tile(np.arange(k, dtype=np.int32), n)), pa.array(u.ravel())], names=["id", "k", "u"])

    clean = points.select(F.col("id").cast("bigint").alias("id"), F.col("features").cast("array<double>").alias("features")).where("id is not null and features is not null")
    return clean.mapInArrow(run, "id bigint, k int, u double")


def window_moments(scored: DataFrame, at: str, width: str, late: str) -> DataFrame:
    """(window, k, n, mass): points and membership mass of each cluster per tumbling window; rows later than `late` are dropped by the watermark.

    scored is (id, k, u) with the time column `at`.
    """
    return scored.withWatermark(at, late).groupBy(F.window(at, width), "k").agg(F.count(F.lit(1)).alias("n"), F.sum("u").alias("mass"))


def each_batch(stream: DataFrame, do: Callable[[DataFrame, int], None], checkpoint: str, **options: str) -> StreamingQuery:
    """Runs `do` on each micro-batch until what is available is read; progress is kept in the folder `checkpoint`."""
    return stream.writeStream.options(checkpointLocation=checkpoint, **options).foreachBatch(do).trigger(availableNow=True).start()


__all__ = ["score_stream", "window_moments", "each_batch"]
