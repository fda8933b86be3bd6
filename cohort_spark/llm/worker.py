"""What a Python worker keeps between tasks, one thing at a time, and what it is sent at once.

Workers are reused by later stages.  Whatever an operator keeps for its next
task goes as soon as another operator, or another call, keeps something.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import SparkSession

_HELD: dict[Hashable, object] = {}
#: Rows with whole texts that a worker is sent at once, and Spark's setting for it.
TEXT_ROWS, BATCH_ROWS = 500, "spark.sql.execution.arrow.maxRecordsPerBatch"


def held(key: Hashable, make: Callable[[], object]):
    """What ``make`` gave for this key; anything kept for another key is let go first."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def one_by_one(column: pa.Array, at_once: int = 32) -> Iterator:
    """The values of a column, few of them as Python objects at a time.

    A batch holds thousands of whole texts, which as strings of two or four
    bytes a letter take several times the memory of the batch.
    """
    for at in range(0, len(column), at_once):
        yield from column.slice(at, at_once).to_pylist()


def few_texts_from_now(spark: SparkSession) -> None:
    """Workers of this session are sent ``TEXT_ROWS`` rows at once at most, also for frames that are computed later.

    Spark bounds a batch by rows, and by default ten thousand whole texts stand
    in the executor's heap, in its Arrow buffers and in the worker.
    """
    most = int(spark.conf.get(BATCH_ROWS))
    spark.conf.set(BATCH_ROWS, str(min(most, TEXT_ROWS) if most > 0 else TEXT_ROWS))


@contextmanager
def few_texts(spark: SparkSession) -> Iterator[None]:
    """As ``few_texts_from_now``, for what runs within; the session's own number then holds again."""
    given = spark.conf.get(BATCH_ROWS, None)
    few_texts_from_now(spark)
    try:
        yield
    finally:
        if given is None:
            spark.conf.unset(BATCH_ROWS)
        else:
            spark.conf.set(BATCH_ROWS, given)
