"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from clipline.session import cut

#: ASCII white space as the contracts name it, in Java regular expressions.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch at most: texts are long, and a batch is held by the JVM and by its Python worker.
BATCH_ROWS = 1_000
_BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(text: str | Column) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def local_table(rows: list[tuple], names: list[str]) -> pa.Table:
    """A small table of longs. As Arrow it reaches the JVM without Python workers, which a list of rows would start."""
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.table([pa.array(list(c), pa.int64()) for c in columns], names)


def stored(df: DataFrame, rows_per_task: int = 100_000) -> tuple[DataFrame, int]:
    """``df`` behind a checkpoint, and its number of rows.

    A small table left in very many partitions would make as many shuffle
    files in every later step, so partitions are joined until a task has about
    ``rows_per_task`` rows; larger tables keep theirs. Rows are counted as they
    are written: a query that counts them afterwards costs the driver as much
    as one that does work.
    """
    seen = Observation()
    kept = cut(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    rows = seen.get["rows"]
    return kept.coalesce(max(1, -(-rows // rows_per_task))), rows


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]],
                schema: str) -> DataFrame:
    """Arrow batches through a function that ``make`` builds once per task.

    Sets the session's Arrow batches to BATCH_ROWS rows if they are longer.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCHES)) <= BATCH_ROWS:
        conf.set(_BATCHES, str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            out = work(batch)
            if out is not None:
                yield out
    return df.mapInArrow(run, schema)


class Memo(dict):
    """Results of ``make`` by key, as a worker's memory: at most ``most`` of them.

    Once full, further keys are made anew each time, so frequent keys (which
    come early) stay; after many misses it starts over.
    """

    def __init__(self, make: Callable, most: int = 50_000):
        super().__init__()
        self.make, self.most, self.missed = make, most, 0

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < self.most:
            self[key] = value
            return value
        self.missed += 1
        if self.missed > 8 * self.most:
            self.clear()
            self.missed = 0
        return value


def keep_rows(docs: DataFrame, key: dict[str, Column], winners: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``key`` columns are in ``winners``, one row for each key.

    ``key`` names the columns of ``winners`` and gives the same values as
    expressions over ``docs``; nulls match nulls. Rows that agree in the whole
    key are repetitions, of which one stays. The key is one struct, in which
    nulls are equal, so join and repetitions share one shuffle of ``docs``.
    """
    name = fresh(docs, "_key")
    left = docs.withColumn(name, F.struct(*[expression.alias(k) for k, expression in key.items()]))
    right = winners.select(F.struct(*key).alias(f"{name}r"))
    kept = left.join(right, F.col(name) == F.col(f"{name}r"), "left_semi").dropDuplicates([name])
    return kept.select(docs.columns)
