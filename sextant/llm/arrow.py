"""Row-wise Arrow helpers shared by the text scanners."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows turned into Arrow at a time; texts are long, so this stays small.
ROWS = 512
#: Bytes of rows that go to a worker at once, where the session sets no bound of its own.
BATCH_BYTES = 4 << 20
SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``mapInArrow`` in batches of BATCH_BYTES, so that long texts fill neither the worker nor the executor's buffers."""
    conf = df.sparkSession.conf
    if conf.get(SETTING, None) is None:
        conf.set(SETTING, f"{BATCH_BYTES}b")
    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, each: Callable[..., Iterable[tuple]], schema: StructType | str) -> DataFrame:
    """Calls ``each(*values)`` for every row of ``df``; it yields the output rows as tuples."""
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(kind)
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * len(arrow)
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
            out.clear()
            return batch

        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                for values in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    out.extend(each(*values))
                if len(out) >= ROWS:
                    yield flush()
        if out:
            yield flush()

    return map_batches(df, run, kind)
