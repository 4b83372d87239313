"""Running a small Python function over the texts of a frame, in Arrow batches, without any shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.pandas.types import to_arrow_schema



def per_text(
    docs: DataFrame, found: Callable[[str | None, str | None], Iterable[tuple]], id_col: str, text_col: str, title_col: str | None, columns: str
) -> DataFrame:
    """For each row the id and each tuple of found(text, title), as rows (id, *columns).  Only these columns are read."""
    title = F.col(title_col) if title_col and title_col in docs.columns else F.lit(None)
    narrow = docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("_text"), title.cast("string").alias("_title"))
    schema = StructType([narrow.schema[id_col], *StructType.fromDDL(columns).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, (text, title) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                for row in found(text, title):
                    at.append(i)
                    rows.append(row)
            ids = batch.column(0).take(pa.array(at, pa.int64()))
            values = list(zip(*rows)) if rows else [()] * (len(arrow) - 1)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(v, f.type) for v, f in zip(values, list(arrow)[1:]))], schema=arrow)

    return narrow.mapInArrow(run, schema)
