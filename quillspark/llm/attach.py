"""Adding computed columns to documents, batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import textkit


def attach(df: DataFrame, name: str, fields: str, make: Callable, text: str = "text", limit: int = 1 << 20) -> DataFrame:
    """df with one more struct column `name`; a column of that name is replaced.

    make(buf, off) gets the UTF-8 bytes and offsets of some rows' texts (null
    texts are empty) and returns one Arrow array for each field.  No shuffle;
    a task holds about `limit` bytes of text at a time, or one longer row.
    """
    base = df.drop(name)
    kind = T._parse_datatype_string(fields)
    schema = T.StructType([*base.schema.fields, T.StructField(name, kind)])
    names = [f.name for f in kind.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.pieces(batches, limit, text):
            made = make(*textkit.utf8(batch.column(text)))
            made = [x if isinstance(x, pa.Array) else pa.array(np.ascontiguousarray(x)) for x in made]
            struct = pa.StructArray.from_arrays(made, names)
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], [*batch.schema.names, name])
        textkit.release()

    return base.mapInArrow(run, schema)
