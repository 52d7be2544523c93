"""Vectorizing streams. Stateless operators are the same functions on streaming DataFrames; a
fitted vocabulary joins as a static table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ..functions.pairs import hashed_cells
from ..operators.vectorize import CountOptions, HashOptions

CELLS = ArrayType(StructType([StructField("col", LongType()), StructField("value", DoubleType())]))
#: Rows of a batch that are hashed at once, which bounds a worker's memory.
ROWS = 256


def hash_stream(docs: DataFrame, options: HashOptions = HashOptions(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, cells array<struct<col, value>>): the hashed vector within each row, so that no state
    is kept between batches. Cells that cancel to 0 are left out."""
    terms = options.count.terms(text_col)
    rows = docs.select(id_col, terms.alias("terms"))

    n, norm = options.n_features, options.norm
    count = hashed_cells("row", n, options.alternate_sign, options.count.binary)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                terms = part.column(1).fill_null([])
                (cells,) = count([pa.RecordBatch.from_arrays([pa.array(np.arange(part.num_rows)), terms], names=["row", "terms"])])
                row, col, v = (np.asarray(c) for c in cells.columns)
                row, col, v = row[v != 0], col[v != 0], v[v != 0]
                if norm is not None:
                    size = np.bincount(row, np.abs(v) if norm == "l1" else v * v, part.num_rows)
                    v = v / (size if norm == "l1" else np.sqrt(size))[row]
                ends = np.cumsum(np.bincount(row, minlength=part.num_rows))
                cells = pa.StructArray.from_arrays([pa.array(col), pa.array(v)], names=["col", "value"])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), cells)], names=[id_col, "cells"])

    return rows.mapInArrow(run, StructType([rows.schema[0], StructField("cells", CELLS)]))


def count_stream(docs: DataFrame, vocabulary: DataFrame, options: CountOptions = CountOptions(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, term, col) of each occurrence of a known term: a stream-static join, with no state."""
    terms = docs.select(id_col, F.explode(options.terms(text_col)).alias("term"))
    return terms.join(vocabulary.select("term", "col"), "term")


