"""Registration of the queries of this subpackage, table access, stored intermediates and dealing into cells."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from loomtab.session import load, scratch_path, shuffle_width

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

WORD = r"[^\x20\x09-\x0D]+"
CELL_BYTES = 8 << 20


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name or function.__name__] = function
        if sql is not None:
            ORACLES[name or function.__name__] = sql
        return function

    return add


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "documents")


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) alone, so that no other column of the input can clash."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: the lineage ends there, and every executor can read it."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few_rows(df: DataFrame) -> list[Row]:
    """All rows of a table whose size is fixed by its maker (parts of a bit map or of counters), fetched by one job."""
    return df.collect()


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(key: str, by: int) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % by


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def cells_for(spark: SparkSession, total_bytes: float, cell_bytes: int = CELL_BYTES) -> int:
    """How many cells of hash space keep each near ``cell_bytes``; a cell is one group of a later step."""
    return max(shuffle_width(spark), 8, int(total_bytes // cell_bytes) + 1)


def cell_bounds(sorted_keys: np.ndarray, cells: int) -> np.ndarray:
    """Where each cell begins in sorted 64-bit keys: cell c holds the c-th of ``cells`` equal parts of hash space."""
    edges = np.array([(c << 64) // cells for c in range(cells)], dtype=np.uint64)
    return np.append(np.searchsorted(sorted_keys, edges, "left"), len(sorted_keys))


def dealt(sorted_keys: np.ndarray, columns: list[np.ndarray], cells: int) -> Iterator[tuple[int, list[bytes]]]:
    """(cell, bytes of every column) of rows sorted by key; the keys are the first column."""
    bounds = cell_bounds(sorted_keys, cells)
    for c in np.flatnonzero(bounds[1:] > bounds[:-1]):
        cut = slice(bounds[c], bounds[c + 1])
        yield int(c), [sorted_keys[cut].tobytes(), *(x[cut].tobytes() for x in columns)]


def joined(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    """All bytes of a binary column as one array."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def blob_sizes(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Entries in every value of a binary column."""
    return np.array([len(x) // width for x in column.to_pylist()], dtype=np.int64)


def record(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def planes(values: np.ndarray) -> bytes:
    """Fixed-width values byte by byte: the high bytes of small numbers become long runs that compress away."""
    return values.view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes()


def from_planes(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    parts = [np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(width, -1).T).view(dtype).ravel() for x in column.to_pylist()]
    return np.concatenate(parts) if parts else np.empty(0, dtype)


def of_cell(key: str, text: str, cells: int) -> Column:
    """The cell of a document, a function of its id; rows without an id are spread by their text. ``cells`` is odd."""
    spread = F.col(key).bitwiseXOR(F.shiftright(key, 15)).bitwiseXOR(F.shiftright(key, 31))
    return F.pmod(F.coalesce(spread, F.xxhash64(text)), F.lit(cells)).cast("int")


def cell_of(ids: np.ndarray, cells: int) -> np.ndarray:
    """``of_cell`` of signed 64-bit ids."""
    return (ids ^ (ids >> 15) ^ (ids >> 31)) % cells


def runs(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where each run of equal rows begins."""
    fresh = np.zeros(len(sorted_columns[0]), bool)
    fresh[:1] = True
    for column in sorted_columns:
        fresh[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(fresh)
