"""Helpers shared by the training-data operators: table access, Arrow views, staging.

Rules that hold for every operator of this subpackage, unless its docstring says otherwise:

* a null text counts as the empty text; a null id stays null in the result and sorts before
  every other id; repeated rows each get a result row;
* only the named input columns are read, so extra columns can't clash with working columns;
* an empty table gives an empty result with the same schema.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: Stands for a null id inside Arrow code; it sorts before every real id.
NULL_ID = -(2**63)
#: Bytes of text that a vectorised kernel takes at a time; bounds its working arrays.
SLICE_BYTES = 2 << 20
#: Bytes of an Arrow batch on its way to a Python worker.  Spark's own limit is as good as none for
#: texts, and executor and worker each hold a batch and copies of it for every running task.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, read by Spark (so the folder may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string) with null texts as empty ones."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc, th, doc_id, text): documents with a key that is never null.

    th is a 64-bit hash of the text.  doc is the id; a null id gets a number from another hash
    of the text, in the lowest eighth of all numbers, so that texts without an id are told apart
    by 125 bits and come before all usual ids.  Rows with equal keys are one document given
    several times.
    """
    unnamed = F.shiftrightunsigned(F.xxhash64(F.lit("null"), "text"), 3) + F.lit(NULL_ID)
    return id_text(docs).select(F.coalesce("doc_id", unnamed).alias("doc"), F.xxhash64("text").alias("th"), "doc_id", "text")


def one_text_each(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """(i, y, text) of the documents with ids in `picked` (i, y; a bounded sample of labels): one
    text for each id, that with the least hash where an id has several."""
    rows = docs.select(F.col("doc_id").cast("long").alias("i"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "i")
    return rows.groupBy("i").agg(F.first("y").alias("y"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    This cuts lineage in a place that survives a lost executor, and keeps a costly
    intermediate result from being computed twice.  The table lives until the job's
    checkpoint folder is cleared.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/spanweave-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """From now on batches of rows for Python hold BATCH_BYTES, and the row that reaches it, in this
    session, unless its user has set a limit.  No result depends on it.  Spark reads the
    setting as a job runs, so it can't be taken back before a stage's result is used."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1, int64) and bytes of an Arrow string or binary column; nulls as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.large_binary()
    if not (pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_string())
    column = column.cast(large)
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(at):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], buf[at[0] : at[-1]]


def ids(column: pa.Array) -> np.ndarray:
    """An id column as int64, nulls as NULL_ID."""
    return column.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def id_array(values: np.ndarray) -> pa.Array:
    """The inverse of ids()."""
    return pa.array(values, pa.int64(), mask=values == NULL_ID)


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of rows with about `limit` bytes each; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def slide(v: np.ndarray, width: int, f) -> np.ndarray:
    """f over each window of `width` values, by doubling; len(v) - width + 1 results."""
    size = 1
    while 2 * size <= width:
        v = f(v[:-size], v[size:])
        size *= 2
    return f(v[: len(v) - (width - size)], v[width - size :]) if size < width else v
