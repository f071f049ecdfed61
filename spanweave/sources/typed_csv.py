"""Delimited text with typed headers, NPZ frames, and the choice by extension.

A typed file starts with a comment `# Type; Type; ...` and a header record; its schema is what
those two lines say, never a guess.
"""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of column types in a typed header.
TYPES = {
    "Byte": T.ByteType(), "Short": T.ShortType(), "Integer": T.IntegerType(), "Long": T.LongType(), "Float": T.FloatType(), "Double": T.DoubleType(),
    "Boolean": T.BooleanType(), "String": T.StringType(),
}
_NAMES = {type(t): n for n, t in TYPES.items()}


def separator(path: str) -> str:
    stem = path.removesuffix(".gz").removesuffix(".zip")
    return "," if stem.endswith(".csv") else "\t"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of plain, gzip or (one entry) zip text files."""
    if not path.endswith(".zip"):
        return spark.read.text(path)

    def unzip(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for raw in f["content"]:
                with zipfile.ZipFile(io.BytesIO(raw)) as z, z.open(z.namelist()[0]) as entry:
                    while lines := entry.readlines(8 << 20):
                        yield pd.DataFrame({"value": [x.decode().rstrip("\r\n") for x in lines]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unzip, "value string")


def schema_of(types: list[str], names: list[str]) -> T.StructType:
    """Unknown type names are enumerations, kept as strings."""
    if len(types) != len(names):
        raise ValueError(f"{len(types)} types for {len(names)} columns")
    return T.StructType([T.StructField(n, TYPES.get(t.strip(), T.StringType())) for t, n in zip(types, names)])


def read(spark: SparkSession, path: str, schema: T.StructType | None = None, header: bool = True) -> DataFrame:
    """A typed file; with a schema, one that may lack the types and the header.

    A value that isn't of its column's type is an error, but anything that isn't 1 or true is
    false; further fields at the end of a record are ignored.
    """
    sep = separator(path)
    lines = _lines(spark, path)
    if schema is None:
        top = [r[0] for r in lines.limit(2).collect()]
        if len(top) < 2 or not top[0].startswith("#"):
            raise ValueError(f"{path} has no typed header")
        schema = schema_of(top[0].lstrip("# ").split(";"), next(csv.reader([top[1]], delimiter=sep)))
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    rows = spark.read.schema(text).option("sep", sep).option("comment", "#").option("quote", '"').option("escape", '"').option("header", header).option("enforceSchema", True)
    if path.endswith(".zip"):
        lines = lines.where(~F.col("value").startswith("#"))
        top = lines.first()[0] if header else None  # a zip file is one task, its first record the header
        lines = lines.where(F.col("value") != top) if header else lines
        cells = F.from_csv("value", F.lit(", ".join(f"`{f.name}` string" for f in text)), {"sep": sep, "escape": '"'})
        got = lines.select(cells.alias("c")).select("c.*")
    else:
        got = rows.csv(path)

    def typed(f: T.StructField):
        c = F.col(f"`{f.name}`")
        return F.lower(F.trim(c)).isin("1", "true") if isinstance(f.dataType, T.BooleanType) else c.cast(f.dataType)

    return got.select(*[typed(f).alias(f.name) for f in schema])


def format_rows(schema: T.StructType, rows: list[list], sep: str, types: bool = True, header: bool = True) -> str:
    """Rows as typed text; booleans are 1 and 0."""
    out = io.StringIO()
    if types:
        out.write("# " + ";\t".join(_NAMES.get(type(f.dataType), "String") for f in schema) + "\n")
    w = csv.writer(out, delimiter=sep, lineterminator="\n", quoting=csv.QUOTE_MINIMAL)
    if header:
        w.writerow([f.name for f in schema])
    w.writerows([[int(v) if isinstance(v, bool) else "" if v is None else v for v in r] for r in rows])
    return out.getvalue()


def write(df: DataFrame, path: str, types: bool = True, header: bool = True) -> None:
    """Part files of typed text, each with its own types and header lines."""
    sep, schema = separator(path), df.schema

    def render(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = True
        for f in frames:
            rows = f.astype(object).where(f.notna(), None).values.tolist()
            text = format_rows(schema, rows, sep, types and first, header and first)
            first = False
            yield pd.DataFrame({"value": text.splitlines()})

    df.mapInPandas(render, "value string").write.mode("overwrite").text(path)


def write_npz(df: DataFrame, path: str) -> None:
    """Write rows as NPZ files, one for each partition, with an array for each column; nulls are an
    error, as arrays have none.

    A file is a line of bytes whose end is the archive's comment of one sign, so that Spark's text
    writer makes it in any store.
    """
    names = df.columns

    def run(parts):
        held = [b for b in parts if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        if any(c.null_count for c in t.columns):
            raise ValueError("arrays have no nulls")
        out = io.BytesIO()
        np.savez_compressed(out, **{n: c.to_numpy() if not pa.types.is_string(c.type) else np.array(c.to_pylist(), str) for n, c in zip(names, t.columns)})
        with zipfile.ZipFile(out, "a") as z:
            z.comment = b"\n"
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()[:-1]], pa.binary())], ["value"])

    df.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value")).write.mode("overwrite").text(path)


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """One-dimensional arrays of NPZ files as columns; the schema is that of the first file."""
    files = spark.read.format("binaryFile").load(path).select("content")
    with np.load(io.BytesIO(files.first()[0]), allow_pickle=False) as z:
        kinds = {k: z[k].dtype for k in z.files}
    names = {"b": "boolean", "i1": "tinyint", "i2": "smallint", "i4": "int", "i8": "long", "f4": "float", "f8": "double"}
    schema = ", ".join(f"`{k}` {names['b'] if d.kind == 'b' else names.get(d.str[1:], 'string')}" for k, d in kinds.items())

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for raw in f["content"]:
                with np.load(io.BytesIO(raw), allow_pickle=False) as z:
                    yield pd.DataFrame({k: z[k] if z[k].dtype.kind != "U" else z[k].astype(object) for k in z.files})

    return files.mapInPandas(load, schema)


def load(spark: SparkSession, path: str) -> DataFrame:
    return read_npz(spark, path) if path.endswith(".npz") else read(spark, path)
