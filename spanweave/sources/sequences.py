"""FASTA, 2bit and FASTQ sources."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The 2bit magic number, and bases by code.
MAGIC, BASES = 0x1A412743, np.frombuffer(b"tcag", np.uint8)
WRAP = 80


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq): records of FASTA text, the sequence in lower case."""
    records = spark.read.option("lineSep", "\n>").text(path).where("trim(value) <> ''")
    body = F.regexp_replace("value", "^>", "")
    head = F.substring_index(body, "\n", 1)
    seq = F.when(F.contains(body, F.lit("\n")), F.expr("substring(regexp_replace(value, '^>', ''), instr(regexp_replace(value, '^>', ''), '\n') + 1)")).otherwise("")
    return records.select(F.trim(head).alias("name"), F.lower(F.regexp_replace(seq, r"\s", "")).alias("seq"))


def write_fasta(df: DataFrame, path: str, width: int = WRAP) -> None:
    wrapped = F.rtrim(F.regexp_replace("seq", f"(.{{{width}}})", "$1\n"))
    df.select(F.concat(F.lit(">"), F.col("name"), F.lit("\n"), wrapped).alias("value")).write.mode("overwrite").text(path)


def encode_twobit(sequences: dict[str, str]) -> bytes:
    """A 2bit file: index, runs of n, four bases a byte."""
    code = np.zeros(256, np.uint8)
    code[BASES] = np.arange(4)
    offset = 16 + sum(5 + len(n.encode()) for n in sequences)
    index, bodies = b"", b""
    for name, seq in sequences.items():
        b = np.frombuffer(seq.lower().encode(), np.uint8)
        gap = np.concatenate([[False], b == ord("n"), [False]])
        begin, end = np.nonzero(gap[1:] & ~gap[:-1])[0], np.nonzero(~gap[1:] & gap[:-1])[0]
        c = np.pad(code[b], (0, -len(b) % 4)).reshape(-1, 4)
        packed = (c[:, 0] << 6 | c[:, 1] << 4 | c[:, 2] << 2 | c[:, 3]).astype(np.uint8).tobytes()
        index += bytes([len(name.encode())]) + name.encode() + struct.pack("<I", offset + len(bodies))
        bodies += struct.pack("<II", len(b), len(begin)) + begin.astype("<u4").tobytes() + (end - begin).astype("<u4").tobytes() + struct.pack("<II", 0, 0) + packed
    return struct.pack("<IIII", MAGIC, 0, len(sequences), 0) + index + bodies


def write_twobit(df: DataFrame, path: str) -> None:
    """Write sequences (name, seq) as 2bit files, one for each partition, of at most 4 GB each."""

    def run(parts):
        held = {n: s for b in parts for n, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([encode_twobit(held)], pa.binary())], ["value"])

    made = df.select("name", F.coalesce("seq", F.lit("")).alias("seq")).mapInArrow(run, "value binary")
    made.select(F.col("value").cast("string").alias("value")).write.mode("overwrite").text(path)  # readers pass over the line end


def decode_twobit(raw: bytes, chunk: int) -> Iterator[tuple[str, int, str]]:
    """(name, start, bases) in chunks; either byte order, masks ignored."""
    order = "<" if struct.unpack("<I", raw[:4])[0] == MAGIC else ">"
    magic, _, n, _ = struct.unpack(f"{order}IIII", raw[:16])
    if magic != MAGIC:
        raise ValueError("not a 2bit file")
    at, entries = 16, []
    for _ in range(n):
        size = raw[at]
        entries.append((raw[at + 1 : at + 1 + size].decode(), struct.unpack(f"{order}I", raw[at + 1 + size : at + 5 + size])[0]))
        at += 5 + size
    u4 = np.dtype(f"{order}u4")
    for name, pos in entries:
        size, gaps = struct.unpack(f"{order}II", raw[pos : pos + 8])
        begin = np.frombuffer(raw, u4, gaps, pos + 8).astype(np.int64)
        end = begin + np.frombuffer(raw, u4, gaps, pos + 8 + 4 * gaps)
        pos += 8 + 8 * gaps
        masks = struct.unpack(f"{order}I", raw[pos : pos + 4])[0]
        pos += 8 + 8 * masks
        for start in range(0, max(size, 1), chunk):
            stop = min(start + chunk, size)
            packed = np.frombuffer(raw, np.uint8, -(-stop // 4) - start // 4, pos + start // 4)
            bases = BASES[np.stack([packed >> 6 & 3, packed >> 4 & 3, packed >> 2 & 3, packed & 3], axis=1).ravel()[start % 4 :][: stop - start]].copy()
            for a, z in zip(begin, end):
                if a < stop and z > start:
                    bases[max(a - start, 0) : z - start] = ord("n")
            yield name, start, bases.tobytes().decode()


def read_twobit(spark: SparkSession, path: str, chunk: int = 1 << 20) -> DataFrame:
    """(name, start, seq): chunks of each sequence of 2bit files."""

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for raw in f["content"]:
                for name, start, seq in decode_twobit(raw, chunk):
                    yield pd.DataFrame({"name": [name], "start": [start], "seq": [seq]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(decode, "name string, start long, seq string")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq, quality) of FASTQ text with four lines a record."""
    records = spark.read.option("lineSep", "\n@").text(path).where("trim(value) <> ''")
    c = F.split(F.regexp_replace("value", "^@", ""), "\n")
    return records.select(c[0].alias("name"), F.lower(c[1]).alias("seq"), c[3].alias("quality"))


def pair_fastq(paths: list[str]) -> tuple[list[tuple[str, str]], list[str]]:
    """Pairs of files _1.f... and _2.f..., and the files without a mate."""
    first = {re.sub(r"_1(?=\.f)", "_*", p): p for p in paths if re.search(r"_1\.f", p)}
    second = {re.sub(r"_2(?=\.f)", "_*", p): p for p in paths if re.search(r"_2\.f", p)}
    both = sorted(first.keys() & second.keys())
    paired = {first[k] for k in both} | {second[k] for k in both}
    return [(first[k], second[k]) for k in both], sorted(set(paths) - paired)
