"""Search of short patterns in sequences, with mismatches and ambiguous bases, on both strands."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import IUPAC
from .chunks import whole

#: Places of a piece that an exact search looks at together.
STEP = 256
_BIT = {"a": 1, "c": 2, "g": 4, "t": 8}
_MASK = np.zeros(256, np.uint8)
for _code, _bases in IUPAC.items():
    _MASK[ord(_code)] = sum(_BIT[b] for b in _bases) if len(_bases) == 1 else 0


def _wanted(pattern: str) -> np.ndarray:
    return np.array([sum(_BIT[b] for b in IUPAC.get(c, "acgt")) for c in pattern.lower()], np.uint8)


def _reverse(pattern: str) -> np.ndarray:
    swap = {1: 8, 2: 4, 4: 2, 8: 1}
    return np.array([sum(v for k, v in swap.items() if m & k) for m in _wanted(pattern)[::-1]], np.uint8)


def seeds(length: int, mismatches: int) -> list[tuple[int, int]]:
    """Disjoint parts of a pattern, one more than mismatches: one of them matches exactly."""
    step = length / (mismatches + 1)
    return [(int(i * step), int((i + 1) * step)) for i in range(mismatches + 1)]


def find_in(seq: np.ndarray, pattern: np.ndarray, mismatches: int) -> np.ndarray:
    """Places where the pattern matches: candidates by an exact seed, then all bases counted.

    A match that would end with the sequence's last base isn't reported.
    """
    n = len(seq) - len(pattern)
    if n <= 0:
        return np.zeros(0, np.int64)
    bits = _MASK[seq]
    fits = {w: (bits & w) != 0 for w in set(pattern.tolist())}
    hit = np.zeros(n, bool)
    for a, z in seeds(len(pattern), mismatches):
        ok = np.ones(n, bool)
        for j in range(a, z):
            ok &= fits[int(pattern[j])][j : j + n]
        hit |= ok
    at = np.nonzero(hit)[0]
    if not mismatches:
        return at
    right = sum(fits[int(p)][at + j].astype(np.int16) for j, p in enumerate(pattern))
    return at[right >= len(pattern) - mismatches]


def search(sequences: DataFrame, patterns: list[str], mismatches: int = 0, both_strands: bool = True) -> DataFrame:
    """(id, pattern, pos, strand) of each match in sequences (id, seq), or in chunks of sequences with
    halos (id, at, seq, halo) of at least the longest pattern's length; seq has a byte a base.

    All sequences of a batch are searched as one array; matches that run over an end are dropped.
    """
    held = sequences if "halo" in sequences.columns else whole(sequences)
    wanted = [(p, strand, f(p)) for p in patterns for strand, f in (("+", _wanted), ("-", _reverse))[: 1 + both_strands]]

    def run(parts):
        for b in parts:
            if not b.num_rows:
                continue
            text = b.column(2).cast(pa.large_binary())
            off = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            seq = np.frombuffer(text.buffers()[2], np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
            off, own, at = off - off[0], b.column(3).to_numpy(), b.column(1).to_numpy()
            for p, strand, want in wanted:
                place = find_in(seq, want, mismatches)
                row = np.searchsorted(off, place, "right") - 1
                local = place - off[row]
                keep = (local < own[row]) & (place + len(want) < off[row + 1])
                row, n = row[keep], int(keep.sum())
                if n:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array([p]).take(pa.array(np.zeros(n, np.int64))), pa.array(at[row] + local[keep]), pa.array([strand]).take(pa.array(np.zeros(n, np.int64)))], ["id", "pattern", "pos", "strand"])

    rows = held.where(F.col("seq").isNotNull()).select("id", F.col("at").cast("long").alias("at"), F.lower(F.concat("seq", "halo")).alias("text"), F.octet_length("seq").cast("long").alias("own"))
    return rows.mapInArrow(run, f"id {sequences.schema['id'].dataType.simpleString()}, pattern string, pos long, strand string")


def unique_matches(found: DataFrame) -> DataFrame:
    """Patterns with one match over all sequences."""
    return found.groupBy("pattern").agg(F.count("*").alias("n"), F.first("id").alias("id"), F.first("pos").alias("pos"), F.first("strand").alias("strand")).where("n = 1").drop("n")


def exact(sequences: DataFrame, text: str) -> DataFrame:
    """(id, pos) of each place of an ASCII text in sequences of one byte a base, overlapping ones
    too, without Python.  Pieces of STEP places are cut from the bytes, so the work grows with
    the length of a sequence, not its square."""
    n = len(text)
    raw = F.col("seq").cast("binary")
    cut = lambda at: F.struct(at.alias("at"), F.substring(raw, at + 1, F.lit(STEP + n - 1)).cast("string").alias("piece"))
    pieces = sequences.where(F.octet_length("seq") >= n).select("id", F.explode(F.transform(F.sequence(F.lit(0), F.octet_length("seq") - n, F.lit(STEP)), cut)).alias("p"))
    held = pieces.where(F.contains("p.piece", F.lit(text))).select("id", "p.at", "p.piece")
    places = F.filter(F.sequence(F.lit(0), F.length("piece") - n), lambda i: F.substring(F.col("piece"), i + 1, F.lit(n)) == text)
    return held.select("id", "at", F.explode(places).alias("i")).select("id", (F.col("at") + F.col("i")).cast("long").alias("pos"))
