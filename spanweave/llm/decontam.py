"""Benchmark decontamination by pigeonhole edit matching.

A test item may occur in a document with an error budget of k edits, a fixed share of its
length.  The item is cut into k + 1 pieces: at most k of them can hold an edit, so at least
one occurs exactly.  All pieces of a block of items are found in one pass by an automaton;
around each hit Myers' bit-parallel recurrence gives the edit distance of the best occurrence.
An item too short for an edit (k = 0) counts only as whole words.  Items without letters match
nothing.  Texts are compared in lower case with each run of white space as one blank.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, small_batches, table

#: Edits allowed for each character of an item.
BUDGET = 0.08
#: Bytes of item texts that one pass over the documents takes; more items mean more passes.
BLOCK_BYTES = 8 << 20


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(item: str, rate: float = BUDGET) -> int:
    return int(rate * len(item))


def occurrence(item: str, text: str, k: int) -> tuple[int, int, int] | None:
    """(distance, start, stop) of the closest occurrence of `item` in `text` within k edits.

    Myers' recurrence with one big integer for a column; the first end with the least
    distance counts, and the latest start that reaches it.
    """
    m = len(item)
    if not m:
        return None
    mask, top = (1 << m) - 1, 1 << (m - 1)

    def column_scores(pattern: str, chars, free: bool):
        eq: dict[str, int] = {}
        for i, c in enumerate(pattern):
            eq[c] = eq.get(c, 0) | 1 << i
        up, down, score = mask, 0, m
        for j, c in enumerate(chars):
            e = eq.get(c, 0)
            x = (((e & up) + up) ^ up) | e | down
            plus = down | (~(x | up) & mask)
            minus = up & x
            if plus & top:
                score += 1
            elif minus & top:
                score -= 1
            plus = (plus << 1 | (0 if free else 1)) & mask
            minus = minus << 1 & mask
            v = e | down
            up = minus | (~(v | plus) & mask)
            down = plus & v
            yield score, j + 1

    best, stop = min(column_scores(item, text, True), default=(k + 1, 0))
    if m <= min(best, k):
        return m, 0, 0
    if best > k:
        return None
    back = column_scores(item[::-1], reversed(text[max(0, stop - m - k) : stop]), False)
    return best, stop - next(j for s, j in back if s == best), stop


#: Letters of scripts that are written without blanks: Thai to Tibetan, Myanmar, Khmer, and from CJK on.
_UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u2e80-\uabff\uf900-\ufaff\U00020000-\U0003ffff]")


def _joined(a: str, b: str) -> bool:
    """Whether neighbouring characters belong to one word."""
    return all((c.isalnum() or c == "_" or unicodedata.category(c)[0] == "M") and not _UNSPACED.match(c) for c in (a, b))


def _whole(text: str, start: int, stop: int) -> bool:
    """Whether text[start:stop] begins and ends at word boundaries."""
    return not (start and _joined(text[start - 1], text[start])) and not (stop < len(text) and _joined(text[stop - 1], text[stop]))


class Matcher:
    """Finds the items of a block in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float = BUDGET):
        import ahocorasick

        self.items = [(i, t, budget(t, rate)) for i, x in items if any(map(str.isalpha, t := normal(x)))]
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, k) in enumerate(self.items):
            cuts = [len(t) * q // (k + 1) for q in range(k + 2)]
            for a, z in zip(cuts, cuts[1:]):
                where.setdefault(t[a:z], []).append((n, a))
        self.auto = ahocorasick.Automaton()
        for piece, at in where.items():
            self.auto.add_word(piece, (len(piece), at))
        self.auto.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, stop) of the closest occurrence of each item found."""
        t = normal(text)
        if not self.items or not t:
            return []
        near: dict[int, list[int]] = {}
        for end, (size, at) in self.auto.iter(t):
            for n, a in at:
                near.setdefault(n, []).append(end + 1 - size - a)
        out = []
        for n, starts in near.items():
            item, x, k = self.items[n]
            starts.sort()
            if not k:  # each start is an occurrence
                if (s := next((s for s in starts if _whole(t, s, s + len(x))), None)) is not None:
                    out.append((item, 0, s, s + len(x)))
                continue
            found, low = [], starts[0]
            for s, after in zip(starts, [*starts[1:], None]):
                if after is None or after - s > 2 * k + 1:  # else one window takes both
                    begin = max(0, low - k)
                    if hit := occurrence(x, t[begin : s + len(x) + k], k):
                        found.append((hit[0], begin + hit[1], begin + hit[2]))
                    low = after
            if found:
                out.append((item, *min(found)))
        return out


def _blocks(bench: DataFrame, limit: int = BLOCK_BYTES):
    """Lists of (item id, text) of about `limit` bytes each.  The driver reads one at a time; the
    broadcasts made of them stay until the query ends, so a benchmark of many blocks takes its
    own size on the driver and a scan of the documents for each block."""
    items = bench.select(F.col("item_id").cast("long").alias("i"), F.coalesce("text", F.lit("")).alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-total // limit)
    for b in range(n):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).distinct().orderBy("i", "t").collect()]


SCHEMA = "doc_id long, item_id long, distance int, start int, stop int"


def contaminated(docs: DataFrame, bench: DataFrame, rate: float = BUDGET, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, distance, start, stop) for each document row and item it holds.

    start and stop count characters of the document in its compared form.  Items without any
    letters and documents without text match nothing; each row of a repeated document counts.
    """
    spark = docs.sparkSession
    out = None
    for block in _blocks(bench, block_bytes):
        shared = spark.sparkContext.broadcast(block)  # at most block_bytes of text

        def run(parts, shared=shared):
            m = Matcher(shared.value, rate)
            for b in parts:
                rows = [(d, *hit) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for hit in m.find(t)]
                if rows:
                    cols = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "distance", "start", "stop"])

        part = id_text(docs).mapInArrow(run, SCHEMA)
        out = part if out is None else out.unionAll(part)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def _holds(spark, block: list[tuple[int, str]], rate: float = BUDGET):
    """A column function: whether a text holds an item of the block."""
    shared = spark.sparkContext.broadcast(block)  # at most BLOCK_BYTES of text

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = Matcher(shared.value, rate)
        for texts in parts:
            yield pd.Series([bool(m.find(t)) for t in texts], dtype=bool)

    return F.pandas_udf(run, "boolean")


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Each item that each row of documents holds; rules as in contaminated(): null and empty texts
    and items hold and match nothing, null ids stay null, repeated rows count each, the first
    closest occurrence counts, long texts are read whole, empty tables give no rows."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold an item within its error budget go.

    Each row is judged by its own text, so ids may repeat or be missing; null texts hold no item
    and stay; with an empty benchmark all documents stay.
    """
    small_batches(spark)
    for block in _blocks(table(spark, sf_dir, "benchmark")):
        docs = docs.where(~_holds(spark, block)(F.coalesce("text", F.lit(""))))
    return docs
