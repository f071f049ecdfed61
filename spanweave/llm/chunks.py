"""Substring dedup by content-defined chunks.

A gear hash rolls over each text's bytes, and a boundary stands where it has a local minimum.
So boundaries depend on the bytes around them only, and an insertion shifts none but its
neighbours.  Chunks have variable sizes and are deduplicated by 128-bit digest: the earliest
by (doc_id, start) stays, later ones are repeats.  Repeats that touch over STRETCH bytes are
removed.  Where a few bytes repeat over and over, minima are tied; there some of the tied ones are
boundaries too, whole periods apart, so that a run falls into equal chunks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, partitions, slices, slide, table, utf8

#: Bytes of the hash's window; positions on either side of a boundary that have no lower
#: hash; most bytes of a chunk.  Chunks have about 2 * NEAR bytes, so a passage of 50 words
#: holds several whole ones.
WINDOW, NEAR, MAX = 16, 24, 512
#: Least bytes between boundaries at tied minima.
TIED = 8
#: Repeated chunks go where they touch over this many bytes; a single common line stays.
STRETCH = 100
#: Input bytes for each partition of the step by digest.
PARTITION = 24 << 20


def _gear() -> np.ndarray:
    z = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z >> np.uint64(32)).astype(np.uint16)


GEAR = _gear()


def rolled(data: np.ndarray) -> np.ndarray:
    """The gear hash h = (h << 1) + GEAR[byte] in 16 bits at each byte, by doubling: a register
    of 16 bits forgets after 16 bytes, so four rounds that add the hash before give all of it."""
    h = GEAR[data]
    for w in (1, 2, 4, 8):
        h[w:] += h[:-w] << np.uint16(w)
    return h


def _bounds(tied: np.ndarray) -> np.ndarray:
    """Of minima in order, the first of each chain of tied ones (NEAR or less apart) and those
    that follow it by TIED bytes or more from one to the next.

    A chain is a run of a period of up to NEAR bytes, so its chunks are equal, wherever it begins.
    """
    if len(tied) < 2:
        return tied
    begins = np.append(True, np.diff(tied) > NEAR)
    taken, chain = begins.copy(), np.cumsum(begins)
    after = np.searchsorted(tied, tied + TIED)
    at = after[begins]  # one step along all chains at a time
    of = chain[begins]
    while len(at):
        on = at < len(tied)
        at, of = at[on], of[on]
        on = chain[at] == of
        at, of = at[on], of[on]
        taken[at] = True
        at = after[at]
    return tied[taken]


def cuts(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """The chunk ends of each text, from its start.

    A boundary is where the hash is less than all of NEAR positions before it and not more
    than those after it.  Unlike a rule with a least size from the last boundary, this looks
    at the bytes around alone, so equal passages get equal chunks at once.  Minima tied with one
    before are boundaries as in _bounds.
    """
    n = len(offsets) - 1
    size = np.diff(offsets)
    which = np.repeat(np.arange(n), size)
    place = np.arange(len(data)) + NEAR * (which + 1)  # texts stand NEAR apart
    h = np.full(len(data) + NEAR * (n + 1) + 1, 0xFFFF, np.uint16)
    h[place] = rolled(data)
    begin = offsets[:-1][size > 0]
    for k in range(WINDOW - 1):  # a window that would reach into the text before
        at = begin[size[size > 0] > k] + k
        h[place[at]] = 0xFFFF
    least = slide(h, NEAR, np.minimum)
    here = np.zeros(len(h), bool)
    here[NEAR : len(h) - NEAR] = (h[NEAR:-NEAR] <= least[: len(h) - 2 * NEAR]) & (h[NEAR:-NEAR] <= least[NEAR + 1 : len(h) - NEAR + 1])
    here &= h < 0xFFFF
    bounds = np.zeros(len(h), bool)
    bounds[_bounds(np.nonzero(here)[0])] = True
    at = np.nonzero(bounds[place])[0] + 1
    marks, bound = at.tolist(), np.searchsorted(at, offsets, "right")
    out = []
    for i in range(n):
        base, end = int(offsets[i]), int(offsets[i + 1])
        ends, start = [], base
        for m in (*marks[bound[i] : bound[i + 1]], end):
            while m - start > MAX:
                start += MAX
                ends.append(start - base)
            if m > start:
                start = m
                ends.append(m - base)
        out.append(ends)
    return out


_SIZE = 10  # bits of a packed chunk place that hold its size
ROWS = "doc long, th long, at long, d1 long, d2 long, kind int"
#: Kinds of rows that are dealt: a chunk; one that an equal chunk of its slice precedes; a
#: document row with its number of chunks and bytes, and such a row without an id.  Only the
#: first kind is dealt by digest, so a common passage has a row for each slice there, not for
#: each document; the others are dealt by document.
CHUNK, LATER, DOCUMENT, UNNAMED = 0, 1, 2, 3


def _chunk_rows(parts):
    """The chunks of all texts with their digests, and a row for each document."""
    for b in parts:
        at, data = utf8(b.column(3))
        doc, th = b.column(0).to_numpy(), b.column(1).to_numpy()
        whole = np.where(b.column(2).is_null().to_numpy(zero_copy_only=False), UNNAMED, DOCUMENT).astype(np.int32)
        own = doc * 31 + th
        for i, j in slices(at):
            part = data[at[i] : at[j]]
            raw = memoryview(part)
            base = at[i : j + 1] - at[i]
            ends = cuts(part, base)
            per = np.array([len(e) for e in ends])
            stop = np.fromiter((x for e in ends for x in e), np.int64, per.sum())
            start = np.append(0, stop[:-1])[: len(stop)]
            start[(np.cumsum(per) - per)[per > 0]] = 0
            row = np.repeat(np.arange(j - i), per)
            lo, hi = (base[row] + start).tolist(), (base[row] + stop).tolist()
            digest = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[a:z]) for a, z in zip(lo, hi)]), "<i8").reshape(-1, 2)
            size = stop - start
            d, t, place, d1, d2 = doc[i + row], th[i + row], start << _SIZE | size, digest[:, 0], digest[:, 1]
            kind = np.where(_preceded(d, place, d1, d2), LATER, CHUNK).astype(np.int32)
            cols = [
                np.concatenate([d, doc[i:j]]), np.concatenate([t, th[i:j]]), np.concatenate([place, np.diff(base)]),
                np.concatenate([np.where(kind == LATER, own[i + row], d1), own[i:j]]), np.concatenate([d2, per]), np.concatenate([kind, whole[i:j]]),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], ["doc", "th", "at", "d1", "d2", "kind"])


def _firsts(d1, d2) -> np.ndarray:
    """For rows in order of digest, the index of the first row with the same one."""
    same = np.append(False, (d1[1:] == d1[:-1]) & (d2[1:] == d2[:-1]))[: len(d1)]
    return np.maximum.accumulate(np.where(same, 0, np.arange(len(d1)))) if len(d1) else np.zeros(0, np.int64)


def _preceded(doc, at, d1, d2) -> np.ndarray:
    """For each chunk, whether an equal one stands earlier by (doc, start)."""
    by = np.lexsort((at, doc, d2, d1))
    first = by[_firsts(d1[by], d2[by])]
    out = np.zeros(len(by), bool)
    out[by] = (doc[by] != doc[first]) | (at[by] != at[first])
    return out


def _repeats(parts):
    """Of rows dealt by digest and sorted: the repeated chunks and the document rows.  Between
    batches only the last digest and its first chunk are held."""
    d1_, d2_, doc_, at_ = (np.zeros(0, np.int64) for _ in range(4))
    for b in parts:
        doc, th, at, d1, d2, kind = (b.column(c).to_numpy() for c in ("doc", "th", "at", "d1", "d2", "kind"))
        out = kind != CHUNK
        i = np.nonzero(~out)[0]
        if len(i):
            held = len(d1_)
            keys = [np.concatenate([x, y[i]]) for x, y in ((d1_, d1), (d2_, d2), (doc_, doc), (at_, at))]
            first = _firsts(keys[0], keys[1])
            out[i] = ((keys[2] != keys[2][first]) | (keys[3] != keys[3][first]))[held:]
            d1_, d2_, doc_, at_ = (k[first[-1] : first[-1] + 1] for k in keys)
        whole = kind[out] >= DOCUMENT
        chunks = np.where(whole, d2[out], 0)
        yield pa.RecordBatch.from_arrays([pa.array(c[out]) for c in (doc, th, at)] + [pa.array(chunks), pa.array(whole), pa.array(kind[out] == UNNAMED)], ["doc", "th", "at", "chunks", "whole", "unnamed"])


def stretches(ats: list[int]) -> list[tuple[int, int, int]]:
    """(start, stop, chunks) of stretches of touching repeated chunks with STRETCH bytes or more."""
    out, begin, end, n = [], -1, -1, 0
    for p in [*sorted(set(ats)), None]:
        start = None if p is None else p >> _SIZE
        if start != end:
            if end - begin >= STRETCH:
                out.append((begin, end, n))
            begin, end, n = start, start, 0
        if p is not None:
            end, n = end + (p & ((1 << _SIZE) - 1)), n + 1
    return out


def repeated_places(docs: DataFrame) -> DataFrame:
    """(doc, th, unnamed, rows, bytes, chunks, ats): one row for each different document (id and
    text), whether its id is null, how often it is given, and the packed places of its repeated
    chunks."""
    texts = keyed(docs)
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(partitions(docs.sparkSession), size // PARTITION + 1)
    dealt = texts.mapInArrow(_chunk_rows, ROWS).repartition(n, "d1").sortWithinPartitions("d1", "d2", "doc", "at")
    found = dealt.mapInArrow(_repeats, "doc long, th long, at long, chunks long, whole boolean, unnamed boolean")
    return found.groupBy("doc", "th").agg(
        F.max("unnamed").alias("unnamed"), F.sum(F.col("whole").cast("long")).alias("rows"), F.max(F.when(F.col("whole"), F.col("at"))).alias("bytes"), F.max("chunks").alias("chunks"),
        F.collect_list(F.when(~F.col("whole"), F.col("at"))).alias("ats"),
    )


def chunk_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_chunks, n_repeated, n_removed, n_spans) for each document row.

    n_repeated counts all repeated chunks; n_removed the bytes of the stretches that go.  Rows
    with the same id and text are one document given twice and get the same result; an empty
    text has no chunks.
    """

    def run(parts):
        for b in parts:
            d = b.to_pydict()
            gone = [stretches(a) for a in d["ats"]]
            times = np.array(d["rows"], np.int64)
            row = np.repeat(np.arange(b.num_rows), times)
            one = [d["bytes"], d["chunks"], [len(set(a)) for a in d["ats"]], [sum(z - a for a, z, _ in g) for g in gone], [len(g) for g in gone]]
            cols = [pa.array(np.array(c, np.int64)[row]) for c in one]
            doc = pa.array(np.array(d["doc"], np.int64)[row], mask=np.array(d["unnamed"], bool)[row])
            yield pa.RecordBatch.from_arrays([doc, *cols], ["doc_id", "n_bytes", "n_chunks", "n_repeated", "n_removed", "n_spans"])

    return repeated_places(docs).mapInArrow(run, "doc_id long, n_bytes long, n_chunks long, n_repeated long, n_removed long, n_spans long")


def _kept(raw: bytes, ats: list[int] | None) -> list[bytes]:
    """The parts of a text that its repeated stretches leave."""
    done, kept = 0, []
    for a, z, _ in stretches(ats or []):
        kept.append(raw[done:a])
        done = z
    return [*kept, raw[done:]]


def _with_places(docs: DataFrame, *columns: str) -> DataFrame:
    """(doc_id, text, ats, columns of repeated_places) for each document row."""
    places = repeated_places(docs).select("doc", "th", "ats", *columns)
    return keyed(docs).join(places.hint("shuffle_hash"), ["doc", "th"], "left").select("doc_id", "text", "ats", *columns)


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the documents without their repeated stretches.  A character that a
    chunk boundary cuts in two, with one half removed, is dropped as a whole."""

    def run(parts):
        for b in parts:
            at, data = utf8(b.column(1))
            raw = data.tobytes()
            out = [b"".join(_kept(raw[at[i] : at[i + 1]], ats)).decode("utf-8", "ignore") for i, ats in enumerate(b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return _with_places(docs).mapInArrow(run, "doc_id long, text string")


def chunk_digests(docs: DataFrame) -> DataFrame:
    """The columns of chunk_dedup and kept_sha256, of the bytes that are left of each document row,
    cut out of its text."""

    def run(parts):
        for b in parts:
            at, data = utf8(b.column(1))
            raw, rows = data.tobytes(), []
            for i, ats in enumerate(b.column(2).to_pylist()):
                ats = ats or []
                kept, digest = _kept(raw[at[i] : at[i + 1]], ats), hashlib.sha256()
                for part in kept:
                    digest.update(part)
                n = int(at[i + 1] - at[i])
                rows.append((n, len(set(ats)), n - sum(map(len, kept)), len(kept) - 1, digest.hexdigest()))
            n_bytes, again, gone, spans, digests = ([r[c] for r in rows] for c in range(5))
            cols = [*(pa.array(c, pa.int64()) for c in (n_bytes, b.column(3).to_pylist(), again, gone, spans)), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "n_bytes", "n_chunks", "n_repeated", "n_removed", "n_spans", "kept_sha256"])

    return _with_places(docs, "chunks").mapInArrow(run, "doc_id long, n_bytes long, n_chunks long, n_repeated long, n_removed long, n_spans long, kept_sha256 string")


def op6_gear_chunks(spark, sf_dir: str) -> DataFrame:
    """Chunks, repeated chunks, removed stretches and a digest of what is left of each row of
    documents.  A null text is an empty one, without chunks; null ids stay null and come first,
    in the order of a hash of their texts; rows with the same id and text are one document; chunks
    that start at the same place of one id are not earlier than each other; texts of any length
    are cut whole; no documents give no rows."""
    return chunk_digests(table(spark, sf_dir, "documents"))
