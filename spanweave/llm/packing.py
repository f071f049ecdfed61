"""Packing along a space-filling curve.

Each document's token ids are hashed into a count vector, projected to a few dimensions and
placed on a Hilbert curve; documents are range-sorted by curve key, and neighbours along the
curve are packed into sequences without gaps.  Documents are cut freely, so only the last
sequence of each range is not full.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_array, id_text, ids, partitions, slices, small_batches, table, utf8

LENGTH, END = 1024, 0
BUCKETS, DIMS, BITS = 256, 4, 10
#: Low key bits that order documents of one curve cell, so a hot cell can be cut in ranges.
TIE_BITS = 63 - DIMS * BITS
#: Share of the documents whose keys place the range bounds (balance only, never results).
BOUNDS_SHARE, WEIGHT = 0.02, 256
#: Input bytes for each range of the curve; a range is sorted by Spark and packed as a stream.
PARTITION = 64 << 20
#: Texts within these letters take the fast encoder; others take the reference one.
PLAIN = re.compile("[^\u0000-ɏ‐-›€]")


class Encoder:
    """Ids of a byte-level BPE file for `tokenizers`.

    The same vocabulary drives a faster encoder.  Each batch compares one of its texts with
    `tokenizers`, which also takes every text with letters outside PLAIN or with the string of
    an added token; if they differ, the whole batch is encoded by `tokenizers`.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        special = {t.content for t in self.slow.get_added_tokens_decoder().values()}
        self.added = re.compile("|".join(map(re.escape, sorted(special))) or r"(?!)", re.I)
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in self.slow.get_vocab().items() if piece not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("spanweave", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.wide = self.slow.get_vocab_size() > 1 << 16

    def one(self, text: str) -> np.ndarray:
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)

    def many(self, texts: list[str]) -> list[np.ndarray]:
        usual = [(t.isascii() or not PLAIN.search(t)) and not self.added.search(t) for t in texts]
        probe = max((t for t, u in zip(texts, usual) if u and t.strip()), key=lambda t: (len(t) <= 2000, len(t)), default="")
        if probe and not np.array_equal(self.fast.encode_to_numpy(probe, disallowed_special=()), self.one(probe)):
            return [self.one(t) for t in texts]
        return [self.fast.encode_to_numpy(t, disallowed_special=()) if u else self.one(t) for t, u in zip(texts, usual)]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(1)
def _projection() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(1891)
    return rng.integers(0, BUCKETS, 1 << 18), rng.choice([-1.0, 1.0], (BUCKETS, DIMS))


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Distance along the Hilbert curve of rows of grid cells (n, dims), each below 2**bits.

    The coordinates are turned into the curve's transposed index in place (a Gray code with
    the reflections undone from the highest bit down), then their bits are interleaved.
    """
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[d - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Curve keys of documents whose ids stand one after another in `flat`."""
    bucket_of, proj = _projection()
    n = len(counts)
    doc = np.repeat(np.arange(n), counts)
    v = np.log1p(np.bincount(doc * BUCKETS + bucket_of[flat & 0x3FFFF], minlength=n * BUCKETS).reshape(n, BUCKETS))
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    cells = np.clip(((v @ proj) / 6 + 0.5) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
    return hilbert(cells)


def _tokenised(docs: DataFrame, path: str, bounds: list[int] | None) -> DataFrame:
    """(pid, key, doc_id, ids) of each document; with bounds None only the keys, by weight."""

    def run(parts):
        enc = encoder(path)
        cuts = np.array(bounds or [], np.int64)
        kind = np.uint32 if enc.wide else np.uint16
        for b in parts:
            at, _ = utf8(b.column(1))
            who = ids(b.column(0))
            for i, j in slices(at):
                got = [np.append(e, np.uint32(END)) for e in enc.many(b.column(1).slice(i, j - i).to_pylist())]
                counts = np.array([len(e) for e in got])
                flat = np.concatenate(got)
                low = (who[i:j].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TIE_BITS)
                key = (curve_keys(flat, counts) << TIE_BITS) | low.astype(np.int64)
                if bounds is None:  # a key for each WEIGHT ids, so ranges hold about as many ids
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(key, -(-counts // WEIGHT)))], ["key"])
                    continue
                ends = np.concatenate([[0], np.cumsum(counts)]) * np.dtype(kind).itemsize
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(flat.astype(kind))])
                pid = np.searchsorted(cuts, key, "right").astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(pid), pa.array(key), b.column(0).slice(i, j - i), raw.cast(pa.binary())], ["pid", "key", "doc_id", "ids"])

    return id_text(docs).mapInArrow(run, "key long" if bounds is None else "pid int, key long, doc_id long, ids binary")


PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _pack(length: int, kind: type, emit_ids: bool):
    schema = PIECE.append(pa.field("ids", pa.binary())) if emit_ids else PIECE

    def run(parts):
        pid, seq, fill = None, 0, 0
        for b in parts:
            rows: list[tuple] = []
            pids = b.column(0).to_numpy()
            at, data = utf8(b.column(2))
            for i, doc_id in enumerate(b.column(1).to_pylist()):
                if pids[i] != pid:
                    pid, seq, fill = int(pids[i]), int(pids[i]) << 40, 0
                flat = data[at[i] : at[i + 1]].view(kind).astype("<u4")
                whole, start = memoryview(flat.tobytes()), 0
                while start < len(flat):
                    take = min(length - fill, len(flat) - start)
                    piece = whole[4 * start : 4 * (start + take)]
                    row = (doc_id, start, take, zlib.crc32(piece), len(flat), seq, fill)
                    rows.append((*row, bytes(piece)) if emit_ids else row)
                    start, fill = start + take, fill + take
                    if fill == length:
                        seq, fill = seq + 1, 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def pack_along_curve(docs: DataFrame, path: str, length: int = LENGTH, emit_ids: bool = False) -> DataFrame:
    """Pieces of documents packed along the curve.

    One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    and with emit_ids the ids themselves (little-endian 32 bits).  Every document has at least
    one piece, as its end id counts; null and empty texts have just that id.  Repeated rows are
    packed once for each row.
    """
    spark = docs.sparkSession
    size = id_text(docs).agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(partitions(spark), size // PARTITION + 1)
    bounds: list[int] = []
    if n > 1:
        some = _tokenised(docs.sample(False, BOUNDS_SHARE, 11), path, None)
        cut = some.agg(F.percentile_approx("key", [i / n for i in range(1, n)], max(10_000, 4 * n))).first()[0]
        bounds = sorted(set(cut or []))
    rows = _tokenised(docs, path, bounds)
    ranged = rows.repartitionById(len(bounds) + 1, "pid").sortWithinPartitions("pid", "key", "doc_id").select("pid", "doc_id", "ids")
    kind = np.uint32 if encoder(path).wide else np.uint16
    made = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ranged.mapInArrow(_pack(length, kind, emit_ids), made + (", ids binary" if emit_ids else ""))


def vocabulary() -> str:
    """The place of the packing vocabulary; never part of this repository."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_curve_packing(spark, sf_dir: str) -> DataFrame:
    """Every document, packed along the curve; rules as in pack_along_curve: a null or empty text
    is its end id alone, a null id stays null, repeated rows are packed each, a long text is cut
    over as many sequences as it fills, ties on the curve go by doc_id, no documents give no rows."""
    return pack_along_curve(table(spark, sf_dir, "documents"), vocabulary())


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: pieces of packed sequences of all that is left, by the rules of
    pack_along_curve for nulls, empty and long texts, ties, repeated rows and empty tables."""
    small_batches(spark)
    return pack_along_curve(docs, vocabulary())
