"""BAM files by their compressed blocks, so that one file is read by many tasks, and written by many.

Spark's text source cuts a file at any separator and keeps bytes as they are; the first bytes of a
block are such a separator.  A cut inside a block's data, where these bytes turn up by chance, is
seen by the block's length and mended by the piece behind it.  A task begins somewhere in a
record: it takes the first place from which a run of records fits, and passes on what lies before
it and behind its last whole record.  These ends of neighbouring splits, put together, must be
whole records; if they aren't, the first place was wrong, which is an error and not other rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import staged

#: Fixed values of the format: first bytes of a block and of its extra field, and the empty last block.
_MAGIC = b"\x1f\x8b\x08\x04"
_EXTRA = b"BC\x02\x00"
_LAST = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: Codes of bases and CIGAR operations in BAM.
_BASES, _OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
_PAIRS = np.array([[ord(a), ord(b)] for a in _BASES for b in _BASES], np.uint8)
#: Bytes of records in a block, before compression; records in a row that a first place must fit.
BLOCK, FIT = 60_000, 8

RECORD = "name string, flag int, chrom string, pos long, mapq int, cigar string, mate_chrom string, mate_pos long, seq string, quality string"


# ---- records ----------------------------------------------------------------------------


def _fits(data: bytes, at: int) -> int | None:
    """Where the record at `at` ends if there can be one; it may reach beyond the data."""
    if at + 36 > len(data):
        return None
    size, ref, pos, l_name, _, _, n_cigar, flag, l_seq, mref, mpos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    need = 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq
    if not (l_name and 0 <= l_seq and need <= size < 1 << 30 and min(ref, mref, pos, mpos) >= -1 and flag < 4096):
        return None
    name = data[at + 36 : at + 36 + l_name]
    if len(name) == l_name and (name[-1] or not all(32 < c < 127 for c in name[:-1])):
        return None
    at_ops = at + 36 + l_name
    if at_ops + 4 * n_cigar <= len(data):
        ops = struct.unpack_from(f"<{n_cigar}I", data, at_ops)
        if any(v & 15 > 8 for v in ops) or (n_cigar and l_seq and sum(v >> 4 for v in ops if v & 15 in (0, 1, 4, 7, 8)) != l_seq):
            return None
    return at + 4 + size


def first_record(data: bytes) -> int:
    """The first place from which records follow each other to the end of the data, or FIT of them;
    two at least, unless only one is there that reaches to the end or beyond."""
    alone = None
    for begin in range(len(data)):
        at, n = begin, 0
        while at < len(data) and n < FIT:
            after = _fits(data, at)
            if after is None:
                break
            at, n = after, n + 1
        if n >= FIT or n >= 2 and (at >= len(data) or at + 36 > len(data)) or n and at == len(data):
            return begin
        if n and alone is None and (at > len(data) or at + 36 > len(data)):
            alone = begin
    return len(data) if alone is None else alone


def _record(data: bytes, at: int, size: int) -> tuple:
    ref, pos, l_name, mapq, _, n_cigar, flag, l_seq, mref, mpos, _ = struct.unpack_from("<iiBBHHHiiii", data, at)
    at += 32
    name = data[at : at + l_name - 1].decode()
    at += l_name
    cigar = "".join(f"{v >> 4}{_OPS[v & 15]}" for v in struct.unpack_from(f"<{n_cigar}I", data, at)) or "*"
    at += 4 * n_cigar
    half = (l_seq + 1) // 2
    seq = _PAIRS[np.frombuffer(data, np.uint8, half, at)].ravel()[:l_seq].tobytes().decode() if l_seq else "*"
    at += half
    quality = np.frombuffer(data, np.uint8, l_seq, at)
    text = (quality + 33).tobytes().decode("latin-1") if l_seq and quality[0] != 255 else "*"
    return name, flag, ref, pos + 1, mapq, cigar, mref, mpos + 1, seq, text


def records(data: bytes, at: int = 0) -> tuple[list[tuple], int]:
    """Whole records from `at` on, and where the first cut-off one begins."""
    out = []
    while at + 4 <= len(data) and at + 4 + (size := struct.unpack_from("<i", data, at)[0]) <= len(data):
        out.append(_record(data, at + 4, size))
        at += 4 + size
    return out, at


def header(data: bytes) -> tuple[list[str], int] | None:
    """Names of the references and the header's length; None if the data ends before it does."""
    try:
        if data[:4] != b"BAM\1":
            if len(data) >= 4:
                raise ValueError("not a BAM file")
            return None
        at = 8 + struct.unpack_from("<i", data, 4)[0]
        n, at, names = struct.unpack_from("<i", data, at)[0], at + 4, []
        for _ in range(n):
            size = struct.unpack_from("<i", data, at)[0]
            name = data[at + 4 : at + 4 + size]
            if len(name) < size or at + 8 + size > len(data):
                return None
            names.append(name[:-1].decode())
            at += 8 + size
        return names, at
    except struct.error:
        return None


# ---- reading ----------------------------------------------------------------------------


def _inflated(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Data of the blocks that the pieces of a split are, each without its first bytes."""
    held = b""
    for piece in pieces:
        held = held + _MAGIC + piece if held else piece
        if len(held) < 14 or held[8:12] != _EXTRA:
            if not held or held == piece:
                held = b""  # before the file's first block, or the rest of a piece of the split before
            continue
        size = struct.unpack_from("<H", held, 12)[0] + 1 - len(_MAGIC)
        if len(held) < size:
            continue  # a separator by chance, the block goes on
        yield zlib.decompress(held[14 : size - 8], -15)
        held = b""
    if held:
        raise ValueError("a split ends inside a block")  # a separator by chance at its very end, or a cut file


_FOUND = "kind int, path string, begin long, ref int, mref int, head binary, tail binary, " + RECORD
_TYPES = [pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
_NAMES = [c.split()[0] for c in _FOUND.split(", ")]
#: Data that a task parses at a time.
_PART = 4 << 20


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)


def _rows_of(found: list[tuple], path: str, begin: int) -> list[tuple]:
    return [(0, path, begin, r[2], r[6], None, None, r[0], r[1], None, r[3], r[4], r[5], None, r[7], r[8], r[9]) for r in found]


def _split(path: str, begin: int, pieces: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    """Records of a split (kind 0), its ends (1) and, of a file's first split, the references (2)."""
    data, head, started = b"", b"", False
    blank = (None,) * 10

    def start(last: bool):
        nonlocal data, head, started
        if begin == 0:
            got = header(data)
            if got is None:
                if last and data:
                    raise ValueError(f"the header of {path} doesn't end in its first split")
                return None
            names, at = got
            refs = [(2, path, i, i, None, None, None, *blank[:2], n, *blank[3:]) for i, n in enumerate(names)]
        else:
            if not last and len(data) < _PART:
                return None
            at, refs = first_record(data), []
            head = data[:at]
        data, started = data[at:], True
        return refs

    def out(refs, found):
        rows = refs + _rows_of(found, path, begin)
        if rows:
            yield _batch(rows)

    for block in _inflated(pieces):
        data += block
        if len(data) < _PART and started:
            continue
        refs = start(False) if not started else []
        if refs is not None:
            found, at = records(data)
            data = data[at:]
            yield from out(refs, found)
    refs = start(True) if not started else []
    found, at = records(data) if started else ([], 0)
    yield from out(refs or [], found)
    if started or data:
        yield _batch([(1, path, begin, None, None, head, data[at:], *blank)])


def _read(parts):
    held = ((path, begin, v) for b in parts for path, begin, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)))
    row = next(held, None)
    while row is not None:
        path, begin = row[:2]

        def own():
            nonlocal row
            while row is not None and row[:2] == (path, begin):  # noqa: B023
                yield row[2].as_py()
                row = next(held, None)

        rest = own()
        yield from _split(path, begin, rest)
        for _ in rest:
            pass


def _seams(parts):
    for b in parts:
        rows = []
        for path, begin, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            found, at = records(data)
            if at != len(data):
                raise ValueError(f"{path}: no record ends where the split after {begin} begins")
            rows += _rows_of(found, path, begin)
        if rows:
            yield _batch(rows)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, begin, piece): what lies between the separators, with its file and its split's begin."""
    held = spark.read.option("lineSep", _MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    return held.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("begin"), F.col("value").cast("binary").alias("piece"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of BAM files in the columns of RECORD, a split of a file in a task; pos is 1-based."""
    found = staged(lines(spark, path).mapInArrow(_read, _FOUND), "bam")
    ends = found.where("kind = 1").select("path", "begin", "head", "tail")
    # a row for each split: the heads up to the next split's first record close the record before it
    after = F.lead("head").over(W.partitionBy("path").orderBy("begin"))
    seams = ends.select("path", "begin", F.concat("tail", F.coalesce(after, F.lit(b""))).alias("data")).where(F.octet_length("data") > 0).mapInArrow(_seams, _FOUND)
    refs = found.where("kind = 2").select("path", F.col("ref").alias("id"), F.col("chrom").alias("named"))
    rows = found.where("kind = 0").unionAll(seams)
    name = lambda df, by, out: df.drop(out).join(refs.select("path", F.col("id").alias(by), F.col("named").alias(out)), ["path", by], "left").withColumn(out, F.coalesce(out, F.lit("*")))
    return name(name(rows, "ref", "chrom"), "mref", "mate_chrom").select(*[c.split()[0] for c in RECORD.split(", ")])


# ---- writing ----------------------------------------------------------------------------


def _block(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    return _MAGIC + b"\0\0\0\0\0\xff\x06\0" + _EXTRA + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def _packed(r: dict, place: dict[str, int]) -> bytes:
    name, cigar = r["name"].encode() + b"\0", [] if r["cigar"] == "*" else r["cigar"]
    ops, n = [], ""
    for c in cigar:
        if c.isdigit():
            n += c
        else:
            ops.append(int(n) << 4 | _OPS.index(c))
            n = ""
    seq = "" if r["seq"] == "*" else r["seq"]
    codes = [_BASES.index(c) for c in seq.upper()] + [0] * (len(seq) % 2)
    bases = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2]))
    quality = bytes([255] * len(seq)) if r["quality"] == "*" else bytes(c - 33 for c in r["quality"].encode())
    ref = place.get(r["chrom"], -1)
    body = struct.pack("<iiBBHHHiiii", ref, r["pos"] - 1, len(name), r["mapq"], 0, len(ops), r["flag"], len(seq), place.get(r["mate_chrom"], -1), r["mate_pos"] - 1, 0)
    body += name + struct.pack(f"<{len(ops)}I", *ops) + bases + quality
    return struct.pack("<i", len(body)) + body


def write(reads: DataFrame, genome: DataFrame, path: str) -> None:
    """Write records as BAM files, one for each partition, each whole in itself.

    `genome` (chrom, length) names the references; names stand in every file's header and so on
    the driver.  A file is lines of blocks with the format's empty block as line end.
    """
    refs = [tuple(r) for r in genome.select("chrom", F.col("length").cast("long")).orderBy("chrom").collect()]
    top = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", len(refs)) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in refs)
    place = {n: i for i, (n, _) in enumerate(refs)}

    def run(parts):
        held, size, begun = [top], len(top), False
        for b in parts:
            for r in b.to_pylist():
                one = _packed(r, place)
                held.append(one)
                size += len(one)
                if size >= BLOCK:
                    data, held, size, begun = b"".join(held), [], 0, True
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(_block(data[i : i + BLOCK]) for i in range(0, len(data), BLOCK))], pa.binary())], ["value"])
        if held and (size > len(top) or begun):
            data = b"".join(held)
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(_block(data[i : i + BLOCK]) for i in range(0, len(data), BLOCK))], pa.binary())], ["value"])

    made = reads.select(*[c.split()[0] for c in RECORD.split(", ")]).mapInArrow(run, "value binary")
    made.select(F.col("value").cast("string").alias("value")).write.option("lineSep", _LAST.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
