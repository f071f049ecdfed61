"""Telephony audio as a column: mu-law, A-law and IMA ADPCM in WAVE files, kept as PCM.

Companded samples are expanded by lookup tables of 256 entries that are built from the
coding's rule.  ADPCM is sequential inside a block, but blocks are independent: they are
decoded together, one numpy step for each sample position over all blocks of a slice.
Decoded speech is resampled from 8 to 16 kHz by a half-band filter and stored as linear PCM.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, slices, table, utf8

#: Payload bytes in an ADPCM block; payloads are padded with FILL to whole blocks.
BLOCK, FILL, RATE = 576, 255, 8000
CODECS = ("ulaw", "alaw", "adpcm")
#: WAVE format tags.
TAGS = {"pcm": 1, "alaw": 6, "ulaw": 7, "adpcm": 0x11}
#: Step sizes and index moves of IMA ADPCM.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190,
     209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499,
     2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385,
     24623, 27086, 29794, 32767], np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def _ulaw_table() -> np.ndarray:
    u = ~np.arange(256) & 0xFF
    size = ((((u & 15) << 3) + 132) << (u >> 4 & 7)) - 132
    return np.where(u & 128, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    a = np.arange(256) ^ 0x55
    seg, low = a >> 4 & 7, (a & 15) << 4
    size = np.where(seg == 0, low + 8, (low + 264) << np.maximum(seg - 1, 0))
    return np.where(a & 128, size, -size).astype(np.int16)


EXPAND = {"ulaw": _ulaw_table(), "alaw": _alaw_table()}
_CODE = np.arange(16)
_STEP = STEPS[:, None]
_SIZE = (_STEP >> 3) + np.where(_CODE & 4, _STEP, 0) + np.where(_CODE & 2, _STEP >> 1, 0) + np.where(_CODE & 1, _STEP >> 2, 0)
#: What a code adds at a step index, and the index after it; both by index * 16 + code.
DELTA = np.where(_CODE & 8, -_SIZE, _SIZE).astype(np.int32).ravel()
NEXT = (np.clip(np.arange(89)[:, None] + MOVES[_CODE & 7], 0, 88) * 16).astype(np.int32).ravel()


def decode_adpcm(codes: np.ndarray, first: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Samples of blocks (n, bytes) of two codes a byte, the low one first; with the first
    sample of each block's header the result is (n, 2 * bytes + 1)."""
    n, size = codes.shape
    out = np.empty((2 * size + 1, n), np.int16)
    value, at = first.astype(np.int32), index.astype(np.int32) * 16
    out[0] = value
    by_place = np.ascontiguousarray(codes.T)
    for j in range(size):
        for k, code in ((1, by_place[j] & 15), (2, by_place[j] >> 4)):
            here = at + code
            value = np.minimum(np.maximum(value + DELTA[here], -32768), 32767)
            at = NEXT[here]
            out[2 * j + k] = value
    return out.T


def encode_adpcm(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, first, index) of blocks of samples (n, 2 * bytes + 1), all blocks at once."""
    n, size = samples.shape
    s = samples.astype(np.int32).T
    value, at = s[0].copy(), np.zeros(n, np.int32)
    codes = np.zeros((size // 2, n), np.uint8)
    for j in range(1, size):
        gap = s[j] - value
        step = STEPS[at // 16]
        left, code = np.abs(gap), np.where(gap < 0, 8, 0)
        for bit in (4, 2, 1):
            hit = left >= step
            code, left, step = code + hit * bit, left - hit * step, step >> 1
        value = np.clip(value + DELTA[at + code], -32768, 32767)
        at = NEXT[at + code]
        codes[(j - 1) // 2] |= (code << (0 if j % 2 else 4)).astype(np.uint8)
    return np.ascontiguousarray(codes.T), s[0].astype(np.int16), np.zeros(n, np.uint8)


def wave(codec: str, data: bytes, samples: int, rate: int = RATE, align: int = 1) -> bytes:
    """A mono WAVE file; `samples` stands in its fact chunk."""
    bits = {"pcm": 16, "adpcm": 4}.get(codec, 8)
    extra = struct.pack("<H", 2 * (align - 4) + 1) if codec == "adpcm" else b""
    per_second = rate * align // (2 * (align - 4) + 1) if codec == "adpcm" else rate * align
    head = struct.pack("<HHIIHHH", TAGS[codec], 1, rate, per_second, align, bits, len(extra)) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(head)) + head + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body) + len(data) % 2) + body + b"\0" * (len(data) % 2)


def parse_wave(raw: bytes | memoryview) -> tuple[str, memoryview, int, int]:
    """(codec, data, samples, bytes of a block) of a WAVE file."""
    raw = memoryview(raw)
    if bytes(raw[:4]) != b"RIFF" or bytes(raw[8:12]) != b"WAVE":
        raise ValueError("not a WAVE file")
    at, tag, align, samples, data = 12, None, 1, -1, raw[:0]
    while at + 8 <= len(raw):
        name, size = bytes(raw[at : at + 4]), struct.unpack_from("<I", raw, at + 4)[0]
        part = raw[at + 8 : at + 8 + size]
        if name == b"fmt ":
            tag, _, _, _, align, _ = struct.unpack_from("<HHIIHH", part)
        elif name == b"fact":
            samples = struct.unpack_from("<I", part)[0]
        elif name == b"data":
            data = part
        at += 8 + size + size % 2
    codec = next((k for k, v in TAGS.items() if v == tag), None)
    if codec is None:
        raise ValueError(f"unknown WAVE format {tag}")
    return codec, data, samples, align


def payload_of(text: bytes) -> bytes:
    """The text's bytes, padded with FILL to a positive multiple of BLOCK."""
    return text.ljust(max(1, -(-len(text) // BLOCK)) * BLOCK, bytes([FILL]))


_HEAD = b"\0\0\0\0"  # an ADPCM block starts from sample 0 and step index 0


def stored_form(text: bytes, codec: str | None = None) -> bytes:
    """The payload of a text as telephone speech.  Its codec follows from its bytes, unless one
    is named; mu-law and A-law take a byte as a sample, ADPCM as two codes of a block."""
    payload = payload_of(text)
    codec = codec or CODECS[zlib.crc32(payload) % 3]
    if codec != "adpcm":
        return wave(codec, payload, len(text))
    blocks = b"".join(_HEAD + payload[i : i + BLOCK] for i in range(0, len(payload), BLOCK))
    return wave(codec, blocks, 2 * len(text), align=4 + BLOCK)


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, media binary): each text as a WAVE file, null texts as empty ones."""

    def run(parts):
        for b in parts:
            at, data = utf8(b.column(1))
            raw = data.tobytes()
            for i, j in slices(at):
                media = [stored_form(raw[at[k] : at[k + 1]]) for k in range(i, j)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(media, pa.binary())], ["doc_id", "media"])

    return id_text(docs).mapInArrow(run, "doc_id long, media binary")


#: Taps of the half-band filter between two samples, from the middle outwards (windowed sinc).
_K = np.arange(4) + 0.5
TAPS = np.sinc(_K) * (0.5 + 0.5 * np.cos(np.pi * _K / 4.5))
TAPS = (TAPS / (2 * TAPS.sum())).astype(np.float32)


def resample(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: samples stay, and between each two stands an interpolated one."""
    n = len(pcm)
    x = np.zeros(n + 8, np.float32)
    x[4 : n + 4] = pcm
    mid = sum(t * (x[4 - k : n + 4 - k] + x[5 + k : n + 5 + k]) for k, t in enumerate(TAPS))
    out = np.empty(2 * n, np.int16)
    out[::2] = pcm
    out[1::2] = np.clip(np.rint(mid), -32768, 32767)
    return out


def decoded(files: list[memoryview]) -> list[tuple[str, memoryview | bytes, int, np.ndarray]]:
    """(codec, payload, bytes without padding, PCM) of each file; all ADPCM blocks together."""
    parsed = [parse_wave(f) for f in files]
    blocks = [np.frombuffer(d, np.uint8).reshape(-1, a) for c, d, _, a in parsed if c == "adpcm"]
    pcm = iter(())
    if blocks:
        flat = np.concatenate(blocks)
        head = np.ascontiguousarray(flat[:, :4])
        all_pcm = decode_adpcm(flat[:, 4:], head[:, :2].view("<i2").ravel(), head[:, 2])
        pcm = iter(np.split(all_pcm, np.cumsum([len(b) for b in blocks])[:-1]))
        codes = iter(blocks)
    out = []
    for codec, data, samples, _ in parsed:
        if codec == "adpcm":
            out.append((codec, next(codes)[:, 4:].tobytes(), samples // 2, next(pcm).ravel()))
        elif codec == "pcm":
            out.append((codec, data, samples, np.frombuffer(data, "<i2")))
        else:
            out.append((codec, data, samples, EXPAND[codec][np.frombuffer(data, np.uint8)]))
    return out


def feature(codec: str, pcm: np.ndarray, wide: np.ndarray) -> str:
    """Loudness, peak, zero crossings and means of the decoded and the resampled speech."""
    x = pcm.astype(np.float32)
    power = float(np.dot(x.astype(np.float64), x)) if len(x) < 1 << 16 else sum(float(np.dot(p.astype(np.float64), p)) for p in np.array_split(x, len(x) >> 16))
    crossed = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"{codec}:n={len(pcm)}:sum={int(pcm.sum(dtype=np.int64))}:peak={int(np.abs(pcm.astype(np.int32)).max(initial=0))}:rms={(power / max(1, len(pcm))) ** 0.5:.2f}:zc={crossed}:wide={int(wide.sum(dtype=np.int64))}"


READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long, pcm_crc32 long"


def read_back(stored: DataFrame, keep_pcm: bool = False) -> DataFrame:
    """Digests and features of stored files (doc_id, media), computed from their bytes; with
    keep_pcm also the resampled speech as a PCM file in `pcm`."""

    def run(parts):
        for b in parts:
            at, data = utf8(b.column(1))
            raw = memoryview(data)
            for i, j in slices(at, 4 << 20):
                files = [raw[at[k] : at[k + 1]] for k in range(i, j)]
                rows = []
                for f, (codec, payload, n, pcm) in zip(files, decoded(files)):
                    wide = resample(pcm)
                    speech = wave("pcm", wide.astype("<i2").tobytes(), len(wide), 2 * RATE, 2)
                    row = (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(f), hashlib.sha256(f).hexdigest(), feature(codec, pcm, wide), len(speech), zlib.crc32(speech))
                    rows.append((*row, speech) if keep_pcm else row)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
                cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                names = [x.split()[0] for x in READ.split(", ")] + ["pcm"] * keep_pcm
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *cols], names)

    return stored.select("doc_id", "media").mapInArrow(run, READ + (", pcm binary" if keep_pcm else ""))


def op1_telephony(spark, sf_dir: str) -> DataFrame:
    """Each row of documents as telephone speech: digests of what was stored and read back, and
    the resampled PCM itself in `pcm`, a WAVE file.  Null and empty texts are one block of
    padding; a null id stays null; repeated rows give equal files; long texts are many blocks;
    no documents give no rows."""
    return read_back(store(table(spark, sf_dir, "documents")), keep_pcm=True)
