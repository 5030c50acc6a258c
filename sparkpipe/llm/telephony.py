"""Telephony audio in media columns: mu-law, A-law and IMA ADPCM (operator 9)."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from .util import arrow_rows

#: WAVE format tags (fixed values).
ALAW, MULAW, IMA = 6, 7, 17
RATE, OUT_RATE = 8000, 16000
#: Payload bytes of an ADPCM block; its header of four bytes comes first.
BLOCK = 64
#: Samples decoded at a time.
PIECE = 1 << 20


def _mulaw_table() -> np.ndarray:
    u = ~np.arange(256, dtype=np.int32) & 0xFF
    t = (((u & 0x0F) << 3) + 0x84 << ((u & 0x70) >> 4)) - 0x84
    return np.where(u & 0x80, -t, t).astype(np.int16)


def _alaw_table() -> np.ndarray:
    a = np.arange(256, dtype=np.int32) ^ 0x55
    seg, t = (a & 0x70) >> 4, ((a & 0x0F) << 4) + 8
    t = np.where(seg == 0, t, t + 0x100 << np.maximum(seg - 1, 0))
    return np.where(a & 0x80, t, -t).astype(np.int16)


MULAW_PCM, ALAW_PCM = _mulaw_table(), _alaw_table()
#: IMA step sizes and index changes (fixed values of the format).
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408,
     449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630,
     9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], dtype=np.int32)
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int32)
_CODE = np.arange(16)
#: For each step index and code: what the predictor gains.
_GAIN = np.where(_CODE & 8, -1, 1) * ((STEPS[:, None] >> 3) + np.where(_CODE & 4, STEPS[:, None], 0) + np.where(_CODE & 2, STEPS[:, None] >> 1, 0) + np.where(_CODE & 1, STEPS[:, None] >> 2, 0))
_NEXT = np.clip(np.arange(len(STEPS))[:, None] + INDEX_CHANGE, 0, len(STEPS) - 1)


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """PCM of mono blocks (n, header 4 + codes): one step for all blocks at once, low nibble first; header sample first."""
    n = len(blocks)
    at = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1)
    codes = np.empty((n, 2 * (blocks.shape[1] - 4)), dtype=np.uint8)
    codes[:, ::2], codes[:, 1::2] = blocks[:, 4:] & 15, blocks[:, 4:] >> 4
    out = np.empty((codes.shape[1] + 1, n), dtype=np.int16)
    out[0] = at
    for i, c in enumerate(np.ascontiguousarray(codes.T)):
        at = np.clip(at + _GAIN[index, c], -32768, 32767)
        index = _NEXT[index, c]
        out[i + 1] = at
    return np.ascontiguousarray(out.T)


def store(payload: bytes, tag: int) -> bytes:
    """A WAVE file that holds the payload as samples of the format: bytes for mu-law and A-law, code pairs for ADPCM."""
    if tag == IMA:
        codes = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK)
        data = np.concatenate((np.zeros((len(codes), 4), np.uint8), codes), axis=1).tobytes()
        per = 2 * BLOCK + 1
        fmt = struct.pack("<HHIIHHHH", IMA, 1, RATE, RATE * (BLOCK + 4) // per, BLOCK + 4, 4, 2, per)
        frames = len(codes) * per
    else:
        data, fmt, frames = payload, struct.pack("<HHIIHHH", tag, 1, RATE, RATE, 1, 8, 0), len(payload)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, frames) + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wave(media: bytes) -> tuple[int, int, int, memoryview]:
    """(format tag, sample rate, block size, data) of a mono WAVE file; ValueError if it isn't one."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, head, view = 12, None, memoryview(media)
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            head = struct.unpack_from("<HHIIH", media, at + 8)
        elif kind == b"data":
            if head is None or head[1] != 1:
                raise ValueError("no mono format before the data")
            return head[0], head[2], head[4], view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def payload_of(media: bytes) -> bytes:
    """The payload that `store` was given."""
    tag, _, block, data = read_wave(media)
    return np.frombuffer(data, np.uint8).reshape(-1, block)[:, 4:].tobytes() if tag == IMA else bytes(data)


def pcm_pieces(media: bytes) -> Iterator[np.ndarray]:
    """16-bit PCM at the file's rate, piece by piece."""
    tag, _, block, data = read_wave(media)
    raw = np.frombuffer(data, np.uint8)
    if tag == IMA:
        blocks = raw[: len(raw) // block * block].reshape(-1, block)
        step = max(1, PIECE // (2 * block))
        for i in range(0, len(blocks), step):
            yield decode_ima(blocks[i : i + step]).reshape(-1)
    elif tag in (MULAW, ALAW):
        table = MULAW_PCM if tag == MULAW else ALAW_PCM
        for i in range(0, len(raw), PIECE):
            yield table[raw[i : i + PIECE]]
    else:
        raise ValueError(f"format {tag} is no telephony format")


def pcm_of(files: list[bytes]) -> Iterator[Iterator[np.ndarray]]:
    """pcm_pieces of each file; the ADPCM blocks of short files, PIECE samples or so, are decoded together."""
    lo = 0
    while lo < len(files):
        hi, samples, ready = lo, 0, {}
        blocks: list[tuple[int, np.ndarray]] = []
        while hi < len(files) and samples < PIECE:
            tag, _, block, data = read_wave(files[hi])
            if tag == IMA and block == BLOCK + 4 and 2 * len(data) <= PIECE:
                raw = np.frombuffer(data, np.uint8)
                blocks.append((hi, raw[: len(raw) // block * block].reshape(-1, block)))
                samples += 2 * len(raw)
            hi += 1
        if blocks:
            pcm = decode_ima(np.concatenate([b for _, b in blocks]))
            ends = np.cumsum([len(b) for _, b in blocks])
            ready = {i: pcm[end - len(b) : end].reshape(-1) for (i, b), end in zip(blocks, ends.tolist(), strict=True)}
        for i in range(lo, hi):
            yield iter((ready[i],)) if i in ready else pcm_pieces(files[i])
        lo = hi


def resampled(pieces: Iterator[np.ndarray], first: int, times: int = OUT_RATE // RATE) -> Iterator[np.ndarray]:
    """PCM at `times` the rate by straight lines between samples; `first` is the sample before the start."""
    last = first
    for p in pieces:
        if not len(p):
            continue
        x = p.astype(np.int32)
        before = np.concatenate(([last], x[:-1]))
        out = np.empty((len(x), times), dtype=np.int16)
        for k in range(times):
            out[:, k] = (before * (times - 1 - k) + x * (k + 1)) // times
        last = int(x[-1])
        yield out.reshape(-1)


def store_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, padded by zeros to a positive multiple of 64, as a WAVE file.

    The content's CRC-32 chooses mu-law, A-law or ADPCM, so equal texts have equal files.  Null counts as empty.
    Repeated rows and null ids stay.  An empty table gives an empty result.  Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in part.column(1)]
                media = [store(t + bytes(max(64, -(-len(t) // 64) * 64) - len(t)), (MULAW, ALAW, IMA)[zlib.crc32(t) % 3]) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return arrow_rows(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`")), run, "doc_id long, n_bytes long, media binary")


def decode_media(stored: DataFrame, *, media_col: str = "media") -> DataFrame:
    """stored with part and pcm (binary, 16-bit little-endian at OUT_RATE): a row for each PIECE samples of a file, from part 0.

    Null and unreadable media have one row without pcm.  Columns `part` and `pcm` that stored has are replaced; others
    pass through.  Repeated rows and null ids stay.  An empty table gives an empty result.
    """
    place = stored.columns.index(media_col)
    keep = [i for i, n in enumerate(stored.columns) if n not in ("part", "pcm")]

    def readable(media: bytes | None) -> bool:
        try:
            return media is not None and read_wave(media)[0] in (IMA, MULAW, ALAW)
        except (ValueError, struct.error):
            return False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                files = part.column(place).to_pylist()
                good = [i for i, m in enumerate(files) if readable(m)]
                decoded = iter(pcm_of([files[i] for i in good]))
                for i in range(len(files)):
                    row = [part.column(k).slice(i, 1) for k in keep]
                    pieces = resampled(next(decoded), 0) if good and i in good else iter((None,))
                    for n, p in enumerate(pieces):
                        pcm = None if p is None else p.astype("<i2").tobytes()
                        yield pa.RecordBatch.from_arrays([*row, pa.array([n], pa.int32()), pa.array([pcm], pa.binary())], names)

    fields = [stored.schema.fields[i] for i in keep]
    names = [f.name for f in fields] + ["part", "pcm"]
    return arrow_rows(stored, run, StructType([*fields, StructField("part", IntegerType()), StructField("pcm", BinaryType())]))


def media_digests(stored: DataFrame) -> DataFrame:
    """What the stored files of store_media hold, read back: digests, and features of the resampled PCM.

    feature: format, samples, peak, mean absolute value in thousandths, sign changes, CRC-32 of the resampled PCM.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows: list[list] = [[] for _ in range(6)]
                files = [media.as_buffer().to_pybytes() for media in part.column(2)]
                for m, pieces in zip(files, pcm_of(files), strict=True):
                    payload = payload_of(m)
                    n = peak = size = turns = crc = 0
                    sign = None
                    for p in resampled(pieces, 0):
                        a = np.abs(p.astype(np.int32))
                        n, peak, size = n + len(p), max(peak, int(a.max())), size + int(a.sum())
                        s = p < 0
                        turns += int(np.count_nonzero(s[1:] != s[:-1])) + (sign is not None and bool(s[0]) != sign)
                        sign, crc = bool(s[-1]), zlib.crc32(p.astype("<i2"), crc)
                    feature = f"{read_wave(m)[0]}:{n}:{peak}:{size * 1000 // max(1, n)}:{turns}:{crc}"
                    for column, v in zip(rows, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature), strict=True):
                        column.append(v)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, k) for c, k in zip(rows, kinds, strict=True))], names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return arrow_rows(stored.select("doc_id", "n_bytes", "media"), run, schema)
