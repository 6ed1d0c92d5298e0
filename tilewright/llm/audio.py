"""Telephony audio as media columns: mu-law, A-law and IMA ADPCM to resampled PCM.

Companded samples expand through 256-entry tables made from the formulas of ITU-T G.711; ADPCM blocks, all of one
length, are decoded side by side: numpy steps through the nibbles of all blocks at once.

Texts are stored as media tables: a text's bytes are the samples of a telephony file (mu-law or A-law, or the nibbles of
IMA ADPCM blocks behind a header each), of which of the three its own checksum decides. `decode_column` turns a media table
into one of resampled PCM; `media_digest` writes such a table as well, reads it back and takes the features from it. PCM
takes four to eight bytes for each byte of text, so of a large table this is done in turns, some files of the media table
at a time: a turn's PCM is deleted when its features are written. Hadoop's local file system starts two processes for each
file that is written, and an executor counts twice while it does, so all tables here have few files.

Defined results: a null payload or text counts as empty, an empty one is padded to one unit; equal bytes give equal
results, so do repeated rows; a very long text is one file; a file that can't be read has an error and no samples; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import arrow_pass, cut, drop

#: WAVE format tags, and the samples a second of telephony.
PCM, ALAW, MULAW, IMA_ADPCM = 1, 6, 7, 17
RATE, UNIT = 8000, 64
#: The index changes of IMA ADPCM.
IMA_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int64)
#: Turns in which PCM is made at most, bytes of text of a turn at least, and rows of a file of the media table at most.
TURNS, TURN, FILE = 10, 1 << 24, 1 << 14
#: Files whose sound a worker holds at once, and bytes of a row group of it: what a task holds until it writes or has read them.
SOUNDS, BLOCK = 256, 1 << 22
#: Half-band low-pass that fills in the sample between two others (windowed sinc, scaled to a gain of 1).
_k = np.arange(-3.5, 4)
HALF = (np.sinc(_k) * np.hamming(8)) / (np.sinc(_k) * np.hamming(8)).sum()


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    part, step = (code >> 4) & 7, (code & 0x0F) << 4
    size = np.where(part == 0, step + 8, (step + 0x108) << np.maximum(part - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


#: Step sizes of IMA ADPCM as published.
IMA_STEPS = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449,
    494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442,
    11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
]
_STEP = np.array(IMA_STEPS, dtype=np.int64)
TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}


def wav(codes: bytes, tag: int = MULAW, rate: int = RATE, block: int = 1, bits: int = 8) -> bytes:
    """A one-channel RIFF file around coded samples."""
    extra = struct.pack("<HH", 2, (block - 4) * 2 + 1) if tag == IMA_ADPCM else struct.pack("<H", 0)
    form = struct.pack("<HHIIHH", tag, 1, rate, rate * bits // 8 if tag != IMA_ADPCM else rate * block // ((block - 4) * 2 + 1), block, bits) + extra
    n = len(codes)
    return b"RIFF" + struct.pack("<I", 20 + len(form) + n + n % 2) + b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", n) + codes + b"\0" * (n % 2)


def chunks(file: bytes) -> dict:
    """tag, rate, block, bits, data of a RIFF file; ValueError if it isn't one."""
    if file[:4] != b"RIFF" or file[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, found = 12, {}
    while at + 8 <= len(file):
        name, n = file[at : at + 4], struct.unpack_from("<I", file, at + 4)[0]
        if name == b"fmt ":
            found["tag"], found["channels"], found["rate"], _, found["block"], found["bits"] = struct.unpack_from("<HHIIHH", file, at + 8)
        elif name == b"data":
            found["data"] = file[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    if "tag" not in found or "data" not in found:
        raise ValueError("no format or no data")
    return found


def ima_decode(data: bytes, block: int) -> np.ndarray:
    """All blocks at once: each starts from its own header, so only the nibbles of a block depend on one another."""
    raw = np.frombuffer(data, np.uint8)
    n = len(raw) // block
    if not n:
        return np.zeros(0, np.int16)
    rows = raw[: n * block].reshape(n, block)
    now = rows[:, :2].copy().view("<i2")[:, 0].astype(np.int64)
    index = np.clip(rows[:, 2].astype(np.int64), 0, 88)
    body = rows[:, 4:]
    out = np.empty((n, 1 + 2 * body.shape[1]), np.int16)
    out[:, 0] = now
    for k in range(2 * body.shape[1]):
        nibble = ((body[:, k // 2] >> (4 * (k % 2))) & 15).astype(np.int64)
        step = _STEP[index]
        change = (step >> 3) + (step >> 2) * (nibble & 1) + (step >> 1) * (nibble >> 1 & 1) + step * (nibble >> 2 & 1)
        now = np.clip(now + np.where(nibble & 8, -change, change), -32768, 32767)
        index = np.clip(index + IMA_INDEX[nibble], 0, 88)
        out[:, 1 + k] = now
    return out.reshape(-1)


def ima_encode(samples: np.ndarray, block: int = 256) -> bytes:
    """Blocks of (block - 4) * 2 + 1 samples; the last is filled up with its last sample."""
    per = (block - 4) * 2 + 1
    n = max(1, -(-len(samples) // per))
    x = np.concatenate([samples, np.repeat(samples[-1:] if len(samples) else np.zeros(1, np.int16), n * per - len(samples))]).astype(np.int64).reshape(n, per)
    now, index = x[:, 0].copy(), np.zeros(n, np.int64)
    out = np.zeros((n, block), np.uint8)
    out[:, :2] = now.astype("<i2").view(np.uint8).reshape(n, 2)
    for k in range(per - 1):
        step = _STEP[index]
        gap = x[:, k + 1] - now
        rest = np.abs(gap)
        a = rest >= step
        rest = rest - step * a
        b = rest >= step >> 1
        rest = rest - (step >> 1) * b
        c = rest >= step >> 2
        nibble = (gap < 0) * 8 + a * 4 + b * 2 + c
        change = (step >> 3) + (step >> 2) * c + (step >> 1) * b + step * a
        now = np.clip(now + np.where(gap < 0, -change, change), -32768, 32767)
        index = np.clip(index + IMA_INDEX[nibble], 0, 88)
        out[:, 4 + k // 2] |= (nibble << (4 * (k % 2))).astype(np.uint8)
    return out.tobytes()


def expand(file: bytes) -> tuple[np.ndarray, int]:
    """The PCM samples of a telephony file and their rate."""
    x = chunks(file)
    if x["tag"] in TABLES:
        return TABLES[x["tag"]][np.frombuffer(x["data"], np.uint8)], x["rate"]
    if x["tag"] == IMA_ADPCM:
        return ima_decode(x["data"], x["block"]), x["rate"]
    if x["tag"] == PCM and x["bits"] == 16:
        return np.frombuffer(x["data"][: len(x["data"]) // 2 * 2], "<i2"), x["rate"]
    raise ValueError(f"format {x['tag']} isn't telephony")


def double_rate(samples: np.ndarray) -> np.ndarray:
    """Twice the samples a second: the old ones, and between them what the half-band filter gives."""
    if not len(samples):
        return samples.astype(np.int16)
    padded = np.concatenate([np.repeat(samples[:1], 3), samples, np.repeat(samples[-1:], 4)]).astype(np.float32)
    between = np.convolve(padded, HALF.astype(np.float32), "valid")
    out = np.empty(2 * len(samples), np.int16)
    out[0::2], out[1::2] = samples, np.clip(np.rint(between), -32768, 32767)
    return out


def _expanded(files: list[bytes]) -> list[tuple[np.ndarray, int] | str]:
    """As expand() for each file, or what is wrong with it; the ADPCM blocks of all files are decoded side by side."""
    out: list = []
    blocks: dict[int, list[tuple[int, bytes]]] = {}
    for i, file in enumerate(files):
        try:
            x = chunks(file)
            if x["tag"] == IMA_ADPCM and x["block"] > 4:
                blocks.setdefault(x["block"], []).append((i, x["data"][: len(x["data"]) // x["block"] * x["block"]]))
                out.append((None, x["rate"]))
            else:
                out.append(expand(file))
        except (ValueError, struct.error) as e:
            out.append(str(e))
    for block, some in blocks.items():
        samples = ima_decode(b"".join(d for _, d in some), block).reshape(-1, 2 * (block - 4) + 1)
        at = 0
        for i, d in some:
            n = len(d) // block
            out[i] = samples[at : at + n].reshape(-1), out[i][1]
            at += n
    return out


def _decoded(files: list[bytes | None]) -> dict:
    """samples, rate, pcm, error of each file: 16-bit little-endian PCM at twice its rate, or what is wrong with it."""
    got = _expanded([f or b"" for f in files])
    pcm = [None if isinstance(g, str) else double_rate(g[0]) for g in got]
    return {
        "samples": pa.array([None if p is None else len(p) for p in pcm], pa.int64()), "rate": pa.array([None if isinstance(g, str) else 2 * g[1] for g in got], pa.int32()),
        "pcm": pa.array([None if p is None else p.astype("<i2").tobytes() for p in pcm], pa.binary()), "error": pa.array([g if isinstance(g, str) else None for g in got], pa.string()),
    }


#: The columns of _decoded.
DECODED = "samples long, rate int, pcm binary, error string"


def decode_column(df: DataFrame, key: str, media: str) -> DataFrame:
    """key, samples, rate, pcm, error: each file as 16-bit little-endian PCM at twice its rate; what can't be read has an error."""
    return arrow_pass(df, [key, media], lambda batch: {key: batch[0], **_decoded(batch[1].to_pylist())}, f"{key} {dict(df.dtypes)[key]}, {DECODED}")


def payload(text: str | None) -> tuple[bytes, int]:
    """The UTF-8 bytes, filled up with zeros to a positive multiple of UNIT, and their number before."""
    raw = (text or "").encode("utf-8", "replace")
    return raw + b"\0" * (-len(raw) % UNIT or (0 if raw else UNIT)), len(raw)


def pack(data: bytes) -> bytes:
    """A payload as a telephony file. In ADPCM each UNIT is the nibbles of a block, behind a header that starts at zero."""
    tag = (MULAW, ALAW, IMA_ADPCM)[zlib.crc32(data) % 3]
    if tag != IMA_ADPCM:
        return wav(data, tag)
    rows = np.zeros((len(data) // UNIT, 4 + UNIT), np.uint8)
    rows[:, 4:] = np.frombuffer(data, np.uint8).reshape(-1, UNIT)
    return wav(rows.tobytes(), tag, block=4 + UNIT, bits=4)


def unpack(file: bytes) -> bytes:
    """The payload of a file made by pack()."""
    x = chunks(file)
    if x["tag"] != IMA_ADPCM:
        return x["data"]
    return np.frombuffer(x["data"], np.uint8).reshape(-1, x["block"])[:, 4:].tobytes()


def store_text(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, media: each whole text as the samples of a telephony file; the table is written and read back."""

    def work(batch: pa.RecordBatch) -> dict:
        both = [payload(t) for t in batch[1].to_pylist()]
        return {key: batch[0], "n_bytes": pa.array([n for _, n in both], pa.int64()), "media": pa.array([pack(p) for p, _ in both], pa.binary())}

    return cut(arrow_pass(df, [key, text], work, f"{key} {dict(df.dtypes)[key]}, n_bytes long, media binary"), "media", "zstd", FILE)


def features(pcm: np.ndarray) -> str:
    """Samples, root mean square, mean, peak and sign changes of resampled sound."""
    pcm = pcm.astype(np.int64)
    rms = int(np.sqrt((pcm * pcm).sum() / len(pcm))) if len(pcm) else 0
    return f"n={len(pcm)};rms={rms};mean={int(pcm.sum()) // max(1, len(pcm))};peak={int(np.abs(pcm).max(initial=0))};turns={int(np.count_nonzero(np.diff(pcm >= 0)))}"


def store_pcm(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of stored files (key, n_bytes, media): sizes and hashes, and the decoded and resampled sound as decode_column gives
    it; the table is written and read back."""

    def work(batch: pa.RecordBatch) -> dict:
        size, sha, tail, media, media_sha = [], [], [], [], []
        files = batch[2].to_pylist()
        for file in files:
            back = unpack(file)
            size.append(len(back))
            sha.append(hashlib.sha256(back).hexdigest())
            tail.append(zlib.crc32(back[-UNIT:]))
            media.append(len(file))
            media_sha.append(hashlib.sha256(file).hexdigest())
        i64 = lambda x: pa.array(x, pa.int64())
        return {key: batch[0], "n_bytes": batch[1], "payload_bytes": i64(size), "payload_sha256": sha, "tail_crc32": i64(tail), "media_bytes": i64(media), "media_sha256": media_sha, **_decoded(files)}

    return cut(arrow_pass(df, [key, "n_bytes", "media"], work, f"{key} {dict(df.dtypes)[key]}, {DIGEST}, {DECODED}", SOUNDS), "pcm", "zstd", 0, BLOCK)


#: The columns of media_digest between the key and the feature.
DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"


def turns(df: DataFrame) -> list[DataFrame]:
    """The rows of df (n_bytes and others) in parts of like size, each of some files; in one if they are few or in no files."""
    try:
        file = df.metadataColumn("_metadata").getField("file_path")
        sizes = sorted((r["file"], r["n"] or 0) for r in df.groupBy(file.alias("file")).agg(F.sum("n_bytes").alias("n")).collect())  # a row per file
    except AnalysisException:
        return [df]
    whole = sum(n for _, n in sizes)
    count, parts, done = max(1, min(TURNS, whole // TURN)), {}, 0
    if count == 1:
        return [df]
    for name, n in sizes:
        parts.setdefault((done + n // 2) * count // (whole + 1), []).append(name)
        done += n
    return [df.where(file.isin(names)) for names in parts.values()]  # Spark opens these files only


def media_digest(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of stored files (key, n_bytes, media): sizes, hashes and the feature string, which is that of the stored PCM."""
    names = [c.split()[0] for c in DIGEST.split(", ")]

    def work(batch: pa.RecordBatch) -> dict:
        feature = [features(np.frombuffer(p.as_buffer(), "<i2")) for p in batch[len(names) + 1]]
        return dict(zip([key, *names], batch.columns)) | {"feature": feature}

    def digest(pcm: DataFrame) -> DataFrame:
        return arrow_pass(pcm, [key, *names, "pcm"], work, f"{key} {dict(df.dtypes)[key]}, {DIGEST}, feature string", SOUNDS)

    parts, out = turns(df), []
    if len(parts) == 1:
        return digest(store_pcm(df, key))
    for part in parts:
        pcm = store_pcm(part, key)
        out.append(cut(digest(pcm).coalesce(len(pcm.inputFiles())), "digest"))
        drop(pcm)
    return functools.reduce(DataFrame.union, out)
