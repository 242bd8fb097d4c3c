"""WAV files as rows (S1-S4), and bytes of them for tests and converters."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RATE = 16000
WAV = "rate int, channels int, bits int, n_samples int, samples array<double>, error string"


def parse_wav(raw: bytes) -> tuple[int, np.ndarray]:
    """(rate, samples) of 16-bit mono PCM at 16 kHz; anything else is a ValueError. Other chunks are skipped, padded to even sizes."""
    if raw[:4] != b"RIFF":
        raise ValueError("not a RIFF file")
    if raw[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        body = at + 8
        if name == b"fmt ":
            if body + 16 > len(raw):
                raise ValueError("short fmt chunk")
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", raw, body)
            for what, got, want in (("format", kind, 1), ("channels", channels, 1), ("rate", rate, RATE), ("bits", bits, 16)):
                if got != want:
                    raise ValueError(f"unsupported {what} {got}")
        elif name == b"data":
            if not rate:
                raise ValueError("data before fmt")
            n = size // 2
            if body + 2 * n > len(raw):
                raise ValueError("short data chunk")
            return rate, np.frombuffer(raw, "<i2", n, body) / 32768.0
        at = body + size + (size & 1 if name != b"fmt " else 0)
    raise ValueError("missing data chunk" if rate else "missing fmt chunk")


def wav_bytes(samples: np.ndarray, rate: int = RATE, channels: int = 1, bits: int = 16) -> bytes:
    """A WAV file of samples in -1..1."""
    pcm = np.clip(np.asarray(samples) * 32768, -32768, 32767).astype("<i2").tobytes()
    head = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    return struct.pack("<4sI4s", b"RIFF", 36 + len(pcm), b"WAVE") + head + struct.pack("<4sI", b"data", len(pcm)) + pcm


def decode_wav(content: Column) -> Column:
    """struct(rate, channels, bits, n_samples, samples, error) of a file's bytes; a bad one has its error and null samples."""

    @F.pandas_udf(WAV)
    def run(raw: pd.Series) -> pd.DataFrame:
        rows = []
        for x in raw:
            try:
                rate, s = parse_wav(bytes(x) if x is not None else b"")
                rows.append((rate, 1, 16, len(s), s, None))
            except ValueError as e:
                rows.append((None, None, None, None, None, str(e)))
        out = pd.DataFrame(rows, columns=["rate", "channels", "bits", "n_samples", "samples", "error"])
        return out.astype({c: "Int32" for c in ("rate", "channels", "bits", "n_samples")})

    return run(content)


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """(path, rate, channels, bits, n_samples, samples, error) of the files of a folder or glob."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_replace("path", "^file:", "").alias("path"), decode_wav(F.col("content")).alias("w")).select("path", "w.*")
